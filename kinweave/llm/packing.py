"""Operator 8, best-fit packing by vectors: tokens, document count and attention cost.

Documents are tokenized whole; only those longer than a sequence are cut, into
full pieces and one rest. Pieces are placed longest first. A bin has three
residual capacities: tokens, documents and attention cost (the sum of squared
piece lengths). Among the bins that hold a piece under every constraint the one
with the largest weighted dot product of demand and residual (``rule='dot'``)
or the smallest residual norm after placing (``rule='norm'``, the default) is
taken. Full pieces are sequences of their own.

The pieces (numbers only, no tokens) are written once and dealt evenly into
groups of bounded size, so hot keys don't matter and a lost task is redone from
the written table; each group is packed by itself and wastes at most a part of
its last bins. Null text counts as empty; an empty text is the end token
alone; repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import batched, ddl, per_process, ship, small_batches, table
from kinweave.scratch import materialize

ship(__name__)

SEQUENCE, END_ID, GROUP_PIECES, CACHE_WORDS, CHUNK_CHARS = 2048, 0, 8192, 400_000, 6_000_000
#: Texts without these are tokenized word by word: for all other characters the tokenizer's
#: normal form is lower case, and no token crosses white space.
_SPECIAL = re.compile(r"[^\t-\r\x20-\x7e¡-ɏ]|<\|")

#: How the packing query's tokenizer cuts lower-case text into parts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merger(model: dict, suffix: str, mark: str):
    """The vocabulary as a rank table for tiktoken, which merges words some times faster; None if it isn't one.

    A byte that no plain text has marks the end of a part, in place of the
    suffix; ids must follow the order of the merges.
    """
    import tiktoken

    vocab, letters, ranks = model["vocab"], _bytes_of_letters(), {}
    first = len(vocab) - len(model["merges"])
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != suffix or any(vocab.get("".join(m)) != first + k for k, m in enumerate(pairs)):
        return None
    for token, i in vocab.items():
        core = token.removesuffix(suffix) if token != suffix else token
        if not all(c in letters for c in core):
            return None
        ranks[bytes(letters[c] for c in core) + mark.encode() * (core != token)] = i
    return tiktoken.Encoding("words", pat_str=f"[^{mark}]+{mark}", mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(vocab) else None


class WordCachedTokenizer:
    """Token ids of whole texts; a word is encoded once for many texts.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
    Word by word only for tokenizers that lower-case, whose tokens never cross
    white space and whose last token of each split part ends in ``suffix``.
    """

    MARK = "\x00"

    def __init__(self, path: str, split: str | None, suffix: str = "</w>") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        model = spec["model"] | {"vocab": {t: i for t, i in spec["model"]["vocab"].items() if t not in special}} if split else {}
        self.whole, self.cache = Tokenizer.from_file(path), {}
        self.merger = _merger(model, suffix, self.MARK) if split else None
        if self.merger:
            self.parts = regex.compile(split)
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def _learn(self, words: list[str]) -> None:
        """Encode words as one text and cut its ids where each word's parts end."""
        parts = [[w] if w.isalpha() else self.parts.findall(w) for w in words]
        text = self.MARK.join(chain.from_iterable(parts)) + self.MARK
        ids = np.array(self.merger.encode_ordinary(text), dtype="<u4") if words else np.zeros(0, "<u4")
        ends = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))
        stops = ends[np.cumsum([len(p) for p in parts], dtype=np.int64)] * 4
        raw, start = ids.tobytes(), 0
        for w, stop in zip(words, stops.tolist()):
            self.cache[w] = raw[start:stop]
            start = stop

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; together the texts should be of bounded size."""
        plain = [t.lower().split() if self.merger and not _SPECIAL.search(t) else None for t in texts]
        met = set(chain.from_iterable(ws for ws in plain if ws))
        if len(self.cache) + len(met) > CACHE_WORDS:
            self.cache = {w: x for w in met if (x := self.cache.get(w)) is not None}
        self._learn([w for w in met if w not in self.cache])
        for text, ws in zip(texts, plain):
            yield np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4") if ws is None else np.frombuffer(b"".join(map(self.cache.__getitem__, ws)), "<u4")


def _chunks(column, chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for text in batched(column):
        held.append(text or "")
        size += len(held[-1])
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pieces_of(path: str, keys: int, sequence: int, end_id: int, split: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = per_process(f"tokenizer {path} {split}", lambda: WordCachedTokenizer(path, split))
        for b in batches:
            row, piece, start, length, crc = (array("q") for _ in range(5))
            for i, found in enumerate(ids for texts in _chunks(b.column(keys)) for ids in tok.ids(texts)):
                ids = np.append(found, np.array([end_id], "<u4"))
                for k, at in enumerate(range(0, len(ids), sequence)):
                    part = ids[at : at + sequence]
                    for a, x in ((row, i), (piece, k), (start, at), (length, len(part)), (crc, zlib.crc32(part))):
                        a.append(x)
            as_array = lambda a: pa.array(np.frombuffer(a, np.int64) if len(a) else np.zeros(0, np.int64))
            at = as_array(row)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(at) for i in range(keys)), as_array(piece).cast(pa.int32()), as_array(start), as_array(length), as_array(crc)],
                [*b.schema.names[:keys], "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, keys: list[str], tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, split: str | None = SPLIT) -> DataFrame:
    """``keys, piece, start, length, ids_crc32`` of every piece of every document's ids and end token.

    ``split`` is the pattern by which the tokenizer cuts a word into parts; None
    encodes every text as a whole, whatever the tokenizer.
    """
    rows = small_batches(docs).select(*keys, F.col("text").cast("string"))
    schema = ddl(docs.select(*keys)) + ", piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(_pieces_of(tokenizer, len(keys), sequence, end_id, split), schema)


def pack(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.1, 0.3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. ``capacity`` is (tokens, documents, attention cost).

    Bins with equal residual vectors are alike, so they are kept as counted
    states; a piece then looks at the distinct states only.
    """
    cap = np.array(capacity, dtype=np.float64)
    weight = np.array(weights) / cap
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.zeros((64, 3))  # residual of every open bin
    of = np.zeros(64, np.int64)
    opened = n = 0
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = float(lengths[i])
        need = np.array([size, 1.0, size * size])
        if (need > cap).any():
            raise ValueError(f"a piece of {size:.0f} tokens is over a bin's capacity {capacity}")
        left = room[:n] - need
        fits = np.flatnonzero((left >= 0).all(1))
        if len(fits):
            score = ((room[fits] * weight) @ (need * weight)) if rule == "dot" else -np.square(left[fits] * weight).sum(1)
            j = int(fits[np.argmax(score)])
        else:
            if n == len(room):
                room, of = np.concatenate((room, np.zeros_like(room))), np.concatenate((of, np.zeros_like(of)))
            j, n = n, n + 1
            room[j], of[j] = cap, opened
            opened += 1
        bins[i], offsets[i] = of[j], cap[0] - room[j, 0]
        room[j] -= need
        if room[j, 0] < smallest or room[j, 1] < 1:  # full: nothing fits any more
            n -= 1
            room[j], of[j] = room[n], of[n]
    return bins, offsets


def _packer(keys: int, sequence: int, documents: int, attention: float, weights, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held = TaskContext.get().partitionId() << 40, [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        lengths = t.column("length").to_numpy()
        full = lengths == sequence
        bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        rest = np.flatnonzero(~full)
        bins[rest], offsets[rest] = pack(lengths[rest], (sequence, documents, attention), weights, rule)
        first = int(bins[rest].max()) + 1 if len(rest) else 0
        bins[full] = first + np.arange(full.sum())
        yield from t.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offsets)).to_batches()

    return run


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, documents: int | None = None, attention: float | None = None, weights=(1.0, 0.1, 0.3), rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``sequence_id, offset`` beside the columns of ``pieces``.

    By default a sequence may hold as many documents as tokens, and attend over
    all its tokens; both can be set lower.
    """
    written = materialize(pieces, "pieces")
    groups = max(1, -(-written.count() // group_pieces))
    run = _packer(0, sequence, documents or sequence, attention or float(sequence) ** 2, weights, rule)
    return written.repartition(groups).mapInArrow(run, ddl(written) + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_pieces(token_pieces(table(spark, sf_dir, "documents"), ["doc_id"], default_tokenizer()))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
