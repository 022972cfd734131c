"""Operator 6, benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets (powers of two).
An item's sketch is its ``k`` smallest shingle hashes, where ``k`` is one more
than the shingles a document may miss at the asked containment. A document that
contains enough of the item has at least one of any ``k`` of its shingles, so
probing whole documents with the sketches of each size class finds all of them,
however long the document is; classes whose items have more shingles than the
document could supply are not probed. Only candidates, items of which a sketch
hash was met, are verified by the exact share of their shingles that the document has.

Words are lower-cased runs of letters and digits after outer and inner
punctuation is taken out. Items with fewer words than a shingle count as one
shingle of their length; null, empty or wordless items match nothing, null and
empty documents contain nothing. Repeated rows give repeated results. Items
are taken in blocks of bounded size, each a broadcast of its own; documents are
read once for all of them, and a worker holds one block at a time.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import batched, ddl, forget, ship, small_batches, table

ship(__name__)

SHINGLE, CONTAINMENT, BLOCK_ITEMS, CACHE_WORDS = 5, 0.8, 20_000, 200_000
_DROP = re.compile(r"[\W_]+")


def plain_words(text: str | None) -> list[str]:
    return [w for w in (_DROP.sub("", x) for x in (text or "").lower().split()) if w]


def shingles(ws: list, size: int) -> set[tuple]:
    """Runs of ``size`` words; a shorter text is one shingle."""
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def _hashes(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``size`` known words (numbers above 0)."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known, h = np.ones(n, bool), np.zeros(n, np.uint64)
    for j in range(size):
        known &= ids[j : n + j] > 0
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j].astype(np.uint64)
    at = np.flatnonzero(known)
    h = h[at]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return at, h ^ (h >> np.uint64(29))


class ContainmentIndex:
    """Sketches by size class, and exact shingle sets, of one block of items."""

    def __init__(self, items: list[tuple[int, str]], size: int, least: float) -> None:
        self.ids: dict[str, int] = {}
        self.names: list = []
        self.grams: list[set[tuple]] = []
        self.least, self.verified = least, 0
        made: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for name, text in items:
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in plain_words(text)], dtype=np.int64)
            own = shingles(ids.tolist(), size)
            if not own:
                continue
            length = len(next(iter(own)))
            may_miss = math.floor((1 - least) * len(own) + 1e-9)
            values = np.unique(_hashes(ids, length)[1])[: may_miss + 1]
            made[length, (len(own) - 1).bit_length()].extend((v, len(self.names)) for v in values.tolist())
            self.names.append(name)
            self.grams.append(own)
        #: (shingle length, size class): sketch hashes in order, and the item of each.
        self.sketches = {k: (np.array([v for v, _ in sorted(x)], dtype=np.uint64), np.array([i for _, i in sorted(x)], dtype=np.int64)) for k, x in made.items()}

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items of which the word numbers (0 is an unknown word) have a sketch hash."""
        met: set[int] = set()
        for length in {k[0] for k in self.sketches}:
            values = np.unique(_hashes(ids, length)[1])
            for (own, power), (table, items) in self.sketches.items():
                fewest = (1 << power >> 1) + 1 if power else 1
                if own == length and len(values) >= self.least * fewest - 1e-9:
                    lo, hi = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
                    for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                        met.update(items[x:y].tolist())
        return sorted(met)

    def find(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, its shingles, those found) of every item that the word numbers contain."""
        out, have = [], {}
        for at in self.candidates(ids):
            own = self.grams[at]
            length = len(next(iter(own)))
            if length not in have:
                places = _hashes(ids, length)[0]
                have[length] = {tuple(ids[i : i + length].tolist()) for i in places.tolist()}
            n = len(own & have[length])
            self.verified += 1
            if n >= self.least * len(own) - 1e-9:
                out.append((at, len(own), n))
        return out


class _WordNumbers:
    """Numbers of a text's words in an index; 0 is an unknown word."""

    def __init__(self, index: ContainmentIndex) -> None:
        self.ids, self.cache = index.ids, {}

    def __call__(self, text: str | None) -> np.ndarray:
        cache, out = self.cache, []
        for w in (text or "").lower().split():
            n = cache.get(w)
            if n is None:
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                p = _DROP.sub("", w)
                n = cache[w] = self.ids.get(p, 0) if p else -1
            out.append(n)
        ids = np.array(out, dtype=np.int64)
        return ids[ids >= 0]


class _Blocks:
    """The broadcast indexes of all blocks as a worker sees them: one is held at a time."""

    def __init__(self, sent: list) -> None:
        self.sent, self.at, self.held = sent, -1, None

    def __iter__(self):
        for k, block in enumerate(self.sent):
            if k != self.at:
                self.held = None
                index = pickle.loads(block.value)
                self.at, self.held = k, (index, _WordNumbers(index))
            yield self.held


def _prober(sent: list, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        blocks = _Blocks(sent)
        for b in batches:
            rows, hits = [], []
            for index, words in blocks:
                for i, text in enumerate(batched(b.column(keys))):
                    for at, size, n in index.find(words(text)):
                        rows.append(i)
                        hits.append((index.names[at], size, n))
            pick = pa.array(rows, pa.int64())
            cols = [b.column(i).take(pick) for i in range(keys)]
            cols += [pa.array([h[k] for h in hits], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:keys], "item_id", "item_shingles", "shared_shingles"])

    return run


def _blocks(items: DataFrame, shingle: int, least: float, block_items: int) -> list:
    """Broadcast indexes over all items, each of about ``block_items``; the driver builds and holds one at a time."""
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks, sent = max(1, -(-items.count() // block_items)), []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = ContainmentIndex([(r["item_id"], r["text"]) for r in block.collect()], shingle, least)
        sent.append(items.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index)))
    return sent


def contained_items(docs: DataFrame, items: DataFrame, keys: list[str], shingle: int = SHINGLE, least: float = CONTAINMENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row for each document and item that it contains: ``keys``, item, shingle counts, ``containment``.

    ``docs`` has ``text``; ``items`` has ``item_id, text``.
    """
    rows = small_batches(docs).select(*keys, F.col("text").cast("string"))
    schema = ddl(docs.select(*keys)) + ", item_id long, item_shingles long, shared_shingles long"
    found = rows.mapInArrow(_prober(_blocks(items, shingle, least, block_items), len(keys)), schema)
    return found.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def _rejector(sent: list, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        blocks = _Blocks(sent)
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for index, words in blocks:
                for i, text in enumerate(batched(b.column(text_at))):
                    if clean[i]:
                        clean[i] = not index.find(words(text))
            yield b.filter(pa.array(clean))

    return run


def without_items(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, least: float = CONTAINMENT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    sent = _blocks(items, shingle, least, block_items)
    return small_batches(docs).mapInArrow(_rejector(sent, docs.columns.index("text")), docs.schema)
