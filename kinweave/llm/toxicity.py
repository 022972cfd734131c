"""Operator 3, toxicity: a factorization machine over hashed terms.

Terms are the words of the whole text (lower case, outer punctuation off) and
their prefixes of 4 to 6 letters, hashed into 2^20 buckets. From a bounded
sample of labelled rows (``max_train``) two kinds of buckets are kept: those that tell
the classes apart alone, and those of the pairs that tell clearly more together
than either alone, looked for among the ``pair_terms`` most frequent neutral buckets and the
best telling ones. A second-order factorization machine learns their weights and
their pairwise interactions, so that two terms together may say what neither
says alone. Scoring is one Arrow pass over all rows, without a shuffle.

Null and empty texts hold no term and score the learned bias. A null ``doc_id``
is never learned from. Of repeated label rows the highest label of a document
counts; null labels are ignored. With one class or no labels the machine
predicts the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import batched, ddl, forget, ship, small_batches, table
from kinweave.scratch import materialize

ship(__name__)

BUCKETS = 1 << 20
EDGE = ".,;:!?\"'()[]{}*#$%&|<>-_=+/\\@~`"


def terms_of(word: str) -> list[int]:
    """Buckets of one word: itself and its prefixes."""
    w = word.strip(EDGE)
    if not w:
        return []
    names = {"=" + w} | {"^" + w[:k] for k in (4, 5, 6) if len(w) >= k}
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def _term_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches:
        terms = [sorted({t for w in set((x or "").lower().split()) for t in terms_of(w)}) for x in batched(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.int32()))], ["y", "terms"])


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        y = np.asarray(b.column(0).to_numpy(zero_copy_only=False))
        lists = b.column(1)
        lengths = np.diff(lists.offsets.to_numpy())
        values = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        of = np.repeat(y, lengths)
        for k in (0, 1):
            seen[k] += np.bincount(values[of == k], minlength=BUCKETS)
    at = np.flatnonzero(seen.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bucket", "n0", "n1"])


def tells(n0, n1, total0: int, total1: int):
    """How well the counts of a thing in either class tell the classes apart; above 6 it is no chance."""
    ratio = np.log((n1 + 0.5) / (total1 + 1.0)) - np.log((n0 + 0.5) / (total0 + 1.0))
    return np.abs(ratio) * np.sqrt(np.minimum(n0 + n1, 200))


def telling_pairs(rows: list[np.ndarray], y: np.ndarray, terms: np.ndarray, least_tell: float, most: int) -> np.ndarray:
    """Terms of the pairs that tell clearly more together than either term alone, of the ``most`` best pairs.

    ``rows`` hold places of ``terms``; both are bounded, and so is the table of pairs.
    """
    bits = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        bits[i, r] = 1
    both = [bits[y == k].T @ bits[y == k] for k in (0, 1)]
    total = [int((y == k).sum()) for k in (0, 1)]
    score = tells(both[0], both[1], *total)
    own = score.diagonal()
    gain = score - np.maximum(own[:, None], own[None, :])
    i, j = np.nonzero(np.triu((score >= least_tell) & (gain >= least_tell / 2) & (both[0] + both[1] >= 8), 1))
    best = np.lexsort((j, i, -gain[i, j]))[:most]
    return np.unique(terms[np.concatenate((i[best], j[best]))])


@dataclass
class FactorizationMachine:
    """sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the kept buckets of a row."""

    buckets: np.ndarray
    w0: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(rows)), lengths)
        z = self.w0 + np.bincount(of, self.w[flat], minlength=len(rows))
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            z += 0.5 * (np.bincount(of, x, minlength=len(rows)) ** 2 - np.bincount(of, x * x, minlength=len(rows)))
        return z

    def fit(self, rows: list[np.ndarray], y: np.ndarray, factors: int, epochs: int, rate: float, decay: float, seed: int, spread: float = 0.05, v_rate: float = 0.3) -> FactorizationMachine:
        rng, n = np.random.default_rng(seed), len(self.buckets)
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        self.w0, self.w, self.v = float(np.log(share / (1 - share))), np.zeros(n), rng.normal(0, spread, (n, factors))
        if not len(y) or y.min() == y.max():
            self.v[:] = 0
            return self
        g0, gw, gv = 1e-8, np.full(n, 1e-8), np.full((n, factors), 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), 256):
                pick = order[at : at + 256]
                part = [rows[i] for i in pick]
                lengths = np.array([len(r) for r in part])
                flat = np.concatenate(part).astype(np.int64)
                of = np.repeat(np.arange(len(part)), lengths)
                err = (1 / (1 + np.exp(-np.clip(self.logits(part), -35, 35))) - y[pick]) / len(part)
                g = err.sum()
                g0 += g * g
                self.w0 -= rate * g / np.sqrt(g0)
                used = np.unique(flat)
                d = np.bincount(flat, err[of], minlength=n)[used] + decay * self.w[used]
                gw[used] += d * d
                self.w[used] -= rate * d / np.sqrt(gw[used])
                for f in range(factors):
                    x = self.v[flat, f]
                    rest = np.bincount(of, x, minlength=len(part))[of] - x
                    d = np.bincount(flat, err[of] * rest, minlength=n)[used] + decay * self.v[used, f]
                    gv[used, f] += d * d
                    self.v[used, f] -= v_rate * rate * d / np.sqrt(gv[used, f])
        return self


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, keep: int = 4096, min_docs: int = 4, least_tell: float = 6.0, pair_terms: int = 768, pairs: int = 256, factors: int = 4, epochs: int = 12, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> FactorizationMachine:
    """Learn from at most about ``max_train`` of the given labelled rows, chosen by a hash of their id.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, y``. Labels that may
    not be learned from must be left out by the caller.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    share = min(1.0, max_train / max(n, 1))
    rank = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000))
    picked = known.where(rank < round(share * 1_000_000)).limit(2 * max_train)
    # At most 2 * max_train rows of two numbers: broadcast, so that no text is shuffled to learn.
    rows = docs.join(F.broadcast(picked.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select(F.col("y").cast("int").alias("y"), "text")
    sample = materialize(small_batches(rows).mapInArrow(_term_arrays, "y int, terms array<int>"), "toxic-sample")
    counts = sample.mapInArrow(_class_counts, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    classes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n = F.col("n0") + F.col("n1")
    p, q = (F.col("n1") + 0.5) / (classes.get(1, 0) + 1.0), (F.col("n0") + 0.5) / (classes.get(0, 0) + 1.0)
    told = counts.where(n >= min_docs).withColumn("tell", F.abs(F.log(p / q)) * F.sqrt(F.least(n, F.lit(200))))
    telling = [r["bucket"] for r in told.where(F.col("tell") >= least_tell).orderBy(F.desc("tell"), "bucket").limit(keep).collect()]
    # A term that is neutral alone may tell beside another: the most frequent ones are looked at in pairs.
    neutral = [r["bucket"] for r in told.where(F.col("tell") < least_tell).orderBy(F.desc(n), "bucket").limit(pair_terms).collect()]
    known = np.array(sorted({*telling, *neutral}), dtype=np.int64)
    slim = sample.mapInArrow(_only(known), "y int, terms binary").toArrow()
    slim = sorted(zip(slim.column("y").to_pylist(), slim.column("terms").to_pylist()))  # the order of rows must not matter
    y, x = np.array([y for y, _ in slim], dtype=float), [np.frombuffer(t, np.int32) for _, t in slim]
    looked = np.array(sorted({*neutral, *telling[: pair_terms // 3]}), dtype=np.int64)
    paired = telling_pairs(_renumbered(x, known, looked), y, looked, least_tell, pairs)
    fm = FactorizationMachine(np.array(sorted({*telling, *paired.tolist()}), dtype=np.int64))
    return fm.fit(_renumbered(x, known, fm.buckets), y, factors, epochs, rate, decay, seed)


def _renumbered(rows: list[np.ndarray], old: np.ndarray, new: np.ndarray) -> list[np.ndarray]:
    """Places in ``old`` as places in ``new``, a part of it; others go."""
    place = np.full(len(old) + 1, -1, np.int64)
    place[np.searchsorted(old, new)] = np.arange(len(new))
    return [place[r][place[r] >= 0] for r in rows]


def _only(buckets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                t = np.array(t, dtype=np.int64)
                at = np.searchsorted(buckets, t)
                kept = at[(at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == t)] if len(buckets) else at[:0]
                out.append(kept.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["y", "terms"])

    return run


class _Scorer:
    """Scores of texts; words met before are not hashed again."""

    def __init__(self, fm: FactorizationMachine) -> None:
        self.fm, self.place, self.cache = fm, {int(b): i for i, b in enumerate(fm.buckets)}, {}

    def __call__(self, column) -> np.ndarray:
        rows, cache, place = [], self.cache, self.place
        for x in batched(column):
            found: set[int] = set()
            for w in set((x or "").lower().split()):
                got = cache.get(w)
                if got is None:
                    if len(cache) > 150_000:
                        cache.clear()
                    got = cache[w] = tuple(place[t] for t in terms_of(w) if t in place)
                if got:
                    found.update(got)
            rows.append(np.array(sorted(found), dtype=np.int64))
        return 1 / (1 + np.exp(-np.clip(self.fm.logits(rows), -35, 35))) if rows else np.zeros(0)


def _score_batches(fm: FactorizationMachine, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = _Scorer(fm)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], pa.array(scorer(b.column(keys)))], [*b.schema.names[:keys], "score"])

    return run


def _keep_batches(fm: FactorizationMachine, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = _Scorer(fm)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(text_at)) < least))

    return run


def score(docs: DataFrame, fm: FactorizationMachine, keys: list[str]) -> DataFrame:
    """``keys`` and ``score`` of every row of ``docs``; the text goes no further."""
    return small_batches(docs).select(*keys, "text").mapInArrow(_score_batches(fm, len(keys)), ddl(docs.select(*keys)) + ", score double")


def reject(docs: DataFrame, fm: FactorizationMachine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score less than ``least``, with all their columns."""
    return small_batches(docs).mapInArrow(_keep_batches(fm, docs.columns.index("text"), least), docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: a fifth by the crc of the id, and null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(spark: SparkSession, sf_dir: str, docs: DataFrame) -> FactorizationMachine:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("y"))
    return train(docs.select("doc_id", "text"), labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(spark, sf_dir, docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
