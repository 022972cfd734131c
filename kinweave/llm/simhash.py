"""Operator 1, SimHash near-dedup over vantage-point trees.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes
have it set. Rows of one fingerprint are first folded into one. A vantage-point
tree, grown on a bounded sample of fingerprints (``sample``), cuts the Hamming
space into shards: a fingerprint goes to its home shard and, where it lies so
near a boundary that the triangle bound can't exclude a neighbour beyond it, as
a visitor to the shards on the other side as well. Every shard searches its
own, deeper vantage-point tree for the exact pairs within the radius and gives
out a spanning forest of them, never all pairs of a group. Components of these
links, found by distributed star rounds, are the near-duplicate groups.

The sample only shapes the tree; every fingerprint is routed and searched, and
no pair within the radius is lost. Null and empty texts have fingerprint zero
and link like others; a text with fewer words than a shingle is one shingle.
Null ids take part but never name a component; repeated rows stay repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import batched, ddl, ship, small_batches, table
from kinweave.operators.components import connected_components
from kinweave.scratch import checkpoint, materialize

ship(__name__)

SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles, repeats included; fewer words are one shingle."""
    ws = (text or "").encode("utf-8").lower().split()  # bytes.lower() maps A-Z only, bytes.split() cuts at ASCII space
    if not ws:
        return np.zeros(0, np.uint64)
    flat, h = b" ".join(ws), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in ws])
    stops = ends[min(shingle, len(ws)) - 1 :] - 1
    starts = np.concatenate(([0], ends[: len(stops) - 1]))
    return np.array([h(flat[s:e], SEED) for s, e in zip(starts.tolist(), stops.tolist())], dtype=np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits by majority over the hashes of word shingles; zero without words."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(keys: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in batched(b.column(keys))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(keys)), pa.array(fp.view(np.int64))], [*b.schema.names[:keys], "fp"])

    return run


def fingerprints(docs: DataFrame, keys: list[str], shingle: int = 3, text: str = "text") -> DataFrame:
    """``keys`` and the signed 64-bit ``fp`` of every row."""
    rows = small_batches(docs).select(*keys, F.col(text).cast("string"))
    return rows.mapInArrow(_fingerprints(len(keys), shingle), ddl(docs.select(*keys)) + ", fp long")


@dataclass
class Node:
    """Inside: at most ``mu`` bits from ``vantage``. A leaf has a shard number instead of children."""

    vantage: int = 0
    mu: int = 0
    inner: Node | None = None
    outer: Node | None = None
    shard: int = -1


def _distance(fps: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(vantage)).astype(np.int16)


def _split(fps: np.ndarray, rng) -> tuple[int, int] | None:
    """A vantage point and a median radius, of a few tries the one that leaves fewest points near the boundary."""
    best = None
    for v in rng.choice(fps, min(4, len(fps)), replace=False):
        d = _distance(fps, int(v))
        mu = int(np.median(d))
        mu -= mu == d.max()
        inside = (d <= mu).mean()
        if 0 < inside < 1:
            cost = ((d >= mu - 1) & (d <= mu + 2)).mean() / min(inside, 1 - inside)
            best = min(best or (math.inf, 0, 0), (float(cost), int(v), mu))
    return best and best[1:]


def grow(sample: np.ndarray, total: int, leaf: int, depth: int, seed: int = 0) -> tuple[Node, int]:
    """A routing tree whose leaves would hold about ``leaf`` of ``total`` fingerprints each; and the number of leaves."""
    rng, made = np.random.default_rng(seed), [0]

    def node(fps: np.ndarray, left: int) -> Node:
        cut = _split(fps, rng) if left and len(fps) > 1 and len(fps) * total > leaf * max(1, len(sample)) else None
        if cut is None:
            made[0] += 1
            return Node(shard=made[0] - 1)
        d = _distance(fps, cut[0])
        return Node(*cut, node(fps[d <= cut[1]], left - 1), node(fps[d > cut[1]], left - 1))

    return node(np.unique(sample), depth), made[0]


def route(root: Node, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every home and visit.

    Of two neighbours on either side of a boundary, the inner one visits; a
    visitor follows every branch that the triangle bound leaves open.
    """
    out: list[tuple[np.ndarray, int, bool]] = []

    def walk(node: Node, home: np.ndarray, guest: np.ndarray) -> None:
        if not len(home) + len(guest):
            return
        if node.shard >= 0:
            out.extend(((home, node.shard, True), (guest, node.shard, False)))
            return
        d, e = _distance(fps[home], node.vantage), _distance(fps[guest], node.vantage)
        walk(node.inner, home[d <= node.mu], guest[e - radius <= node.mu])
        walk(node.outer, home[d > node.mu], np.concatenate((home[(d <= node.mu) & (d + radius > node.mu)], guest[e + radius > node.mu])))

    walk(root, np.arange(len(fps)), np.zeros(0, np.int64))
    empty = np.zeros(0, np.int64)
    return (
        np.concatenate([o[0] for o in out] or [empty]),
        np.concatenate([np.full(len(o[0]), o[1], np.int32) for o in out] or [empty]),
        np.concatenate([np.full(len(o[0]), o[2], bool) for o in out] or [empty.astype(bool)]),
    )


def _flood(fps: np.ndarray, at: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows ``at``; a found row is never compared again."""
    links: list[tuple[int, int]] = []
    rest, vals = at, fps[at]
    near = np.zeros(len(at), bool)
    step = max(1, (1 << 21) // max(1, len(at)))
    for s in range(0, len(at), step):
        hit = np.bitwise_count(vals[s : s + step, None] ^ vals[None, :]) <= radius
        near[s : s + step] = hit.sum(1) > 1
    rest, vals = at[near], vals[near]
    while len(rest):
        root, frontier = rest[0], [vals[0]]
        rest, vals = rest[1:], vals[1:]
        while frontier and len(rest):
            hit = np.bitwise_count(vals ^ frontier.pop()) <= radius
            if hit.any():
                links.extend((int(x), int(root)) for x in rest[hit])
                frontier.extend(vals[hit])
                rest, vals = rest[~hit], vals[~hit]
    return links


def links_within(fps: np.ndarray, home: np.ndarray, radius: int, leaf: int = 1024) -> list[tuple[int, int]]:
    """Links among homes and between homes and guests of one shard, through a local vantage-point tree."""
    rng, links = np.random.default_rng(1), []

    def walk(own: np.ndarray, guest: np.ndarray, left: int) -> None:
        if not len(own):
            return
        both = np.concatenate((own, guest))
        cut = _split(fps[own], rng) if left and len(both) > leaf and len(own) > 64 else None
        if cut is not None:
            d, e = _distance(fps[own], cut[0]), _distance(fps[guest], cut[0])
            inner, outer = d <= cut[1], d > cut[1]
            to_inner, to_outer = guest[e - radius <= cut[1]], np.concatenate((own[inner & (d + radius > cut[1])], guest[e + radius > cut[1]]))
            if max(inner.sum() + len(to_inner), outer.sum() + len(to_outer)) < 0.97 * len(both):
                walk(own[inner], to_inner, left - 1)
                walk(own[outer], to_outer, left - 1)
                return
        links.extend(_flood(fps, both, radius))

    walk(np.flatnonzero(home), np.flatnonzero(~home), 24)
    return links


def _router(tree: Node, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, shard, home = route(tree, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(fps[row].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    return run


def _searcher(radius: int):
    def run(shard: pa.Table) -> pa.Table:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        home = shard.column("home").to_numpy()
        signed = fps.view(np.int64)
        links = np.array(links_within(fps, home, radius), dtype=np.int64).reshape(-1, 2)
        return pa.table({"src": signed[links[:, 0]], "dst": signed[links[:, 1]]})

    return run


def hamming_links(distinct: DataFrame, radius: int = 2, shard_rows: int = 8192, sample: int = 50_000, most_shards: int = 1 << 16) -> DataFrame:
    """``src, dst``: links that connect every two fingerprints (column ``fp``, distinct) within ``radius`` bits.

    Shards hold about ``shard_rows`` homes each; the tree grows with the table up to ``most_shards``, and so
    does the sample that shapes it: 32 fingerprints a shard, 16 MB at most.
    """
    total = distinct.count()
    shards = min(most_shards, max(1, total // shard_rows))
    depth, sample = max(10, math.ceil(math.log2(shards)) + 2), max(sample, 32 * shards)
    part = F.pmod(F.xxhash64(F.lit(3), "fp"), F.lit(1 << 20)) < int(min(1.0, sample / max(total, 1)) * (1 << 20))
    seen = np.array([r["fp"] for r in distinct.where(part).select("fp").limit(2 * sample).collect()], dtype=np.int64).view(np.uint64)
    tree, _ = grow(seen, total, max(shard_rows, total // most_shards), depth)
    sent = distinct.select("fp").mapInArrow(_router(tree, radius), "shard int, fp long, home boolean")
    return sent.groupBy("shard").applyInArrow(_searcher(radius), "src long, dst long")


def near_duplicates(fps: DataFrame, radius: int = 2, doc_id: str = "doc_id") -> DataFrame:
    """``component_id`` (the smallest id reachable) beside every row of ``fps`` (``fp`` and ``doc_id``)."""
    folded = checkpoint(fps.groupBy("fp").agg(F.min(doc_id).alias("low")))
    labels = connected_components(hamming_links(folded, radius)).withColumnRenamed("node", "fp")
    linked = labels.join(folded, "fp")
    lows = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    joined = checkpoint(linked.join(lows, "component").select("fp", "component_id"))
    named = folded.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return fps.join(named, "fp")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fps = materialize(fingerprints(docs, ["doc_id"], 3), "fingerprints")
    return near_duplicates(fps).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
