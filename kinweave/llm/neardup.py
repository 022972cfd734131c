"""Near-duplicate groups at a stated similarity, for the pipeline's SimHash stage.

Fingerprints within two bits are nearly always similar, but texts of Jaccard
similarity 0.8 differ in about ten of 64 bits, a radius at which the triangle
bounds of a vantage-point tree exclude nothing. So candidate groups come from the
SimHash trees and, besides, from MinHash bands over the same shingles.

Equal word sequences are folded first. Candidate groups of up to ``PART_ROWS``
members are taken whole (groups of the same members once): signatures estimate
every similarity, and a spanning forest of the most similar pairs is verified by
the exact similarity of the shingle sets. The first bands come first: what they
join is one tree for all others. Where a failed pair leaves trees apart, the members
that are likely similar to one of another tree meet in one task, which holds their
shingle sets against each other. So a part of ``n`` gives about ``n`` rows, not pairs.

Larger groups, joined where they share members, go to ``families``, which links
every two similar members exactly and without comparing all pairs.

Candidates are what can be lost: 24 bands of 6 miss a pair of similarity 0.8 once
in 1,500, one of 0.85 once in 85,000; an estimate of 128 values lies ``SLACK``
too low once in 3,000 at 0.8 (3.4 standard errors), in groups up to ``PART_ROWS``.

Null and empty texts are one group; a text of fewer words than a shingle is one
shingle; null ids are the last to represent a group. Of repeated rows one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import batched, forget, ship, small_batches
from kinweave.llm.families import family_links, few_rows, forest
from kinweave.llm.simhash import hamming_links, majority, shingle_hashes, shingle_set
from kinweave.operators.components import connected_components
from kinweave.scratch import checkpoint, materialize, scope

ship(__name__)

SHINGLE, SIMILARITY, BANDS, ROWS, FIRST_BANDS, SALT_ROWS, PART_ROWS = 5, 0.8, 24, 6, 4, 400, 300
#: Signature values of 16 bits, and how far an estimate may lie below the similarity.
SIGNATURE, SLACK = 128, 0.12
#: Row keys (one number each) that are broadcast at most; 16 MB of them.
BROADCAST_ROWS = 1_000_000
#: Links that are joined into groups by one task at most; 16 MB of them.
ONE_TASK_ROWS = 1_000_000


class MinHasher:
    def __init__(self, bands: int, rows: int) -> None:
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1))[:, None]

    def __call__(self, hashes: np.ndarray) -> tuple[list[int], bytes]:
        """A key for each band and the signature; no keys for an empty set."""
        if not len(hashes):
            return [], b""
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        mixed = hashes ^ (hashes >> np.uint64(31))
        for at in range(0, len(mixed), 2048):
            low = np.minimum(low, (self.a * mixed[None, at : at + 2048]).min(1))
        raw = low.reshape(self.bands, self.rows)
        keys = [xxhash.xxh64_intdigest(raw[k].tobytes(), k) - (1 << 63) for k in range(self.bands)]
        return keys, (low[:SIGNATURE] >> np.uint64(24)).astype(np.uint16).tobytes()


def _sketches(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        minhash = MinHasher(bands, rows)
        for b in batches:
            fps, keys, same, signatures = [], [], [], []
            for text in batched(b.column(2)):
                hashes = shingle_hashes(text, shingle)
                fp = majority(hashes)
                fps.append(fp - (1 << 64) if fp >> 63 else fp)
                own, signature = minhash(np.unique(hashes))
                keys.append(own)
                signatures.append(signature)
                same.append(xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8").lower().split())))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["row", "rank", "same", "fp", "bands", "signature"],
            )

    return run


def likeness_of(signatures: list[bytes], least: float) -> tuple[np.ndarray, float]:
    """Equal signature values of every two members, and how many make a pair likely."""
    sig = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(signatures), -1)
    return np.stack([(sig == s).sum(1, dtype=np.int32) for s in sig]), (least - SLACK) * max(1, sig.shape[1])


def likely_pairs(ids: list[int], signatures: list[bytes], failed: list, good: list, trees: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs to verify in a part: a maximum spanning forest by estimated similarity, between members of different ``trees``."""
    place, (likeness, need) = {x: i for i, x in enumerate(ids)}, likeness_of(signatures, least)
    pair = lambda i, j: (min(ids[i], ids[j]), max(ids[i], ids[j]))
    tree, links = np.unique(np.array(trees, dtype=np.int64), return_inverse=True)[1], []
    for i, own in enumerate(good):
        for x in own or ():
            if x in place and tree[i] != tree[place[x]]:
                tree[tree == tree[place[x]]] = tree[i]
    for i, own in enumerate(failed):
        for x in own or ():
            if x in place:
                likeness[i, place[x]] = likeness[place[x], i] = -1
    joined = tree[:, None] == tree[None, :]
    # Prim: each member's best link to what has grown; a member without one starts the next tree.
    likeness[joined] = np.iinfo(np.int32).max
    best, to, left = np.full(len(ids), -1, np.int32), np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
    while left.any():
        i = int(np.argmax(np.where(left, best, -2)))
        left[i] = False
        if best[i] >= need and not joined[i, to[i]]:
            links.append(pair(i, to[i]))
        nearer = likeness[i] > best
        best, to = np.where(nearer, likeness[i], best), np.where(nearer, i, to)
    return links


def _pairs(least: float):
    def run(part: pa.Table) -> pa.Table:
        links = likely_pairs(*(part.column(c).to_pylist() for c in ("id", "signature", "failed", "good", "tree")), least)
        return pa.table({"center": pa.array([x for x, _ in links], pa.int64()), "id": pa.array([x for _, x in links], pa.int64())})

    return run


def _likely_members(least: float):
    """Members of a part that are likely similar to one of another tree."""

    def run(part: pa.Table) -> pa.Table:
        likeness, need = likeness_of(part.column("signature").to_pylist(), least)
        tree = part.column("tree").to_numpy()
        likely = ((likeness >= need) & (tree[:, None] != tree[None, :])).any(1)
        return part.select(["part", "id", "tree"]).filter(pa.array(likely))

    return run


def _inside(shingle: int, least: float):
    """Links that join the trees of a part by the exact similarity of all its members."""
    c = (1 - least) / (1 + least)

    def run(part: pa.Table) -> pa.Table:
        sets = [shingle_set(text, shingle) for text in batched(part.column("text"))]
        ids, tree = part.column("id").to_pylist(), np.unique(part.column("tree").to_numpy(), return_inverse=True)[1]
        links = forest((c - 1) * np.array([len(s) for s in sets]), sets, tree)
        return pa.table({"center": pa.array([ids[i] for i, _ in links], pa.int64()), "id": pa.array([ids[j] for _, j in links], pa.int64())})

    return run


def _verifier(shingle: int, least: float):
    def run(group: pa.Table) -> pa.Table:
        center = group.column("center")[0].as_py()
        ids, texts = group.column("id").to_pylist(), group.column("text")
        own = shingle_set(texts[ids.index(center)].as_py(), shingle)
        good, seen = [], {center}
        for i, text in zip(ids, batched(texts)):
            if i in seen:
                continue
            seen.add(i)
            other = shingle_set(text, shingle)
            both = len(np.intersect1d(own, other, assume_unique=True))
            good.append((i, both >= least * (len(own) + len(other) - both) - 1e-9))
        return pa.table({"center": pa.array([center] * len(good), pa.int64()), "id": pa.array([g[0] for g in good], pa.int64()), "similar": pa.array([g[1] for g in good], pa.bool_())})

    return run


def _verified(edges: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """``center, id, similar`` of distinct candidate pairs; a center with many members is met in parts."""
    many = edges.groupBy("center").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    dealt = edges.join(many, "center").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    members = dealt.select("center", "salt", "id")
    centers = many.select("center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("center").alias("id"))
    both = members.unionAll(centers).join(texts.withColumnRenamed("row", "id"), "id").select("center", "salt", "id", "text")
    return both.groupBy("center", "salt").applyInArrow(_verifier(shingle, least), "center long, id long, similar boolean")


def spark_empty(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def few(wide: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """A semi or anti join of wide rows with one-column ``keys``, broadcast if they are counted to be few."""
    keys = materialize(keys, "keys")
    return wide.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key, how)


def row_key(docs: DataFrame) -> Column:
    """Equal for rows of equal id and text only (but for a chance of 2^-64 a pair)."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))


def _parts(buckets: DataFrame, sizes: DataFrame) -> DataFrame:
    """``part, id``: the members of the buckets in ``sizes``; buckets of the same members once."""
    dealt = buckets.join(sizes.select("bucket"), "bucket", "left_semi")
    sets = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return sets.select("ids").distinct().select(F.xxhash64("ids").alias("part"), F.explode("ids").alias("id"))


def _families(buckets: DataFrame, large: DataFrame) -> DataFrame:
    """``family, id``: members of large buckets; buckets that share a member are one family."""
    keyed = buckets.join(few_rows(large.select("bucket")), "bucket", "left_semi").select(F.xxhash64("bucket").alias("src"), F.col("id").alias("dst"))
    keyed = materialize(keyed, "large-buckets")
    labels = connected_components(keyed, one_task_rows=ONE_TASK_ROWS)
    return labels.join(keyed.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select(F.col("component").alias("family"), F.col("node").alias("id"))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, radius: int = 2, part_rows: int = PART_ROWS) -> DataFrame:
    """``row`` (see ``row_key``), ``rank`` (its id) and ``head``, the row that represents its group."""
    slim = small_batches(docs).select(row_key(docs).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"), F.col("text").cast("string").alias("text"))
    made = materialize(slim.mapInArrow(_sketches(shingle, bands, rows), "row long, rank long, same binary, fp long, bands array<long>, signature binary"), "sketches")
    folded = made.groupBy("same").agg(F.min(F.struct("rank", "row")).alias("head"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    folded = materialize(folded.select("same", F.col("head.row").alias("id"), F.col("head.rank").alias("rank"), "fp", "bands", "signature"), "folded")
    links = connected_components(hamming_links(folded.select("fp").distinct(), radius), one_task_rows=ONE_TASK_ROWS)
    near = folded.join(links, folded.fp == links.node, "left").select(F.struct(F.lit(-1).alias("band"), F.coalesce("component", "fp").alias("key")).alias("bucket"), "id")
    banded = folded.select("id", F.posexplode("bands").alias("band", "key")).select(F.struct("band", "key").alias("bucket"), "id")
    signed, buckets = folded.where("signature <> x''").select("id", "signature"), near.unionAll(banded)
    sizes = materialize(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    small, large = sizes.where(F.col("n") <= part_rows), sizes.where(F.col("n") > part_rows)
    whole = materialize(_parts(buckets, small), "parts")
    families = None if large.isEmpty() else materialize(_families(buckets, large), "families")
    wanted = whole.select("id") if families is None else whole.select("id").unionAll(families.select("id"))
    texts = materialize(few(slim, wanted.distinct().withColumnRenamed("id", "row"), "row", "left_semi").select("row", "text").dropDuplicates(["row"]), "candidate-texts")
    no_links = spark_empty(docs, "center long, id long, similar boolean")
    known = no_links if families is None else family_links(families.select("family", "id"), texts, shingle, similarity).withColumn("similar", F.lit(True))
    tested = materialize(known, "verified")
    for chosen in (_parts(buckets, small.where(F.col("bucket.band") < FIRST_BANDS)), whole):
        tested = _next_round(_apart(chosen, tested).join(signed, "id"), tested, texts, shingle, similarity)
    open_ = _apart(whole, tested).join(signed, "id").groupBy("part").applyInArrow(_likely_members(similarity), "part long, id long, tree long")
    met = materialize(open_, "likely-members").join(texts.withColumnRenamed("row", "id"), "id").select("part", "id", "tree", "text")
    inside = met.groupBy("part").applyInArrow(_inside(shingle, similarity), "center long, id long")
    tested = materialize(inside.distinct().withColumn("similar", F.lit(True)).unionAll(tested), "verified")
    labels = connected_components(tested.where("similar"), "center", "id", one_task_rows=ONE_TASK_ROWS).join(folded.select(F.col("id").alias("node"), "rank"), "node")
    firsts = labels.groupBy("component").agg(F.min(F.struct("rank", F.col("node").alias("id")))["id"].alias("head"))
    heads = checkpoint(labels.join(firsts, "component").select(F.col("node").alias("id"), "head"))
    named = folded.join(heads, "id", "left").select("same", F.coalesce("head", "id").alias("head"))
    return made.select("row", "rank", "same").join(named, "same").select("row", "rank", "head")


def _apart(parts: DataFrame, tested: DataFrame) -> DataFrame:
    """``part, id, tree`` of the parts that verified links don't join already."""
    trees = connected_components(tested.where("similar"), "center", "id", one_task_rows=ONE_TASK_ROWS).select(F.col("node").alias("id"), "component")
    named = parts.join(trees, "id", "left").select("part", "id", F.coalesce("component", "id").alias("tree"))
    apart = named.groupBy("part").agg(F.min("tree").alias("a"), F.max("tree").alias("b")).where("a <> b").select("part")
    return materialize(named.join(apart, "part", "left_semi"), "apart")


def _next_round(parts: DataFrame, tested: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``tested`` and the outcome of the next pairs of all parts; ``tested`` itself if there are none."""
    ways = tested.unionAll(tested.select(F.col("id").alias("center"), F.col("center").alias("id"), "similar"))
    partner = lambda cond: F.collect_list(F.when(cond, F.col("center")))
    known = ways.join(parts.select("id").distinct(), "id", "left_semi").groupBy("id").agg(partner(~F.col("similar")).alias("failed"), partner(F.col("similar")).alias("good"))
    grown = parts.join(known, "id", "left").groupBy("part").applyInArrow(_pairs(similarity), "center long, id long").distinct()
    edges = materialize(grown.join(tested, ["center", "id"], "left_anti"), "likely-pairs")
    if edges.isEmpty():
        return tested
    return materialize(_verified(edges, texts, shingle, similarity).unionAll(tested), "verified")


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (``doc_id, text`` and any others) that represent their group, one row each."""
    with scope(docs.sparkSession) as keep:
        groups = similar_groups(docs, **how)
        rows = keep(materialize(groups.groupBy("row").agg(F.max(F.col("row") == F.col("head")).alias("kept"), F.count("*").alias("times")), "row-groups"))
    name = "_row"
    while name in docs.columns:
        name += "_"
    keyed = docs.withColumn(name, row_key(docs))
    # Rows to leave out: those that lost, and repeated ones, of which one is put back.
    gone = rows.where("not kept or times > 1").select(F.col("row").alias(name))
    again = rows.where("kept and times > 1").select(F.col("row").alias(name))
    out = few(keyed, gone, name, "left_anti")
    if not again.isEmpty():
        out = out.unionByName(few(keyed, again, name, "left_semi").dropDuplicates([name]))
    return out.select(*docs.columns)
