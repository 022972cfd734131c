"""Exact similarity links inside large groups of candidates, without comparing all pairs.

Members of a large group (a family) are mostly edits of one text. A sample of
them outlines a common set of shingles ``T``; a member ``x`` is then known by its
difference ``D(x) = S(x) xor T``, which is short. With ``c = (1 - t) / (1 + t)``
two sets have a Jaccard similarity of ``t`` or more if and only if

    slack(x) + slack(y) + 2 |D(x) & D(y)| >= 0,   slack(x) = c |S(x)| - |D(x)|,

whatever ``T`` is: the sample decides how short the differences are, never a result.

1. The member of the most slack is the pivot; each member is verified against it
   (one comparison each). Most of a family is one tree by then.
2. A pair with a member that stays open can only be similar if the differences
   share an element (else the pivot would have been similar as well). Elements
   are ordered by how rare they are in the family, and a pair must share one among
   the first few of either side (prefix filter): few of the member of more
   slack, a quarter of its size of the other. Upper bounds of the overlap, kept
   as one number a row, exclude whole elements by grouped maxima and then rows.
3. What is left under one element is compared exactly in one task if it is small;
   else it is a family of its own, with an outline of its own. Families that are
   still large after ``DEPTH`` outlines are compared in blocks.

No pair is emitted but links of a spanning forest, and no pair is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import batched, ship
from kinweave.llm.simhash import shingle_set
from kinweave.scratch import materialize, scope

ship(__name__)

SAMPLE, SALT_ROWS, GROUP_ROWS, DEPTH, EPS = 64, 128, 300, 5, 1e-6


def _outline(shingle: int):
    """``common``: elements seen twice or more in the sample; ``rare``: how often they differ from the outline, which is negative for its own elements."""

    def run(sample: pa.Table) -> pa.Table:
        sets = [shingle_set(t, shingle) for t in batched(sample.column("text"))]
        element, seen = np.unique(np.concatenate(sets), return_counts=True)
        element, seen = element[seen > 1], seen[seen > 1]
        weight = np.where(2 * seen > len(sets), seen - len(sets) - 1, seen)
        family = sample.column("family")[0].as_py()
        return pa.table({"family": pa.array([family], pa.int64()), "common": pa.array([element.view(np.int64)], pa.list_(pa.int64())), "weight": pa.array([weight], pa.list_(pa.int32()))})

    return run


def _differences(shingle: int, c: float):
    def run(group: pa.Table) -> pa.Table:
        family, ids = group.column("family")[0].as_py(), group.column("id").to_pylist()
        common, weight = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        for i, x in enumerate(ids):
            if x is None:
                common = np.array(group.column("common")[i].as_py(), dtype=np.int64).view(np.uint64)
                weight = np.array(group.column("weight")[i].as_py(), dtype=np.int32)
        core = common[weight < 0]
        out: dict[str, list] = {"id": [], "size": [], "slack": [], "diff": []}
        for i, text in zip(ids, batched(group.column("text"))):
            if i is None:
                continue
            own = shingle_set(text, shingle)
            diff = np.setxor1d(own, core, assume_unique=True)
            at = np.minimum(np.searchsorted(common, diff), max(0, len(common) - 1))
            often = np.where(common[at] == diff, np.abs(weight[at]), 0) if len(common) else np.zeros(len(diff), np.int32)
            # A core element differs where it is missing: as often as the sample lacks it.
            out["id"].append(i)
            out["size"].append(len(own))
            out["slack"].append(c * len(own) - len(diff))
            out["diff"].append(diff[np.lexsort((diff, often))].view(np.int64))
        return pa.table({"family": pa.array([family] * len(out["id"]), pa.int64()), "id": pa.array(out["id"], pa.int64()), "size": pa.array(out["size"], pa.int32()), "slack": pa.array(out["slack"], pa.float64()), "diff": pa.array(out["diff"], pa.list_(pa.int64()))})

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two of the sets share; long ones are met in pieces of about half a million elements."""
    n = len(sets)
    flat = np.concatenate(sets) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    out, pieces = np.zeros((n, n), np.float32), 1 + (len(flat) >> 19)
    piece = flat % flat.dtype.type(pieces)
    for p in range(pieces):
        own, rows = flat[piece == p], of[piece == p]
        element, place, seen = np.unique(own, return_inverse=True, return_counts=True)
        shared = seen[place] > 1
        column, rows = np.unique(place[shared], return_inverse=True)[1], rows[shared]
        for at in range(0, int(column.max(initial=-1)) + 1, 4096):
            mine = (column >= at) & (column < at + 4096)
            block = np.zeros((n, 4096), np.float32)
            block[rows[mine], column[mine] - at] = 1
            out += block @ block.T
    return out


def forest(slack: np.ndarray, diffs: list[np.ndarray], tree: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs of a small group; members of equal ``tree`` are joined already."""
    need = -(slack[:, None] + slack[None, :]) - EPS
    close = np.triu(2 * overlaps(diffs) >= need, 1) & (tree[:, None] != tree[None, :])
    tree, links = tree.copy(), []
    for i, j in zip(*np.nonzero(close)):
        a, b = tree[i], tree[j]
        if a != b:
            links.append((int(i), int(j)))
            tree[tree == b] = a
    return links


def _linker(group: pa.Table) -> pa.Table:
    ids = group.column("id").to_numpy()
    _, first = np.unique(ids, return_index=True)
    diffs = [np.array(d, dtype=np.int64) for d in group.column("diff").take(pa.array(first)).to_pylist()]
    near = group.column("near").to_numpy(zero_copy_only=False)[first]
    links = forest(group.column("slack").to_numpy()[first], diffs, np.where(near, len(first), np.arange(len(first))))
    ids = ids[first]
    return pa.table({"center": pa.array([ids[i] for i, _ in links], pa.int64()), "id": pa.array([ids[j] for _, j in links], pa.int64())})


LINK = "center long, id long"


def _ceil(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(x - EPS).cast("int"))


def _prefixes(tested: DataFrame, c: float, least: float) -> DataFrame:
    """``family, element, id, index, probe, slack, upper, far``: the rows under which an open pair must meet.

    ``reach``: the most slack of an open member of the family; ``top``: the pivot's.
    """
    n, far = F.size("diff"), ~F.col("near")
    bound = F.when(far, F.col("slack")).otherwise(F.least("reach", "slack"))
    index = n - _ceil(-(bound + F.col("slack")) / 2) + 1
    partner = F.least(F.when(far, F.col("top")).otherwise(F.col("reach")), 2 * c / least * F.col("size") + F.col("slack"))
    probe = F.when(far | (F.col("slack") <= F.col("reach") + EPS), n - _ceil(-(F.col("slack") + partner) / 2) + 1).otherwise(0)
    sized = tested.withColumns({"in_": index, "out_": probe}).withColumn("head", F.slice("diff", 1, F.greatest(F.lit(0), F.least(n, F.greatest("in_", "out_")))))
    rows = sized.select("family", "id", "slack", far.alias("far"), n.alias("n"), "in_", "out_", F.posexplode("head").alias("pos", "element"))
    return rows.select("family", "element", "id", (F.col("pos") < F.col("in_")).alias("index"), (F.col("pos") < F.col("out_")).alias("probe"), "slack", (F.col("slack") + 2 * (F.col("n") - F.col("pos"))).alias("upper"), "far")


def _meetings(rows: DataFrame) -> DataFrame:
    """``family, element, id`` of rows that may be one side of a similar pair at its first common element."""
    most = lambda side, c: F.max(F.when(F.col(side), F.col(c)))
    told = rows.groupBy("family", "element").agg(F.count("*").alias("k"), F.max("far").alias("open"), most("index", "slack").alias("is"), most("index", "upper").alias("iu"), most("probe", "slack").alias("ps"), most("probe", "upper").alias("pu"))
    told = told.where((F.col("k") > 1) & F.col("open") & (F.col("iu") + F.col("ps") >= -EPS) & (F.col("is") + F.col("pu") >= -EPS)).drop("k", "open")
    both = rows.join(few_rows(told), ["family", "element"])
    fits = lambda side, s, u: F.col(side) & (F.col("upper") + F.col(s) >= -EPS) & (F.col("slack") + F.col(u) >= -EPS)
    return both.where(fits("probe", "is", "iu") | fits("index", "ps", "pu")).select("family", "element", "id")


def few_rows(keys: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table to join with, written and broadcast if it is counted to have ``most`` rows or fewer."""
    keys = materialize(keys, "keys")
    return F.broadcast(keys) if keys.count() <= most else keys


def _blocks(members: DataFrame, rows: int) -> DataFrame:
    """``part, family, id``: every two members meet in some part of at most ``2 rows`` members or so."""
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / rows).cast("int").alias("b"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("b")).cast("int")
    dealt = members.join(few_rows(sizes), "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return dealt.select(F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "family", "id")


def family_links(members: DataFrame, texts: DataFrame, shingle: int, least: float, group_rows: int = GROUP_ROWS, depth: int = DEPTH) -> DataFrame:
    """``center, id``: verified links that connect every two similar members of a family.

    ``members`` has ``family, id`` (distinct), ``texts`` has ``row, text`` for every id. Ids with
    an empty text are similar to nothing here: equal texts are folded before.
    """
    c, links = (1 - least) / (1 + least), []
    texts = texts.withColumnRenamed("row", "id")
    while True:
        found, wide = _one_outline(materialize(members, "family-members"), texts, shingle, least, c, group_rows, depth <= 0)
        links.append(found)
        if wide is None or wide.isEmpty():
            return reduce(DataFrame.unionAll, links).distinct()
        members, depth = wide, depth - 1


def _one_outline(members: DataFrame, texts: DataFrame, shingle: int, least: float, c: float, group_rows: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Links of the families' members, and families (``family, id``) that are left to look at."""
    none = lambda kind: F.lit(None).cast(kind)
    with scope(members.sparkSession) as keep:
        sizes = few_rows(members.groupBy("family").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")))
        picked = members.groupBy("family", F.pmod(F.xxhash64("id", "family"), F.lit(SAMPLE)).alias("cell")).agg(F.min("id").alias("id"))
        outlines = materialize(picked.join(texts, "id").groupBy("family").applyInArrow(_outline(shingle), "family long, common array<long>, weight array<int>"), "outlines")
        salt = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
        dealt = members.join(sizes, "family").withColumn("salt", salt).drop("salts").join(texts, "id")
        dealt = dealt.select("family", "salt", "id", "text", none("array<long>").alias("common"), none("array<int>").alias("weight"))
        each = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        plans = outlines.join(sizes, "family").select("family", each, none("long").alias("id"), none("string").alias("text"), "common", "weight")
        made = dealt.unionAll(plans).groupBy("family", "salt").applyInArrow(_differences(shingle, c), "family long, id long, size int, slack double, diff array<long>")
        made = materialize(made, "differences")
        pivot = made.groupBy("family").agg(F.max(F.struct("slack", "id")).alias("p")).select("family", F.col("p.id").alias("id"))
        pivot = made.join(few_rows(pivot), ["family", "id"]).select("family", F.col("id").alias("center"), F.col("slack").alias("top"), F.col("diff").alias("own"))
        pivots = materialize(pivot.join(sizes, "family").select("family", "center", "top", "own", each), "pivots")
        salted = made.join(sizes, "family").withColumn("salt", salt)
        both = F.size(F.array_intersect("diff", "own"))
        tested = salted.join(pivots, ["family", "salt"]).select("family", "id", "size", "slack", "diff", "center", "top", (F.col("slack") + F.col("top") + 2 * both >= -EPS).alias("near"))
        tested = materialize(tested, "near-pivot")
        starred = tested.where("near and id <> center").select("center", "id")
        reach = tested.where("not near").groupBy("family").agg(F.max("slack").alias("reach"))
        rows = _prefixes(tested.join(few_rows(reach), "family"), c, least)
        met = materialize(_meetings(rows), "meetings")
        counted = met.groupBy("family", "element").agg(F.count("*").alias("k"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"), F.min("id").alias("low"))
        # The same members under several elements are one group.
        groups = counted.where("k > 1").groupBy("family", "k", "mark", "low").agg(F.min("element").alias("element"))
        groups = materialize(groups.select("family", "element", "k"), "groups")
        inner = met.join(few_rows(groups), ["family", "element"]).select("family", F.xxhash64("family", "element").alias("part"), "id", "k")
        inner = materialize(inner, "grouped")
        parts = inner.where(F.col("k") <= group_rows).select("part", "family", "id")
        wide = inner.where(F.col("k") > group_rows).select(F.col("part").alias("family"), "id")
        if last:
            again = inner.where(F.col("k") > group_rows).select("part", "family", "id")
            blocks = _blocks(again.select(F.col("part").alias("family"), "id"), group_rows // 2)
            back = again.select(F.col("part").alias("fam"), "family", "id")
            parts = parts.unionAll(blocks.withColumnRenamed("family", "fam").join(back, ["fam", "id"]).select("part", "family", "id"))
        slim = tested.select("family", "id", "slack", "diff", "near")
        inside = parts.join(slim, ["family", "id"]).groupBy("part").applyInArrow(_linker, LINK)
        found = keep(materialize(starred.unionAll(inside).distinct(), "family-links"))
        return found, None if last else keep(materialize(wide, "families-again"))
