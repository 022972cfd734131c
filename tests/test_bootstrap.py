"""The packed bootstrap against one row for each draw."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions.hashing import u
from kinweave.functions.ranking import rank_within
from kinweave.operators import bootstrap as B
from kinweave.operators import sensitivity as S

KEYS = ["label", "input", "output"]


def row_by_row(pairs, replicates, seed, **how):
    ranked = rank_within(pairs.withColumn("_x", u(seed, "row")), KEYS, "_x", "row", "i")
    sizes = pairs.groupBy(*KEYS).agg(F.count("*").alias("n"))
    slots = ranked.select(*KEYS, "i").join(sizes, KEYS).select(*KEYS, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    drawn = slots.select(*KEYS, "rep", (F.floor(u(seed + 1, "input", "output", "label", "rep", "i") * F.col("n")) + 1).alias("i"))
    sample = drawn.join(ranked.select(*KEYS, "i", "x", "y"), [*KEYS, "i"]).select(*KEYS, "rep", "x", "y")
    return S.pawn(sample, extra=("rep",), **how).where(~F.isnan("index"))


def made(spark, n=700):
    r = np.random.default_rng(4)
    rows = []
    for label, m in (("é|a", n), ("b", 60), ("few", 12), ("flat", 40), (None, 30)):
        for i in range(m):
            x = float(r.integers(0, 9))
            y = 1.5 if label == "flat" else float(np.round(x * r.random() * 10))
            rows += [(label, "x", "y", x, y, f"r{i}"), (label, "z", "y", float(r.random()), y, f"r{i // 2}" if label == "b" else f"r{i}")]
    return spark.createDataFrame(rows, "label string, input string, output string, x double, y double, row string").where("not (label = 'b' and input = 'z')")


@pytest.mark.parametrize("how", [{}, {"statistic": "max", "slices": 4, "least_slice": 30, "edge_digits": 3}])
def test_same_indices_as_row_by_row(spark, monkeypatch, how):
    for name, small in (("BUCKET", 90), ("RANGE", 500), ("CHUNK", 256)):
        monkeypatch.setattr(B, name, small)
    pairs = made(spark, 2500)
    told = lambda df: {tuple(r[k] for k in [*KEYS, "rep"]): r["index"] for r in df.collect()}
    want, got = told(row_by_row(pairs, 6, 3, **how)), told(B.bootstrap_indices(pairs, 6, 3, **how))
    assert len(want) == (12 if how else 18) and got == pytest.approx(want, abs=1e-12)


def test_draws_are_the_keyed_numbers():
    for prefix in (b"1|x|y|all|0|", b"q" * 52, b"q" * 58, "ü".encode() * 70):
        for first, last, n in ((1, 40, 7), (9_985, 20_010, 123), (999_995, 1_000_005, 1 << 40)):
            plain = [int(int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:13], 16) / float(1 << 52) * n) for i in range(first, last + 1)]
            assert B.draws(prefix, first, last, n).tolist() == plain


def test_no_row_for_each_draw(spark):
    """Rows that tasks exchange follow the rows of the table, not rows times replicates."""
    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    n, replicates = 5000, 40
    pairs = spark.range(n).selectExpr("'all' as label", "'x' as input", "'y' as output", "double(id % 10) as x", "double(id * 7919 % 1000) as y", "string(id) as row")
    before = written()
    assert S.pawn_bootstrap(pairs, replicates).count() == 1
    assert written() - before < n * replicates / 2


def test_nothing_to_draw(spark):
    assert S.pawn_bootstrap(made(spark).where("label = 'few'"), 3).count() == 0
    assert S.pawn_bootstrap(made(spark).limit(0), 3).count() == 0
