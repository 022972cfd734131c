"""Bootstrap of PAWN indices in packed blocks: rows are drawn, counted and ranked without a row for each draw.

1. Rows are ranked by a keyed number, in buckets of about ``BUCKET`` rows.
2. A replicate's draws are keyed by its slots alone, so tasks make them in chunks
   (md5 over arrays) and send each bucket its places as one packed value.
3. A bucket counts how often each of its rows is drawn, in all replicates, and sends
   the counts on by ranges of the output.
4. Slices come from the counted inputs. Each range sorts its rows by the output;
   what lies in earlier ranges is added to its running sums, so gaps are exact.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.functions.hashing import u
from kinweave.scratch import materialize, scope

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Rows of a bucket of ranks, counts (rows times replicates) of a range of the output, slots of a chunk of draws.
BUCKET, RANGE, CHUNK, TEN = 50_000, 4_000_000, 1_000_000, 10_000

_K = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_S = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_block(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    """One round of md5 over arrays; a word is a number or an array."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = (7 * i) % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(words[g], int):
            f += np.uint32((_K[i] + words[g]) & 0xFFFFFFFF)
        else:
            f += words[g]
            f += np.uint32(_K[i])
        s = _S[i // 16][i % 4]
        np.left_shift(f, np.uint32(s), out=t)
        np.right_shift(f, np.uint32(32 - s), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d))]


_DIGITS = [(np.arange(TEN, dtype=np.uint32) // np.uint32(10 ** (3 - j))) % np.uint32(10) for j in range(4)]


def draws(prefix: bytes, first: int, last: int, n: int) -> np.ndarray:
    """0-based places ``floor(u * n)`` of the slots ``first`` to ``last``: ``u`` is that of ``functions.hashing``, over ``prefix`` and the slot."""
    out = []
    for q in range(first // TEN, last // TEN + 1):
        if not q:
            v = np.array([int(hashlib.md5(prefix + b"%d" % i).hexdigest()[:13], 16) for i in range(first, min(last, TEN - 1) + 1)], np.uint64)
        else:
            head = prefix + b"%d" % q
            text = head + b"0000\x80"
            text += bytes((56 - len(text)) % 64) + (8 * (len(head) + 4)).to_bytes(8, "little")
            words: list = np.frombuffer(text, "<u4").tolist()
            for j in range(4):
                at = len(head) + j
                words[at // 4] = words[at // 4] + (_DIGITS[j] << np.uint32(8 * (at % 4)))  # digits lie in bytes of their own: no carry
            words = [w if isinstance(w, int) else w.astype(np.uint32) for w in words]
            state = [np.full(TEN, x, np.uint32) for x in _START]
            for block in range(0, len(words), 16):
                state = _md5_block(state, words[block : block + 16])
            v = (state[0].byteswap().astype(np.uint64) << np.uint64(20)) | (state[1].byteswap() >> np.uint32(12)).astype(np.uint64)
            v = v[max(first - q * TEN, 0) : last - q * TEN + 1]
        out.append(np.floor(v.astype(np.float64) / float(1 << 52) * n).astype(np.int64))
    return np.concatenate(out)


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks of slots: each bucket's places, counted from its start."""
    for b in batches:
        for row in b.to_pylist():
            n, starts = row["n"], np.array(row["starts"], np.int64)
            got = draws(row["prefix"].encode(), max(1, row["chunk"] * CHUNK), min(n, (row["chunk"] + 1) * CHUNK - 1), n)
            got = np.sort(got.astype(np.uint32) if n < 1 << 32 else got)
            cut = np.r_[np.searchsorted(got, starts.astype(got.dtype)), len(got)]
            ends = np.r_[starts[1:], n]
            own, packed = [], []
            for i in np.flatnonzero(np.diff(cut)):
                places = got[cut[i] : cut[i + 1]].astype(np.int64) - starts[i]
                own.append(row["buckets"][i])
                packed.append(places.astype(np.uint16 if ends[i] - starts[i] <= 1 << 16 else np.uint32).tobytes())
            k = len(own)
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * k, pa.int64()), pa.array(own, pa.int64()), pa.array([row["rep"]] * k, pa.int32()), pa.array(packed, pa.binary())], ["key", "bucket", "rep", "packed"])


def _counter(replicates: int):
    def run(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        m, v = rows.num_rows, rows.column("u").to_numpy()
        order = np.argsort(v, kind="stable")
        if (np.diff(v[order]) == 0).any():
            names = [s.encode() for s in rows.column("row").to_pylist()]
            order = np.array(sorted(range(m), key=lambda i: (v[i], names[i])))
        pieces: dict[int, list] = {}
        cuts = np.zeros(0)
        for i, (rep, packed) in enumerate(zip(drawn.column("rep").to_pylist(), drawn.column("packed"))):
            if rep < 0:
                cuts = np.array(drawn.column("cuts")[i].as_py(), np.float64)
            else:
                pieces.setdefault(rep, []).append(np.frombuffer(packed.as_buffer(), np.uint16 if m <= 1 << 16 else np.uint32))
        counts = np.zeros((replicates, m), np.uint32)
        for rep, own in pieces.items():
            counts[rep, order] = np.bincount(np.concatenate(own), minlength=m)
        x, y = rows.column("x").to_numpy(), rows.column("y").to_numpy()
        part = np.searchsorted(cuts, y, side="right")
        by = np.argsort(part, kind="stable")
        x, y, part, counts = x[by], y[by], part[by], counts[:, by]
        counts = counts if counts.max(initial=0) > 255 else counts.astype(np.uint8)
        at = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), m]
        spans = list(zip(at[:-1], at[1:]))
        key = rows.column("key")[0].as_py()
        return pa.table({
            "key": pa.array([key] * len(spans), pa.int64()), "range": pa.array([int(part[i]) for i, _ in spans], pa.int32()),
            "y": pa.array([y[i:j].tobytes() for i, j in spans], pa.binary()), "x": pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()),
            "counts": pa.array([np.ascontiguousarray(counts[:, i:j]).tobytes() for i, j in spans], pa.binary()),
        })

    return run


def _unpacked(x: bytes, counts: bytes, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    m = len(x) // 8
    return np.frombuffer(x), np.frombuffer(counts, np.uint8 if len(counts) == replicates * m else np.uint32).reshape(replicates, m)


def _inputs(replicates: int):
    """How often each value of the input is drawn in each replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, xs, cs in zip(*(b.column(i).to_pylist() for i in range(3))):
                x, counts = _unpacked(xs, cs, replicates)
                value, of = np.unique(x, return_inverse=True)
                k = np.stack([np.bincount(of, c, len(value)) for c in counts]).astype(np.int64)
                rep, at = np.nonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rep), key, np.int64)), pa.array(rep.astype(np.int32)), pa.array(value[at]), pa.array(k[rep, at])], ["key", "rep", "x", "k"])

    return run


def _slices(x: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The slice of every row in every replicate: half open, the last closed."""
    value, of = np.unique(x, return_inverse=True)
    return [np.where(value == e[-1], len(e) - 1, np.searchsorted(e[:-1], value, side="right")).astype(np.uint16)[of] for e in edges]


def _in_order(group: pa.Table, replicates: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """What the plan of a range holds, and the range's rows in the order of the output."""
    plan, parts = {}, []
    planned = group.column("edges").is_valid().to_pylist()
    for i, is_plan in enumerate(planned):
        if is_plan:
            plan = {c: np.array(group.column(c)[i].as_py()).reshape(replicates, -1) for c in group.column_names if c in ("edges", "before", "whole")}
        else:
            y, x, counts = (group.column(c)[i].as_py() for c in ("y", "x", "counts"))
            parts.append((np.frombuffer(y), *_unpacked(x, counts, replicates)))
    y, x = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    counts = np.concatenate([p[2] for p in parts], axis=1)
    by = np.argsort(y, kind="stable")
    return plan, y[by], x[by], counts[:, by]


def _totals(replicates: int, slices: int):
    """What each replicate has in each slice of a range, and its least and largest output there."""

    def run(group: pa.Table) -> pa.Table:
        plan, y, x, counts = _in_order(group, replicates)
        totals = np.stack([np.bincount(s, c, slices + 1) for s, c in zip(_slices(x, plan["edges"]), counts)]).astype(np.int64)
        seen = [np.flatnonzero(c) for c in counts]
        ends = [pa.array([[y[s[at]] if len(s) else None for s in seen]], pa.list_(pa.float64())) for at in (0, -1)]
        return pa.table([group.column("key").slice(0, 1), group.column("range").slice(0, 1), pa.array([totals.ravel()], pa.list_(pa.int64())), *ends], ["key", "range", "totals", "low", "high"])

    return run


def _gaps(replicates: int, slices: int, least_slice: int):
    """The largest gap of each slice inside a range; ``before`` and ``whole`` count the earlier ranges and all."""

    def run(group: pa.Table) -> pa.Table:
        plan, y, x, counts = _in_order(group, replicates)
        new = y[1:] != y[:-1]
        value, ends, out = np.r_[0, np.cumsum(new)], np.r_[np.flatnonzero(new), len(y) - 1], []
        for rep, (s, c) in enumerate(zip(_slices(x, plan["edges"]), counts)):
            before, whole = plan["before"][rep], plan["whole"][rep]
            n, upto = whole.sum(), before.sum() + np.cumsum(c, dtype=np.int64)[ends]
            f, f_before = upto / n, np.r_[before.sum(), upto[:-1]] / n
            drawn = np.flatnonzero(c)
            drawn = drawn[np.argsort(s[drawn], kind="stable")]
            cut = np.searchsorted(s[drawn], np.arange(slices + 2))
            for t in range(slices + 1):
                own, m = drawn[cut[t] : cut[t + 1]], whole[t]
                if m < least_slice or not len(own):
                    continue
                of = value[own]
                last = np.r_[np.flatnonzero(of[1:] != of[:-1]), len(of) - 1]
                upto, of = before[t] + np.cumsum(c[own], dtype=np.int64)[last], of[last]
                g, g_before = upto / m, np.r_[before[t], upto[:-1]] / m
                out.append((rep, t, max(np.abs(g - f[of]).max(), np.abs(g_before - f_before[of]).max())))
        key = group.column("key")[0].as_py()
        return pa.table([pa.array([key] * len(out), pa.int64()), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64())))], ["key", "rep", "slice", "ks"])

    return run


def bootstrap_indices(pairs: DataFrame, replicates: int, seed: int, slices: int = 10, statistic: str = "median", least_rows: int = 20, least_slice: int = 10, edge_digits: int | None = None) -> DataFrame:
    """``label, input, output, rep, index``: the PAWN index of every resample that has one (see ``sensitivity.pawn``)."""
    keys = ["label", "input", "output"]
    spark = pairs.sparkSession
    with scope(spark) as keep:
        keyed = pairs.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("key", F.xxhash64(*keys))
        sizes = materialize(keyed.groupBy("key", *keys).agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1")).where((F.col("n") >= least_rows) & (F.col("y0") < F.col("y1"))), "sizes")
        most = sizes.agg(F.max("n"), F.sum(F.floor(F.col("n") / CHUNK) + 1)).first()
        per_range = max(1000, RANGE // replicates)
        ranges = math.ceil((most[0] or 0) / per_range)
        # Ranges of about as many rows each; where they are cut bears on the tasks' sizes alone.
        shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
        cuts = keyed.groupBy("key").agg(F.percentile_approx("y", shares, max(10_000, 50 * ranges)).alias("cuts"), F.count("*").alias("n")).withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(ranges) / F.ceil(F.col("n") / per_range))))
        cuts = cuts.select("key", F.filter("cuts", lambda c, i: (i + 1) % F.col("step") == 0).alias("cuts")) if ranges > 1 else sizes.select("key", F.array().cast("array<double>").alias("cuts"))
        cuts = materialize(cuts, "cuts")
        known = F.broadcast(sizes.select("key", "n", F.ceil(F.col("n") / BUCKET).alias("in_")))  # one row for each label, input and output
        ranked = keyed.join(known, "key").withColumn("u", u(seed, "row")).select("key", F.floor(F.col("u") * F.col("in_")).alias("bucket"), "u", F.col("row").cast("string").alias("row"), "x", "y")
        counted = materialize(ranked.groupBy("key", "bucket").agg(F.count("*").alias("m")), "bucket-sizes")
        start = F.coalesce(F.sum("m").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counted.withColumn("start", start).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("bucket", "start"))).alias("s")).select("key", F.col("s.bucket").alias("buckets"), F.col("s.start").alias("starts"))
        prefix = F.concat_ws("|", F.lit(str(seed + 1)), "input", "output", "label", F.col("rep").cast("string"), F.lit(""))
        chunks = sizes.join(starts, "key").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / CHUNK))))
        chunks = chunks.select("key", "rep", "chunk", "n", "buckets", "starts", prefix.alias("prefix")).repartition(max(1, min(500, replicates * (most[1] or 0))), "key", "rep", "chunk")
        told = counted.join(F.broadcast(cuts), "key").select("key", "bucket", F.lit(-1).alias("rep"), F.lit(None).cast("binary").alias("packed"), "cuts")
        drawn = chunks.mapInArrow(_drawn, "key long, bucket long, rep int, packed binary").withColumn("cuts", F.lit(None).cast("array<double>")).unionAll(told)
        packed = "y binary, x binary, counts binary"
        rows = ranked.groupBy("key", "bucket").cogroup(drawn.groupBy("key", "bucket")).applyInArrow(_counter(replicates), f"key long, range int, {packed}")
        rows = materialize(rows, "counted-rows")
        values = rows.select("key", "x", "counts").mapInArrow(_inputs(replicates), "key long, rep int, x double, k long").groupBy("key", "rep", "x").agg(F.sum("k").alias("k"))
        quantiles = F.percentile("x", F.array(*[F.lit(i / slices) for i in range(slices + 1)]), F.col("k"))
        quantiles = quantiles if edge_digits is None else F.transform(quantiles, lambda q: F.round(q, edge_digits))
        edges = values.groupBy("key", "rep").agg(quantiles.alias("e")).groupBy("key").agg(F.flatten(F.sort_array(F.collect_list(F.struct("rep", "e")))["e"]).alias("edges"))
        null = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
        plans = rows.select("key", "range").distinct().join(F.broadcast(materialize(edges, "edges")), "key")
        plans = materialize(plans.select("key", "range", *null("binary", "y", "x", "counts"), "edges"), "plans")
        both = rows.select("*", *null("array<double>", "edges")).unionAll(plans)
        done = both.groupBy("key", "range").applyInArrow(_totals(replicates, slices), "key long, range int, totals array<long>, low array<double>, high array<double>")
        done = materialize(done, "totals")
        each = done.select("key", "range", F.posexplode("totals").alias("pos", "k"))
        earlier = F.coalesce(F.sum("k").over(Window.partitionBy("key", "pos").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = each.withColumns({"before": earlier, "whole": F.sum("k").over(Window.partitionBy("key", "pos"))})
        sums = each.groupBy("key", "range").agg(F.sort_array(F.collect_list(F.struct("pos", "before", "whole"))).alias("s")).select("key", "range", F.col("s.before").alias("before"), F.col("s.whole").alias("whole"))
        both = rows.select("*", *null("array<double>", "edges"), *null("array<long>", "before", "whole")).unionAll(plans.join(sums, ["key", "range"]))
        gaps = both.groupBy("key", "range").applyInArrow(_gaps(replicates, slices, least_slice), "key long, rep int, slice int, ks double").groupBy("key", "rep", "slice").agg(F.max("ks").alias("ks"))
        span = done.select("key", F.posexplode(F.arrays_zip("low", "high")).alias("rep", "s")).groupBy("key", "rep").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high")).where("low < high").drop("low", "high")
        stat = {"median": F.median("ks"), "max": F.max("ks"), "mean": F.avg("ks")}[statistic]
        index = gaps.groupBy("key", "rep").agg(stat.alias("index")).join(span, ["key", "rep"])
        return keep(materialize(index.join(sizes.select("key", *keys), "key").select(*keys, "rep", "index"), "indices"))

