"""Summaries of numeric columns with population moments and linear quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EIGHT = ("mean", "std", "min", "q25", "median", "q75", "max", "skew")


def eight_numbers(df: DataFrame, column: str, prefix: str = "", *by: str) -> DataFrame:
    """mean, std, min, q25, median, q75, max and biased skewness; zeros where there are no rows."""
    x = F.col(column).cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    aggs: dict[str, Column] = {"mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "q25": q[0], "median": q[1], "q75": q[2], "max": F.max(x), "skew": F.skewness(x)}
    out = df.groupBy(*by).agg(*[F.coalesce(c, F.lit(0.0)).alias(prefix + k) for k, c in aggs.items()])
    return out


def eight_sql(column: str, prefix: str, source: str, digits: int = 6) -> str:
    """The same in DuckDB, the skewness by moments."""
    x, r = f"({column})::double", lambda e, k: f"round(coalesce({e}, 0), {digits}) AS {prefix}{k}"
    m = f"avg({x})"
    skew = f"CASE WHEN stddev_pop({x}) > 0 THEN (avg({x}*{x}*{x}) - 3*{m}*avg({x}*{x}) + 2*{m}*{m}*{m}) / pow(stddev_pop({x}), 3) ELSE 0 END"
    parts = [r(m, "mean"), r(f"stddev_pop({x})", "std"), r(f"min({x})", "min"), r(f"quantile_cont({x}, 0.25)", "q25"), r(f"quantile_cont({x}, 0.5)", "median"), r(f"quantile_cont({x}, 0.75)", "q75"), r(f"max({x})", "max"), r(skew, "skew")]
    return f"SELECT {', '.join(parts)} FROM {source}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that sums in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
