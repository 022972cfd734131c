"""Randomness by key: the same draw wherever and however often a row is computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = float(1 << 52)


def u(seed: int, *keys: Column | str) -> Column:
    """A uniform number in [0, 1) from the md5 of seed and keys (52 bits)."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cols)).cast("binary"))
    return F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("long").cast("double") / F.lit(_SPAN)


def u_sql(seed: int, *keys: str) -> str:
    """The same number in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 13))::bigint / {_SPAN}::double)"


def normal(seed: int, *keys: Column | str) -> Column:
    """A standard normal number by Box-Muller over two keyed uniforms."""
    return F.sqrt(-2 * F.log(1 - u(seed, *keys))) * F.cos(F.lit(6.283185307179586) * u(seed + 1, *keys))


def normal_sql(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u_sql(seed, *keys)})) * cos(6.283185307179586::double * {u_sql(seed + 1, *keys)}))"
