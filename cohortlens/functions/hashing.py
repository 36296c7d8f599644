"""Seeded draws as pure functions of (seed, key).

Every random choice in the library (splits, samples, bootstrap weights,
sign flips) is a function of a seed and a row key, so a task that is
retried after a lost executor draws exactly the same numbers, the result
does not depend on partitioning, and any SQL engine with ``md5`` can
recompute it: ``md5(seed || ':' || key)``, first 13 hex digits read as a
52-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2**52)


def _key(seed, *parts) -> Column:
    cols = [F.lit(str(seed))] + [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def h52(seed, *parts) -> Column:
    """52-bit integer hash of ``seed:part1:part2...`` (bigint, exact)."""
    return F.conv(F.substring(F.md5(_key(seed, *parts)), 1, 13), 16, 10).cast("bigint")


def uniform(seed, *parts) -> Column:
    """Uniform draw in [0, 1) with 52 bits of resolution."""
    return h52(seed, *parts) / F.lit(TWO_52)


def sql_h52(seed_sql: str, *parts_sql: str) -> str:
    """The same hash as an ANSI/DuckDB SQL expression (for oracles)."""
    inner = " || ':' || ".join([f"CAST({seed_sql} AS VARCHAR)"] + [f"CAST({p} AS VARCHAR)" for p in parts_sql])
    return f"CAST(('0x' || substr(md5({inner}), 1, 13)) AS BIGINT)"


def sql_uniform(seed_sql: str, *parts_sql: str) -> str:
    return f"({sql_h52(seed_sql, *parts_sql)} / 4503599627370496.0)"
