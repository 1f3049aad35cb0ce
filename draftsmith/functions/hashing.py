"""Deterministic hash keys.

The reference shuffles with a seeded RNG; Spark tasks cannot reproduce that
order, so every "random" choice here is a pure function of ``(seed, id)``:
the first 8 hex digits of an md5, read as an unsigned 32-bit integer.  The
same expression exists in DuckDB (``('0x' || substr(md5(x), 1, 8))::bigint``),
which is what makes the oracles possible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 16 ** 8


def md5_int(expr: Column) -> Column:
    """Unsigned 32-bit integer from the md5 of ``expr`` (as string)."""
    return F.conv(F.substring(F.md5(expr.cast("string")), 1, 8), 16, 10).cast("bigint")


def seeded_key(seed: int | Column, *ids: Column | str) -> Column:
    """``md5_int(seed:id1:id2...)`` — the stable shuffle key."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [F.col(c) if isinstance(c, str) else c for c in ids]
    return md5_int(F.concat_ws(":", *[p.cast("string") for p in parts]))


def seeded_hex(seed: int | Column, *ids: Column | str) -> Column:
    """Full md5 hex string of ``seed:id...``; sorts like ``seeded_key`` on its prefix."""
    parts = [seed if isinstance(seed, Column) else F.lit(str(seed))]
    parts += [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def unit_uniform(seed: int | Column, *ids: Column | str) -> Column:
    """Reproducible uniform value in [0, 1) from ``(seed, ids)``."""
    return seeded_key(seed, *ids) / F.lit(float(HASH_RANGE))


def sql_md5_int(expr: str) -> str:
    """DuckDB twin of :func:`md5_int` for oracle SQL."""
    return f"('0x' || substr(md5(CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def sql_seeded_key(seed: int, *ids: str) -> str:
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({i} AS VARCHAR)" for i in ids])
    return sql_md5_int(f"({inner})")
