"""Numeric rounding with one rule for every engine.

``ROUND(double, 2)`` disagrees between engines on ``.xx5`` ties (some round
the shortest decimal text, some the binary value). Going through
``decimal(28,8)`` first pins the value to 8 decimals, after which
``ROUND`` is exact HALF_UP decimal arithmetic everywhere. The result is cast
back to double so schemas stay simple.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIVOT_DECIMAL = "decimal(28,8)"


def rnd(c: Column | str, digits: int) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast(_PIVOT_DECIMAL), digits).cast("double")


def r2(c: Column | str) -> Column:
    return rnd(c, 2)


def r4(c: Column | str) -> Column:
    return rnd(c, 4)


def sql_rnd(expr: str, digits: int) -> str:
    """The same rule as SQL text (used by the DuckDB twins)."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"
