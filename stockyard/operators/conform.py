"""Projection and reshaping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by mapping; names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def drop_columns(df: DataFrame, cols: list[str], strict: bool = False) -> DataFrame:
    """Drop listed columns. ``strict`` raises when one is absent."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def conform(df: DataFrame, target: list[str],
            types: dict[str, T.DataType] | None = None,
            default_type: T.DataType = T.DoubleType()) -> DataFrame:
    """Keep the target columns in order, add absent ones as typed NULL."""
    types = types or {}
    cols = []
    for name in target:
        typ = types.get(name, default_type)
        if name in df.columns:
            cols.append(F.col(f"`{name}`").cast(typ).alias(name))
        else:
            cols.append(F.lit(None).cast(typ).alias(name))
    return df.select(*cols)


def fill_sentinel(df: DataFrame, value: float, subset: list[str] | None = None) -> DataFrame:
    """NULL -> sentinel in every double column (or in ``subset``)."""
    if subset is None:
        subset = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.na.fill(value, subset=subset) if subset else df


def unpivot(df: DataFrame, ids: list[str], var: str, val: str,
            values: list[str] | None = None, value_type: T.DataType = T.DoubleType()) -> DataFrame:
    """Wide -> long; every non-id column becomes (var, val). NULLs kept."""
    values = values if values is not None else [c for c in df.columns if c not in ids]
    casted = df.select(*[F.col(f"`{c}`") for c in ids],
                       *[F.col(f"`{c}`").cast(value_type).alias(c) for c in values])
    return casted.unpivot([F.col(f"`{c}`") for c in ids],
                          [F.col(f"`{c}`") for c in values], var, val)


def pivot_first(df: DataFrame, index: list[str], column: str, value: str,
                names: list[str]) -> DataFrame:
    """P10 + A19: long -> wide with the first non-NULL value per cell.

    ``names`` is the explicit column list: no extra job to discover it, and
    the width is bounded by the caller's vocabulary.
    """
    return df.groupBy(*index).pivot(column, names).agg(F.first(value, ignorenulls=True))


def dedupe_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Keep the first row per key in an explicit order (dropDuplicates keeps any)."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") == 1).drop("_rn"))
