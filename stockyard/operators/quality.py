"""Data-quality gates and reports (Q1-Q7) and the column profile."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions.rounding import rnd
from stockyard.operators.selection import exact_quantiles
from stockyard.schemas import DECIMAL_LIMITS, PRIMARY_KEYS


class EmptyInputError(RuntimeError):
    """A required input or dimension holds no rows."""


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Q1/Q2: raise when ``df`` is empty (one cheap job that stops at the first row)."""
    if df.isEmpty():
        raise EmptyInputError(f"{what} has no rows")
    return df


class InvalidRowsError(ValueError):
    """A batch holds NULL keys or values beyond the declared limits."""


def _beyond(c: str, p: int, s: int) -> Column:
    """Q6: a value that decimal(p,s) cannot hold, exactly as a ``try_cast`` to it finds.

    A cast that fails raises and catches an exception for each value, some ten times the cost of one that succeeds.
    The wide cast rounds alike and has room for all but the far values, so the limit is a comparison."""
    x = F.col(c)
    if p > 36:                                          # no wider type with room
        return x.isNotNull() & x.try_cast(T.DecimalType(p, s)).isNull()
    wide = T.DecimalType(38, s)
    limit = F.lit(Decimal(10) ** (p - s)).cast(wide)
    return (F.when(x.isNull(), False).when(F.abs(x.try_cast("double")) >= 10.0 ** (37 - s), True)      # NaN is above all
            .otherwise(F.coalesce(F.abs(x.try_cast(wide)) >= limit, F.lit(True))))


def validity(table: str) -> dict[str, Column]:
    """Q5 + Q6 as aggregates: counts of NULL keys of ``table``, and of values that do not fit its
    declared decimals."""
    checks = {f"{c} is NULL": F.col(c).isNull() for c in PRIMARY_KEYS[table]}
    for c, (p, s) in DECIMAL_LIMITS.get(table, {}).items():
        checks[f"{c} beyond decimal({p},{s})"] = _beyond(c, p, s)
    return {n: F.count_if(c) for n, c in checks.items()}


def require_none(table: str, found: dict) -> None:
    """The gate on counted ``validity``: raise if any is not zero."""
    bad = {n: found[n] for n in validity(table) if found[n]}
    if bad:
        raise InvalidRowsError(f"{table}: {bad}")


def require_valid(df: DataFrame, table: str) -> None:
    """Q5 + Q6 as a gate, in one pass."""
    require_none(table, df.agg(*[c.alias(n) for n, c in validity(table).items()]).first().asDict())


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def pk_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q3: keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("Copies")).where(F.col("Copies") > 1)


def pk_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q3 over several tables: Table, Rows, DuplicateKeys, DuplicateRows."""
    parts = []
    for name, (df, keys) in tables.items():
        per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        parts.append(per_key.agg(
            F.lit(name).alias("Table"),
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("Rows"),
            F.count_if(F.col("_n") > 1).alias("DuplicateKeys"),
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("bigint")
             .alias("DuplicateRows")))
    return _union(parts)


def fk_report(links: list[tuple[str, DataFrame, str, str, DataFrame, str]]) -> DataFrame:
    """Q4: per link (child, column, parent): child rows whose value has no parent row.

    ``links`` items: (child name, child df, child column, parent name, parent df, parent column).
    NULL child values are not orphans (they are Q5's business).
    """
    parts = []
    for cname, child, ccol, pname, parent, pcol in links:
        keys = parent.select(F.col(pcol).alias(ccol)).distinct()
        orphans = child.where(F.col(ccol).isNotNull()).join(keys, ccol, "left_anti")
        parts.append(orphans.agg(F.count("*").alias("Orphans")).select(
            F.lit(cname).alias("ChildTable"), F.lit(ccol).alias("Column"),
            F.lit(pname).alias("ParentTable"), "Orphans"))
    return _union(parts)


def null_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q5: NULL count per key column: Table, Column, NullRows."""
    parts = []
    for name, (df, cols) in tables.items():
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        parts.append(agg.select(
            F.lit(name).alias("Table"),
            F.explode(F.array(*[F.struct(F.lit(c).alias("Column"), F.col(c).alias("NullRows"))
                                for c in cols])).alias("_s")).select("Table", "_s.*"))
    return _union(parts)


def limit_report(table: str, df: DataFrame, varchar: dict[str, int],
                 decimal: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Q6: values that do not fit the declared types.

    Output: Table, Column, Limit, Violations, MaxLength (NULL for decimals).
    """
    decimal = decimal or {}
    aggs, specs = [], []
    for c, n in varchar.items():
        aggs += [F.count_if(F.length(c) > n).alias(f"{c}__v"), F.max(F.length(c)).alias(f"{c}__m")]
        specs.append((c, f"varchar({n})", True))
    for c, (p, s) in decimal.items():
        aggs.append(F.count_if(_beyond(c, p, s)).alias(f"{c}__v"))
        specs.append((c, f"decimal({p},{s})", False))
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("Column"), F.lit(lim).alias("Limit"),
                        F.col(f"{c}__v").alias("Violations"),
                        (F.col(f"{c}__m") if has_len else F.lit(None).cast("int")).alias("MaxLength"))
               for c, lim, has_len in specs]
    return row.select(F.lit(table).alias("Table"), F.explode(F.array(*structs)).alias("_s")) \
              .select("Table", "_s.*")


def load_metrics(df: DataFrame, name: str, symbol_col: str, time_col: str) -> DataFrame:
    """Q7: Table, Rows, Symbols, Days."""
    return df.agg(F.lit(name).alias("Table"), F.count("*").alias("Rows"),
                  F.count_distinct(symbol_col).alias("Symbols"),
                  F.count_distinct(time_col).alias("Days"))


# ---------------------------------------------------------------------------
# A17 profile with exact quantiles
# ---------------------------------------------------------------------------
PROFILE_QUANTILES = (0.25, 0.5, 0.75)


def profile(df: DataFrame, cols: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Per numeric column: type, non-NULL count, NULL count, mean, sample std,
    min, 25/50/75 % (exact, linear interpolation) and max.

    One pass for the plain statistics, then a few that shuffle histograms only (``selection``)."""
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
               T.DecimalType)
    fields = {f.name: f.dataType for f in df.schema.fields}
    cols = cols or [n for n, t in fields.items() if isinstance(t, numeric)]
    name = {f"v{i}": c for i, c in enumerate(cols)}
    # -0.0 and 0.0 are one value
    doubles = df.select(*[(F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(v) for v, c in name.items()])
    stats = {"Rows": lambda v: F.count("*"), "NonNull": F.count, "Mean": F.avg, "Std": F.stddev_samp, "Min": F.min, "Max": F.max}
    row = doubles.agg(*[f(v).alias(f"{v}_{k}") for v in name for k, f in stats.items()]).first()
    quantile = exact_quantiles(doubles, {v: row[f"{v}_NonNull"] for v in name}, PROFILE_QUANTILES)
    double = lambda x: F.lit(x).cast("double")
    out = [F.struct(
        F.lit(c).alias("Column"), F.lit(fields[c].simpleString()).alias("DType"),
        F.lit(row[f"{v}_NonNull"]).cast("long").alias("NonNull"),
        F.lit(row[f"{v}_Rows"] - row[f"{v}_NonNull"]).cast("long").alias("Nulls"),
        *[rnd(double(row[f"{v}_{k}"]), digits).alias(k) for k in ("Mean", "Std")], double(row[f"{v}_Min"]).alias("Min"),
        *[rnd(double(quantile[v, q]), digits).alias(f"P{int(q * 100)}") for q in PROFILE_QUANTILES],
        double(row[f"{v}_Max"]).alias("Max")) for v, c in name.items()]
    return df.sparkSession.range(1).select(F.inline(F.array(*out)))


def column_info(df: DataFrame) -> DataFrame:
    """A17 for every column of any type: Position, Column, DType, Rows, NonNull, Nulls,
    and the least and greatest value as text. One pass over the table."""
    aggs = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0)                          # -0.0 and 0.0 are one value
        aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(i).alias("Position"), F.lit(f.name).alias("Column"),
                      F.lit(f.dataType.simpleString()).alias("DType"), F.col("rows").alias("Rows"),
                      F.col(f"n{i}").alias("NonNull"), (F.col("rows") - F.col(f"n{i}")).alias("Nulls"),
                      F.col(f"lo{i}").alias("Least"), F.col(f"hi{i}").alias("Greatest"))
             for i, f in enumerate(df.schema.fields)]
    return row.select(F.inline(F.array(*parts)))


def head(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an explicit order."""
    return df.orderBy(*order_by).limit(n)
