"""Dimension builders (L1-L3) and surrogate-key allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions.dates import date_parts
from stockyard.functions.rounding import rnd
from stockyard.functions.names import (
    COMPANY_RENAME, DEFINITION_DROP, DEFINITION_RENAME, RATIO_NAMES,
    canonical_ratio_name, strip_trailing_paren,
)
from stockyard.operators.conform import dedupe_first, rename_columns

# Leading hexadecimal digits of the natural key's hash that make a numbering bucket.
BUCKET_DIGITS = 4


def build_dim_time(quotes: DataFrame, time_col: str = "time",
                   fmt: str = "yyyy-MM-dd") -> DataFrame:
    """L1: one row per distinct quote date with its calendar parts."""
    d = quotes.select(F.try_to_timestamp(F.col(time_col), F.lit(fmt)).cast("date").alias("Date")).where(F.col("Date").isNotNull())
    return d.distinct().select(*date_parts("Date"))


def build_dim_company(company: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """L2: renamed company feed with StockRating rounded to 2, keys from L6."""
    c = rename_columns(company, COMPANY_RENAME)
    c = c.withColumn("StockRating", rnd(F.col("StockRating").cast("double"), 2)
                     .cast("decimal(5,2)"))
    cols = ["StockSymbol", "CompanyName", "ShortName", "Industry", "CompanyType", "StockRating"]
    keyed = allocate_keys(c.select(*cols), existing, natural="StockSymbol", key="StockKey")
    return keyed.select("StockKey", *cols)


def build_dim_ratio(definitions: DataFrame, normalise: bool = True,
                    order_col: str = "_seq") -> DataFrame:
    """L3: tracked ratios only, first row per name kept, names cleaned, dense keys.

    ``normalise`` applies the same canonical form the fact side uses, so a
    name whose blanks differ from the fact column still resolves (D8). With
    ``normalise=False`` only the trailing '(...)' is stripped, as in the feed's
    original load, and such a ratio stays unresolved.
    """
    d = definitions.where(F.col("name").isin(RATIO_NAMES)).drop(*DEFINITION_DROP)
    d = dedupe_first(d, ["name"], [order_col])
    clean = canonical_ratio_name("name") if normalise else strip_trailing_paren("name")
    d = rename_columns(d.withColumn("name", clean), DEFINITION_RENAME)
    # The ratio vocabulary is a fixed list of 34 names: a global window is fine.
    w = Window.orderBy(order_col)
    return d.select(F.row_number().over(w).cast("int").alias("RatioKey"),
                    "RatioName", "Unit", "RatioType")


def allocate_keys(new: DataFrame, existing: DataFrame | None, natural: str, key: str) -> DataFrame:
    """Surrogate keys that survive re-runs.

    A natural key already in ``existing`` keeps its key (largest one if the
    existing table repeats the natural key); new natural keys get
    ``max(existing key) + dense number``, numbered in the order of
    (md5 of the natural key, natural key). That order is the same for any number of
    rows, and a prefix of the hash splits it into even ranges, so the
    numbering is one window for each of 16**BUCKET_DIGITS ranges plus the ranges' prefix sums.
    """
    new = dedupe_first(new, [natural], [c for c in new.columns if c != natural] or [natural])
    if existing is None:
        return numbered(new, natural, key, F.lit(0))
    known = existing.groupBy(natural).agg(F.max(key).alias(key))
    base = F.coalesce(existing.select(F.max(key)).scalar(), F.lit(0))
    fresh = new.join(known.select(natural), natural, "left_anti")
    return new.join(known, natural, "inner").unionByName(numbered(fresh, natural, key, base))


def numbered(df: DataFrame, natural: str, key: str, base: Column) -> DataFrame:
    """Dense numbers ``base + 1 ..`` in the order of (md5 of the natural key, natural key)."""
    ranged = df.withColumn("_hash", F.md5(F.col(natural).cast("string").cast("binary"))) \
               .withColumn("_range", F.substring("_hash", 1, BUCKET_DIGITS))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range: at most 16**BUCKET_DIGITS
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", natural))
    return (ranged.join(F.broadcast(offsets), "_range")
            .withColumn(key, (base + F.col("_before") + rank).cast("int"))
            .drop("_hash", "_range", "_before"))
