"""Fact preparation (L4, L5) and key resolution with a miss report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.functions.names import (
    RATIO_COLUMN_RENAME, RATIO_SENTINEL, canonical_ratio_name,
)
from stockyard.functions.rounding import r4
from stockyard.operators.conform import fill_sentinel, rename_columns, unpivot

RATIO_IDS = ["StockSymbol", "Năm", "Kỳ"]


def _maybe_broadcast(df: DataFrame, small: bool | None) -> DataFrame:
    """Broadcast when known small; otherwise leave the choice to the planner's
    statistics and AQE (no forced broadcast of a table that grows with data)."""
    return F.broadcast(df) if small else df


def prepare_fact_price(quotes: DataFrame, dim_time: DataFrame) -> DataFrame:
    """L4: quote feed -> (TimeKey, StockSymbol, open..volume); date misses dropped.

    The time dimension is one row per trading day, bounded by the calendar
    rather than by data volume, so it is broadcast.
    """
    q = quotes.withColumn("Date", F.try_to_timestamp("time", F.lit("yyyy-MM-dd")).cast("date"))
    t = F.broadcast(dim_time.select("Date", "TimeKey"))
    return (q.join(t, "Date")
             .withColumnRenamed("MaCK", "StockSymbol")
             .select("TimeKey", "StockSymbol", "open", "high", "low", "close", "volume"))


def company_key_map(dim_company: DataFrame) -> DataFrame:
    """StockSymbol -> StockKey. A repeated symbol maps to its largest key."""
    return dim_company.groupBy("StockSymbol").agg(F.max("StockKey").alias("StockKey"))


def ratio_key_map(dim_ratio: DataFrame, normalise: bool = True) -> DataFrame:
    """RatioName -> RatioKey (on canonical names in normalised mode)."""
    name = canonical_ratio_name("RatioName") if normalise else F.col("RatioName")
    return (dim_ratio.select(name.alias("_rname"), "RatioKey")
                     .groupBy("_rname").agg(F.max("RatioKey").alias("RatioKey")))


def resolve_price_keys(staged: DataFrame, dim_company: DataFrame,
                       company_small: bool | None = None) -> DataFrame:
    """J6 for prices: symbol -> StockKey, unknown symbols dropped; volume to bigint."""
    keys = _maybe_broadcast(company_key_map(dim_company), company_small)
    return (staged.join(keys, "StockSymbol")
                  .select("TimeKey", "StockKey",
                          F.col("open").alias("Open"), F.col("high").alias("High"),
                          F.col("low").alias("Low"), F.col("close").alias("Close"),
                          F.col("volume").cast("bigint").alias("Volume")))


def unresolved_symbols(staged: DataFrame, dim_company: DataFrame,
                       company_small: bool | None = None) -> DataFrame:
    """L7 for prices: symbols without a company, with the rows they drop."""
    keys = _maybe_broadcast(company_key_map(dim_company).select("StockSymbol"), company_small)
    return (staged.join(keys, "StockSymbol", "left_anti").groupBy("StockSymbol")
            .agg(F.count("*").alias("DroppedRows")))


def quarter_first_day(dim_time: DataFrame) -> DataFrame:
    """J5 lookup table: (Year, Quarter) -> first TimeKey of the quarter."""
    return dim_time.groupBy("Year", "Quarter").agg(F.min("TimeKey").alias("TimeKey"))


def prepare_fact_ratios(wide: DataFrame, dim_time: DataFrame,
                        sentinel: float | None = RATIO_SENTINEL) -> DataFrame:
    """Wide ratio feed -> (TimeKey, StockSymbol, RatioName, Value).

    P1 rename, P8 sentinel fill, P9 unpivot, then J5: each (year, quarter) maps
    to the first trading day of that quarter; quarters without trading days
    are dropped. The quarter lookup is bounded by the calendar -> broadcast.
    """
    w = rename_columns(wide, RATIO_COLUMN_RENAME)
    values = [c for c in w.columns if c not in RATIO_IDS]
    w = w.select(*[F.col(f"`{c}`") for c in RATIO_IDS],
                 *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    if sentinel is not None:
        w = fill_sentinel(w, sentinel, subset=values)
    long = unpivot(w, RATIO_IDS, "RatioName", "Value", values)
    q = F.broadcast(quarter_first_day(dim_time))
    return (long.join(q, (long["Năm"] == q["Year"]) & (long["Kỳ"] == q["Quarter"]))
                .select("TimeKey", "StockSymbol", "RatioName", "Value"))


def resolve_ratio_keys(long: DataFrame, dim_company: DataFrame, dim_ratio: DataFrame,
                       normalise: bool = True, company_small: bool | None = None) -> DataFrame:
    """J6 for ratios: (symbol, name) -> (StockKey, RatioKey); misses dropped.

    Value is kept at 4 decimals (the warehouse's decimal(20,4)).
    The ratio map is bounded by the fixed ratio vocabulary -> broadcast.
    """
    rname = canonical_ratio_name("RatioName") if normalise else F.col("RatioName")
    ck = _maybe_broadcast(company_key_map(dim_company), company_small)
    rk = F.broadcast(ratio_key_map(dim_ratio, normalise))
    l2 = long.withColumn("_rname", rname)
    return (l2.join(ck, "StockSymbol").join(rk, "_rname")
              .select("TimeKey", "StockKey", "RatioKey", r4("Value").alias("Value")))


def unresolved_keys(long: DataFrame, dim_company: DataFrame, dim_ratio: DataFrame,
                    normalise: bool = True, company_small: bool | None = None) -> DataFrame:
    """Natural keys that found no dimension row, with the rows they drop.

    Output: KeyKind ('StockSymbol' | 'RatioName'), KeyValue, DroppedRows.
    """
    rname = canonical_ratio_name("RatioName") if normalise else F.col("RatioName")
    ck = _maybe_broadcast(company_key_map(dim_company).select("StockSymbol"), company_small)
    rk = F.broadcast(ratio_key_map(dim_ratio, normalise).select("_rname"))
    sym_miss = (long.join(ck, "StockSymbol", "left_anti")
                    .groupBy(F.col("StockSymbol").alias("KeyValue")).agg(F.count("*").alias("DroppedRows"))
                    .select(F.lit("StockSymbol").alias("KeyKind"), "KeyValue", "DroppedRows"))
    ratio_miss = (long.withColumn("_rname", rname).join(rk, "_rname", "left_anti")
                      .groupBy(F.col("RatioName").alias("KeyValue")).agg(F.count("*").alias("DroppedRows"))
                      .select(F.lit("RatioName").alias("KeyKind"), "KeyValue", "DroppedRows"))
    return sym_miss.unionByName(ratio_miss)
