"""Load flows (L8 daily prices, L9 quarterly ratios) over a parquet warehouse.

The warehouse is a folder of parquet tables (one per star table). A flow checks
its gates before it writes anything, then writes dimensions, then facts. Every
write is an append of rows whose key is new (insert-ignore), and the high-water
mark is read from the fact, the last table written: a flow that fails at any
point - or is re-run after a lost executor killed the job - can be run again and
ends in the state of one clean run.

A batch is evaluated once: it is staged in the scratch folder, its counts, key range and limit violations
are observed on that write (``Observation``), and gates, comparison and append work on the staged rows.

Fact files are partitioned by Year and range-clustered by StockKey within it, so
a date or symbol filter on the stored fact skips folders and row groups, and a
batch is compared only with the years and days it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.functions.names import INDEX_SYMBOLS, OVERVIEW_DROP, PROFILE_DROP
from stockyard.operators import dims, facts, load, quality
from stockyard.operators.conform import drop_columns
from stockyard.schemas import PRIMARY_KEYS, TABLES
from stockyard.session import drop_scratch, fits_broadcast, scratch_path

# Facts stored by year of their TimeKey.
BY_YEAR = {"Fact_StockPrice", "Fact_FinancialRatios"}


@dataclass
class FlowResult:
    status: str                       # "loaded" | "dimensions" | "skipped"
    metrics: dict = field(default_factory=dict)


class StoredWarehouse:
    """Star tables stored as parquet under ``root`` (the view/analysis star interface)."""

    def __init__(self, spark: SparkSession, root: str, index_symbols: list[str] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.index_symbols = INDEX_SYMBOLS if index_symbols is None else index_symbols
        # readers and derived decisions, dropped whenever this object appends to a table
        self._cache: dict[str, object] = {}

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        """The table, or an empty frame of its schema when nothing was loaded yet."""
        return self._stored(table).select(*TABLES[table].fieldNames())

    def _stored(self, table: str) -> DataFrame:
        """The table with its partition column, if it has one."""
        if table not in self._cache:
            schema = TABLES[table]
            if table in BY_YEAR:
                schema = T.StructType([*schema.fields, T.StructField("Year", T.IntegerType())])
            try:
                df = self.spark.read.schema(schema).parquet(self.path(table))
            except Exception as e:  # noqa: BLE001 - missing folder before the first load
                if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                    raise
                df = self.spark.createDataFrame([], schema)
            self._cache[table] = df
        return self._cache[table]

    @property
    def dim_time(self) -> DataFrame:
        return self.read("Dim_Time")

    @property
    def dim_company(self) -> DataFrame:
        return self.read("Dim_Company")

    @property
    def dim_ratio(self) -> DataFrame:
        return self.read("Dim_Ratio")

    @property
    def fact_price(self) -> DataFrame:
        f = self.read("Fact_StockPrice")
        return f.select("TimeKey", "StockKey", *[F.col(c).cast("double").alias(c)
                                                  for c in ("Open", "High", "Low", "Close")], "Volume")

    @property
    def fact_ratio(self) -> DataFrame:
        f = self.read("Fact_FinancialRatios")
        return f.withColumn("Value", F.col("Value").cast("double"))

    @property
    def company_small(self) -> bool:
        """Size check on the stored dimension (answered from parquet footers)."""
        if "company_small" not in self._cache:
            self._cache["company_small"] = fits_broadcast(self.dim_company)
        return self._cache["company_small"]

    def index_fact_price(self) -> DataFrame:
        """Index members' prices: symbols resolved to keys through the member
        list (at most len(index_symbols) keys), pushed to the fact scan."""
        if "index_keys" not in self._cache:
            self._cache["index_keys"] = [
                r[0] for r in self.dim_company.where(F.col("StockSymbol").isin(self.index_symbols))
                .select("StockKey").collect()]
        return self.fact_price.where(F.col("StockKey").isin(self._cache["index_keys"]))

    # ---- writes --------------------------------------------------------------
    def append(self, table: str, rows: DataFrame) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].fields])
        if table in BY_YEAR:
            rows = rows.withColumn("Year", _year_of("TimeKey"))
            rows = rows.repartitionByRange("Year", "StockKey").sortWithinPartitions("Year", "StockKey", "TimeKey")
            rows.write.mode("append").partitionBy("Year").parquet(self.path(table))
        else:
            rows.write.mode("append").parquet(self.path(table))
        self._cache.clear()

    @contextmanager
    def staged(self, rows: DataFrame, name: str, metrics: dict[str, Column]) -> Iterator[tuple[DataFrame, dict]]:
        """``rows`` written once to the scratch folder, with ``metrics`` observed on the way; dropped afterwards."""
        path, seen = scratch_path(self.spark, name), Observation()
        rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
        try:
            yield self.spark.read.schema(rows.schema).parquet(path), seen.get
        finally:
            drop_scratch(self.spark, path)

    def between(self, table: str, low: int | None, high: int | None) -> DataFrame:
        """Stored rows with a TimeKey from low to high; other years' folders are not read."""
        stored = self._stored(table)
        if low is not None and table in BY_YEAR:
            stored = stored.where(F.col("Year").between(low // 10000, high // 10000)
                                  & F.col("TimeKey").between(low, high))
        return stored.select(*TABLES[table].fieldNames())

    def around(self, table: str, batch: DataFrame) -> DataFrame:
        """Stored rows in the batch's range of TimeKey."""
        return self.between(table, *batch.agg(F.min("TimeKey"), F.max("TimeKey")).first())

    def load(self, table: str, rows: DataFrame, strict: bool = False) -> None:
        """Insert-ignore on the primary key (K2); ``strict`` (K3) raises on any key
        that repeats or exists. Keys and declared limits are checked first."""
        keys = PRIMARY_KEYS[table]
        span = {"low": F.min("TimeKey"), "high": F.max("TimeKey")} if "TimeKey" in keys else {}
        with self.staged(rows, table, {"rows": F.count("*"), **span, **quality.validity(table)}) as (batch, seen):
            quality.require_none(table, seen)
            if not seen["rows"]:
                return
            target = self.between(table, seen["low"], seen["high"]) if span else self.read(table)
            if strict:
                load.require_new_keys(target, batch, keys, cut=True)
                self.append(table, batch)
            else:
                self.append(table, load.new_rows(target, batch, keys))

    def quarantine(self, feed: str, bad: DataFrame) -> None:
        """Keep a feed's malformed rows beside the tables."""
        bad.write.mode("append").parquet(f"{self.root}/quarantine/{feed}")


def _year_of(key: str):
    return F.floor(F.col(key) / 10000).cast("int")


def load_companies(wh: StoredWarehouse, overview: DataFrame, profile: DataFrame) -> None:
    """Dim_Company from the two company feeds; known symbols keep their keys."""
    company = drop_columns(profile, PROFILE_DROP).join(drop_columns(overview, OVERVIEW_DROP), "symbol")
    existing = wh.dim_company
    wh.load("Dim_Company", dims.build_dim_company(company, existing if not existing.isEmpty() else None))


def daily_flow(wh: StoredWarehouse, quotes: DataFrame, until: str | None = None,
               apply_high_water: bool = True, strict: bool = False,
               companies: tuple[DataFrame, DataFrame] | None = None,
               bad_rows: DataFrame | None = None, start: str = load.HISTORY_START) -> FlowResult:
    """Quotes -> Dim_Time and Fact_StockPrice.

    Rows before the high-water mark (day after the last day in the *fact*, ``start`` if
    that is empty) or after ``until`` are ignored; an empty selection is a "skipped" run.
    ``companies`` (overview, profile) are loaded first, which lets the flow start from an
    empty warehouse; without any company it raises before it writes anything.
    ``bad_rows`` of the feed go to the quarantine. Metrics: rows, symbols and days
    of the batch, and the rows dropped for an unknown symbol (L7).
    """
    if bad_rows is not None:
        wh.quarantine("quotes", bad_rows)
    if companies is not None:
        load_companies(wh, *companies)
    if apply_high_water:
        loaded = wh.read("Fact_StockPrice").select(F.to_date(F.col("TimeKey").cast("string"), "yyyyMMdd").alias("Date"))
        quotes = load.rows_after_high_water(quotes, loaded, until=until, start=start)
    with wh.staged(quotes, "quotes", {"rows": F.count("*")}) as (quotes, seen):
        if not seen["rows"]:
            return FlowResult("skipped")
        quality.require_rows(wh.dim_company, "Dim_Company")
        wh.load("Dim_Time", dims.build_dim_time(quotes))
        small = wh.company_small
        staged = facts.prepare_fact_price(quotes, wh.dim_time)
        wh.load("Fact_StockPrice", facts.resolve_price_keys(staged, wh.dim_company, company_small=small), strict)
        m = quality.load_metrics(staged, "staging", "StockSymbol", "TimeKey").first().asDict()
        dropped = facts.unresolved_symbols(staged, wh.dim_company, small).agg(
            F.coalesce(F.sum("DroppedRows"), F.lit(0))).first()[0]
        return FlowResult("loaded", m | {"Unresolved": dropped})


def quarterly_flow(wh: StoredWarehouse, ratio_wide: DataFrame, overview: DataFrame,
                   profile: DataFrame, definitions: DataFrame, normalise: bool = True,
                   strict: bool = False) -> FlowResult:
    """Company and ratio dimensions, then the ratio fact.

    From an empty warehouse it loads the dimensions and reports "dimensions":
    ratio rows need trading days, so it is run again after the first daily flow.
    Returns the unresolved-key report's size in the metrics (L7).
    """
    if ratio_wide.isEmpty():
        return FlowResult("skipped")
    load_companies(wh, overview, profile)
    ratio_dim = dims.build_dim_ratio(definitions, normalise=normalise)
    existing = wh.dim_ratio
    fresh = ratio_dim.join(existing.select("RatioName"), "RatioName", "left_anti")
    base = existing.select(F.coalesce(F.max("RatioKey"), F.lit(0))).first()[0]
    # the ratio vocabulary is a fixed list: one small window
    fresh = fresh.withColumn("RatioKey", (F.lit(base) + F.row_number().over(Window.orderBy("RatioKey"))).cast("int"))
    wh.load("Dim_Ratio", fresh)
    if wh.dim_time.isEmpty():
        return FlowResult("dimensions")
    long = facts.prepare_fact_ratios(ratio_wide, wh.dim_time)
    small = wh.company_small
    fact = facts.resolve_ratio_keys(long, wh.dim_company, wh.dim_ratio, normalise, small)
    missing = facts.unresolved_keys(long, wh.dim_company, wh.dim_ratio, normalise, small)
    wh.load("Fact_FinancialRatios", fact, strict)
    return FlowResult("loaded", {"unresolved": missing.count()})
