"""The equity star derived from the driver's TPC-H-style tables.

Mapping (same definitions in the Spark plans and in the SQL twins):

* a supplier is a listed stock: StockKey = s_suppkey, symbol = s_name,
  industry = nation name, company type = region name;
* a lineitem is a trade: price = l_extendedprice / l_quantity, size = l_quantity,
  trade date = l_shipdate; the daily bar per (stock, date) takes Open/Close at the
  first/last trade in (l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  l_quantity) order, High/Low = max/min price, Volume = total size;
* quarterly ratios per (stock, year, quarter) come from the same trades.

Everything is one lazy plan over the parquet files: no per-symbol loop and
no collect. Raw trade skew (one stock with a third of all trades) is absorbed by
the map-side partial aggregation of the daily bar: after it each stock-day is
one row, so a stock's history is bounded by the number of trading days.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.functions.dates import date_parts, time_key
from stockyard.functions.rounding import r2
from stockyard.session import fits_broadcast, literal_rows

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]

# Trade order inside a day: l_orderkey, l_linenumber alone are not unique.
TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"]

# Index membership in the derived star: a list of 30 symbols, like the production one.
INDEX_MEMBERS = [f"Supplier#{i:09d}" for i in range(30)]

# Test definition feed for the ratio dimension (name, type, unit, order, com_type_code).
# Contains a repeated name (first kept), a name outside the tracked list
# (filtered out) and 'TSCĐ / Vốn CSH', whose blanks differ from the fact column.
RATIO_DEFINITION_ROWS = [
    ("Nợ/VCSH", "Capital structure", "Times", "1", "CT"),
    ("TSCĐ / Vốn CSH", "Capital structure", "Times", "2", "CT"),
    ("ROE (%)", "Profitability", "%", "3", "CT"),
    ("ROA (%)", "Profitability", "%", "4", "CT"),
    ("P/E", "Valuation", "Times", "5", "CT"),
    ("P/B", "Valuation", "Times", "6", "CT"),
    ("EPS (VND)", "Valuation", "VND", "7", "CT"),
    ("P/E", "Valuation", "Times", "8", "NH"),
    ("Doanh thu thuần", "Income", "Billion VND", "9", "CT"),
]


# (application id, sf dir) -> supplier table passed the broadcast size check
_SMALL_SUPPLIER: dict[tuple[str, str], bool] = {}


# (application id, path) -> reader DataFrame. The driver tables are read-only
# inputs, so the listing and footer schema read are done once per session
# (this caches the plan, not data).
_READERS: dict[tuple[str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _READERS:
        _READERS[key] = spark.read.parquet(path)
    return _READERS[key]


def _price() -> Column:
    return F.col("l_extendedprice") / F.col("l_quantity")


class DerivedStar:
    """Warehouse tables (and their raw feeds) derived from one sf directory."""

    date_of_key = True           # the time dimension is derived from the fact's own days

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # ---- raw trades -----------------------------------------------------
    def index_keys(self) -> DataFrame:
        """Stock keys of the index members: at most one for each listed symbol."""
        return (self.table("supplier").where(F.col("s_name").isin(INDEX_MEMBERS))
                .select(F.col("s_suppkey").alias("l_suppkey")))

    def trades(self, index_only: bool = False) -> DataFrame:
        """Trade rows keyed by StockKey; ``index_only`` keeps the index members' trades
        (a semi-join on the broadcast member keys, before anything is shuffled)."""
        li = self.table("lineitem")
        if index_only:
            li = li.join(F.broadcast(self.index_keys()), "l_suppkey", "left_semi")
        return li.select(F.col("l_suppkey").cast("int").alias("StockKey"),
                         F.to_date("l_shipdate").alias("Date"), _price().alias("p"),
                         *TRADE_ORDER, "l_discount", "l_tax", "l_returnflag")

    def daily_bars(self, index_only: bool = False) -> DataFrame:
        """One OHLCV row per (StockKey, Date); ``index_only`` keeps index members.

        Partial aggregation runs in the map tasks, so a stock-day that holds a
        third of all trades reaches the shuffle as one row for each task.
        """
        seq = F.struct(*TRADE_ORDER)
        t = self.trades(index_only)
        return t.groupBy("StockKey", "Date").agg(
            F.min_by("p", seq).alias("Open"),
            F.max("p").alias("High"),
            F.min("p").alias("Low"),
            F.max_by("p", seq).alias("Close"),
            F.sum("l_quantity").cast("bigint").alias("Volume"))

    # ---- lookups ----------------------------------------------------------
    @property
    def supplier_small(self) -> bool:
        """Size check on the supplier table (it grows with the data).

        ``limit(n+1).count()`` on a stored table is answered from parquet
        footers; the answer is kept per session and path, so queries do not
        repeat the job. Beyond the limit, joins to the company dimension are
        shuffle joins on the stock key (which the per-stock windows need anyway).
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir.rstrip("/"))
        if key not in _SMALL_SUPPLIER:
            _SMALL_SUPPLIER[key] = fits_broadcast(self.table("supplier"))
        return _SMALL_SUPPLIER[key]

    def symbols(self) -> DataFrame:
        """(StockKey, StockSymbol): the supplier name is the ticker."""
        s = self.table("supplier").select(F.col("s_suppkey").cast("int").alias("StockKey"),
                                          F.col("s_name").alias("StockSymbol"))
        return F.broadcast(s) if self.supplier_small else s

    # ---- warehouse tables -------------------------------------------------
    def _fact(self, bars: DataFrame) -> DataFrame:
        return bars.select(time_key("Date").alias("TimeKey"), "StockKey",
                           "Open", "High", "Low", "Close", "Volume")

    @cached_property
    def fact_price(self) -> DataFrame:
        return self._fact(self.daily_bars())

    @cached_property
    def most_price_rows(self) -> int:
        """A bound of the fact's rows: the trades (answered from parquet footers)."""
        return self.table("lineitem").count()

    def index_fact_price(self) -> DataFrame:
        """Fact rows of the index members only."""
        return self._fact(self.daily_bars(index_only=True))

    @cached_property
    def dim_time(self) -> DataFrame:
        """Distinct trading dates. Bounded by the calendar (one row per day)."""
        d = self.table("lineitem").select(F.to_date("l_shipdate").alias("Date")).distinct()
        return d.select(*date_parts("Date"))

    @cached_property
    def dim_company(self) -> DataFrame:
        region = F.broadcast(self.table("region"))      # fixed-size reference tables
        nation = F.broadcast(self.table("nation"))
        s = self.table("supplier")
        return (s.join(nation, s.s_nationkey == nation.n_nationkey)
                 .join(region, nation.n_regionkey == region.r_regionkey)
                 .select(F.col("s_suppkey").cast("int").alias("StockKey"),
                         F.col("s_name").alias("StockSymbol"),
                         F.col("s_name").alias("CompanyName"),
                         F.col("s_name").alias("ShortName"),
                         F.col("n_name").alias("Industry"),
                         F.col("r_name").alias("CompanyType"),
                         r2(F.col("s_acctbal") / 1000).alias("StockRating")))

    @cached_property
    def dim_ratio(self) -> DataFrame:
        from stockyard.operators.dims import build_dim_ratio
        return build_dim_ratio(self.definition_feed())

    @cached_property
    def fact_ratio(self) -> DataFrame:
        from stockyard.operators.facts import prepare_fact_ratios, resolve_ratio_keys
        long = prepare_fact_ratios(self.ratio_wide(), self.dim_time)
        return resolve_ratio_keys(long, self.dim_company, self.dim_ratio,
                                  company_small=self.supplier_small)

    # ---- raw feeds --------------------------------------------------------
    def staging_quotes(self) -> DataFrame:
        """Quote feed shape: time (yyyy-MM-dd text), MaCK, open, high, low, close, volume."""
        b = self.daily_bars().join(self.symbols(), "StockKey")
        return b.select(F.date_format("Date", "yyyy-MM-dd").alias("time"),
                        F.col("StockSymbol").alias("MaCK"),
                        F.col("Open").alias("open"), F.col("High").alias("high"),
                        F.col("Low").alias("low"), F.col("Close").alias("close"),
                        F.col("Volume").cast("double").alias("volume"))

    def ratio_wide(self) -> DataFrame:
        """Wide ratio feed: CP, Năm, Kỳ + ratio columns under their feed names."""
        t = self.trades()
        g = t.groupBy("StockKey", F.year("Date").cast("int").alias("Năm"),
                      F.quarter("Date").cast("int").alias("Kỳ")).agg(
            (F.avg("l_discount") * 100).alias("ROE (%)"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("P/E"),
            F.avg(F.when(F.col("l_returnflag") == "R", F.col("p"))).alias("P/B"),
            (F.avg("l_tax") * 100).alias("TSCĐ / Vốn CSH"))
        return g.join(self.symbols(), "StockKey").select(
            F.col("StockSymbol").alias("CP"), "Năm", "Kỳ",
            "ROE (%)", "P/E", "P/B", "TSCĐ / Vốn CSH")

    def definition_feed(self) -> DataFrame:
        return literal_rows(self.spark, RATIO_DEFINITION_ROWS,
                            ["name", "type", "unit", "order", "com_type_code"], position="_seq")

    def company_feeds(self) -> tuple[DataFrame, DataFrame]:
        """(overview, profile) company feeds, each with columns the load drops."""
        region = F.broadcast(self.table("region"))
        nation = F.broadcast(self.table("nation"))
        s = self.table("supplier")
        base = (s.join(nation, s.s_nationkey == nation.n_nationkey)
                 .join(region, nation.n_regionkey == region.r_regionkey))
        overview = base.select(
            F.col("s_name").alias("symbol"), F.col("s_name").alias("short_name"),
            F.col("n_name").alias("industry"), F.col("r_name").alias("company_type"),
            (F.col("s_acctbal") / 1000).alias("stock_rating"),
            F.lit("HOSE").alias("exchange"), F.col("s_nationkey").alias("industry_id"),
            F.lit(None).cast("string").alias("website"))
        profile = s.select(
            F.col("s_name").alias("symbol"), F.col("s_name").alias("company_name"),
            F.lit("").alias("history_dev"), F.lit("").alias("company_profile"))
        return overview, profile

    # ---- star interface used by the views ---------------------------------
    @property
    def company_small(self) -> bool:
        return self.supplier_small
