"""The four analytic views, as DataFrame plans over a star.

A *star* is any object with DataFrame attributes ``fact_price``,
``fact_ratio``, ``dim_time``, ``dim_company``, ``dim_ratio``, a boolean
``company_small`` (True: broadcast Dim_Company; False/None: no hint, the
planner decides from statistics) and a method ``index_fact_price()`` returning
the price fact of the index members (filtered where it reaches the scan).

Join strategy: Dim_Time is one row per trading day (bounded by the calendar,
not by data volume) and is broadcast; Dim_Ratio is bounded by the fixed ratio
vocabulary and is broadcast; Dim_Company grows with the listed universe and is
broadcast only when known small (or when the planner's size estimate is under
the broadcast threshold), otherwise it is a shuffle join on StockKey, which
the per-stock windows need anyway.

Every window is partitioned by the stock key first, so all symbols are
computed in one plan; the fact is one row per stock-day, so a partition holds
at most the stock's trading days, whatever the raw trade skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions.dates import DATE_PARTS, date_parts
from stockyard.functions.indicators import pct_change
from stockyard.functions.rounding import r2


def time_dim(star, cols: list[str]) -> DataFrame:
    return F.broadcast(star.dim_time.select("TimeKey", *cols))


def dated(star, rows: DataFrame, cols: list[str]) -> DataFrame:
    """``rows`` with parts of their day. A star that derives its time dimension from the fact itself
    (``date_of_key``) takes them from the key, without another scan of the trades."""
    if not getattr(star, "date_of_key", False):
        return rows.join(time_dim(star, cols), "TimeKey")
    year, month, day = F.floor(F.col("TimeKey") / 10000), F.floor(F.col("TimeKey") / 100) % 100, F.col("TimeKey") % 100
    date = F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))
    parts = dict(zip(DATE_PARTS, date_parts("Date"), strict=True))
    return rows.withColumn("Date", date).select(*rows.columns, *[parts[c] for c in cols])


def company_dim(star, cols: list[str]) -> DataFrame:
    d = star.dim_company.select("StockKey", *cols)
    return F.broadcast(d) if star.company_small else d


# ---------------------------------------------------------------------------
# V-MV  price movement
# ---------------------------------------------------------------------------
MOVEMENT_COLUMNS = ["StockSymbol", "CompanyName", "Year", "Month", "Date", "CurrentPrice",
                    "PrevClose", "DailyChangePercent", "FiveDayAvgChange", "TwentyDayAvgChange"]


def price_movement(star, with_key: bool = False) -> DataFrame:
    """Daily change vs the previous close, its 5- and 20-row means.

    The first row of each stock (no previous close) is removed *between*
    the LAG window and the averaging windows, as in the view definition.
    """
    w = Window.partitionBy("StockKey").orderBy("Date")
    daily = dated(star, star.fact_price.select("TimeKey", "StockKey", "Close"), ["Date", "Year", "Month"]).withColumn(
        "PrevClose", F.lag("Close").over(w))
    chg = pct_change("Close", "PrevClose")
    out = (daily.where(F.col("PrevClose").isNotNull())
           .join(company_dim(star, ["StockSymbol", "CompanyName"]), "StockKey")
           .select("StockKey", "StockSymbol", "CompanyName", "Year", "Month", "Date",
                   F.col("Close").alias("CurrentPrice"), "PrevClose",
                   r2(chg).alias("DailyChangePercent"),
                   r2(F.avg(chg).over(w.rowsBetween(-4, 0))).alias("FiveDayAvgChange"),
                   r2(F.avg(chg).over(w.rowsBetween(-19, 0))).alias("TwentyDayAvgChange")))
    return out if with_key else out.drop("StockKey")


# ---------------------------------------------------------------------------
# V-PS  price summary (faithful day grain) and the monthly variant
# ---------------------------------------------------------------------------
SUMMARY_COLUMNS = ["StockSymbol", "CompanyName", "Industry", "Year", "Quarter", "Month",
                   "AvgClosePrice", "MinPrice", "MaxPrice", "TotalVolume",
                   "MonthStartPrice", "MonthEndPrice", "MonthlyChangePercent"]


# Rows of a task of the summary.
MONTH_ROWS = 250_000


def _priced(star) -> DataFrame:
    return dated(star, star.fact_price, ["Date", "Year", "Quarter", "Month"]).join(
        company_dim(star, ["StockSymbol", "CompanyName", "Industry"]), "StockKey")


def by_month(star, priced: DataFrame) -> DataFrame:
    """``priced`` dealt by stock and month to as many tasks as its rows need, if the star knows a bound of them: the
    windows, the grouping and the de-duplication run in one task, whose memory follows its rows."""
    most = getattr(star, "most_price_rows", None)
    return priced if most is None else priced.repartition(max(2, -(-most // MONTH_ROWS)), "StockKey", "Year", "Month")


def price_summary(star, with_key: bool = False) -> DataFrame:
    """Faithful summary: the 'monthly' aggregates are per trading day (D1),
    then rows equal on every output column collapse (D2).

    The windows come first: the day-grain grouping and the de-duplication start
    with the windows' keys, so all three share one exchange (and the two window
    values are the same for every row of a stock-month).
    """
    wm = Window.partitionBy("StockKey", "Year", "Month").orderBy("Date")
    whole = wm.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    priced = by_month(star, _priced(star)).withColumn("MonthStartPrice", F.first("Close").over(whole)).withColumn(
        "MonthEndPrice", F.last("Close").over(whole))
    days = priced.groupBy("StockKey", "StockSymbol", "CompanyName", "Industry", "Year", "Quarter", "Month",
                          "Date", "Close", "MonthStartPrice", "MonthEndPrice").agg(
        r2(F.avg("Close")).alias("AvgClosePrice"), r2(F.min("Low")).alias("MinPrice"),
        r2(F.max("High")).alias("MaxPrice"), F.sum("Volume").cast("bigint").alias("TotalVolume"))
    rows = days.select(
        "StockKey", "StockSymbol", "CompanyName", "Industry", "Year", "Quarter", "Month",
        "AvgClosePrice", "MinPrice", "MaxPrice", "TotalVolume", "MonthStartPrice", "MonthEndPrice")
    out = rows.distinct().withColumn(
        "MonthlyChangePercent", r2(pct_change("MonthEndPrice", "MonthStartPrice")))
    return out.select(*(["StockKey"] if with_key else []), *SUMMARY_COLUMNS)


def price_summary_monthly(star, with_key: bool = False) -> DataFrame:
    """Intent of the summary: one row per stock-month, start/end = first/last close."""
    g = _priced(star).groupBy("StockKey", "StockSymbol", "CompanyName", "Industry",
                              "Year", "Quarter", "Month").agg(
        r2(F.avg("Close")).alias("AvgClosePrice"),
        r2(F.min("Low")).alias("MinPrice"),
        r2(F.max("High")).alias("MaxPrice"),
        F.sum("Volume").cast("bigint").alias("TotalVolume"),
        F.min_by("Close", "Date").alias("MonthStartPrice"),
        F.max_by("Close", "Date").alias("MonthEndPrice"))
    out = g.withColumn("MonthlyChangePercent",
                       r2(pct_change("MonthEndPrice", "MonthStartPrice")))
    return out.select(*(["StockKey"] if with_key else []), *SUMMARY_COLUMNS)


# ---------------------------------------------------------------------------
# V-QR  quarterly ratios
# ---------------------------------------------------------------------------
RATIO_VIEW_COLUMNS = ["StockSymbol", "CompanyName", "Year", "Quarter", "RatioName", "Unit",
                      "RatioType", "RatioValue"]


def quarterly_ratios(star, sentinel_as_null: bool = False, only: Column | None = None) -> DataFrame:
    """Mean ratio value per stock, quarter and ratio, rounded to 2.

    ``sentinel_as_null`` drops the missing-value sentinel from the mean;
    the default keeps it (the stored values are averaged as they are).
    ``only``: a predicate on the fact's StockKey, applied at its scan.
    """
    from stockyard.functions.names import RATIO_SENTINEL
    f = star.fact_ratio if only is None else star.fact_ratio.where(only)
    value = F.col("Value")
    if sentinel_as_null:
        value = F.when(value != F.lit(RATIO_SENTINEL), value)
    r = F.broadcast(star.dim_ratio.select("RatioKey", "RatioName", "Unit", "RatioType"))
    j = (f.join(company_dim(star, ["StockSymbol", "CompanyName"]), "StockKey")
          .join(time_dim(star, ["Year", "Quarter"]), "TimeKey")
          .join(r, "RatioKey"))
    return (j.groupBy("StockSymbol", "CompanyName", "Year", "Quarter", "RatioName", "Unit", "RatioType")
             .agg(r2(F.avg(value)).alias("RatioValue")))


# ---------------------------------------------------------------------------
# V-PF  index performance
# ---------------------------------------------------------------------------
PERFORMANCE_COLUMNS = ["Date", "Year", "Quarter", "Month", "StockSymbol", "Industry", "Close",
                       "Volume", "DailyReturn", "YTDReturn", "MA10", "MA30"]


def index_rows(star) -> DataFrame:
    """Index members' price rows joined to their dimensions (before any window); with the stock's known
    first close of the year, if the star has one (``year_open``)."""
    rows = dated(star, star.index_fact_price(), ["Date", "Year", "Quarter", "Month"]).join(
        company_dim(star, ["StockSymbol", "Industry"]), "StockKey")
    known = getattr(star, "year_open", None)
    return rows if known is None else rows.join(F.broadcast(known) if star.company_small else known, ["StockKey", "Year"], "left")


def index_performance(star, with_key: bool = False, null_on_zero: bool = False) -> DataFrame:
    """Daily return, year-to-date return and 10/30-row moving averages of the
    index members.

    Both windows sort by (StockKey, Year, Date) - Year follows from Date, so
    the order is the date order - and the per-stock window is computed first:
    one exchange on StockKey and one sort serve all of them. The year-to-date return
    raises on a zero base, as the view does; ``null_on_zero`` gives NULL instead.
    """
    f = index_rows(star)
    wd = Window.partitionBy("StockKey").orderBy("Year", "Date")
    wy = Window.partitionBy("StockKey", "Year").orderBy("Date")
    prev = F.lag("Close").over(wd)
    known = [c for c in ("YearOpen",) if c in f.columns]
    step1 = f.select(
        *known, "StockKey", "Date", "Year", "Quarter", "Month", "StockSymbol", "Industry", "Close", "Volume",
        r2(pct_change("Close", prev)).alias("DailyReturn"),
        r2(F.avg("Close").over(wd.rowsBetween(-9, 0))).alias("MA10"),
        r2(F.avg("Close").over(wd.rowsBetween(-29, 0))).alias("MA30"))
    base = F.coalesce(*known, F.first("Close").over(wy))
    ratio = F.try_divide(F.col("Close"), base) if null_on_zero else F.col("Close") / base
    out = step1.withColumn("YTDReturn", r2((ratio - 1) * 100))
    return out.select(*(["StockKey"] if with_key else []), *PERFORMANCE_COLUMNS)
