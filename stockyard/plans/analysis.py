"""Analysis API (API1-API4) as DataFrame plans over a star.

Every function works for one symbol or for all (``symbol=None``): windows
are partitioned by StockKey, so "all symbols" is the same plan without the
filter. A symbol filter is resolved to its StockKey first so it reaches the
fact scan instead of staying above the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions.indicators import (
    clip_gain, clip_loss, ma_signal, pct_change, rsi_from_means, rsi_state, trend3,
)
from stockyard.functions.rounding import r2, r4, rnd
from stockyard.plans import views


def symbol_keys(star, symbol: str) -> Column:
    """Predicate on StockKey for one symbol; a symbol with several keys is an error."""
    keys = star.dim_company.where(F.col("StockSymbol") == symbol).select("StockKey").distinct().take(2)
    if len(keys) > 1:
        raise ValueError(f"symbol {symbol!r} has several stock keys")
    return F.col("StockKey") == F.lit(keys[0][0]) if keys else F.lit(False)


def _digits(c: Column, digits: int | None) -> Column:
    return c if digits is None else rnd(c, digits)


# ---------------------------------------------------------------------------
# API1  price summary
# ---------------------------------------------------------------------------
def price_summary_report(star, symbol: str | None = None, year: int | None = None,
                         quarter: int | None = None, monthly: bool = False) -> DataFrame:
    """Summary rows (+ PriceVolatility) filtered by symbol / year / quarter."""
    v = (views.price_summary_monthly if monthly else views.price_summary)(star, with_key=True)
    if symbol is not None:
        v = v.where(symbol_keys(star, symbol))
    if year is not None:
        v = v.where(F.col("Year") == year)
    if quarter is not None:
        v = v.where(F.col("Quarter") == quarter)
    vol = (F.col("MaxPrice") - F.col("MinPrice")) / F.nullif(F.col("AvgClosePrice"), F.lit(0.0)) * 100
    return v.withColumn("PriceVolatility", vol)


def volume_peak(summary: DataFrame) -> DataFrame:
    """Per symbol, the row with the largest TotalVolume; ties -> latest month."""
    w = Window.partitionBy("StockKey").orderBy(
        F.col("TotalVolume").desc_nulls_last(), F.col("Year").desc(), F.col("Month").desc())
    # day-grain rows can tie within a month as well; the peak's month and volume are then the same
    return (summary.where(F.col("TotalVolume").isNotNull())
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("StockSymbol", F.col("Year").alias("PeakYear"),
                    F.col("Month").alias("PeakMonth"), F.col("TotalVolume").alias("PeakVolume")))


def cumulative_growth(summary: DataFrame) -> DataFrame:
    """First month's start price -> last month's end price, only with > 1 row."""
    ym = F.col("Year") * 100 + F.col("Month")          # start and end prices are a month's own
    g = summary.groupBy("StockKey", "StockSymbol").agg(
        F.min_by("MonthStartPrice", ym).alias("FirstStartPrice"),
        F.max_by("MonthEndPrice", ym).alias("LastEndPrice"),
        F.count("*").alias("Rows"))
    growth = F.when(F.col("Rows") > 1, r2(pct_change("LastEndPrice", "FirstStartPrice")))
    return g.select("StockSymbol", "FirstStartPrice", "LastEndPrice", "Rows",
                    growth.alias("CumulativeGrowthPercent"))


# ---------------------------------------------------------------------------
# API2  quarterly ratios
# ---------------------------------------------------------------------------
def quarterly_ratio_rows(star, symbol: str | None = None, year: int | None = None,
                         ratio_name: str | None = None) -> DataFrame:
    v = views.quarterly_ratios(star, only=symbol_keys(star, symbol) if symbol is not None else None)
    if year is not None:
        v = v.where(F.col("Year") == year)
    if ratio_name is not None:          # the argument filters on the ratio's *name*
        v = v.where(F.col("RatioName") == ratio_name)
    return v


def ordered_ratio_rows(rows: DataFrame) -> DataFrame:
    """O2: newest quarter first, then by ratio name and type."""
    return rows.orderBy(F.col("Year").desc(), F.col("Quarter").desc(), "RatioName", "RatioType")


def ratio_names(star) -> list[str]:
    """The ratio vocabulary (bounded by the fixed list of tracked ratios)."""
    return sorted(r[0] for r in star.dim_ratio.select("RatioName").distinct().collect())


def quarterly_ratio_table(star, symbol: str | None = None, year: int | None = None,
                          ratio_name: str | None = None, names: list[str] | None = None) -> DataFrame:
    """P10: one row per (symbol, year, quarter), one column per ratio name."""
    from stockyard.operators.conform import pivot_first
    rows = quarterly_ratio_rows(star, symbol, year, ratio_name)
    names = names if names is not None else ratio_names(star)
    return pivot_first(rows, ["StockSymbol", "Year", "Quarter"], "RatioName", "RatioValue", names)


def ratio_types_by_name(rows: DataFrame) -> DataFrame:
    """Distinct ratio types per (symbol, ratio name), as sorted text."""
    return rows.groupBy("StockSymbol", "RatioName").agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("RatioType"))).alias("RatioTypes"))


# ---------------------------------------------------------------------------
# API3  price movement with indicators
# ---------------------------------------------------------------------------
def movement_rows(star, symbol: str | None = None, from_date: str | None = None,
                  to_date: str | None = None) -> DataFrame:
    """View rows, filtered. The date filter runs after the view's windows."""
    v = views.price_movement(star, with_key=True)
    if symbol is not None:
        v = v.where(symbol_keys(star, symbol))
    if from_date is not None:
        v = v.where(F.col("Date") >= F.to_date(F.lit(from_date)))
    if to_date is not None:
        v = v.where(F.col("Date") <= F.to_date(F.lit(to_date)))
    return v


def movement_stats(rows: DataFrame, digits: int | None = 4) -> DataFrame:
    """A9 + A10 over the (rounded) daily change of the selected rows."""
    d = F.col("DailyChangePercent")
    return rows.groupBy("StockKey", "StockSymbol").agg(
        _digits(F.avg(d), digits).alias("AvgDailyChange"),
        _digits(F.stddev_samp(d), digits).alias("StdDailyChange"),
        F.max(d).alias("MaxDailyGain"),
        F.min(d).alias("MaxDailyLoss"),
        F.count_if(d > 0).alias("DaysUp"),
        F.count_if(d < 0).alias("DaysDown"),
        F.count_if(d == 0).alias("DaysUnchanged")).drop("StockKey")


def with_indicators(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """MA10, MA30, two-way MA signal and 14-row simple RSI per stock.

    Computed over the rows given (after any date filter), ordered by date.
    """
    w = Window.partitionBy("StockKey").orderBy("Date")
    price = F.col("CurrentPrice")
    step = (rows
            .withColumn("_ma10", F.avg(price).over(w.rowsBetween(-9, 0)))
            .withColumn("_ma30", F.avg(price).over(w.rowsBetween(-29, 0)))
            .withColumn("_delta", price - F.lag(price).over(w)))
    frame = w.rowsBetween(-13, 0)
    step = (step.withColumn("_gain", F.avg(clip_gain("_delta")).over(frame))
                .withColumn("_loss", F.avg(clip_loss("_delta")).over(frame)))
    return (step.withColumn("MA10", _digits(F.col("_ma10"), digits))
                .withColumn("MA30", _digits(F.col("_ma30"), digits))
                .withColumn("MA_Signal", ma_signal("_ma10", "_ma30"))
                .withColumn("RSI", _digits(rsi_from_means("_gain", "_loss"), digits))
                .drop("_ma10", "_ma30", "_delta", "_gain", "_loss"))


def latest_rsi_state(indicators: DataFrame) -> DataFrame:
    """Current (latest-date) RSI and its state per symbol."""
    w = Window.partitionBy("StockKey").orderBy(F.col("Date").desc())
    return (indicators.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select("StockSymbol", "Date", "RSI", rsi_state("RSI").alias("RSIState")))


# ---------------------------------------------------------------------------
# API4  index performance
# ---------------------------------------------------------------------------
PERIOD_COLUMNS = ["StockSymbol", "Industry", "Latest_Close", "Latest_Date", "Period_Start_Price",
                  "Period_End_Price", "Period_Return_Percent", "Total_Period_Volume",
                  "Trading_Days", "Up_Days", "Down_Days", "Avg_Daily_Return", "Return_StdDev",
                  "Sharpe_Ratio", "YTDReturn", "Trend"]


def period_predicate(rows: DataFrame, period: str = "month", all_years: bool = False) -> Column:
    """predicate selecting the latest month / quarter / year (TRUE for anything else).

    The latest period is a scalar subquery over ``rows`` (the view's rows before
    its windows, so the subquery does not recompute them). By default the
    month/quarter must also be in the latest year; ``all_years=True`` matches
    the month/quarter number in any year.
    """
    if period not in ("month", "quarter", "year"):
        return F.lit(True)
    if period == "year":
        return F.col("Year") == rows.select(F.max("Year")).scalar()
    part = "Month" if period == "month" else "Quarter"
    if all_years:
        latest_year = rows.select(F.max("Year")).scalar()
        return F.col(part) == rows.where(F.col("Year") == latest_year).select(F.max(part)).scalar()
    scale = 100 if period == "month" else 10
    key = F.col("Year") * scale + F.col(part)
    return key == rows.select(F.max(key)).scalar()


def period_rows(v: DataFrame, period: str = "month", all_years: bool = False) -> DataFrame:
    """Rows of ``v`` in the latest period (see ``period_predicate``)."""
    return v.where(period_predicate(v, period, all_years))


def index_period_performance(star, period: str = "month", all_years: bool = False,
                             symbol: str | None = None, null_on_zero: bool = False) -> DataFrame:
    """One row per index member with rows in the period: period statistics and
    the member's latest row (over all dates).

    One grouped pass over the view: period statistics are conditional
    aggregates (min_by/max_by skip rows whose date is masked to NULL), the
    latest row's values are max_by(..., Date). The grouping starts with
    StockKey, so it reuses the view's partitioning - no extra shuffle, no
    self-join.
    """
    v = views.index_performance(star, with_key=True, null_on_zero=null_on_zero)
    if symbol is not None:          # below the grouping; the latest period stays the index's
        v = v.where(symbol_keys(star, symbol))
    inp = period_predicate(views.index_rows(star), period, all_years)
    r = F.col("DailyReturn")
    d = F.when(inp, F.col("Date"))
    g = v.groupBy("StockKey", "StockSymbol", "Industry").agg(
        F.min_by("Close", d).alias("Period_Start_Price"),
        F.max_by("Close", d).alias("Period_End_Price"),
        F.sum(F.when(inp, F.col("Volume"))).cast("bigint").alias("Total_Period_Volume"),
        F.count_if(inp).alias("Trading_Days"),
        F.count_if(inp & (r > 0)).alias("Up_Days"),
        F.count_if(inp & (r < 0)).alias("Down_Days"),
        F.avg(F.when(inp, r)).alias("_avg"),
        F.stddev_samp(F.when(inp, r)).alias("_std"),
        F.max_by("Close", "Date").alias("Latest_Close"),
        F.max("Date").alias("Latest_Date"),
        F.max_by("YTDReturn", "Date").alias("YTDReturn"),
        F.max_by("MA10", "Date").alias("_ma10"),
        F.max_by("MA30", "Date").alias("_ma30"))
    return g.where(F.col("Trading_Days") > 0).select(
        "StockSymbol", "Industry", "Latest_Close", "Latest_Date", "Period_Start_Price",
        "Period_End_Price",
        r2(pct_change("Period_End_Price", "Period_Start_Price")).alias("Period_Return_Percent"),
        "Total_Period_Volume", "Trading_Days", "Up_Days", "Down_Days",
        r2("_avg").alias("Avg_Daily_Return"), r2("_std").alias("Return_StdDev"),
        r4(F.col("_avg") / F.nullif(F.col("_std"), F.lit(0.0))).alias("Sharpe_Ratio"),
        "YTDReturn", trend3("_ma10", "_ma30").alias("Trend"))


def index_report(star, symbol: str | None = None, top_n: int = 5, period: str = "month",
                 all_years: bool = False, nulls_last: bool = False) -> DataFrame:
    """API4: one symbol's row, or the top-n members by period return.

    Ranking is by return descending with NULL returns first (set
    ``nulls_last`` to push them down), ties broken by symbol.
    """
    perf = index_period_performance(star, period, all_years, symbol)
    if symbol is not None:
        return perf
    ret = F.col("Period_Return_Percent")
    order = ret.desc_nulls_last() if nulls_last else ret.desc_nulls_first()
    return perf.orderBy(order, F.col("StockSymbol").asc()).limit(top_n)


def industry_performance(report: DataFrame) -> DataFrame:
    """Mean period return per industry over a report, best first."""
    return (report.groupBy("Industry")
            .agg(r4(F.avg("Period_Return_Percent")).alias("AvgPeriodReturn"),
                 F.count("*").alias("Stocks"))
            .orderBy(F.col("AvgPeriodReturn").desc_nulls_last(), "Industry"))


def average_return(report: DataFrame) -> DataFrame:
    """Mean period return over a report (one row; NULL returns skipped)."""
    return report.agg(r4(F.avg("Period_Return_Percent")).alias("AvgPeriodReturn"),
                      F.count("*").alias("Stocks"))


class Warehouse:
    """The four analysis functions bound to one star (the tool surface, API5)."""

    def __init__(self, star):
        self.star = star

    def analyze_stock_price_summary(self, stock_symbol: str, year: int | None = None,
                                    quarter: int | None = None) -> DataFrame:
        """Monthly price summary of one symbol, newest first, with volatility."""
        return price_summary_report(self.star, stock_symbol, year, quarter).orderBy(
            F.col("Year").desc_nulls_first(), F.col("Month").desc_nulls_first())

    def analyze_quarterly_financial_ratios(self, stock_symbol: str, year: int | None = None,
                                           ratio_type: str | None = None) -> DataFrame:
        """Quarterly ratios of one symbol pivoted by (Year, Quarter); the argument
        filters on the ratio's name, as the published tool does."""
        return quarterly_ratio_table(self.star, stock_symbol, year, ratio_type).orderBy(
            "Year", "Quarter")

    def analyze_stock_price_movement(self, stock_symbol: str, from_date: str | None = None,
                                     to_date: str | None = None) -> DataFrame:
        """Daily movement with MA10/MA30, signal and RSI, newest first."""
        rows = movement_rows(self.star, stock_symbol, from_date, to_date)
        return with_indicators(rows).drop("StockKey").orderBy(F.col("Date").desc())

    def analyze_vn30_performance(self, stock_symbol: str | None = None, top_n: int = 5,
                                 period: str = "month") -> DataFrame:
        """Index members' period performance: one symbol or the top n."""
        return index_report(self.star, stock_symbol, top_n, period)

    # ---- the numbers that go with a report --------------------------------------
    def price_summary_facts(self, stock_symbol: str, year: int | None = None,
                            quarter: int | None = None) -> dict[str, DataFrame]:
        """Peak volume and cumulative growth of one symbol's summary rows."""
        rows = price_summary_report(self.star, stock_symbol, year, quarter)
        return {"volume_peak": volume_peak(rows), "cumulative_growth": cumulative_growth(rows)}

    def quarterly_ratio_facts(self, stock_symbol: str, year: int | None = None,
                              ratio_type: str | None = None) -> dict[str, DataFrame]:
        """Ordered ratio rows and the types under each name."""
        rows = quarterly_ratio_rows(self.star, stock_symbol, year, ratio_type)
        return {"rows": ordered_ratio_rows(rows), "types": ratio_types_by_name(rows)}

    def price_movement_facts(self, stock_symbol: str, from_date: str | None = None,
                             to_date: str | None = None) -> dict[str, DataFrame]:
        """Statistics of the daily changes and the latest RSI with its state."""
        rows = movement_rows(self.star, stock_symbol, from_date, to_date)
        return {"statistics": movement_stats(rows), "rsi": latest_rsi_state(with_indicators(rows))}

    def vn30_performance_facts(self, stock_symbol: str | None = None, top_n: int = 5,
                               period: str = "month") -> dict[str, DataFrame]:
        """Mean return of the report and by industry."""
        report = index_report(self.star, stock_symbol, top_n, period)
        return {"average_return": average_return(report), "industries": industry_performance(report)}

    TOOLS = {
        "analyze_stock_price_summary": "Monthly price summary of a stock symbol.",
        "analyze_quarterly_financial_ratios": "Quarterly financial ratios of a stock symbol.",
        "analyze_stock_price_movement": "Daily price movement and technical indicators.",
        "analyze_vn30_performance": "Period performance ranking of the index members.",
    }
