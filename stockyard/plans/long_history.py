"""The movement and performance views over histories too long for one task a stock.

The same columns as ``views``, with windows by (stock, segment). Frames that look back a bounded number of
rows are fed by carried rows; the first close of the year has no such bound, so it is a grouped minimum, joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.functions.indicators import pct_change
from stockyard.functions.rounding import r2
from stockyard.operators.segments import CARRIED, SEGMENT, SEGMENT_ROWS, segmented
from stockyard.plans.views import MOVEMENT_COLUMNS, PERFORMANCE_COLUMNS, company_dim, dated, index_rows

MOVEMENT_LOOKBACK, PERFORMANCE_LOOKBACK = 20, 29     # a mean of 20 changes reads 21 closes; a mean of 30 closes, 30


def movement(star, segment: int = SEGMENT_ROWS) -> DataFrame:
    """V-MV. A stock's first row, which has no change, is dropped between the windows, as in the view; so
    is the first carried row of a segment, which no frame of an own row reaches."""
    rows = dated(star, star.fact_price.select("TimeKey", "StockKey", "Close"), ["Date", "Year", "Month"]).drop("TimeKey")
    w = Window.partitionBy("StockKey", SEGMENT).orderBy("Date")
    daily = segmented(rows, "StockKey", "Date", MOVEMENT_LOOKBACK, segment).withColumn("PrevClose", F.lag("Close").over(w))
    change = pct_change("Close", "PrevClose")
    means = daily.where(F.col("PrevClose").isNotNull()).select(
        "*", r2(change).alias("DailyChangePercent"), F.col("Close").alias("CurrentPrice"),
        r2(F.avg(change).over(w.rowsBetween(-4, 0))).alias("FiveDayAvgChange"),
        r2(F.avg(change).over(w.rowsBetween(-19, 0))).alias("TwentyDayAvgChange"))
    return means.where(~F.col(CARRIED)).join(company_dim(star, ["StockSymbol", "CompanyName"]), "StockKey").select(*MOVEMENT_COLUMNS)


def performance(star, segment: int = SEGMENT_ROWS) -> DataFrame:
    """V-PF."""
    rows = index_rows(star).select("StockKey", "StockSymbol", "Industry", "Date", "Year", "Quarter", "Month", "Close", "Volume")
    opens = rows.groupBy("StockKey", "Year").agg(F.min_by("Close", "Date").alias("base"))
    w = Window.partitionBy("StockKey", SEGMENT).orderBy("Date")
    out = segmented(rows, "StockKey", "Date", PERFORMANCE_LOOKBACK, segment).select(
        "*", r2(pct_change("Close", F.lag("Close").over(w))).alias("DailyReturn"),
        r2(F.avg("Close").over(w.rowsBetween(-9, 0))).alias("MA10"),
        r2(F.avg("Close").over(w.rowsBetween(-29, 0))).alias("MA30")).where(~F.col(CARRIED))
    return out.join(opens, ["StockKey", "Year"]).withColumn(
        "YTDReturn", r2((F.col("Close") / F.col("base") - 1) * 100)).select(*PERFORMANCE_COLUMNS)
