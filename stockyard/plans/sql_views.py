"""The SQL surface: star tables and analytic views as session views.

``register_views`` exposes a star's tables as temporary views and defines the
analytic views on top of them with CREATE OR REPLACE TEMP VIEW, so SQL users
(and BI tools on the same session) query them by name. ``query_view`` reads a
view with optional equality filters passed as bound parameters - never
formatted into the SQL text. Catalyst plans these exactly like the DataFrame
versions in ``stockyard.plans.views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockyard.functions.rounding import sql_rnd
from stockyard.plans import views

PREFIX = "sy_"


def _r(expr: str, digits: int = 2) -> str:
    return sql_rnd(expr, digits)


def performance_sql(prefix: str = PREFIX) -> str:
    """Index performance in SQL: rows are put in order once, and every measure is
    stated over that order by a named window."""
    return f"""
WITH ranked AS (
  SELECT d.Date, d.Year, d.Quarter, d.Month, p.StockKey, p.Close, p.Volume,
         row_number() OVER by_stock AS place, first_value(p.Close) OVER by_year AS opening,
         lag(p.Close, 1) OVER by_stock AS before
  FROM {prefix}index_price AS p INNER JOIN {prefix}dim_time AS d USING (TimeKey)
  WINDOW by_year AS (PARTITION BY p.StockKey, d.Year ORDER BY d.Date),
         by_stock AS (PARTITION BY p.StockKey ORDER BY d.Year, d.Date)
)
SELECT Date, Year, Quarter, Month, StockSymbol, Industry, Close, Volume,
       {_r('(Close - before) / nullif(before, 0) * 100')} AS DailyReturn,
       {_r('(Close / opening - 1) * 100')} AS YTDReturn,
       {_r('avg(Close) OVER ten')} AS MA10, {_r('avg(Close) OVER thirty')} AS MA30
FROM ranked INNER JOIN {prefix}dim_company USING (StockKey)
WINDOW ten AS (PARTITION BY StockKey ORDER BY place ROWS 9 PRECEDING),
       thirty AS (PARTITION BY StockKey ORDER BY place ROWS 29 PRECEDING)
"""


def register_star(spark: SparkSession, star, prefix: str = PREFIX) -> list[str]:
    """The star's tables as temporary views (dimensions carry the same
    broadcast decisions as the DataFrame plans)."""
    from pyspark.sql import functions as F
    frames = {
        "fact_price": star.fact_price,
        "index_price": star.index_fact_price(),
        "dim_time": F.broadcast(star.dim_time),
        "dim_company": F.broadcast(star.dim_company) if star.company_small else star.dim_company,
    }
    if getattr(star, "fact_ratio", None) is not None:
        frames["fact_ratio"] = star.fact_ratio
        frames["dim_ratio"] = F.broadcast(star.dim_ratio)
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + n for n in frames]


def register_views(spark: SparkSession, star, prefix: str = PREFIX) -> list[str]:
    """K5: create or replace the analytic views by name.

    vw_StockPriceSummary, vw_StockPriceMonthly, vw_QuarterlyFinancialRatios,
    vw_StockPriceMovement come from the DataFrame plans; vw_IndexPerformance
    is defined in SQL.
    """
    register_star(spark, star, prefix)
    made = {
        "vw_StockPriceSummary": views.price_summary(star),
        "vw_StockPriceMonthly": views.price_summary_monthly(star),
        "vw_StockPriceMovement": views.price_movement(star),
    }
    if getattr(star, "fact_ratio", None) is not None:
        made["vw_QuarterlyFinancialRatios"] = views.quarterly_ratios(star)
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    spark.sql(f"CREATE OR REPLACE TEMP VIEW vw_IndexPerformance AS {performance_sql(prefix)}")
    return [*made, "vw_IndexPerformance"]


def query_view(spark: SparkSession, view: str, filters: dict | None = None,
               order_by: str | None = None, limit: int | None = None) -> DataFrame:
    """SELECT * FROM a registered view with equality filters as bound
    parameters (column names are checked against the view's columns)."""
    cols = set(spark.table(view).columns)
    filters = filters or {}
    unknown = [c for c in filters if c not in cols]
    if unknown:
        raise KeyError(f"unknown columns for {view}: {unknown}")
    where = " AND ".join(f"`{c}` = :p{i}" for i, c in enumerate(filters))
    args = {f"p{i}": v for i, v in enumerate(filters.values())}
    sql = f"SELECT * FROM `{view}`" + (f" WHERE {where}" if where else "")
    if order_by:
        parts = []
        for item in order_by.split(","):
            name, *direction = item.split()
            if name not in cols or [d.upper() for d in direction] not in ([], ["ASC"], ["DESC"]):
                raise ValueError(f"bad ORDER BY item: {item!r}")
            parts.append(f"`{name}` {' '.join(direction)}".strip())
        sql += " ORDER BY " + ", ".join(parts)
    if limit is not None:
        sql += " LIMIT :n"
        args["n"] = int(limit)
    return spark.sql(sql, args=args)
