"""The SQL surface: named views, bound parameters, WINDOW clause."""

import pytest
from pyspark.sql import functions as F

from stockyard.plans import views
from stockyard.plans.sql_views import query_view, register_views
from stockyard.sources.star import DerivedStar

from conftest import SMALL


def test_views_registered_and_parameterised(spark):
    s = DerivedStar(spark, SMALL)
    names = register_views(spark, s)
    assert "vw_IndexPerformance" in names and "vw_StockPriceSummary" in names
    sym = s.dim_company.orderBy("StockKey").first()["StockSymbol"]
    got = query_view(spark, "vw_StockPriceMovement", {"StockSymbol": sym}, "Date DESC", limit=3)
    rows = got.collect()
    assert len(rows) == 3 and all(r["StockSymbol"] == sym for r in rows)
    assert rows[0]["Date"] >= rows[1]["Date"] >= rows[2]["Date"]
    with pytest.raises(KeyError):
        query_view(spark, "vw_StockPriceMovement", {"nope": 1})
    with pytest.raises(ValueError):
        query_view(spark, "vw_StockPriceMovement", order_by="Date; DROP TABLE x")


def test_sql_performance_view_equals_dataframe_view(spark):
    s = DerivedStar(spark, SMALL)
    register_views(spark, s)
    a = spark.table("vw_IndexPerformance")
    b = views.index_performance(s)
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())


def test_warehouse_tool_surface_single_symbol(spark):
    from stockyard.plans import analysis as A
    s = DerivedStar(spark, SMALL)
    api = A.Warehouse(s)
    sym = s.dim_company.orderBy("StockKey").first()["StockSymbol"]
    summ = api.analyze_stock_price_summary(sym, year=1998).collect()
    assert summ and all(r["StockSymbol"] == sym and r["Year"] == 1998 for r in summ)
    assert [(r["Year"], r["Month"]) for r in summ] == sorted(
        [(r["Year"], r["Month"]) for r in summ], reverse=True)
    ratios = api.analyze_quarterly_financial_ratios(sym, ratio_type="ROE").collect()
    assert ratios and all(r["StockSymbol"] == sym and r["ROE"] is not None for r in ratios)
    mv = api.analyze_stock_price_movement(sym, from_date="1998-01-01", to_date="1998-12-31").collect()
    assert mv and all(r["StockSymbol"] == sym for r in mv)
    # a symbol filter applied first gives the same rows as filtering the all-symbol result
    everyone = A.index_period_performance(s).where(F.col("StockSymbol") == sym).collect()
    one = api.analyze_vn30_performance(sym).collect()
    assert sorted(one) == sorted(everyone)
