"""Plan checks: what reaches the scan, how many shuffles, no Python in the hot path."""

import pytest

from stockyard.plans import analysis as A
from stockyard.plans import views
from stockyard.plans.flows import StoredWarehouse, daily_flow
from stockyard.plans.registry import FIRST_DAY, QUERIES
from stockyard.sources.star import DerivedStar

from conftest import SMALL

# Queries that write feed files first (their plans depend on a fresh folder).
WRITES_FILES = {"conform_union", "quarantine_bad_rows", "file_routing", "quote_ingest_good", "history_window",
                "company_ingest", "definition_ingest", "daily_flow_rerun", "quarterly_flow_state",
                "movement_refreshed", "performance_refreshed", "refresh_state", "vector_store_topk"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_members_are_kept_before_any_shuffle(spark):
    p = plan(views.index_performance(DerivedStar(spark, SMALL)))
    # the plan is printed top down: the semi-join on the members' keys stands below the bars' partial aggregation
    assert p.index("LeftSemi") > p.rindex("partial_max_by")


def test_scan_reads_only_needed_columns(spark):
    df = views.price_movement(DerivedStar(spark, SMALL))
    p = plan(df)
    assert "l_discount" not in p and "l_returnflag" not in p and "l_comment" not in p


def exchanges(p: str) -> int:
    return p.count("Exchange hashpartitioning(StockKey")


def test_bars_are_aggregated_in_the_map_tasks(spark):
    p = plan(views.price_movement(DerivedStar(spark, SMALL)))
    assert "partial_max_by" in p and "RepartitionBy" not in p and "REPARTITION" not in p


@pytest.mark.parametrize("view", [views.price_movement, views.price_summary, views.index_performance])
def test_views_over_trades_shuffle_bars_then_stocks(spark, view):
    # one exchange for the bars' aggregation by (stock, day), one by stock for all
    # windows; the company join is a broadcast of a table that passed the size check
    assert exchanges(plan(view(DerivedStar(spark, SMALL)))) == 2


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    s = DerivedStar(spark, SMALL)
    wh = StoredWarehouse(spark, str(tmp_path_factory.mktemp("wh")), index_symbols=[f"Supplier#{i:09d}" for i in range(5)])
    daily_flow(wh, s.staging_quotes(), companies=s.company_feeds(), start=FIRST_DAY)
    return wh


@pytest.mark.parametrize("view", [views.price_movement, views.price_summary, views.index_performance])
def test_views_over_the_stored_star_shuffle_once(stored, view):
    assert exchanges(plan(view(stored))) <= 1


def test_symbol_reaches_the_fact_scan(stored):
    key = stored.dim_company.where("StockSymbol = 'Supplier#000000003'").first()["StockKey"]
    for df in (A.movement_rows(stored, "Supplier#000000003"), A.price_summary_report(stored, "Supplier#000000003")):
        assert f"EqualTo(StockKey,{key})" in plan(df)


def test_symbol_reaches_the_ratio_fact(spark, stored):
    ratios = spark.range(1).selectExpr("19970102 TimeKey", "1 StockKey", "1 RatioKey", "1.0 Value")
    stored.load("Fact_FinancialRatios", ratios)
    key = stored.dim_company.where("StockSymbol = 'Supplier#000000003'").first()["StockKey"]
    p = plan(A.quarterly_ratio_rows(stored, "Supplier#000000003"))
    scan = next(x for x in p.splitlines() if "Fact_FinancialRatios" in x)
    assert f"EqualTo(StockKey,{key})" in scan


def test_a_batch_is_compared_with_its_own_years_only(spark, stored):
    batch = stored.read("Fact_StockPrice").where("TimeKey between 19970301 and 19970305")
    p = plan(stored.around("Fact_StockPrice", batch))
    assert "PartitionFilters: [isnotnull(Year" in p and "1997" in p.split("PartitionFilters")[1][:200]
    assert stored.around("Fact_StockPrice", batch).count() == batch.count()


def test_top_k_per_query_is_limited_before_the_shuffle(spark):
    df = QUERIES["cosine_topk_symbol"](spark, SMALL)
    p = plan(df)
    assert "WindowGroupLimit" in p and "Partial" in p


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES_FILES))
def test_no_python_udf_in_any_plan(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                 "ExistingRDD"):
        assert node not in p, f"{name} runs Python: {node}"


def test_views_over_trades_scan_them_once(spark):
    for view in (views.price_movement, views.price_summary, views.index_performance):
        assert plan(view(DerivedStar(spark, SMALL))).count("lineitem.parquet") == 1
