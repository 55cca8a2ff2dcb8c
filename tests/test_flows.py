"""Load flows over a parquet warehouse, and the streaming daily load."""

import os

import pytest
from pyspark.sql import functions as F

from stockyard.operators.load import DuplicateKeyError
from stockyard.operators.quality import EmptyInputError
from stockyard.plans import analysis as A
from stockyard.plans import views
from stockyard.plans.flows import StoredWarehouse, daily_flow, load_companies, quarterly_flow
from stockyard.plans.registry import FIRST_DAY
from stockyard.sources.feeds import write_damaged_quotes, write_quote_feed
from stockyard.sources.star import DerivedStar
from stockyard.streaming.daily import start_daily_stream

from conftest import SMALL


def load_all(spark, root):
    """First load of an empty warehouse: dimensions, prices, ratios."""
    s = DerivedStar(spark, SMALL)
    wh = StoredWarehouse(spark, root, index_symbols=[f"Supplier#{i:09d}" for i in range(30)])
    overview, profile = s.company_feeds()
    assert quarterly_flow(wh, s.ratio_wide().limit(0), overview, profile, s.definition_feed()).status == "skipped"
    assert quarterly_flow(wh, s.ratio_wide(), overview, profile, s.definition_feed()).status == "dimensions"
    assert daily_flow(wh, s.staging_quotes(), start=FIRST_DAY).status == "loaded"
    r2 = quarterly_flow(wh, s.ratio_wide(), overview, profile, s.definition_feed())
    assert r2.status == "loaded" and r2.metrics["unresolved"] == 0
    return s, wh


def state(wh):
    return sorted(wh.fact_price.join(wh.dim_company.select("StockKey", "StockSymbol"), "StockKey").collect())


def test_flows_load_and_rerun_is_idempotent(spark, tmpdir_path):
    s, wh = load_all(spark, os.path.join(tmpdir_path, "wh"))
    n_price = wh.read("Fact_StockPrice").count()
    n_ratio = wh.read("Fact_FinancialRatios").count()
    assert n_price == s.fact_price.count()
    assert n_ratio == s.fact_ratio.count()
    # re-running the same loads adds nothing
    daily_flow(wh, s.staging_quotes(), apply_high_water=False)
    overview, profile = s.company_feeds()
    quarterly_flow(wh, s.ratio_wide(), overview, profile, s.definition_feed())
    assert wh.read("Fact_StockPrice").count() == n_price
    assert wh.read("Fact_FinancialRatios").count() == n_ratio
    # the high-water mark skips everything already loaded
    assert daily_flow(wh, s.staging_quotes()).status == "skipped"


def test_views_over_stored_warehouse_match_derived_star(spark, tmpdir_path):
    s, wh = load_all(spark, os.path.join(tmpdir_path, "wh"))
    # the stored fact keeps prices as decimal(10,4): compare at that precision
    a = views.price_movement(wh).select("StockSymbol", "Date", "CurrentPrice")
    b = views.price_movement(s).select(
        "StockSymbol", "Date", F.col("CurrentPrice").cast("decimal(10,4)").cast("double"))
    assert sorted(a.collect()) == sorted(b.collect())
    top = A.index_report(wh, top_n=3).collect()
    assert len(top) == 3


def test_failures_leave_nothing_behind(spark, tmpdir_path, monkeypatch):
    s = DerivedStar(spark, SMALL)
    quotes = s.staging_quotes()
    clean = StoredWarehouse(spark, os.path.join(tmpdir_path, "clean"))
    daily_flow(clean, quotes, companies=s.company_feeds(), start=FIRST_DAY)
    wh = StoredWarehouse(spark, os.path.join(tmpdir_path, "wh"))
    with pytest.raises(EmptyInputError):                       # gates first: nothing is written
        daily_flow(wh, quotes, start=FIRST_DAY)
    assert wh.dim_time.isEmpty()
    load_companies(wh, *s.company_feeds())
    real = StoredWarehouse.load

    def fails_at_the_fact(self, table, rows, strict=False):
        if table == "Fact_StockPrice":
            raise OSError("lost")
        return real(self, table, rows, strict)

    monkeypatch.setattr(StoredWarehouse, "load", fails_at_the_fact)
    with pytest.raises(OSError):
        daily_flow(wh, quotes, start=FIRST_DAY)
    monkeypatch.undo()
    assert not wh.dim_time.isEmpty()
    assert daily_flow(wh, quotes, start=FIRST_DAY).status == "loaded"
    assert state(wh) == state(clean)


def test_strict_mode_and_unresolved_symbols(spark, tmpdir_path):
    s, wh = load_all(spark, os.path.join(tmpdir_path, "wh"))
    with pytest.raises(DuplicateKeyError):
        daily_flow(wh, s.staging_quotes(), apply_high_water=False, strict=True)
    strange = spark.createDataFrame([("2030-01-02", "NEW", 1.0, 1.0, 1.0, 1.0, 5.0)],
                                    "time string, MaCK string, open double, high double, low double, close double, volume double")
    r = daily_flow(wh, strange, until="2031-01-01")
    assert r.metrics["Unresolved"] == 1


def test_stream_quarantines_malformed_lines(spark, tmpdir_path):
    s = DerivedStar(spark, SMALL)
    wh = StoredWarehouse(spark, os.path.join(tmpdir_path, "wh"))
    load_companies(wh, *s.company_feeds())
    src = os.path.join(tmpdir_path, "incoming")
    write_damaged_quotes(s, src)
    start_daily_stream(spark, wh, src, os.path.join(tmpdir_path, "ckpt")).awaitTermination(300)
    day = F.dayofmonth(F.to_date(F.col("time")))
    good = s.staging_quotes().where(day > 6).count()
    assert wh.read("Fact_StockPrice").count() == good
    assert spark.read.parquet(f"{wh.root}/quarantine/quotes").count() == s.staging_quotes().count() - good


def test_streaming_daily_load(spark, tmpdir_path):
    s = DerivedStar(spark, SMALL)
    wh = StoredWarehouse(spark, os.path.join(tmpdir_path, "wh"))
    overview, profile = s.company_feeds()
    load_companies(wh, overview, profile)
    src = os.path.join(tmpdir_path, "incoming")
    write_quote_feed(s, src, corrupt_first_day=False)
    q = start_daily_stream(spark, wh, src, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(300)
    assert wh.read("Fact_StockPrice").count() == s.fact_price.count()
    # a second run over the same folder finds nothing new
    q2 = start_daily_stream(spark, wh, src, os.path.join(tmpdir_path, "ckpt"))
    q2.awaitTermination(300)
    assert wh.read("Fact_StockPrice").count() == s.fact_price.count()


def test_quarterly_flow_reports_unresolved_ratio_in_literal_mode(spark, tmpdir_path):
    s = DerivedStar(spark, SMALL)
    wh = StoredWarehouse(spark, os.path.join(tmpdir_path, "wh"))
    overview, profile = s.company_feeds()
    load_companies(wh, overview, profile)
    daily_flow(wh, s.staging_quotes(), apply_high_water=False)
    r = quarterly_flow(wh, s.ratio_wide(), overview, profile, s.definition_feed(), normalise=False)
    assert r.status == "loaded" and r.metrics["unresolved"] == 1    # 'TSCĐ/Vốn CSH'
    names = {row["RatioName"] for row in wh.read("Dim_Ratio").collect()}
    assert "TSCĐ / Vốn CSH" in names
    # three of the four ratio columns resolve
    per_quarter = wh.read("Fact_FinancialRatios").groupBy("TimeKey", "StockKey").count()
    assert per_quarter.agg(F.max("count")).first()[0] == 3
