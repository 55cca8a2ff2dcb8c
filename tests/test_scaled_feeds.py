"""Queries over tables of their own: ratings that outgrow a type, feeds derived once, files that do not follow the symbols."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stockyard.operators.evolve import narrowed
from stockyard.sources import feeds, star

from conftest import SMALL


@pytest.fixture()
def tables(spark, tmpdir_path):
    """The small tables with 40 suppliers, one with a rating of 10.00."""
    root = f"{tmpdir_path}/tables"
    os.makedirs(root)
    for t in star.TABLE_NAMES:
        if t not in ("supplier", "lineitem"):
            os.symlink(f"{SMALL}/{t}.parquet", f"{root}/{t}.parquet")
    copies = F.explode(F.sequence(F.lit(0), F.lit(3)))
    s = spark.read.parquet(f"{SMALL}/supplier.parquet").withColumn("c", copies)
    s = s.withColumns({"s_suppkey": F.col("s_suppkey") + 10 * F.col("c"), "s_nationkey": (F.col("s_nationkey") + 6 * F.col("c")) % 25})
    s = s.withColumns({"s_name": F.format_string("Supplier#%09d", "s_suppkey"),
                       "s_acctbal": F.when(F.col("s_suppkey") == 17, 9999.0).otherwise(F.col("s_acctbal"))})
    s.drop("c").write.parquet(f"{root}/supplier.parquet")
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("c", copies)
    li.withColumn("l_suppkey", F.col("l_suppkey") + 10 * F.col("c")).drop("c").write.parquet(f"{root}/lineitem.parquet")
    return root


def test_a_rating_that_outgrows_the_type_stays(spark, tables):
    got = {r.StockKey: r.StockRating for r in entry.queries()["schema_downgraded"](spark, tables).collect()}
    assert len(got) == 40 and got[17] == 10.0
    small = spark.sql("SELECT CAST(1.25 AS DECIMAL(5,2)) AS r")
    assert narrowed(small, "r", 3, 2).schema["r"].dataType.simpleString() == "decimal(3,2)"


def test_ratio_files_hold_many_symbols(spark, tables, tmpdir_path):
    s = star.DerivedStar(spark, tables)
    feeds.write_ratio_feed(s, f"{tmpdir_path}/ratios")
    files = [f for _, _, names in os.walk(f"{tmpdir_path}/ratios") for f in names if f.endswith(".csv")]
    assert 0 < len(files) <= 3
    rows = entry.queries()["conform_union"](spark, tables)
    assert rows.count() == s.ratio_wide().count() and rows.where("`P/B` is null").count() > 0


@pytest.mark.parametrize("name", ["daily_flow_rerun", "quarterly_flow_state"])
def test_feeds_are_derived_once(spark, tables, monkeypatch, name):
    feed = {"daily_flow_rerun": "staging_quotes", "quarterly_flow_state": "ratio_wide"}[name]
    seen, whole = [], getattr(star.DerivedStar, feed)
    reads = spark.sparkContext.accumulator(0)

    def counted(self):
        seen.append(1)
        return whole(self).mapInArrow(lambda batches: (reads.add(b.num_rows) or b for b in batches), whole(self).schema)
    monkeypatch.setattr(star.DerivedStar, feed, counted)
    rows = whole(star.DerivedStar(spark, tables)).count()
    assert entry.queries()[name](spark, tables).count() > 0
    assert reads.value == rows


def test_summary_tasks_follow_the_rows(spark, tables, monkeypatch):
    from stockyard.plans import views
    monkeypatch.setattr(views, "MONTH_ROWS", 1_000)
    s = star.DerivedStar(spark, tables)
    trades = s.table("lineitem").count()
    plan = views.price_summary(s)._jdf.queryExecution().executedPlan().toString()
    assert f"{-(-trades // 1_000)}), REPARTITION_BY_NUM" in plan.replace(f", {-(-trades // 1_000)})", f"{-(-trades // 1_000)})")


def test_vendor_files_are_put_in_place_by_tasks(spark, tables, monkeypatch, tmpdir_path):
    seen = []
    monkeypatch.setattr(feeds, "write_csv", lambda df, path, **named: seen.append(named["options"]))
    feeds.write_vendor_quotes(star.DerivedStar(spark, tables), f"{tmpdir_path}/vendor")
    assert seen == [{"mapreduce.fileoutputcommitter.algorithm.version": "2"}]
