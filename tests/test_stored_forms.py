"""Refreshed views, segmented windows, key index, radix selection, loads that evaluate their batch once."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockyard.operators import key_index as ki
from stockyard.operators import selection
from stockyard.operators.segments import CARRIED, SEGMENT, segmented
from stockyard.plans import long_history, views
from stockyard.plans.flows import StoredWarehouse, daily_flow, load_companies
from stockyard.plans.refresh import LateRowsError, RefreshedViews
from stockyard.plans.registry import FIRST_DAY
from stockyard.sources.frames import FrameStar
from stockyard.sources.star import DerivedStar

from conftest import SMALL


def history(spark, days, stocks=3, seed=1):
    """A star of ``stocks`` with gaps, equal closes and different first days."""
    rng = random.Random(seed)
    rows = []
    for s in range(stocks):
        close = 10.0
        for i in range(s * 7, days):
            if rng.random() < 0.8:
                close = close if rng.random() < 0.2 else round(max(0.1, close * rng.uniform(0.9, 1.1)), 2)
                rows.append((s, dt.date(2019, 11, 1) + dt.timedelta(days=i), close, i))
    prices = spark.createDataFrame(rows, "StockKey int, Date date, Close double, Volume long")
    companies = spark.createDataFrame([(s, f"S{s}", f"S{s}", "I") for s in range(stocks)],
                                      "StockKey int, StockSymbol string, CompanyName string, Industry string")
    return prices, companies


def star_of(prices, companies):
    from stockyard.functions.dates import date_parts, time_key
    fact = prices.select(time_key("Date").alias("TimeKey"), "StockKey", "Close", "Volume")
    return FrameStar(fact, prices.select("Date").distinct().select(*date_parts("Date")), companies, index_keys=[0, 2])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_daily_refreshes_equal_the_views(spark, tmpdir_path):
    prices, companies = history(spark, 90)
    prices = prices.cache()
    star = star_of(prices, companies)
    done = RefreshedViews(spark, f"{tmpdir_path}/views", companies, ["S0", "S2"])
    ends = [dt.date(2019, 11, 20), dt.date(2019, 11, 21), dt.date(2019, 12, 30), dt.date(2020, 1, 2), dt.date(2021, 1, 1)]
    for low, high in zip([dt.date(2000, 1, 1), *ends], ends):
        part = prices.where((F.col("Date") > F.lit(low)) & (F.col("Date") <= F.lit(high)))
        done.refresh(part, str(high))
        if high == ends[2]:
            done.refresh(part, str(high))                      # a repeated load replaces itself
    columns = ["StockKey", *views.MOVEMENT_COLUMNS]
    assert rows_of(done.view("movement").select(columns)) == rows_of(views.price_movement(star, with_key=True).select(columns))
    columns = ["StockKey", *views.PERFORMANCE_COLUMNS]
    assert rows_of(done.view("performance").select(columns)) == rows_of(views.index_performance(star, with_key=True).select(columns))
    with pytest.raises(LateRowsError):
        done.refresh(prices.limit(1), "2021-01-02")            # not later than what is stored
    with pytest.raises(LateRowsError):
        done.refresh(prices.limit(0), "2019-12-01")            # out of order
    assert done.loads() == [str(e) for e in ends]
    again = RefreshedViews(spark, f"{tmpdir_path}/views", companies, ["S0"])
    assert again.state().count() == 3 and again.state(before="2019-11-21").where(F.size("Tail") > 0).count() == 3


def test_failed_refresh_is_run_again(spark, tmpdir_path, monkeypatch):
    prices, companies = history(spark, 60)
    done = RefreshedViews(spark, f"{tmpdir_path}/views", companies, ["S0"], ["movement"])
    first, rest = prices.where("Date < '2019-12-01'"), prices.where("Date >= '2019-12-01'")
    done.refresh(first, "a")
    real = RefreshedViews._write

    def lost(self, df, name, load):
        if name == "state":
            raise OSError("lost")
        real(self, df, name, load)

    monkeypatch.setattr(RefreshedViews, "_write", lost)
    with pytest.raises(OSError):
        done.refresh(rest, "b")
    monkeypatch.undo()
    assert done.view("movement").where("Date >= '2019-12-01'").count() == 0      # does not count yet
    done.refresh(rest, "b")
    assert rows_of(done.view("movement").select(views.MOVEMENT_COLUMNS)) == rows_of(views.price_movement(star_of(prices, companies)))


def test_refresh_reads_batch_and_state_only(spark, tmpdir_path):
    prices, companies = history(spark, 60)
    done = RefreshedViews(spark, f"{tmpdir_path}/views", companies, ["S0"], ["movement"])
    prices.where("Date < '2019-12-20'").write.parquet(f"{tmpdir_path}/old")
    done.refresh(spark.read.parquet(f"{tmpdir_path}/old"), "a")
    seen = []
    real = RefreshedViews._write

    def look(self, df, name, load):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        real(self, df, name, load)

    RefreshedViews._write = look
    try:
        done.refresh(prices.where("Date >= '2019-12-20'"), "b")
    finally:
        RefreshedViews._write = real
    assert seen and all("/old" not in p and "/views/movement" not in p and "/views/state" in p for p in seen)


@pytest.mark.parametrize("segment", [29, 40, 1000])
def test_segmented_views_equal_the_views(spark, segment):
    prices, companies = history(spark, 200)
    star = star_of(prices, companies)
    assert rows_of(long_history.movement(star, segment)) == rows_of(views.price_movement(star))
    assert rows_of(long_history.performance(star, segment)) == rows_of(views.index_performance(star))


def test_one_long_history_is_many_even_tasks(spark):
    from pyspark.sql import Window
    n, segment = 200_000, 5_000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    cut = segmented(rows, "k", "at", 29, segment)
    size = {r[0]: r[1] for r in cut.groupBy(SEGMENT).count().collect()}
    assert len(size) >= n // segment and max(size.values()) <= segment + 29
    w = Window.partitionBy("k", SEGMENT).orderBy("at")
    got = cut.withColumn("m", F.avg("v").over(w.rowsBetween(-29, 0))).where(~F.col(CARRIED))
    want = rows.withColumn("m", F.avg("v").over(Window.partitionBy("k").orderBy("at").rowsBetween(-29, 0)))
    assert got.count() == n and got.join(want.select("at", F.col("m").alias("w")), "at").where("m <> w").isEmpty()
    with pytest.raises(ValueError):
        segmented(rows, "k", "at", 29, 20)


def test_key_index_answers_like_the_joins(spark):
    rng = random.Random(2)
    keys = [1, 2, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 100_000, 2**31 - 1, 0, -1, -32_768, -40_000]
    old = {(19970101 + rng.randrange(4), rng.choice(keys)) for _ in range(40)}
    new = [(19970102 + rng.randrange(5), rng.choice(keys), v) for v in range(80)]
    target = spark.createDataFrame(sorted(old), "TimeKey int, StockKey int")
    batch = spark.createDataFrame(new, "TimeKey int, StockKey int, v int")
    half = ki.key_index(target.where("StockKey % 2 = 0"))
    index = ki.merged(half, ki.key_index(target.where("StockKey % 2 <> 0")))
    want = {}
    for t, s, v in new:
        if (t, s) not in old:
            want[t, s] = min(v, want.get((t, s), v))
    assert sorted(tuple(r) for r in ki.rows_to_insert(index, batch).collect()) == sorted((*k, v) for k, v in want.items())
    count = {}
    for t, s, _ in new:
        count[t, s] = count.get((t, s), 0) + 1
    assert sorted(tuple(r) for r in ki.key_conflicts(index, batch).select("TimeKey", "StockKey", "BatchRows", "InTarget").collect()) == sorted(
        (*k, n, k in old) for k, n in count.items() if n > 1 or k in old)
    assert sorted(tuple(r) for r in ki.duplicates(batch).collect()) == sorted((*k, n) for k, n in count.items() if n > 1)
    assert ki.duplicates(target).collect() == [] and ki.rows_to_insert(index.limit(0), batch).count() == len(count)


def test_insert_by_the_index_does_not_scan_the_fact(spark, tmpdir_path):
    s = DerivedStar(spark, SMALL)
    ki.key_index(s.fact_price.where("TimeKey < 19970101")).write.parquet(f"{tmpdir_path}/index")
    batch = spark.range(5).selectExpr("19970101 AS TimeKey", "cast(id as int) AS StockKey", "id AS v")
    plan = ki.rows_to_insert(spark.read.parquet(f"{tmpdir_path}/index"), batch)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and f"{tmpdir_path}/index" in plan


def test_selection_against_numpy(spark):
    rng = np.random.default_rng(4)
    tiny = 5e-324
    columns = {
        "normal": rng.normal(size=500), "wide": np.exp(rng.uniform(-700, 700, 500)) * rng.choice([-1, 1], 500),
        "few": rng.integers(0, 3, 500).astype(float), "one": np.full(500, 7.25), "close": 1 + np.arange(500) * 2.0**-52,
        "odd": np.array([0.0, -0.0, tiny, -tiny, 2.2e-308, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0] * 50),
        "ints": rng.integers(-2**50, 2**50, 500).astype(float)}
    df = spark.createDataFrame([tuple(float(c[i]) for c in columns.values()) for i in range(500)],
                               ", ".join(f"{c} double" for c in columns)).repartition(4)
    ranks = [0, 1, 17, 124, 125, 249, 250, 374, 375, 498, 499]
    got = selection.values_at(df, {c: ranks for c in columns})
    for c, v in columns.items():
        v = np.sort(v)
        assert [got[c, k] for k in ranks] == [v[k] for k in ranks], c
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (None,), (3.0,)], "x double")
    found = selection.values_at(nan, {"x": [0, 1, 2]})
    assert (found["x", 0], found["x", 1]) == (1.0, 3.0) and math.isnan(found["x", 2])
    assert selection.exact_quantiles(nan.where("x < 4"), {"x": 2}, (0.25, 0.5)) == {("x", 0.25): 1.5, ("x", 0.5): 2.0}
    assert selection.exact_quantiles(nan.limit(0), {"x": 0}, (0.5,)) == {("x", 0.5): None}


def test_daily_flow_evaluates_its_source_once(spark, tmpdir_path):
    s = DerivedStar(spark, SMALL)
    wh = StoredWarehouse(spark, f"{tmpdir_path}/wh")
    load_companies(wh, *s.company_feeds())
    quotes = s.staging_quotes()
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    n = quotes.count()
    r = daily_flow(wh, quotes.mapInArrow(count, quotes.schema), start=FIRST_DAY)
    assert r.status == "loaded" and met.value == n == wh.read("Fact_StockPrice").count() == r.metrics["Rows"]
    met.value = 0
    assert daily_flow(wh, quotes.mapInArrow(count, quotes.schema), apply_high_water=False).status == "loaded"
    assert met.value == n == wh.read("Fact_StockPrice").count()
    # a batch without rows (decided at runtime) loads nothing and does not hang
    none = quotes.mapInArrow(count, quotes.schema).where("close < -1")
    assert daily_flow(wh, none, apply_high_water=False).status == "skipped"
    wh.load("Fact_StockPrice", wh.read("Fact_StockPrice").where("Volume < -1"))
