"""Properties and brute-force checks on small inputs."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockyard.functions.dates import date_parts
from stockyard.functions.rounding import rnd
from stockyard.plans import analysis as A
from stockyard.sources.frames import FrameStar

from conftest import SMALL


def star_of(spark, closes_by_key):
    rows, dates = [], set()
    d0 = dt.date(2022, 1, 3)
    for key, closes in closes_by_key.items():
        for i, c in enumerate(closes):
            d = d0 + dt.timedelta(days=i)
            rows.append((d.year * 10000 + d.month * 100 + d.day, key, c, c, c, c, 10))
            dates.add(d)
    fact = spark.createDataFrame(rows, "TimeKey int, StockKey int, Open double, High double, "
                                       "Low double, Close double, Volume bigint")
    dim_time = spark.createDataFrame([(d,) for d in sorted(dates)], "Date date").select(
        *date_parts("Date"))
    comp = spark.createDataFrame([(k, f"S{k}", f"S{k}", f"S{k}", "X", "Y", 1.0) for k in closes_by_key],
                                 "StockKey int, StockSymbol string, CompanyName string, "
                                 "ShortName string, Industry string, CompanyType string, "
                                 "StockRating double")
    return FrameStar(fact, dim_time, comp)


def pandas_indicators(closes):
    """The indicator definitions, computed with pandas on one symbol's rows
    (after the view's first row is dropped)."""
    s = pd.Series(closes[1:], dtype="float64")
    ma10 = s.rolling(10, min_periods=1).mean()
    ma30 = s.rolling(30, min_periods=1).mean()
    delta = s.diff()
    gain = delta.clip(lower=0).rolling(14, min_periods=1).mean()
    loss = (-delta.clip(upper=0)).rolling(14, min_periods=1).mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = 100 - 100 / (1 + gain / loss)
    return ma10, ma30, rsi


def test_indicators_match_pandas_on_random_series(spark):
    rng = np.random.default_rng(7)
    series = {k: [float(x) for x in np.round(50 + np.cumsum(rng.normal(0, 1, 60)), 2)]
              for k in (1, 2, 3)}
    series[2][10:16] = [series[2][10]] * 6              # flat stretch: 0/0 RSI windows
    s = star_of(spark, series)
    got = A.with_indicators(A.movement_rows(s)).orderBy("StockKey", "Date").collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r["StockKey"], []).append(r)
    for k, closes in series.items():
        ma10, ma30, rsi = pandas_indicators(closes)
        rows = by_key[k]
        assert len(rows) == len(closes) - 1
        for i, r in enumerate(rows):
            assert r["MA10"] == pytest.approx(ma10[i], rel=1e-12)
            assert r["MA30"] == pytest.approx(ma30[i], rel=1e-12)
            if math.isnan(rsi[i]):
                assert r["RSI"] is None
            else:
                assert r["RSI"] == pytest.approx(rsi[i], rel=1e-9)


def test_ma1_is_close_and_counts_add_up(spark):
    s = star_of(spark, {1: [10.0, 11.0, 11.0, 9.0, 12.0, 12.0]})
    rows = A.movement_rows(s)
    one_row = Window.partitionBy("StockKey").orderBy("Date").rowsBetween(0, 0)
    ma1 = rows.select("CurrentPrice", F.avg("CurrentPrice").over(one_row).alias("ma1")).collect()
    assert all(r["ma1"] == r["CurrentPrice"] for r in ma1)
    st_ = A.movement_stats(rows).first()
    assert st_["DaysUp"] + st_["DaysDown"] + st_["DaysUnchanged"] == rows.count()


@settings(max_examples=40, deadline=None)
@given(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False))
def test_rounding_rule_matches_decimal_half_up(spark, x):
    from decimal import ROUND_HALF_UP, Decimal
    got = spark.range(1).select(rnd(F.lit(x), 2).alias("r")).first()["r"]
    pinned = Decimal(repr(x)).quantize(Decimal("0.00000001"), rounding=ROUND_HALF_UP)
    want = float(pinned.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
    assert got == want


def test_lsh_scores_are_exact_and_recall_reasonable(spark):
    from stockyard.plans.registry import QUERIES
    lsh = QUERIES["lsh_topk"](spark, SMALL).collect()
    exact = QUERIES["cosine_topk"](spark, SMALL).collect()
    emb = {r["vec_id"]: np.array(r["embedding"], dtype="float64")
           for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    queries = {}
    for vid, lab in sorted(labels.items()):
        queries.setdefault(lab, vid)                      # lowest id per label
    for r in lsh:
        q, v = emb[queries[r["QueryLabel"]]], emb[r["VecId"]]
        cos = float(q @ v / (np.linalg.norm(q) * np.linalg.norm(v)))
        assert r["Score"] == pytest.approx(round(cos, 6), abs=2e-6)
    got = {(r["QueryLabel"], r["VecId"]) for r in lsh}
    want = {(r["QueryLabel"], r["VecId"]) for r in exact}
    assert len(got & want) / len(want) >= 0.5
