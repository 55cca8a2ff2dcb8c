"""Hand fixtures (FIXTURES.md section 2): edge cases of the views and the API."""

import datetime as dt

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from stockyard.functions.names import canonical_ratio_name, strip_trailing_paren
from stockyard.functions.dates import date_parts
from stockyard.plans import analysis as A
from stockyard.plans import views
from stockyard.sources.frames import FrameStar

D0 = dt.date(2021, 3, 1)


def make_star(spark, series: dict[int, list[tuple[dt.date, float]]]):
    """series: StockKey -> [(date, close)]; open/high/low = close, volume = 100."""
    rows, dates = [], set()
    for key, pts in series.items():
        for d, c in pts:
            tk = d.year * 10000 + d.month * 100 + d.day
            rows.append((tk, key, c, c, c, c, 100))
            dates.add(d)
    fact = spark.createDataFrame(rows, "TimeKey int, StockKey int, Open double, High double, "
                                       "Low double, Close double, Volume bigint")
    dts = spark.createDataFrame([(d,) for d in sorted(dates)], "Date date")
    dim_time = dts.select(*date_parts("Date"))
    comp = spark.createDataFrame(
        [(k, f"S{k}", f"Company {k}", f"S{k}", "Banks" if k % 2 else "Steel", "HOSE", 1.0)
         for k in series],
        "StockKey int, StockSymbol string, CompanyName string, ShortName string, Industry string, "
        "CompanyType string, StockRating double")
    return FrameStar(fact, dim_time, comp)


def days(n, start=D0):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_steady_rise_rsi_100_and_ma_warmup(spark):
    s = make_star(spark, {1: [(d, 10.0 + i) for i, d in enumerate(days(25))]})
    ind = A.with_indicators(A.movement_rows(s)).orderBy("Date").collect()
    # the movement view drops the first day (no previous close)
    assert len(ind) == 24
    assert ind[0]["RSI"] is None                   # no delta on the first row
    assert all(r["RSI"] == 100.0 for r in ind[1:])  # no loss at all
    assert ind[0]["MA10"] == ind[0]["CurrentPrice"]
    assert ind[4]["MA10"] == pytest.approx(sum(r["CurrentPrice"] for r in ind[:5]) / 5)
    # while fewer than 11 rows exist MA10 and MA30 average the same rows: a tie,
    # which the two-way signal reports as Bearish; afterwards the fast mean leads
    assert all(r["MA_Signal"] == "Bearish" for r in ind[:10])
    assert all(r["MA_Signal"] == "Bullish" for r in ind[10:])


def test_flat_series_neutral_and_null_rsi(spark):
    s = make_star(spark, {1: [(d, 5.0) for d in days(5)]})
    ind = A.with_indicators(A.movement_rows(s)).collect()
    assert all(r["DailyChangePercent"] == 0.0 for r in ind)
    assert all(r["RSI"] is None for r in ind)      # 0 / 0
    st = A.movement_stats(A.movement_rows(s)).first()
    assert (st["DaysUp"], st["DaysDown"], st["DaysUnchanged"]) == (0, 0, 4)
    rep = A.index_period_performance(s, period="all").first()
    assert rep["Trend"] == "Neutral"
    assert rep["Period_Return_Percent"] == 0.0


def test_faithful_summary_collapses_identical_days(spark):
    s = make_star(spark, {1: [(d, 5.0) for d in days(5)]})
    faithful = views.price_summary(s).collect()
    assert len(faithful) == 1                      # five equal day rows -> one (D2)
    monthly = views.price_summary_monthly(s).collect()
    assert len(monthly) == 1 and monthly[0]["TotalVolume"] == 500


def test_zero_previous_close_gives_null_change(spark):
    s = make_star(spark, {1: [(days(3)[0], 0.0), (days(3)[1], 2.0), (days(3)[2], 3.0)]})
    rows = views.price_movement(s).orderBy("Date").collect()
    assert rows[0]["DailyChangePercent"] is None
    assert rows[1]["DailyChangePercent"] == 50.0


def test_ytd_base_zero_raises_under_ansi(spark):
    s = make_star(spark, {1: [(days(2)[0], 0.0), (days(2)[1], 2.0)]})
    with pytest.raises(Exception) as e:
        views.index_performance(s).collect()
    assert "DIVIDE_BY_ZERO" in str(e.value) or isinstance(e.value, ArithmeticException)


def test_year_edge_week_53_and_ytd_reset(spark):
    pts = [(d, 10.0 + i) for i, d in enumerate(days(12, dt.date(2020, 12, 28)))]
    s = make_star(spark, {1: pts})
    t = {r["Date"]: r for r in s.dim_time.collect()}
    assert t[dt.date(2021, 1, 3)]["Week"] == 53
    assert t[dt.date(2021, 1, 4)]["Week"] == 1
    perf = {r["Date"]: r for r in views.index_performance(s).collect()}
    assert perf[dt.date(2021, 1, 1)]["YTDReturn"] == 0.0    # new year, new base
    assert perf[dt.date(2020, 12, 31)]["YTDReturn"] == 30.0


def test_period_filter_month_requires_latest_year(spark):
    # the latest month is Jan 2021; Jan 2020 must not be mixed in (D7 intent)
    pts = [(dt.date(2020, 1, 10), 10.0), (dt.date(2020, 1, 11), 20.0),
           (dt.date(2021, 1, 10), 10.0), (dt.date(2021, 1, 11), 11.0)]
    s = make_star(spark, {1: pts})
    r = A.index_period_performance(s, period="month").first()
    assert r["Trading_Days"] == 2 and r["Period_Return_Percent"] == 10.0
    lit = A.index_period_performance(s, period="month", all_years=True).first()
    assert lit["Trading_Days"] == 4


def test_top_n_orders_nulls_first_and_ties_by_symbol(spark):
    feb = dt.date(2021, 2, 26)
    s = make_star(spark, {
        1: [(d, 10.0 + i) for i, d in enumerate(days(3))],
        2: [(d, 10.0 + i) for i, d in enumerate(days(3))],
        3: [(d, 10.0 - i) for i, d in enumerate(days(3))],
        # the latest month starts at 0 -> NULL period return (the year's base is 5)
        4: [(feb, 5.0), (days(3)[0], 0.0), (days(3)[1], 1.0)]})
    top = [r["StockSymbol"] for r in A.index_report(s, top_n=3, period="month").collect()]
    assert top == ["S4", "S1", "S2"]
    top_last = [r["StockSymbol"] for r in
                A.index_report(s, top_n=3, period="month", nulls_last=True).collect()]
    assert top_last == ["S1", "S2", "S3"]
    assert set(top[:2]) <= set(r["StockSymbol"] for r in
                               A.index_report(s, top_n=4, period="month").collect())


def test_ratio_names(spark):
    df = spark.createDataFrame([("TSCĐ / Vốn CSH",), ("(Vay NH+DH)/VCSH",), ("ROE (%)",),
                                ("EPS (VND)",)], "n string")
    got = df.select(strip_trailing_paren("n").alias("a"), canonical_ratio_name("n").alias("b")).collect()
    assert [r["a"] for r in got] == ["TSCĐ / Vốn CSH", "(Vay NH+DH)/VCSH", "ROE", "EPS"]
    assert [r["b"] for r in got] == ["TSCĐ/Vốn CSH", "(Vay NH+DH)/VCSH", "ROE", "EPS"]


def test_quarter_without_trading_days_is_dropped(spark):
    from stockyard.operators.facts import prepare_fact_ratios
    s = make_star(spark, {1: [(d, 1.0) for d in days(3)]})       # only 2021 Q1 trades
    wide = spark.createDataFrame([("S1", 2021, 1, 5.0), ("S1", 2021, 2, 6.0)],
                                 "CP string, `Năm` int, `Kỳ` int, `ROE (%)` double")
    long = prepare_fact_ratios(wide, s.dim_time).collect()
    assert len(long) == 1 and long[0]["TimeKey"] == 20210301 and long[0]["RatioName"] == "ROE"


def test_first_match_lookup_does_not_duplicate(spark):
    from stockyard.operators.facts import prepare_fact_ratios
    s = make_star(spark, {1: [(d, 1.0) for d in days(40)]})      # many days in the quarter
    wide = spark.createDataFrame([("S1", 2021, 1, None)],
                                 "CP string, `Năm` int, `Kỳ` int, `P/B` double")
    long = prepare_fact_ratios(wide, s.dim_time).collect()
    assert len(long) == 1 and long[0]["Value"] == -99999999.0    # NULL -> sentinel


def test_average_return_over_report(spark):
    s = make_star(spark, {1: [(d, 10.0 + i) for i, d in enumerate(days(3))],
                          2: [(d, 10.0) for d in days(3)]})
    rep = A.index_report(s, top_n=5, period="month")
    got = A.average_return(rep).first()
    assert got["Stocks"] == 2 and got["AvgPeriodReturn"] == 10.0     # (20% + 0%) / 2
    ind = {r["Industry"]: r["AvgPeriodReturn"] for r in A.industry_performance(rep).collect()}
    assert ind == {"Banks": 20.0, "Steel": 0.0}
