"""Key handling, incremental loads, quality gates, ingest and evolution."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockyard.operators import dims, load, quality
from stockyard.operators.conform import conform, pivot_first, unpivot
from stockyard.operators.evolve import change_decimal, create_tables
from stockyard.schemas import QUOTE_SCHEMA
from stockyard.sources import files

from conftest import SMALL


def test_insert_ignore_twice_is_once(spark):
    t = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], "a int, b int, v double")
    b = spark.createDataFrame([(2, 1, 9.0), (3, 1, 3.0), (3, 1, 4.0)], "a int, b int, v double")
    once = load.insert_ignore(t, b, ["a", "b"])
    twice = load.insert_ignore(once, b, ["a", "b"])
    assert sorted(once.collect()) == sorted(twice.collect())
    got = {(r.a, r.b): r.v for r in once.collect()}
    assert got == {(1, 1): 1.0, (2, 1): 2.0, (3, 1): 3.0}   # existing kept, first of batch


def test_first_key_insert_differs_from_composite(spark):
    t = spark.createDataFrame([(1, 1)], "a int, b int")
    b = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert load.new_by_first_key(t, b, ["a", "b"]).collect() == [(2, 1)]
    assert load.rows_to_insert(t, b, ["a", "b"]).count() == 2


def test_strict_append_raises_on_duplicate(spark):
    t = spark.createDataFrame([(1, 1)], "a int, b int")
    with pytest.raises(load.DuplicateKeyError):
        load.strict_append(t, spark.createDataFrame([(1, 1)], "a int, b int"), ["a", "b"])
    with pytest.raises(load.DuplicateKeyError):
        load.strict_append(t, spark.createDataFrame([(5, 1), (5, 1)], "a int, b int"), ["a", "b"])
    ok = load.strict_append(t, spark.createDataFrame([(2, 1)], "a int, b int"), ["a", "b"])
    assert ok.count() == 2


def test_high_water_on_empty_time_dimension(spark):
    empty = spark.createDataFrame([], "Date date")
    q = spark.createDataFrame([("2019-12-31", "A"), ("2020-01-01", "A"), ("2020-02-01", "A")],
                              "time string, MaCK string")
    got = load.rows_after_high_water(q, empty, until="2020-01-31").collect()
    assert [r.time for r in got] == ["2020-01-01"]


def test_allocate_keys_stable_and_bucketed(spark):
    old = spark.createDataFrame([("B", 1), ("A", 2)], "s string, k int")
    new = spark.createDataFrame([("A",), ("C",), ("D",), ("C",)], "s string")
    got = {r.s: r.k for r in dims.allocate_keys(new, old, "s", "k").collect()}
    order = sorted("CD", key=lambda x: hashlib.md5(x.encode()).hexdigest())
    assert got == {"A": 2, order[0]: 3, order[1]: 4}
    big = spark.range(1000).select(F.format_string("n%04d", "id").alias("s"))
    keyed = {r.s: r.k for r in dims.allocate_keys(big, None, "s", "k").collect()}
    by_hash = sorted(keyed, key=lambda x: (hashlib.md5(x.encode()).hexdigest(), x))
    assert [keyed[s] for s in by_hash] == list(range(1, 1001))     # dense, in one order at any size


def test_quality_reports(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "toolongvalue"), (None, "x")], "k int, s string")
    rep = quality.pk_report({"t": (df, ["k"])}).first()
    assert (rep.Rows, rep.DuplicateKeys, rep.DuplicateRows) == (3, 1, 2)
    nul = quality.null_report({"t": (df, ["k"])}).first()
    assert nul.NullRows == 1
    lim = quality.limit_report("t", df, {"s": 5}).first()
    assert (lim.Violations, lim.MaxLength) == (1, 12)
    with pytest.raises(quality.EmptyInputError):
        quality.require_rows(df.limit(0), "t")


def test_profile_quantiles_match_pandas(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 2.0, 3.0, 10.0, 11.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    p = quality.profile(df, ["x"]).first()
    s = pd.Series([v for v in vals if v is not None])
    assert p.P25 == pytest.approx(s.quantile(0.25))
    assert p.P50 == pytest.approx(s.quantile(0.5))
    assert p.P75 == pytest.approx(s.quantile(0.75))
    assert (p.NonNull, p.Nulls) == (7, 1)


def test_unpivot_then_pivot_is_identity(spark):
    w = spark.createDataFrame([("A", 1.0, None), ("B", 3.0, 4.0)], "id string, x double, y double")
    long = unpivot(w, ["id"], "name", "value")
    back = pivot_first(long, ["id"], "name", "value", ["x", "y"])
    assert sorted(back.collect()) == sorted(w.collect())


def test_conform_adds_missing_and_reorders(spark):
    df = spark.createDataFrame([(1.0, "A")], "b double, a string")
    out = conform(df, ["a", "b", "c"], {"a": T.StringType()})
    assert out.columns == ["a", "b", "c"] and out.first().c is None


def test_csv_with_bom_and_broken_row(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "quotes")
    os.makedirs(p)
    with open(os.path.join(p, "VNM.csv"), "w", encoding="utf-8-sig") as f:
        f.write("time,MaCK,open,high,low,close,volume\n")
        f.write("2024-01-02,VNM,1,2,0.5,1.5,100\n")
        f.write("2024-01-03,VNM,1,2,0.5,oops,100\n")
        f.write("2024-01-04,VNM,1,2,0.5,1.5,100,surplus\n2024-01-05,VNM,1\n")
        f.write("2024-99-03,VNM,1,2,0.5,1.5,100\n,VNM,1,2,0.5,1.5,100\n2024-01-08,,1,2,0.5,1.5,100\n")
    good, bad = files.read_with_quarantine(spark, p, QUOTE_SCHEMA, dates=["time"], required=["time", "MaCK"])
    assert [r.close for r in good.collect()] == [1.5] and good.count() == 1
    got = sorted("; ".join(r.reasons) for r in bad.collect())
    assert got == ["MaCK: missing", "close: type", "field count", "field count", "time: date", "time: missing"]
    assert files.read_quotes(spark, os.path.join(tmpdir_path, "missing")).count() == 0
    assert [f.count() for f in files.read_vendor_quotes(spark, os.path.join(tmpdir_path, "missing"))] == [0, 0]


def test_vendor_files_are_renamed_tagged_and_cut(spark, tmpdir_path):
    for symbol in ("VNM", "FPT"):
        with open(os.path.join(tmpdir_path, f"{symbol}.csv"), "w", encoding="utf-8") as f:
            f.write("date,openPrice,highPrice,lowPrice,closePrice,volume\n2019-12-31,1,1,1,1,1\n2021-05-03,1,2,0.5,1.5,10\n")
    good, bad = files.read_vendor_quotes(spark, tmpdir_path)
    assert sorted((r.MaCK, r.time, r.close) for r in good.collect()) == [("FPT", "2021-05-03", 1.5), ("VNM", "2021-05-03", 1.5)]
    assert bad.count() == 0


def test_repeated_header_name_takes_its_first_value(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "ratio_A.csv"), "w", encoding="utf-8") as f:
        f.write("Meta,G1,G2\nCP,EBIT,EBIT\nA,,7\nB,5,6\n")
    df = files.read_two_row_header(spark, tmpdir_path, ["CP", "EBIT"], {"CP": T.StringType()})
    assert sorted((r.CP, r.EBIT) for r in df.collect()) == [("A", 7.0), ("B", 5.0)]


def test_two_row_header_files_conform(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "finance_ratio_quarter")
    os.makedirs(root)
    with open(os.path.join(root, "finance_ratio_quarter_A.csv"), "w", encoding="utf-8-sig") as f:
        f.write("Meta,Meta,Meta,Chỉ tiêu,Chỉ tiêu\nCP,Năm,Kỳ,P/E,ROE (%)\nA,2024,1,10.5,3\n")
    with open(os.path.join(root, "finance_ratio_quarter_B.csv"), "w", encoding="utf-8") as f:
        f.write("Meta,Meta,Meta,Chỉ tiêu\nCP,Năm,Kỳ,ROE (%)\nB,2024,1,4\nB,2024,2,5\n")
    types = {"CP": T.StringType(), "Năm": T.IntegerType(), "Kỳ": T.IntegerType()}
    df = files.read_two_row_header(spark, root, ["CP", "Năm", "Kỳ", "ROE (%)", "P/E"], types)
    got = sorted((r["CP"], r["Kỳ"], r["ROE (%)"], r["P/E"]) for r in df.collect())
    assert got == [("A", 1, 3.0, 10.5), ("B", 1, 4.0, None), ("B", 2, 5.0, None)]


def test_feed_routing_priority(spark):
    df = spark.createDataFrame([("overview_ratio_X.csv",), ("profile_X.csv",), ("x.csv",),
                                ("Profile_Overview.csv",)], "n string")
    got = [r.k for r in df.select(files.feed_kind(F.col("n")).alias("k")).collect()]
    assert got == ["ratio", "profile", None, "overview"]


def test_create_tables_and_decimal_changes(spark, tmpdir_path):
    made = create_tables(spark, tmpdir_path, ["Dim_Company"])
    assert made == ["Dim_Company"]
    spark.sql("INSERT INTO Dim_Company VALUES (1, 'VNM', 'Vinamilk', 'VNM', 'Food', 'HOSE', 1.25)")
    with pytest.raises(Exception) as e:
        spark.sql("INSERT INTO Dim_Company VALUES (2, 'WAYTOOLONGSYMBOL', 'x', 'x', 'x', 'x', 1.0)")
    assert "EXCEED_LIMIT_LENGTH" in str(e.value) or "length" in str(e.value).lower()
    df = spark.createDataFrame([(123.45,)], "r double").select(F.col("r").cast("decimal(5,2)").alias("r"))
    assert change_decimal(df, "r", 7, 2).first().r is not None
    with pytest.raises(Exception):
        change_decimal(df, "r", 2, 2).collect()          # narrowing overflow raises (ANSI)


def test_per_symbol_quote_history_round_trip(spark, tmpdir_path):
    from stockyard.sources.feeds import write_quote_feed
    from stockyard.sources.star import DerivedStar
    from conftest import SMALL
    s = DerivedStar(spark, SMALL)
    path = os.path.join(tmpdir_path, "history")
    write_quote_feed(s, path, corrupt_first_day=False, per_symbol=True)
    back = files.read_quotes(spark, path, per_symbol_folders=True)
    want = s.staging_quotes()
    assert back.count() == want.count()
    sym = want.select("MaCK").first()["MaCK"]
    one = back.where(F.col("MaCK") == sym)
    assert one.count() == want.where(F.col("MaCK") == sym).count()
    assert one.select("source_file").distinct().count() >= 1
    assert all(f"MaCK=" in r.source_file for r in one.select("source_file").distinct().collect())


def test_rewrite_keeps_limits_and_the_table_on_failure(spark, tmpdir_path):
    from stockyard.operators.evolve import alter_add_column, rewrite_table, schema_downgrade
    spark.sql(f"CREATE TABLE evolving (k int NOT NULL, s varchar(5), r decimal(5,2)) USING parquet LOCATION '{tmpdir_path}/a'")
    spark.sql("INSERT INTO evolving VALUES (1, 'abc', 1.25), (2, 'de', 123.45)")
    alter_add_column(spark, "evolving", "extra", "int")
    out = rewrite_table(spark, "evolving", f"{tmpdir_path}/b", lambda df: df.drop("extra"))
    assert out.columns == ["k", "s", "r"] and out.count() == 2
    with pytest.raises(Exception):
        spark.sql("INSERT INTO evolving VALUES (3, 'toolong', 1.0)")
    with pytest.raises(Exception):
        schema_downgrade(spark, "evolving", "r", 2, 2, f"{tmpdir_path}/c")
    assert spark.table("evolving").count() == 2 and "evolving__new" not in [t.name for t in spark.catalog.listTables()]
    assert schema_downgrade(spark, "evolving", "r", 5, 1, f"{tmpdir_path}/d").schema["r"].dataType.simpleString() == "decimal(5,1)"
    spark.sql("DROP TABLE evolving")


def test_gate_raises_on_null_keys_and_overflow(spark):
    ok = spark.createDataFrame([(20240102, 1, 1.0)], "TimeKey int, StockKey int, Open double").selectExpr(
        "*", "Open High", "Open Low", "Open Close")
    quality.require_valid(ok, "Fact_StockPrice")
    for bad in (ok.selectExpr("TimeKey", "cast(null as int) StockKey", "Open", "High", "Low", "Close"),
                ok.selectExpr("TimeKey", "StockKey", "Open", "High", "Low", "Close * 1e8 as Close")):
        with pytest.raises(quality.InvalidRowsError):
            quality.require_valid(bad, "Fact_StockPrice")


@pytest.mark.parametrize("dtype", ["double", "string", "decimal(38,6)"])
def test_limits_are_those_of_the_cast(spark, dtype):
    limits = [(10, 4), (5, 2), (20, 4), (36, 4), (38, 4)]
    vals = [0.0, 0.00005, 123.455, 999.995, 999999.99995, 999999.99994, 1e6, 1e16, 1e32, 9.99e33, 1e34, 1e300, float("inf"), float("nan")]
    text = [(repr(sign * v),) for v in vals for sign in (1, -1)] + [(v,) for v in (
        None, "n/a", "", " 12.5 ", "1.0d", "1e400", "1e-400", "999999.99994999999999", "9" * 32 + ".999949", "9" * 32 + ".99995")]
    df = spark.createDataFrame(text, "t string").selectExpr("t", f"try_cast(t as {dtype}) as x").repartition(1)
    cast = "x is not null and try_cast(x as decimal({},{})) is null"
    row = df.select("t", F.array(*[quality._beyond("x", p, s) for p, s in limits]).alias("got"),
                    F.expr("array(" + ", ".join(cast.format(p, s) for p, s in limits) + ")").alias("want"))
    assert row.where("not (got <=> want)").collect() == [] and row.where("want[0]").count() > 4


def test_no_cast_fails_for_each_price_beyond_its_limit(spark):
    from stockyard.plans.registry import QUERIES
    for df in (QUERIES["decimal_overflow"](spark, SMALL), spark.createDataFrame(
            [(20240102, 1, 1e8, 1e8, 1e8, 1e8)], "TimeKey int, StockKey int, Open double, High double, Low double, Close double").agg(
            *quality.validity("Fact_StockPrice").values())):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "decimal(38,4)" in plan and "as decimal(10,4)" not in plan


def test_column_info_covers_every_type(spark):
    df = spark.createDataFrame([(1, "b", None), (2, None, True)], "i int, s string, f boolean")
    got = [(r.Column, r.DType, r.NonNull, r.Nulls, r.Least, r.Greatest) for r in quality.column_info(df).orderBy("Position").collect()]
    assert got == [("i", "int", 2, 0, "1", "2"), ("s", "string", 1, 1, "b", "b"), ("f", "boolean", 1, 1, "true", "true")]
