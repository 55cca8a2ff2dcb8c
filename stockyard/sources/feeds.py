"""Feed folders derived from the star, for the ingest operators.

The production feeds are CSV exports: one quote file per symbol, two-level-header
ratio files, company overview/profile files. These writers produce
the same shapes from the derived star with Spark jobs, under the shared
checkpoint folder, so the readers are exercised on data that grows with the
tables. Layout variations are decided by data (the supplier's nation and
region), not by sampling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators.retrieval import _kept
from stockyard.sources.files import csv_field, write_csv
from stockyard.sources.star import DerivedStar

RATIO_FEED_COLUMNS = ["CP", "Năm", "Kỳ", "ROE (%)", "P/E", "P/B", "TSCĐ / Vốn CSH"]
RATIO_GROUP_LABEL = {"CP": "Meta", "Năm": "Meta", "Kỳ": "Meta"}
RATIO_GROUP_DEFAULT = "Chỉ tiêu"
# Files of suppliers in nations below this key lack the 'P/B' column.
NO_PB_NATION_LIMIT = 5
# Files of suppliers in nations [5, 10) list the ratio columns in reverse order.
REVERSED_NATIONS = (5, 10)
COMMITTER = "mapreduce.fileoutputcommitter.algorithm.version"
# Symbols of a ratio file: some MB of lines.
SYMBOLS_A_FILE = 2_000


def _write_lines(lines: DataFrame, path: str, file_col: str, order_col: str) -> None:
    """Write text lines, one folder per ``file_col`` value, lines in ``order_col`` order.

    Written through the CSV writer with a delimiter that never occurs and no
    quoting, so each line lands verbatim in a .csv file.
    """
    (lines.repartition(file_col).sortWithinPartitions(file_col, order_col)
          .select(file_col, "line")
          .write.mode("errorifexists").partitionBy(file_col)
          .option("delimiter", "\u0001").option("quote", "").option("escapeQuotes", False)
          .csv(path))


def _join_present(items: list[tuple[Column, Column]]) -> Column:
    """CSV line from (present, text) pairs, skipping absent columns."""
    arr = F.array(*[F.struct(p.alias("p"), t.alias("t")) for p, t in items])
    return F.array_join(F.transform(F.filter(arr, lambda e: e["p"]), lambda e: e["t"]), ",")


def write_ratio_feed(star: DerivedStar, path: str) -> None:
    """Two-level-header ratio files of up to about SYMBOLS_A_FILE symbols; some lack 'P/B', some list
    the ratio columns in reverse order. Creating, listing and opening a file costs far more than a symbol's few
    lines, so the number of files follows the symbols only by that factor."""
    nat = star.table("supplier").select(F.col("s_name").alias("CP"), F.col("s_nationkey").alias("_nat"))
    nat = F.broadcast(nat) if star.supplier_small else nat
    files = -(-star.table("supplier").count() // SYMBOLS_A_FILE)
    layout = F.when(F.col("_nat") >= REVERSED_NATIONS[1], "plain").when(F.col("_nat") >= REVERSED_NATIONS[0], "reversed").otherwise("short")
    number = F.pmod(F.xxhash64("CP"), F.lit(max(files, 1)))
    w = _kept(star.ratio_wide().join(nat, "CP").withColumn("feed_file", F.concat_ws("-", layout, number)), "ratios")
    has_pb = F.col("_nat") >= NO_PB_NATION_LIMIT
    rev = (F.col("_nat") >= REVERSED_NATIONS[0]) & (F.col("_nat") < REVERSED_NATIONS[1])
    ids, ratios = RATIO_FEED_COLUMNS[:3], RATIO_FEED_COLUMNS[3:]

    def line(text_of) -> Column:
        fwd = [(F.lit(True), text_of(c)) for c in ids] + \
              [((has_pb if c == "P/B" else F.lit(True)), text_of(c)) for c in ratios]
        bwd = fwd[:3] + list(reversed(fwd[3:]))
        return F.when(rev, _join_present(bwd)).otherwise(_join_present(fwd))

    group = line(lambda c: F.lit(RATIO_GROUP_LABEL.get(c, RATIO_GROUP_DEFAULT)))
    names = line(lambda c: F.lit(c))
    data = line(lambda c: csv_field(F.col(f"`{c}`")))
    # rows without a quarter come last: before the headers they would be taken for them
    order = F.coalesce(F.col("Năm") * 10 + F.col("Kỳ") + 10, F.lit(2**31 - 1))
    heads = w.select("feed_file", group.alias("group"), names.alias("names")).distinct()
    lines = (heads.select("feed_file", F.lit(0).alias("_ord"), F.col("group").alias("line"))
             .unionByName(heads.select("feed_file", F.lit(1).alias("_ord"), F.col("names").alias("line")))
             .unionByName(w.select("feed_file", order.alias("_ord"), data.alias("line"))))
    _write_lines(lines, path, "feed_file", "_ord")


# Kinds of damage in the quote feed, by the day of the month of a row.
DAMAGED_DAYS = {1: "price", 2: "extra field", 3: "missing fields", 4: "date", 5: "no date", 6: "no symbol"}


def write_quote_feed(star: DerivedStar, path: str, corrupt_first_day: bool = True,
                     per_symbol: bool = False) -> None:
    """Quote CSV files (header row) with the close price unreadable ('n/a') on the
    first calendar day of a month, to exercise the quarantine."""
    q = star.staging_quotes()
    close = F.col("close").cast("string")
    if corrupt_first_day:
        close = F.when(F.dayofmonth(F.to_date("time")) == 1, F.lit("n/a")).otherwise(close)
    out = q.select("time", "MaCK", F.col("open").cast("string").alias("open"),
                   F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"),
                   close.alias("close"), F.col("volume").cast("string").alias("volume"))
    write_csv(out, path, partition_by=["MaCK"] if per_symbol else None)


def write_damaged_quotes(star: DerivedStar, path: str) -> None:
    """Quote lines with every kind of damage in DAMAGED_DAYS, without a header row of their own
    (each file starts with one line of column names, as the reader expects)."""
    q = star.staging_quotes().withColumn("_day", F.dayofmonth(F.to_date("time")))
    text = lambda c: F.col(c).cast("string")
    on = lambda kind: F.col("_day") == next(d for d, k in DAMAGED_DAYS.items() if k == kind)
    time = F.when(on("date"), F.concat(F.substring("time", 1, 4), F.lit("-99-03"))).when(
        on("no date"), F.lit("")).otherwise(F.col("time"))
    symbol = F.when(on("no symbol"), F.lit("")).otherwise(F.col("MaCK"))
    close = F.when(on("price"), F.lit("n/a")).otherwise(text("close"))
    whole = F.concat_ws(",", time, symbol, text("open"), text("high"), text("low"), close, text("volume"))
    line = (F.when(on("extra field"), F.concat(whole, F.lit(",surplus")))
            .when(on("missing fields"), F.concat_ws(",", time, symbol, text("open"))).otherwise(whole))
    (q.select(line.alias("time,MaCK,open,high,low,close,volume"))
     .write.mode("errorifexists").option("header", True).option("delimiter", "\u0001")
     .option("quote", "").option("escapeQuotes", False).csv(path))


def write_vendor_quotes(star: DerivedStar, path: str) -> None:
    """The vendor's export: its own column names, one folder for each symbol and no symbol column."""
    q = star.staging_quotes()
    out = q.select(F.col("time").alias("date"), F.col("open").alias("openPrice"), F.col("high").alias("highPrice"),
                   F.col("low").alias("lowPrice"), F.col("close").alias("closePrice"), "volume",
                   F.col("MaCK").alias("symbol"))
    # clustered by symbol first, so a symbol's folder gets its rows from one task; tasks put their
    # files in place themselves, as the driver would move those of all symbols one by one
    write_csv(out.repartition("symbol"), path, partition_by=["symbol"], options={COMMITTER: "2"})


def write_definition_feed(star: DerivedStar, path: str) -> None:
    write_csv(star.definition_feed().drop("_seq"), path)


def write_company_feeds(star: DerivedStar, root: str) -> None:
    """Overview and profile CSV feeds, plus one folder whose name holds two kinds."""
    overview, profile = star.company_feeds()
    write_csv(overview, f"{root}/company_overview")
    write_csv(profile, f"{root}/company_profile")
    write_csv(profile, f"{root}/profile_overview_extract")
