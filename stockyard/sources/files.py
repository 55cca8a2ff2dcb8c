"""File ingest and CSV sinks.

Feeds are folders of CSV files. Everything is read in one scan per folder
with explicit schemas; per-file structure (which feed a file belongs to, its
header rows) comes from ``_metadata.file_path`` and line order, never from a
per-file driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from stockyard.functions.names import QUOTE_RENAME
from stockyard.operators.conform import rename_columns
from stockyard.schemas import (
    DEFINITION_SCHEMA, OVERVIEW_SCHEMA, PROFILE_SCHEMA, QUOTE_SCHEMA, VENDOR_QUOTE_SCHEMA,
)
from stockyard.session import fits_broadcast

# First and last day of the price history that the vendor feed is asked for.
HISTORY_WINDOW = ("2020-01-01", "2024-12-31")

# Feed kinds in routing priority: a file whose name holds several goes to the first.
FEED_KINDS = ["ratio", "overview", "profile"]



# ---- sinks -------------------------------------------------------------------
def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
              mode: str = "errorifexists", options: dict[str, str] | None = None) -> None:
    """K1: CSV with a header row, UTF-8 (Spark writes no byte-order mark)."""
    w = df.write.mode(mode).option("header", True).option("encoding", "UTF-8").options(**options or {})
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def csv_field(c: Column) -> Column:
    """One CSV field as text: quoted when it holds a comma, quote or line break."""
    s = c.cast("string")
    needs = s.rlike('[",\r\n]')
    quoted = F.concat(F.lit('"'), F.regexp_replace(s, '"', '""'), F.lit('"'))
    return F.when(s.isNull(), F.lit("")).when(needs, quoted).otherwise(s)


# ---- readers -----------------------------------------------------------------
def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.csv",
             header: bool = True, mode: str = "PERMISSIVE", corrupt: str | None = None) -> DataFrame:
    """S3: one scan over every matching CSV under ``path`` (recursively).

    A missing folder or no matching file gives an empty frame, not an error.
    The file each row came from is kept as ``source_file``. ``corrupt`` names a
    column that gets the whole line where its fields do not fit the schema.
    """
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    try:
        df = (spark.read.schema(schema).option("header", header).option("mode", mode)
              .option("columnNameOfCorruptRecord", corrupt or "_corrupt_record")
              .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
              .option("encoding", "UTF-8").csv(path))
        return df.withColumn("source_file", F.col("_metadata.file_path"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return _empty(spark, schema).withColumn("source_file", F.lit(None).cast("string"))
        raise


def read_quotes(spark: SparkSession, path: str, glob: str = "*.csv",
                per_symbol_folders: bool = False) -> DataFrame:
    """Quote files (time, MaCK, open, high, low, close, volume).

    ``per_symbol_folders``: the history is laid out one folder per symbol
    (``MaCK=<symbol>/``, as written by ``write_csv(..., partition_by=["MaCK"])``);
    the symbol then comes from the folder, via partition discovery, and a
    filter on it prunes whole folders.
    """
    if not per_symbol_folders:
        return read_csv(spark, path, QUOTE_SCHEMA, glob)
    df = (spark.read.schema(QUOTE_SCHEMA).option("header", True).option("pathGlobFilter", glob)
          .option("encoding", "UTF-8").csv(path))
    return df.select(*QUOTE_SCHEMA.fieldNames(), F.col("_metadata.file_path").alias("source_file"))


def read_vendor_quotes(spark: SparkSession, path: str, since: str | None = HISTORY_WINDOW[0],
                       until: str | None = HISTORY_WINDOW[1], glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """The vendor's per-symbol exports -> (good, quarantined) staging quotes.

    Vendor columns are renamed (P1), each row is tagged with the symbol its file is named
    after (P5), fields are typed, and dates outside [since, until] are left out.
    """
    good, bad = read_with_quarantine(spark, path, VENDOR_QUOTE_SCHEMA, glob, dates=["date"], required=["date"])
    folder = F.regexp_extract("source_file", r"/[^/=]+=([^/]+)/[^/]*$", 1)
    symbol = F.when(folder != "", folder).otherwise(F.regexp_extract("source_file", r"([^/]+)\.csv$", 1))
    # folder names are escaped when written, and paths are escaped once more when read
    renamed = rename_columns(good, QUOTE_RENAME).withColumn("MaCK", F.try_url_decode(F.try_url_decode(symbol)))
    if since is not None:
        renamed = renamed.where(F.col("time") >= since)
    if until is not None:
        renamed = renamed.where(F.col("time") <= until)
    return renamed.select(*QUOTE_SCHEMA.fieldNames(), "source_file"), bad


def read_overview(spark: SparkSession, path: str, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Company overview files -> (good, quarantined); a row needs its symbol."""
    return read_with_quarantine(spark, path, OVERVIEW_SCHEMA, glob, required=["symbol"])


def read_profile(spark: SparkSession, path: str, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Company profile files -> (good, quarantined); a row needs its symbol."""
    return read_with_quarantine(spark, path, PROFILE_SCHEMA, glob, required=["symbol"])


def read_definitions(spark: SparkSession, path: str, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """Ratio definition files -> (good with ``_seq``, the feed's order; quarantined)."""
    good, bad = read_with_quarantine(spark, path, DEFINITION_SCHEMA, glob, required=["name"])
    return good.withColumn("_seq", F.col("order").try_cast("int")), bad


CORRUPT = "_corrupt"


def read_with_quarantine(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.csv",
                         dates: list[str] | None = None,
                         required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows). A malformed line does not stop the load.

    Fields are read as text. A row is quarantined when its number of fields
    differs from the schema's (the reader keeps such a line as a whole), when a non-empty
    field does not convert to its type, when a field in ``dates`` is no
    yyyy-MM-dd date, or when a field in ``required`` is empty. Quarantined rows keep
    their text fields, the raw line if its field count was wrong, the source
    file, and the ``reasons``.
    """
    raw = read_csv(spark, path, _as_text(schema), glob, corrupt=CORRUPT)
    return split_bad_rows(raw, schema, dates, required)


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def split_bad_rows(raw: DataFrame, schema: T.StructType, dates: list[str] | None = None,
                   required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of rows read as text, with the raw line in CORRUPT where the reader
    could not split it into the schema's fields (see ``read_with_quarantine``)."""
    dates, required = dates or [], required or []
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
    empty = lambda n: F.col(n).isNull() | (F.trim(n) == "")
    day = lambda n: F.try_to_timestamp(F.col(n), F.lit("yyyy-MM-dd")).isNull()
    reasons = [F.when(F.col(CORRUPT).isNotNull(), F.lit("field count"))]
    reasons += [F.when(F.col(n).isNotNull() & c.isNull(), F.lit(f"{n}: type")) for n, c in typed.items()]
    reasons += [F.when(~empty(n) & day(n), F.lit(f"{n}: date")) for n in dates]
    reasons += [F.when(empty(n), F.lit(f"{n}: missing")) for n in required]
    split = F.col(CORRUPT).isNull()
    found = F.array_compact(F.array(reasons[0], *[F.when(split, r) for r in reasons[1:]]))
    checked = raw.withColumn("reasons", found)
    carried = [c for c in raw.columns if c not in typed and c != CORRUPT]
    good = checked.where(F.size("reasons") == 0).select(*[c.alias(n) for n, c in typed.items()], *carried)
    return good, checked.where(F.size("reasons") > 0)


def feed_kind(name: Column) -> Column:
    """First feed kind contained in a (lower-cased) file or feed name."""
    low = F.lower(name)
    expr = None
    for k in FEED_KINDS:
        expr = F.when(low.contains(k), F.lit(k)) if expr is None else expr.when(low.contains(k), F.lit(k))
    return expr


def read_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """Every line of every file under ``path`` with its file path and line id.

    ``line_id`` increases with the position of the line inside its file.
    A leading byte-order mark is removed.
    """
    return (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .text(path)
            .select(F.regexp_replace("value", "^\ufeff", "").alias("line"),
                    F.col("_metadata.file_path").alias("file"),
                    F.monotonically_increasing_id().alias("line_id")))


def _nth_line_ids(lines: DataFrame, n: int) -> DataFrame:
    """(file, id_1 .. id_n): ids of the first n lines of each file, by aggregation only
    (no window over a whole file, so one huge file is not one task's sort)."""
    out = lines.groupBy("file").agg(F.min("line_id").alias("id_1"))
    for i in range(2, n + 1):
        nxt = (lines.join(out, "file").where(F.col("line_id") > F.col(f"id_{i - 1}"))
                    .groupBy("file").agg(F.min("line_id").alias(f"id_{i}")))
        out = out.join(nxt, "file", "left")
    return out


# Comma not inside double quotes (an even number of quotes follows it).
CSV_SPLIT = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _unquote(f: Column) -> Column:
    quoted = f.startswith('"') & f.endswith('"') & (F.length(f) >= 2)
    body = F.regexp_replace(F.regexp_extract(f, '^"(.*)"$', 1), '""', '"')
    return F.when(f == F.lit(""), F.lit(None).cast("string")).when(quoted, body).otherwise(f)


def _fields(line: Column) -> Column:
    """CSV fields of one line (RFC-4180 quoting, no embedded line breaks);
    empty fields are NULL, as in Spark's CSV reader."""
    return F.transform(F.split(line, CSV_SPLIT), _unquote)


def read_headed_lines(lines: DataFrame, header_rows: int = 1) -> DataFrame:
    """Lines -> (file, record: pairs of name and text) using each file's own header.

    ``header_rows``: the last of the first ``header_rows`` lines holds the
    column names (2 for the two-level ratio export, whose first line holds
    group labels); those lines are not data. Files may differ in columns and
    order: every record lists its own file's (name, value) pairs. The header
    table has one row per file and is broadcast if it passes the size check, so
    the lines of one huge file are not gathered on its path.
    """
    ids = _nth_line_ids(lines, header_rows)
    hdr_id = f"id_{header_rows}"
    headers = (lines.join(ids.select("file", hdr_id), "file")
                    .where(F.col("line_id") == F.col(hdr_id))
                    .select("file", _fields(F.col("line")).alias("_names")))
    data = (lines.join(ids.select("file", hdr_id), "file")
                 .where(F.col("line_id") > F.col(hdr_id))
                 .where(F.length(F.trim("line")) > 0)
                 .select("file", "line_id", _fields(F.col("line")).alias("_vals")))
    j = data.join(F.broadcast(headers) if fits_broadcast(headers) else headers, "file")
    pairs = F.filter(F.arrays_zip(F.col("_names").alias("k"), F.col("_vals").alias("v")),
                     lambda e: e["k"].isNotNull())
    return j.select("file", "line_id", F.transform(
        pairs, lambda e: F.struct(F.trim(e["k"]).alias("k"), e["v"].alias("v"))).alias("record"))


def conform_records(records: DataFrame, target: list[str],
                    types: dict[str, T.DataType] | None = None,
                    default_type: T.DataType = T.DoubleType(),
                    keep: list[str] | None = None) -> DataFrame:
    """P4 + U1: target columns from each record (absent names -> NULL), typed. A name
    that a header repeats takes its first non-NULL value."""
    types = types or {}

    def value(name: str) -> Column:
        return F.get(F.filter("record", lambda e: (e["k"] == F.lit(name)) & e["v"].isNotNull()), 0)["v"]

    cols = [value(n).try_cast(types.get(n, default_type)).alias(n) for n in target]
    return records.select(*(keep or []), *cols)


def read_two_row_header(spark: SparkSession, path: str, target: list[str],
                        types: dict[str, T.DataType] | None = None, glob: str = "*.csv") -> DataFrame:
    """S5 + P4: two-level-header CSV files (group labels, then names) conformed
    to ``target`` and unioned, whatever columns each file has."""
    recs = read_headed_lines(read_lines(spark, path, glob), header_rows=2)
    return conform_records(recs, target, types, keep=["file"])


def route_feeds(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Every line under ``root`` tagged with its feed kind; lines of unknown
    kind get kind NULL."""
    lines = read_lines(spark, root, glob)
    name = F.substring_index(F.col("file"), "/", -1)
    # the file's own name decides; written part files carry it in their folders' names
    folders = F.substring_index(F.col("file"), "/", -3)
    return lines.withColumn("kind", F.coalesce(feed_kind(name), feed_kind(folders)))


def feeds_by_kind(spark: SparkSession, root: str, glob: str = "*.csv") -> dict[str, DataFrame]:
    """One frame of lines for each feed kind."""
    routed = route_feeds(spark, root, glob)
    return {k: routed.where(F.col("kind") == k).drop("kind") for k in FEED_KINDS}
