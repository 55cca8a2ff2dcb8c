"""Shared steps of the corpus operators: document keys, scratch tables, batches."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockyard.session import scratch_path

NO_ID = (1 << 63) - 1            # stands for a null doc_id: ordered after every other
WORK_BYTES = 1 << 19             # bytes of text that one vector step works on


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text_hash, doc_id, text) with a non-null order key.

    ``doc`` is the id, a null id counting as the largest; ``text_hash`` tells
    rows apart that share an id but not a text. Repeated rows share both, so
    they are one document met several times and each gets the same result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def stored(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (cuts lineage,
    survives lost executors). ``large``: its shuffles are released before going on."""
    spark = df.sparkSession
    path, schema = scratch_path(spark, name), df.schema
    df.write.parquet(path)
    del df
    if large:
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer held; it
    goes by garbage collection on the driver, which may not happen for long otherwise."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def text_bytes_total(docs: DataFrame, column: str = "text") -> int:
    row = docs.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(row["n"] or 0)


def parts_for(amount: int, each: int, spark: SparkSession) -> int:
    """Partitions so that one holds about ``each``; at least the session's count."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = WORK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
