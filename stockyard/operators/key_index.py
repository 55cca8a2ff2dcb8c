"""An exact index of a fact's keys (K2, K3, Q3): bitmaps of StockKeys for each day.

The index holds, for each TimeKey and each range of 32,768 StockKeys, the bitmap of the keys present. It is
built by ``bitmap_construct_agg`` in the map tasks, two indexes are one by ``bitmap_or_agg``, and
whether a key exists is one bit test after a join on (TimeKey, range). So a load is compared with the index
of its days and never scans the fact, and a table's duplicates are found by comparing row counts with bit
counts: only days whose counts differ are looked at key by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators.load import dedupe_batch

DAY, KEY = "TimeKey", "StockKey"
KEYS = [DAY, KEY]


def _ranged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_range", F.bitmap_bucket_number(KEY)).withColumn("_bit", F.bitmap_bit_position(KEY))


def key_index(rows: DataFrame) -> DataFrame:
    """(TimeKey, Range, Bits) of the rows' keys."""
    return _ranged(rows.select(*KEYS)).groupBy(DAY, F.col("_range").alias("Range")).agg(
        F.bitmap_construct_agg("_bit").alias("Bits"))


def merged(index: DataFrame, more: DataFrame) -> DataFrame:
    """One index of the keys of both."""
    return index.unionByName(more).groupBy(DAY, "Range").agg(F.bitmap_or_agg("Bits").alias("Bits"))


def has_bit(bits: str, bit: str) -> Column:
    """Whether the bitmap has the bit set; false for no bitmap."""
    byte = f"CAST(conv(hex(substring({bits}, CAST({bit} DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)"
    return F.expr(f"coalesce(shiftright({byte}, CAST({bit} % 8 AS INT)) % 2 = 1, false)")


def looked_up(index: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` with ``InTarget``: whether the row's key is in the index. Only the index rows of the
    batch's days and ranges are joined."""
    own = index.select(DAY, F.col("Range").alias("_range"), "Bits")
    return _ranged(batch).join(own, [DAY, "_range"], "left").withColumn("InTarget", has_bit("Bits", "_bit")).select(
        *[F.col(c) for c in batch.columns], "InTarget")


def rows_to_insert(index: DataFrame, batch: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """K2 by the index: the batch's first row of each key that the target does not have."""
    return looked_up(index, dedupe_batch(batch, KEYS, order_by)).where("NOT InTarget").drop("InTarget")


def key_conflicts(index: DataFrame, batch: DataFrame) -> DataFrame:
    """K3 by the index: keys that repeat in the batch or exist in the target (BatchRows, InTarget)."""
    per_key = batch.groupBy(*KEYS).agg(F.count("*").alias("BatchRows"))
    return looked_up(index, per_key).where((F.col("BatchRows") > 1) | F.col("InTarget"))


def duplicates(rows: DataFrame) -> DataFrame:
    """Q3: (TimeKey, StockKey, Copies) of keys that occur more than once. Days and ranges with as many rows
    as set bits have none; only the others' rows are grouped by key."""
    ranged = _ranged(rows.select(*KEYS))
    crowded = ranged.groupBy(DAY, "_range").agg(F.count("*").alias("n"), F.bitmap_construct_agg("_bit").alias("b")).where(
        F.col("n") > F.bitmap_count("b")).select(DAY, "_range")
    return (ranged.join(crowded, [DAY, "_range"], "left_semi").groupBy(*KEYS).agg(F.count("*").alias("Copies"))
            .where(F.col("Copies") > 1))
