"""Windows over long histories (W3-W7, W12-W14): one key's rows as many tasks.

A window partitioned by a key puts all rows of the key into one task. Where a frame looks back at most ``lookback``
rows, the history can be cut: rows are sorted by range over (key, order), numbered exactly within their key
by prefix sums over the ranges, and dealt to segments of ``segment`` rows. The last ``lookback`` rows of a segment are
carried into the next one, where they feed the frames and are dropped afterwards. The window then runs by
(key, segment): every task holds at most segment + lookback rows of a key, with the same frames as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockyard.operators.retrieval import _kept

SEGMENT_ROWS = 100_000
SEGMENT, CARRIED = "_segment", "_carried"


def numbered(rows: DataFrame, key: str, order: str, place: str) -> DataFrame:
    """``rows`` with ``place``: the row's 0-based number within its key, in ``order`` (unique within a key)."""
    spread = _kept(rows.repartitionByRange(key, order).withColumn("_task", F.spark_partition_id()), "ranges")
    counts = spread.groupBy(key, "_task").agg(F.count("*").alias("_n"))
    # a row for each key and range that holds rows of it
    before = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_task").orderBy(order)) - 1
    return (spread.withColumn("_within", within).join(offsets, [key, "_task"])
            .withColumn(place, F.col("_before") + F.col("_within")).drop("_task", "_within", "_before"))


def segmented(rows: DataFrame, key: str, order: str, lookback: int, segment: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with SEGMENT and CARRIED: each row in its own segment and, if it is among the last ``lookback``
    ones there, once more in the next. Windows go by (key, SEGMENT); carried rows are dropped after them."""
    if segment < lookback:
        raise ValueError(f"a segment of {segment} rows cannot feed frames of {lookback}")
    copy = lambda n, carried: F.struct(n.cast("long").alias(SEGMENT), F.lit(carried).alias(CARRIED))
    own = F.floor(F.col("_place") / segment)
    late = F.col("_place") % segment >= segment - lookback
    return numbered(rows, key, order, "_place").select(
        *rows.columns, F.explode(F.when(late, F.array(copy(own, False), copy(own + 1, True)))
                                 .otherwise(F.array(copy(own, False)))).alias("_s")).select(
        *rows.columns, f"_s.{SEGMENT}", f"_s.{CARRIED}")
