"""Incremental load semantics.

Plain parquet tables have no MERGE, so every load is anti-join + append:
the batch is de-duplicated on its key, compared with the target's keys and
only new keys are appended. The target is first cut to the batch's range of the
leading key (a scalar subquery that reaches the target's scan), so a daily batch
is compared with the days it holds, not with the whole history.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockyard.operators.conform import dedupe_first

# First date loaded into an empty warehouse (the history start of the quote feed).
HISTORY_START = "2020-01-01"


class DuplicateKeyError(ValueError):
    """A strict append found keys that already exist or repeat in the batch."""


def dedupe_batch(batch: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key: the first in ``order_by`` (default: the other columns)."""
    order_by = order_by or [c for c in batch.columns if c not in keys]
    return dedupe_first(batch, keys, order_by) if order_by else batch.dropDuplicates(keys)


def rows_to_insert(target: DataFrame, batch: DataFrame, keys: list[str],
                   order_by: list[str] | None = None) -> DataFrame:
    """K2: batch rows whose key is not in the target (insert ... on conflict do nothing)."""
    return new_rows(within_batch(target, batch, keys[0]), batch, keys, order_by)


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str],
             order_by: list[str] | None = None) -> DataFrame:
    """K2 against target rows that are cut to the batch's range already."""
    return dedupe_batch(batch, keys, order_by).join(target.select(*keys), keys, "left_anti")


def within_batch(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target rows whose ``key`` lies in the batch's range of it."""
    span = batch.agg(F.struct(F.min(key).alias("low"), F.max(key).alias("high"))).scalar()
    return target.where((F.col(key) >= span["low"]) & (F.col(key) <= span["high"]))


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str],
                  order_by: list[str] | None = None) -> DataFrame:
    """K2: the target after an insert-ignore of the batch."""
    return target.unionByName(rows_to_insert(target, batch, keys, order_by))


def new_by_first_key(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """K4: batch rows whose *first* key column value is absent from the target.

    Differs from K2 for composite keys: a new (time, stock) pair is skipped
    when its time is already present for any stock.
    """
    return batch.join(target.select(keys[0]).distinct(), keys[0], "left_anti")


def key_conflicts(target: DataFrame, batch: DataFrame, keys: list[str], cut: bool = False) -> DataFrame:
    """K3 report: batch keys that repeat in the batch or already exist in the target (``cut``: which is
    cut to the batch's range already).

    Output: keys..., BatchRows (copies in the batch), InTarget (bool).
    """
    per_key = batch.groupBy(*keys).agg(F.count("*").alias("BatchRows"))
    target = target if cut else within_batch(target, batch, keys[0])
    existing = target.select(*keys).distinct().withColumn("InTarget", F.lit(True))
    j = per_key.join(existing, keys, "left").withColumn(
        "InTarget", F.coalesce(F.col("InTarget"), F.lit(False)))
    return j.where((F.col("BatchRows") > 1) | F.col("InTarget"))


def strict_append(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """K3: the target plus the batch; raises DuplicateKeyError on any key conflict."""
    require_new_keys(target, batch, keys)
    return target.unionByName(batch)


def require_new_keys(target: DataFrame, batch: DataFrame, keys: list[str], cut: bool = False) -> None:
    """Raise DuplicateKeyError if a batch key repeats or is in the target."""
    sample = [r.asDict() for r in key_conflicts(target, batch, keys, cut).take(5)]
    if sample:
        raise DuplicateKeyError(f"duplicate primary key in {keys}: {sample}")


def high_water_date(dim_time: DataFrame, start: str = HISTORY_START) -> Column:
    """Next date to load = max(Date) + 1 day; the history start on an empty table."""
    nxt = dim_time.select(F.date_add(F.max("Date"), 1).alias("d")).scalar()
    return F.coalesce(nxt, F.to_date(F.lit(start)))


def rows_after_high_water(quotes: DataFrame, dim_time: DataFrame, time_col: str = "time",
                          until: str | _dt.date | None = None,
                          start: str = HISTORY_START) -> DataFrame:
    """Quote rows dated from the high-water mark up to ``until`` (default: today)."""
    d = F.try_to_timestamp(F.col(time_col), F.lit("yyyy-MM-dd")).cast("date")
    end = F.current_date() if until is None else F.to_date(F.lit(str(until)))
    return quotes.where((d >= high_water_date(dim_time, start)) & (d <= end))
