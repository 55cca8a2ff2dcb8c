"""Incremental refresh of the movement and performance views (V-MV, V-PF).

A new day's view rows look back at most 29 rows of a stock (the 30-row mean; the 20-row mean of changes needs 20) and
at the first close of the year. So the state of a refresh is one row for each stock: its last ``TAIL`` (Date, Close)
pairs, and year and first close of its last day. A load reads its batch and the state of the load before, runs the
unchanged view plans over tails and batch together, and keeps the batch's rows; neither history nor
earlier view rows are read.

Everything is written by load: the views' rows first, the new state last, which makes the load
count. A load that failed or is repeated starts from the same earlier state and overwrites its own rows, so
it ends as one clean run. Loads come in order, and a stock's rows in a load are later than its earlier ones;
anything else raises before the first write.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockyard.functions.dates import time_key
from stockyard.operators.retrieval import _kept
from stockyard.plans import views
from stockyard.session import fits_broadcast

TAIL = 29
STATE = "StockKey int, Tail array<struct<Date: date, Close: double>>, Year int, YearOpen double"
VIEWS = {"movement": views.price_movement, "performance": views.index_performance}


class LateRowsError(ValueError):
    """A load holds rows that are not later than what its stock has already, or comes out of order."""


class BatchStar:
    """Tails and batch as a star: what the view plans need of one."""

    date_of_key = True

    def __init__(self, rows: DataFrame, dim_company: DataFrame, members: DataFrame, year_open: DataFrame, company_small: bool):
        self.fact_price, self.dim_company, self.company_small = rows, dim_company, company_small
        self.members, self.year_open = members, year_open

    def index_fact_price(self) -> DataFrame:
        return self.fact_price.join(F.broadcast(self.members), "StockKey", "left_semi")


def with_tails(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(StockKey, Date, Close, Volume): the stocks' tails (without volumes), then the batch."""
    tails = state.select("StockKey", F.inline("Tail")).withColumn("Volume", F.lit(None).cast("long"))
    return tails.unionByName(batch)


def next_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after ``batch`` (StockKey, Date, Close, Volume)."""
    newest = Window.partitionBy("StockKey").orderBy(F.desc("Date"))
    last = with_tails(state, batch).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= TAIL)
    tails = last.groupBy("StockKey").agg(F.sort_array(F.collect_list(F.struct("Date", "Close"))).alias("Tail"))
    # the state's year comes first in its order, so a year that goes on keeps its first close
    opened = state.select("StockKey", "Year", F.lit(0).alias("late"), F.lit(None).cast("date").alias("Date"), F.col("YearOpen").alias("Close"))
    seen = batch.select("StockKey", F.year("Date").alias("Year"), F.lit(1).alias("late"), "Date", "Close")
    opens = opened.unionByName(seen).groupBy("StockKey", "Year").agg(F.min_by("Close", F.struct("late", "Date")).alias("YearOpen"))
    years = opens.groupBy("StockKey").agg(F.max_by("YearOpen", "Year").alias("YearOpen"), F.max("Year").alias("Year"))
    return tails.join(years, "StockKey").select("StockKey", "Tail", "Year", "YearOpen")


class RefreshedViews:
    """Stored views under ``root``; ``members`` are the index members' symbols."""

    def __init__(self, spark: SparkSession, root: str, dim_company: DataFrame, members: Iterable[str],
                 names: Iterable[str] = tuple(VIEWS)):
        self.spark, self.root, self.names = spark, root.rstrip("/"), tuple(names)
        self.dim_company, self.company_small = dim_company, fits_broadcast(dim_company)
        # at most one key for each listed symbol
        self.members = dim_company.where(F.col("StockSymbol").isin(list(members))).select("StockKey")

    def _stored(self, name: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(f"{schema}, load string")
        try:
            return reader.parquet(f"{self.root}/{name}")
        except Exception as e:  # noqa: BLE001 - nothing stored yet
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return None

    def loads(self) -> list[str]:
        """Loads that count, in order."""
        states = self._stored("state", STATE)
        return [] if states is None else sorted(r[0] for r in states.select("load").distinct().collect())

    def state(self, before: str | None = None) -> DataFrame:
        """State after the last load (before ``before``); empty at first."""
        known = [x for x in self.loads() if before is None or x < before]
        if not known:
            return self.spark.createDataFrame([], STATE)
        return self._stored("state", STATE).where(F.col("load") == known[-1]).drop("load")

    def view(self, name: str) -> DataFrame:
        """The stored rows of all loads that count."""
        loads = self.loads()
        return self._stored(name).where(F.col("load").isin(loads)).drop("load")

    def refresh(self, rows: DataFrame, load: str) -> None:
        """Add the (StockKey, Date, Close, Volume) rows of ``load``; loads are ordered as text."""
        later = [x for x in self.loads() if x > load]
        if later:
            raise LateRowsError(f"load {load} comes after {later[0]}")
        batch = _kept(rows.select("StockKey", "Date", "Close", "Volume"), "batch")
        state = self.state(before=load)
        last = state.select("StockKey", F.element_at("Tail", -1)["Date"].alias("_last"))
        last = F.broadcast(last) if self.company_small else last
        late = batch.join(last, "StockKey").where(F.col("Date") <= F.col("_last")).select("StockKey", "Date").take(3)
        if late:
            raise LateRowsError(f"load {load}: not later than what is stored: {[tuple(r) for r in late]}")
        facts = with_tails(state, batch).select(time_key("Date").alias("TimeKey"), "StockKey", "Close", "Volume")
        star = BatchStar(facts, self.dim_company, self.members, state.select("StockKey", "Year", "YearOpen"), self.company_small)
        for name in self.names:
            out = VIEWS[name](star, with_key=True).join(last, "StockKey", "left").where(
                F.col("_last").isNull() | (F.col("Date") > F.col("_last"))).drop("_last")
            self._write(out, name, load)
        self._write(next_state(state, batch), "state", load)

    def _write(self, df: DataFrame, name: str, load: str) -> None:
        (df.withColumn("load", F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("load").parquet(f"{self.root}/{name}"))
