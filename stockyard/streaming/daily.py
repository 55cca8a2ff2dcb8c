"""The daily price load as a Structured Streaming job.

New quote files dropped into a folder are picked up by a file stream; each
micro-batch runs the daily flow (L8). Because the flow only appends rows whose
key is new, a micro-batch replayed after a failure (the checkpoint records
which files were committed) changes nothing: the sink is effectively
exactly-once. Late quotes for an already loaded day are simply new keys. Lines are read
as text and checked like a file load's, so a malformed one goes to the quarantine
and does not stop the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stockyard.plans.flows import StoredWarehouse, daily_flow
from stockyard.schemas import QUOTE_SCHEMA
from stockyard.sources.files import CORRUPT, split_bad_rows


def quote_stream(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in QUOTE_SCHEMA.fields]
                        + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.readStream.schema(text).option("header", True).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.csv"))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(source_dir)


def start_daily_stream(spark: SparkSession, wh: StoredWarehouse, source_dir: str,
                       checkpoint: str, available_now: bool = True,
                       apply_high_water: bool = False) -> StreamingQuery:
    """Run the daily flow on every micro-batch of new quote files.

    ``apply_high_water`` is off by default: in streaming mode the file log,
    not the date, decides what is new, so late files for old days still load.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_bad_rows(batch, QUOTE_SCHEMA, dates=["time"], required=["time", "MaCK"])
        daily_flow(wh, good, apply_high_water=apply_high_water, bad_rows=bad)

    w = (quote_stream(spark, source_dir).writeStream.foreachBatch(each_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
