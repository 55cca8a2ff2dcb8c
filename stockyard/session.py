"""Session construction, shared scratch location and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a dimension may hold and still be broadcast. A dimension row here is a
# handful of short columns (~100 bytes), so this keeps broadcasts under ~20 MB.
BROADCAST_ROW_LIMIT = 200_000


def build_session(master: str | None = None, app: str = "stockyard",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the library relies on.

    * UTC session time zone (date parts must not depend on the host).
    * AQE on: partitions are coalesced and skewed joins split at runtime, and
      shuffle joins whose side turns out small are turned into broadcasts.
    * Shuffle partitions: on a cluster leave Spark's setting (size it to the
      data, AQE coalesces); locally default to 2 x cores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions is None and master and master.startswith("local"):
        inner = master[len("local["):-1] if "[" in master else "1"
        cores = (os.cpu_count() or 8) if inner in ("*", "") else int(inner)
        shuffle_partitions = max(2 * cores, 2)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``. In local mode, where one
    process does everything, a fresh private folder serves when none is configured;
    on a cluster that would scatter files over the executors' disks, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="stockyard-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table of this run, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fits_broadcast(probe: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when ``probe`` has at most ``max_rows`` rows.

    ``limit(n+1).count()`` stops early, and on a stored table the count is
    answered from file footers, so the check is cheap.
    """
    return probe.limit(max_rows + 1).count() <= max_rows


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str],
                 position: str | None = None) -> DataFrame:
    """A small literal table built JVM-side (inline over literal structs), so
    using it starts no Python worker. ``position`` adds the 0-based row index."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    one = spark.range(1)
    if position:
        return one.select(F.posexplode(F.array(*structs)).alias(position, "_r")).select(
            *[F.col(f"_r.{n}").alias(n) for n in names], position)
    return one.select(F.inline(F.array(*structs)))
