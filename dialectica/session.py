"""Session helpers: a default session, checkpoints in the cluster's shared folder, and table reads."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings for a session this library starts itself; on a cluster the caller's session is used as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "dialectica", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS and conf (dots written as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def materialize(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is spark.checkpoint.dir of the session. Only where that is unset (tests, local runs) a local
    temporary folder takes its place.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="dialectica-")
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores.

    Only an input of fewer splits than cores is shuffled, so at most cores x split size; larger inputs stay as read.
    Use it before Python work, whose cost for a byte is far above that of moving it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def numbered(keys: DataFrame, name: str = "number") -> DataFrame:
    """Distinct keys (one column) numbered from 0 in their order: the same numbers on every run.

    Sorted ranges are counted, and only the table of the ranges is summed in one task.
    """
    key = keys.columns[0]
    rows = materialize(keys.orderBy(key).withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("__part", before.alias("__before")), "__part").select(key, (F.col("__before") + F.col("__row").bitwiseAND((1 << 33) - 1)).alias(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` below `folder`."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet") if "://" not in folder else f"{folder}/{name}.parquet")
