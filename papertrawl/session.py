"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's join even where an aggregate on the same key then needs a shuffle of its own
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(app: str = "papertrawl", master: str | None = None, **extra: str) -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        b = b.config(key, value)
    return b


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by the cluster; in a local session, one under /tmp.

    A cluster without the setting is refused: a machine-local folder would not survive a lost executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = f"/tmp/papertrawl-checkpoints-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later branches share the rows and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, counted as they pass: progress without another job."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def with_local_timers(spark: SparkSession) -> SparkSession:
    """Session settings the streaming jobs need when the session was built elsewhere."""
    for key in ("spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def ship_with_tasks(module_name: str) -> None:
    """Send this module's functions along with the tasks, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
