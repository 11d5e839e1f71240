"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tapelens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        STATE_STORE: ROCKSDB,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: str | int = "*", app: str = "tapelens") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return build_session(
        app, f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": "12g"},
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable folder the cluster names in spark.checkpoint.dir.

    A folder of our own is set only where the setting is empty, as in local tests.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may go without the setting."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tapelens-")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
