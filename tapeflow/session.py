"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tapeflow", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on and a fixed UTC session zone."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        # Call sites of column expressions cost a round trip each while plans are built.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    A cluster must name a shared folder in that setting. Only with a local master,
    as in tests, is a temporary folder taken and the setting filled in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tapeflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors. The files of the write's
    shuffles are removed when it ends, not at some later collection of garbage."""
    conf, path = df.sparkSession.conf, shared_folder(df.sparkSession, purpose)
    before = conf.get(RELEASE)
    conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
