"""Sessions and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit this engine at any size; a cluster's own settings come on top.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "quillstream", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the tables of a folder, with only the named columns read."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return found.select(*columns) if columns else found


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        conf = spark.conf.get("spark.checkpoint.dir", None)
        if conf is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            conf = tempfile.mkdtemp(prefix="quillstream-")
        context.setCheckpointDir(conf)
    return context.getCheckpointDir()
