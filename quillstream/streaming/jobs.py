"""Bounded runs of streaming queries over files, written to the shared folder and returned as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def file_stream(spark: SparkSession, folder: str, table: str, files: int = 4) -> DataFrame:
    """A table of a folder as a stream, a few files per micro-batch."""
    path = f"{folder.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")  # a glob, as a table may be one file


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query until its input is used up. Modes append (each micro-batch adds files) and complete (each one replaces the result)."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out, schema = f"{base}/out", stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)
