"""Shared helpers: tables written to cut lineage, columns and their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def written(df: DataFrame) -> DataFrame:
    """The table as written to the shared folder and read back: lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with those an operator adds."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def free(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
