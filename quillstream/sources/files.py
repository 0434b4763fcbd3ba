"""Sources and sinks: Parquet, JSON, CSV, paired folders, audio bytes, messages, subtitles."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import srt_block

# --- sources -----------------------------------------------------------------------------------------------------------


def scan(spark: SparkSession, *paths: str, columns: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """Parquet files, folders and globs as one table, by name; only the named columns are read."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("mergeSchema", "true")
    found = reader.parquet(*paths)
    return found.select(*columns) if columns else found


def expand(spark: SparkSession, *paths: str, suffix: str = ".parquet") -> DataFrame:
    """The different files behind paths, folders and globs, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(list(paths))
    return found.select("path", "length", "modificationTime").distinct().orderBy("path")


def find_files(spark: SparkSession, *paths: str, glob: str = "*", after: str | None = None, exclude: str | None = None) -> DataFrame:
    """path, length and modificationTime; times strictly after ``after``; without paths that match the regular expression ``exclude``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(paths)).drop("content")
    if after:
        found = found.where(F.col("modificationTime") > F.lit(after).cast("timestamp"))
    return (found.where(~F.col("path").rlike(exclude)) if exclude else found).distinct().orderBy("path")


def inspect(df: DataFrame) -> DataFrame:
    """A row per column: place, name, type, rows, nulls. One pass over the table."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{k}") for k, c in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("name"), F.lit(t).alias("type"), F.col("_n").alias("rows"), F.col(f"_{k}").alias("nulls")) for k, (c, t) in enumerate(df.dtypes)])
    return one.select(F.inline(rows))


def preview(df: DataFrame, width: int = 60) -> DataFrame:
    """A row per column of the first row: name, type, and the value's beginning or <null>."""
    first = df.limit(1)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(t).alias("type"), F.coalesce(F.left(F.to_json(F.struct(F.col(f"`{c}`"))) if "<" in t else F.col(f"`{c}`").cast("string"), F.lit(width)), F.lit("<null>")).alias("preview")) for c, t in df.dtypes])
    return first.select(F.inline(cells))


def column_json(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row with each column as an array in one order; nulls keep their places. For samples, not whole tables."""
    items = F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("v"))))
    return df.agg(items.alias("_i")).select(*[_pick(c) for c in columns])


def _pick(c: str) -> Column:
    return F.transform("_i", lambda x: x["v"][c]).alias(c)


def rows_of_columns(df: DataFrame, columns: list[str], required: list[str], limit: int | None = None) -> DataFrame:
    """Rows by position of array columns; rows without a required value go, then the limit holds."""
    zipped = df.select(F.posexplode(F.arrays_zip(*columns)).alias("pos", "_z")).select("pos", "_z.*")
    for c in required:
        zipped = zipped.where(F.col(c).isNotNull())
    return zipped.orderBy("pos").limit(limit) if limit is not None else zipped


def from_column_json(spark: SparkSession, path: str, columns: list[str], required: list[str], limit: int | None = None) -> DataFrame:
    return rows_of_columns(spark.read.option("multiLine", "true").json(path), columns, required, limit)


def paired_folder(spark: SparkSession, audio: str, texts: str, limit: int | None = None) -> DataFrame:
    """Audio and text files of one stem, by name."""
    stem = lambda p: F.regexp_extract(p, r"([^/]+)\.[^./]+$", 1)
    a = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(audio).select(stem(F.col("path")).alias("stem"), F.col("path").alias("audio_path"), "content")
    t = spark.read.option("pathGlobFilter", "*.txt").text(texts, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("reference"))
    both = a.join(t, "stem").orderBy("stem")
    return both.limit(limit) if limit is not None else both


def audio_files(spark: SparkSession, *paths: str, recursive: bool = False) -> DataFrame:
    """Paths of audio files; an empty result is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{wav,mp3,flac,m4a,ogg,opus}").load(list(paths)).select("path", "length").orderBy("path")
    if found.limit(1).count() == 0:
        raise FileNotFoundError("no audio files")
    return found


def decode_pcm(df: DataFrame, content: str, dtype: str = "int16", channels: int = 1, name: str = "samples") -> DataFrame:
    """Raw little-endian samples as floats in [-1, 1], the channels' mean."""

    @F.pandas_udf("array<float>")
    def apply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: None if b is None else _mono(np.frombuffer(b[: len(b) // (np.dtype(dtype).itemsize * channels) * np.dtype(dtype).itemsize * channels], np.dtype(dtype)), channels))

    return df.withColumn(name, apply(F.col(content)))


def _mono(x: np.ndarray, channels: int) -> np.ndarray:
    scaled = x.astype(np.float32) / np.float32(np.iinfo(x.dtype).max + 1) if x.dtype.kind == "i" else x.astype(np.float32)
    return scaled.reshape(-1, channels).mean(axis=1)


def decode_wav(df: DataFrame, content: str) -> DataFrame:
    """samples and sample_rate of WAV bytes; null for bytes that are none."""

    @F.pandas_udf("samples array<float>, sample_rate int")
    def apply(part: pd.Series) -> pd.DataFrame:
        out = []
        for b in part:
            try:
                with wave.open(io.BytesIO(b)) as w:
                    kind = {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
                    x = np.frombuffer(w.readframes(w.getnframes()), kind)
                    x = (x.astype(np.int16) - 128).astype(np.int8) if kind is np.uint8 else x
                    out.append((_mono(x, w.getnchannels()), w.getframerate()))
            except (wave.Error, EOFError, KeyError, TypeError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["samples", "sample_rate"])

    return df.withColumn("_w", apply(F.col(content))).select("*", "_w.*").drop("_w")


def audio_cell(array: Column, content: Column, path: Column) -> Column:
    """Where a cell's audio comes from: the first of array, bytes and path that is there."""
    return F.when(array.isNotNull(), "array").when(content.isNotNull(), "bytes").when(path.isNotNull(), "path")


def parse_frames(df: DataFrame, content: str, header: str) -> DataFrame:
    """Messages of a JSON header, a zero byte, and PCM: the header's fields and ``pcm``; malformed ones go."""
    cut = F.expr(f"locate('00', regexp_replace(hex({content}), '(..)', '$1 '))")
    at = F.floor((cut - 1) / 3).cast("int")
    out = df.withColumn("_at", F.when(cut > 0, at)).where("_at IS NOT NULL")
    text = F.expr(f"decode(substring({content}, 1, _at), 'UTF-8')")
    out = out.withColumn("_h", F.from_json(text, header)).withColumn("pcm", F.expr(f"substring({content}, _at + 2)"))
    return out.where("_h IS NOT NULL").select(*df.columns, "_h.*", "pcm")


def parse_packets(df: DataFrame, packet: str) -> DataFrame:
    """seq and payload of ``seq|payload``; packets that don't parse go."""
    parts = F.split(packet, r"\|", 2)
    seq = F.when(F.get(parts, F.lit(0)).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.get(parts, F.lit(0))).try_cast("long"))
    return df.withColumn("seq", seq).withColumn("payload", F.get(parts, F.lit(1))).where(F.col("seq").isNotNull() & F.col("payload").isNotNull())


def route_messages(df: DataFrame, message: str, schema: str, kinds: list[str]) -> DataFrame:
    """Fields of JSON messages of the known types; others and invalid ones go."""
    parsed = df.withColumn("_m", F.from_json(message, schema))
    return parsed.where(F.col("_m.type").isin(*kinds)).select(*df.columns, "_m.*")


def headerless_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


# --- sinks -------------------------------------------------------------------------------------------------------------


def grade(wer: Column) -> Column:
    """The grades' limits are 8, 15 and 25 percent."""
    return F.when(wer < 0.08, "excellent").when(wer < 0.15, "good").when(wer < 0.25, "fair").otherwise("poor")


def save_results(results: DataFrame, path: str, wer: str = "wer", cer: str = "cer") -> DataFrame:
    """Writes the rows as CSV and one JSON record of metrics; returns the metrics."""
    results.write.mode("overwrite").csv(f"{path}/results", header=True)
    metrics = results.agg(F.avg(wer).alias("wer"), F.avg(cer).alias("cer"), F.count(F.lit(1)).alias("rows")).withColumn("grade", grade(F.col("wer")))
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    return metrics


def save(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Writes a table in the format that the path's suffix names (.json and .jsonl, .csv, .parquet, .orc; Parquet without one) and returns the path."""
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    writer = df.write.mode(mode)
    if suffix in ("json", "jsonl"):
        writer.json(path)
    elif suffix == "csv":
        writer.csv(path, header=True)
    elif suffix in ("parquet", "orc"):
        writer.format(suffix).save(path)
    else:
        raise ValueError(f"no format for .{suffix}")
    return path


def head(df: DataFrame, n: int, order: str | None = None) -> DataFrame:
    """The first rows of a dataset, by a column where there is one, for ``save``."""
    return (df.orderBy(order) if order else df).limit(n)


def save_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def srt_text(df: DataFrame, number: str, start: str, duration: str, lines: list[str]) -> DataFrame:
    """number and block of each subtitle."""
    return df.select(F.col(number).alias("number"), srt_block(F.col(number), F.col(start), F.col(duration), *[F.col(c) for c in lines]).alias("block"))


def save_srt(df: DataFrame, path: str, **columns) -> None:
    """One text part per partition, in order of the number."""
    srt_text(df, **columns).repartitionByRange("number").sortWithinPartitions("number").select("block").write.mode("overwrite").text(path)


def save_segments(segments: DataFrame, path: str, key: str = "segment_index") -> None:
    """Segments with their probabilities, a folder each; what is out of range is null, nothing is made up."""
    segments.write.mode("overwrite").partitionBy(key).json(path)


def append_index(segments: DataFrame, path: str) -> None:
    """Append to an index table; usable as a foreachBatch sink, which also makes it run once per batch id."""
    segments.write.mode("append").parquet(path)


def save_requests(log: DataFrame, path: str, time: str = "ts") -> None:
    log.withColumn("date", F.date_format(time, "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)
