"""Sources and sinks: round trips over small folders."""

import io
import struct
import wave

import pytest
from pyspark.sql import functions as F

from quillstream.sources import files as IO
from quillstream.streaming import machines as R


def test_scan_expand_inspect_preview(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, t string").coalesce(1).write.parquet(str(tmp_path / "p/one"))
    spark.createDataFrame([(2, None, 3.0)], "k int, t string, v double").coalesce(1).write.parquet(str(tmp_path / "p/two"))
    df = IO.scan(spark, str(tmp_path / "p"), recursive=True)
    assert sorted(r["k"] for r in df.collect()) == [1, 2] and IO.scan(spark, str(tmp_path / "p/one"), columns=["t"]).columns == ["t"]
    assert IO.expand(spark, str(tmp_path / "p")).count() == 2
    assert {r["name"]: (r["rows"], r["nulls"]) for r in IO.inspect(df).collect()} == {"k": (2, 0), "t": (2, 1), "v": (2, 1)}
    assert {r["name"]: r["preview"] for r in IO.preview(df.where("k = 2")).collect()} == {"k": "2", "t": "<null>", "v": "3.0"}
    assert IO.find_files(spark, str(tmp_path / "p"), glob="*.parquet", exclude="/one/").count() == 1


def test_column_json(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None), (3, "c")], "k int, t string")
    wide = IO.column_json(df, ["k", "t"], "k")
    assert wide.first()[:] == ([1, 2, 3], [None, "b", "c"])
    (tmp_path / "d.json").write_text('{"k": [1, 2, 3],\n "t": [null, "b", "c"]}')
    got = IO.from_column_json(spark, str(tmp_path / "d.json"), ["k", "t"], ["t"], 1).collect()
    assert [(r["pos"], r["k"], r["t"]) for r in got] == [(1, 2, "b")]


def wav(samples, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}h", *samples))
    return out.getvalue()


def test_audio(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "t").mkdir()
    for name in ("x", "y"):
        (tmp_path / "a" / f"{name}.wav").write_bytes(wav([0, 16384, -32768, 0], channels=2))
    (tmp_path / "t" / "x.txt").write_text("hello\nworld")
    paired = IO.paired_folder(spark, str(tmp_path / "a"), str(tmp_path / "t"))
    row = IO.decode_wav(paired, "content").first()
    assert row["stem"] == "x" and row["reference"] == "hello\nworld" and row["samples"] == [0.25, -0.5] and row["sample_rate"] == 8000
    assert IO.audio_files(spark, str(tmp_path / "a")).count() == 2
    with pytest.raises(FileNotFoundError):
        IO.audio_files(spark, str(tmp_path / "t"))
    raw = spark.createDataFrame([(bytearray(struct.pack("<3h", 0, 16384, -32768)),), (None,), (bytearray(b"\0"),)], "b binary")
    assert [r["samples"] for r in IO.decode_pcm(raw, "b").collect()] == [[0.0, 0.5, -1.0], None, []]
    assert IO.decode_wav(raw, "b").where("samples IS NULL").count() == 3


def test_messages(spark):
    frames = [bytearray(b'{"type": "a", "n": 1}\0\1\2\0\3'), bytearray(b"no zero"), None]
    got = IO.parse_frames(spark.createDataFrame([(x,) for x in frames], "b binary"), "b", "type string, n int").collect()
    assert [(r["type"], r["n"], bytes(r["pcm"])) for r in got] == [("a", 1, b"\1\2\0\3")]
    packets = spark.createDataFrame([("7|a|b",), ("x|a",), ("9",), (None,), (" 8 |",)], "p string")
    assert [(r["seq"], r["payload"]) for r in IO.parse_packets(packets, "p").collect()] == [(7, "a|b"), (8, "")]
    routed = IO.route_messages(spark.createDataFrame([('{"type": "a", "x": 1}',), ('{"type": "b"}',), ("{",), (None,)], "m string"), "m", "type string, x int", ["a"])
    assert [(r["type"], r["x"]) for r in routed.collect()] == [("a", 1)]
    audio = spark.createDataFrame([(bytearray(b"\0" * 900),), (bytearray(b"\1" * 900),), (bytearray(b"\1"),)], "b binary")
    assert audio.where(R.not_tiny_or_silent(F.col("b"))).count() == 1


def test_sinks(spark, tmp_path):
    results = spark.createDataFrame([("f", "a", "a", 0.1, 0.05), ("g", "b", "c", 0.05, 0.01)], "file string, reference string, prediction string, wer double, cer double")
    assert IO.save_results(results, str(tmp_path / "r")).first()["grade"] == "excellent"
    assert spark.read.csv(str(tmp_path / "r/results"), header=True).count() == 2
    IO.save_jsonl(results, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    blocks = spark.createDataFrame([(2, 1.5, 1.0, "b", "B"), (1, 0.0, 1.0, "a", "A")], "n int, s double, d double, ja string, en string")
    IO.save_srt(blocks, str(tmp_path / "s"), number="n", start="s", duration="d", lines=["ja", "en"])
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*")))
    assert text.startswith("1\n00:00:00,000 --> 00:00:01,000\na\nA\n") and "2\n00:00:01,500 --> 00:00:02,500\nb\nB\n" in text
    segments = spark.createDataFrame([(1, 0, [0.5]), (2, 5, None)], "segment_index int, start int, probs array<double>")
    IO.save_segments(segments, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g")).count() == 2
    IO.append_index(segments, str(tmp_path / "i"))
    IO.append_index(segments, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 4
    log = spark.createDataFrame([("2024-01-02 10:00:00", "x")], "ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    IO.save_requests(log, str(tmp_path / "q"))
    assert (tmp_path / "q" / "date=2024-01-02").exists()
    (tmp_path / "c.csv").write_text("gpu, 1, 2\n")
    assert IO.headerless_csv(spark, str(tmp_path / "c.csv"), "a string, b string, c string").first()[:] == ("gpu", "1", "2")


def test_windowed_counts_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "ab"[m % 2], float(m)) for m in range(40)]
    df = spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    batch = R.windowed_counts(df, "ts", "k", "v")
    stream = R.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "k", "v")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.sql("SELECT * FROM counts").collect())) == sorted(map(str, batch.collect()))
