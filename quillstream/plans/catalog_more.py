"""Registered queries: the remaining filters, joins, segment helpers and text steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import textual as T
from ..operators import aggregates as A
from ..operators import frames as G
from ..operators import ordered as O
from ..session import table
from ..streaming import machines as R
from . import sql_folds as Q
from .catalog import FRAMES, NUDGE, K, frames, query, r6


@query("""SELECT user_id, count(*) FILTER (WHERE value >= 100 AND event_type IN ('click', 'view')) AS kept, count(*) AS entities FROM events GROUP BY user_id""")
def entity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entities (text, label, score) of each user, filtered inside their array."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value")
    lists = e.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("label"), F.col("value").alias("score"))).alias("entities"))
    kept = F.filter("entities", lambda x: (x["score"] >= 100) & x["label"].isin("click", "view"))
    return lists.select("user_id", F.size(kept).cast("long").alias("kept"), F.size("entities").cast("long").alias("entities"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) AS n FROM s WHERE length(trim(s)) > 0 GROUP BY doc_id""")
def embeddable_sentences(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return lines.where(F.length(F.trim("s")) > 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT l_suppkey, string_agg(DISTINCT l_linenumber::VARCHAR, ', ' ORDER BY l_linenumber::VARCHAR) AS ports, min(l_linenumber) AS first_port FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey)
SELECT s_suppkey, s_name, coalesce(ports, 'N/A') AS ports, coalesce(first_port, -1) AS first_port FROM supplier LEFT JOIN p ON s_suppkey = l_suppkey""")
def process_ports(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_quantity").where("l_quantity > 45")
    ports = A.joined_distinct(big, ["l_suppkey"], "l_linenumber").join(big.groupBy("l_suppkey").agg(F.min("l_linenumber").alias("first_port")), "l_suppkey")
    ports = ports.select(F.col("l_suppkey").alias("s_suppkey"), F.col("joined").alias("ports"), "first_port")
    return O.lookup(table(spark, d, "supplier", "s_suppkey", "s_name"), ports, ["s_suppkey"], {"ports": F.lit("N/A"), "first_port": F.lit(-1)})


@query("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def anti_membership(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(names, "o_custkey", "left_anti").select("o_orderkey")


@query("""SELECT round(avg(CASE WHEN event_id % 7 > 0 THEN value END), 6) AS mean, count(CASE WHEN event_id % 7 > 0 THEN value END) AS valid FROM events""")
def mean_without_nan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "value").withColumn("x", F.when(F.col("event_id") % 7 > 0, F.col("value")).otherwise(float("nan")))
    return A.mean_valid(e, "x").select(r6("mean").alias("mean"), "valid")


@query("""SELECT lang, count(*) AS files, CAST(sum(length(regexp_replace(text, '\\n\\s*\\n+', chr(10), 'g'))) AS BIGINT) AS clean_length FROM documents GROUP BY lang""".replace("\\\\", "\\"))
def file_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "text", "lang")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(S.squeeze_newlines(F.col("text"))).cast("long")).alias("clean_length"))


@query()
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 documents by a seeded hash: the same ones on every run."""
    return O.seeded_sample(table(spark, d, "documents", "doc_id", "source"), "doc_id", 100)


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, count(*) AS boundaries, CAST(sum(pos) AS BIGINT) AS places FROM p WHERE x > 0.1 GROUP BY vec_id""")
def boundary_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    at = F.filter(F.transform("embedding", lambda x, i: F.when(x.cast("double") > 0.1, i)), lambda i: i.isNotNull())
    found = e.select("vec_id", at.alias("at")).where(F.size("at") > 0)
    return found.select("vec_id", F.size("at").cast("long").alias("boundaries"), F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x).alias("places"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, lead(list_transform(embedding, lambda x: x::DOUBLE)) OVER (ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT vec_id, list_dot_product(a, b) AS d, sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)) AS n FROM v WHERE b IS NOT NULL)
SELECT vec_id, round(1 - d / n, 6) AS distance, round(d / (n + 1e-8), 6) AS eps_form, round(d / greatest(n, 1e-8), 6) AS max_form FROM c""")
def cosine_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one in id order, by a join on the id's rank."""
    ranked = O.global_rank(table(spark, d, "embeddings", "vec_id", "embedding"), [F.asc("vec_id")], "n")
    pairs = ranked.select("vec_id", "n", F.col("embedding").alias("a")).join(ranked.select((F.col("n") - 1).alias("n"), F.col("embedding").alias("b")), "n")
    a, b = F.col("a"), F.col("b")
    return pairs.select("vec_id", r6(1 - S.cosine(a, b)).alias("distance"), r6(S.cosine(a, b, "eps")).alias("eps_form"), r6(S.cosine(a, b, "max")).alias("max_form"))


@query("""SELECT vec_id, len(embedding[9:24]) AS n, round(embedding[9]::DOUBLE, 6) AS first, len(embedding[49:]) AS tail FROM embeddings""")
def slice_by_time(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    cut = G.slice_by_time(F.col("embedding"), 1.0, 3.0, 8)
    return e.select("vec_id", F.size(cut).cast("long").alias("n"), r6(F.get(cut, F.lit(0)).cast("double")).alias("first"), F.size(G.slice_by_time(F.col("embedding"), 6.0, None, 8)).cast("long").alias("tail"))


@query(FRAMES + """, v AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM f WHERE prob >= 0.5)
SELECT stream_id, round(min(frame_idx) * 0.01 + stream_id * 10.0, 6) AS "start", round((max(frame_idx) + 1) * 0.01 + stream_id * 10.0, 6) AS "end" FROM v GROUP BY stream_id, g""")
def mask_segments(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("offset", F.col("stream_id") * 10.0)
    return G.mask_segments(f, K, F.col("prob") >= 0.5, 0.01, "offset").select(*K, r6("start").alias("start"), r6("end").alias("end"))


@query(FRAMES + """, v AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM f WHERE value >= 50),
r AS (SELECT stream_id, min(frame_idx) AS frame_start, count(*) AS n FROM v GROUP BY stream_id, g HAVING count(*) >= 3) SELECT stream_id, frame_start, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY frame_start) AS INTEGER) AS num FROM r""")
def segment_finaliser(spark: SparkSession, d: str) -> DataFrame:
    runs = G.threshold_runs(frames(spark, d), K, F.col("value") >= 50, "prob").withColumn("seconds", F.col("frames") * 0.1)
    return G.finalise(runs, K, ["frame_start"], "seconds", 0.25).select(*K, "frame_start", "num")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
f AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l WHERE trim(s) <> '')
SELECT doc_id, CAST(min(i) AS INTEGER) AS first, count(*) AS lines, md5(string_agg(trim(s), chr(10) ORDER BY i)) AS digest FROM f GROUP BY doc_id, g""")
def paragraph_runs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))
    return G.paragraphs(lines, ["doc_id"], "i", "s").select("doc_id", "first", "lines", F.md5("paragraph").alias("digest"))


@query(FRAMES + """ SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS recent FROM f""")
def bounded_deque(spark: SparkSession, d: str) -> DataFrame:
    return G.last_n(frames(spark, d), K, ["frame_idx"], "event_type", 3).select("event_id", F.array_join("recent", ",").alias("recent"))


@query("""SELECT vec_id, len(list_concat(embedding, embedding[1:20])[-70:]) AS n, round(list_concat(embedding, embedding[1:20])[-70:][1]::DOUBLE, 6) AS first FROM embeddings""")
def ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    ring = R.ring(F.col("embedding"), F.slice("embedding", 1, 20), 70)
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.size(ring).cast("long").alias("n"), r6(F.get(ring, F.lit(0)).cast("double")).alias("first"))


@query(FRAMES + """ SELECT stream_id, round(min(rms), 6) AS rms_min, round(max(rms), 6) AS rms_max, round(sum(rms) / count(*), 6) AS rms_avg, round(sqrt(greatest(sum(rms * rms) / count(*) - (sum(rms) / count(*)) * (sum(rms) / count(*)), 0)), 6) AS rms_std FROM f GROUP BY stream_id""")
def running_energy(spark: SparkSession, d: str) -> DataFrame:
    out = A.series_stats(frames(spark, d), K, "rms")
    return out.select(*K, r6("min").alias("rms_min"), r6("max").alias("rms_max"), r6("mean").alias("rms_avg"), r6("std").alias("rms_std"))


@query(Q.TEXT_STEPS)
def text_steps(spark: SparkSession, d: str) -> DataFrame:
    """Dot words glued, line ends expanded, symbol blocks split, comments and logging calls removed."""
    t = F.col("text")
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select(
        "doc_id", F.md5(S.merge_dot_words(t)).alias("dots"), F.size(S.newline_expansion(F.split(t, r"(?<=\n)(?!\n)"))).alias("segments"), F.size(S.split_symbols(t)).alias("symbols"),
        F.md5(T.remove_calls_udf()(T.strip_comments_udf()(t))).alias("code"),
    )


@query()
def appended_text(spark: SparkSession, d: str) -> DataFrame:
    pairs = O.previous_row(table(spark, d, "conversations"), ["conv_id"], ["turn"], ["text"]).where("prev_text IS NOT NULL")
    a, b = F.col("prev_text"), F.col("text")
    return pairs.select("conv_id", "turn", T.appended_count_udf()(a, b).alias("words"), F.md5(T.appended_restored_udf()(a, b)).alias("restored"), F.size(T.opcodes_udf()(a, b)).alias("opcodes"))


@query(Q.SPEECH_EVENTS)
def speech_events(spark: SparkSession, d: str) -> DataFrame:
    """Start and end events of the hybrid machine's segments."""
    f = frames(spark, d).select(*K, F.col("frame_idx").alias("idx"), "prob")
    step = R.hybrid_vad({"start_frames": 3, "end_silence": 4, "soft_limit": 20, "hard_limit": 40, "threshold": 0.4, "pad": 1})
    found = R.fold_batch(f, K, ["idx"], step, "start int, end int, reason string")
    return R.fold_batch(found, K, ["start"], R.segment_events(5), "event string, frame int, reason string")


@query()
def incremental_transcript(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's texts so far, as a recogniser would send them, and what each adds."""
    grown = G.progressive_text(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text")
    rows = grown.select("conv_id", F.col("turn").alias("idx"), F.col("text_so_far").alias("text"))
    return R.fold_batch(rows, ["conv_id"], ["idx"], R.incremental_transcript(), "idx long, is_continued boolean, new_text string")


@query(Q.SEGMENT_METADATA)
def segment_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A run's metadata as JSON; parts that are missing are left out."""
    runs = G.threshold_runs(frames(spark, d), K, F.col("value") >= 50, "prob", 2)
    vad = F.struct(F.round(F.col("mean_prob") + float(NUDGE), 4).alias("mean"), F.round(F.col("std_prob") + float(NUDGE), 4).alias("std"))
    meta = F.struct(F.concat(F.lit("segment_"), F.col("frame_start").cast("string")).alias("filename"), F.col("stream_id").alias("utterance_id"), F.round(F.col("frames") * 0.01, 3).alias("duration_sec"),
                    F.lit(16000).alias("sample_rate"), F.when(F.col("frames") > 3, vad).alias("vad_stats"))
    return runs.select(*K, "frame_start", F.to_json(meta).alias("meta"))


@query("""SELECT CAST(floor(epoch(ts)) AS BIGINT) // 600 * 600 AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """The event-time windows of ``tumbling_counts``, run as a stream to its end."""
    from ..streaming.jobs import drain, file_stream

    out = drain(R.windowed_counts(file_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "10 minutes"), "complete")
    return out.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "n", r6("total").alias("total"))


@query("""SELECT event_id, least(value / 200, 1.0) >= 0.5 AS is_speech, event_type FROM events WHERE event_type IN ('click', 'purchase')""")
def stream_route(spark: SparkSession, d: str) -> DataFrame:
    """Rows of known types as they arrive."""
    from ..streaming.jobs import drain, file_stream

    rows = file_stream(spark, d, "events").where(F.col("event_type").isin("click", "purchase"))
    return drain(rows.select("event_id", (F.least(F.col("value") / 200, F.lit(1.0)) >= 0.5).alias("is_speech"), "event_type"))


@query(Q.HOTWORDS)
def stream_hotwords(spark: SparkSession, d: str) -> DataFrame:
    """The stateful fold of ``hotwords_decay`` over a stream of conversations."""
    from ..streaming.jobs import drain, file_stream

    rows = file_stream(spark, d, "conversations", 1000).select("conv_id", F.col("turn").alias("idx"), S.words(F.col("text")).alias("tokens"))
    return drain(R.fold_stream(rows, ["conv_id"], ["idx"], R.decayed_words(), "idx int, rank int, word string, weight double")).withColumn("weight", r6("weight"))


@query("""SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS batch, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 8 AS INTEGER) AS slot FROM events""")
def batch_queue(spark: SparkSession, d: str) -> DataFrame:
    return O.batch_queue(table(spark, d, "events", "user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id", "batch", "slot")


@query("""WITH t AS (SELECT l_suppkey, l_linenumber AS size, l_quantity / (l_extendedprice / 1000) AS rate FROM lineitem WHERE l_extendedprice <= 30000),
b AS (SELECT l_suppkey, size, rate, row_number() OVER (PARTITION BY l_suppkey ORDER BY rate DESC, size) AS k FROM t)
SELECT s_suppkey AS l_suppkey, CAST(coalesce(size, 1) AS BIGINT) AS batch_size, round(coalesce(rate, 0.0), 6) AS throughput FROM (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem) LEFT JOIN b ON s_suppkey = l_suppkey AND k = 1""")
def best_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Lines as trials: the line number is the batch size, the quantity what was done, a thousandth of the price the time, the price the memory."""
    t = table(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").withColumn("seconds", F.col("l_extendedprice") / 1000)
    out = A.best_throughput(t, ["l_suppkey"], "l_linenumber", "l_quantity", "seconds", "l_extendedprice", 30000)
    return out.select("l_suppkey", "batch_size", r6("throughput").alias("throughput"))


@query("""SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50""")
def dataset_head(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import files as IO

    return IO.head(table(spark, d, "documents", "doc_id", "source"), 50, "doc_id")
