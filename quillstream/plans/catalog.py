"""Registered queries over the driver's tables, and the SQL that each is held against.

``events`` plays the frame series: a stream is a user, its order is (ts, event_id), a frame's probability is value / 200 up
to 1, its energy value / 1000, and it is voiced from value 50 on. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as G
from ..operators import ordered as O
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
K = ["stream_id"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace(", 6)", f" + {NUDGE}, 6)")
        return f

    return put


#: Added before rounding on both sides, so that means of short decimals, which often end in an exact half, round alike.
NUDGE = "3e-9"


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + float(NUDGE), 6)


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").withColumnRenamed("user_id", "stream_id")
    out = G.frame_index(e, K, ["ts", "event_id"])
    return out.select("stream_id", "event_id", "event_type", "value", "frame_idx", F.least(F.col("value") / 200, F.lit(1.0)).alias("prob"), (F.col("value") / 1000).alias("rms"))


def voiced() -> Column:
    return F.col("value") >= 50


FRAMES = """WITH f AS (SELECT user_id AS stream_id, event_id, event_type, value,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
  least(value / 200, 1.0) AS prob, value / 1000 AS rms FROM events)"""
RUNS = FRAMES + """, v AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM f WHERE value >= 50),
r AS (SELECT stream_id, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, count(*) AS frames, avg(prob) AS mean_prob,
  coalesce(stddev_samp(prob), 0) AS std_prob FROM v GROUP BY stream_id, g)"""


# --- runs and segments -------------------------------------------------------------------------------------------------


@query(RUNS + " SELECT stream_id, frame_start, frame_end, frames, round(mean_prob, 6) AS mean_prob, round(std_prob, 6) AS std_prob FROM r WHERE frames >= 3")
def speech_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = G.threshold_runs(frames(spark, d), K, voiced(), "prob", 3)
    return runs.select(*K, "frame_start", "frame_end", "frames", r6("mean_prob").alias("mean_prob"), r6("std_prob").alias("std_prob"))


MERGED = RUNS + """, b AS (SELECT *, CASE WHEN frame_start - lag(frame_end) OVER (PARTITION BY stream_id ORDER BY frame_start) - 1 < 2 THEN 0 ELSE 1 END AS b FROM r),
c AS (SELECT *, sum(b) OVER (PARTITION BY stream_id ORDER BY frame_start) AS m FROM b),
s AS (SELECT stream_id, min(frame_start) AS frame_start, max(frame_end) AS frame_end, count(*) AS parts FROM c GROUP BY stream_id, m
  HAVING max(frame_end) - min(frame_start) + 1 >= 3)"""


@query(MERGED + " SELECT * FROM s")
def speech_runs_merged(spark: SparkSession, d: str) -> DataFrame:
    return G.merge_gaps(G.threshold_runs(frames(spark, d), K, voiced(), "prob"), K, 2, 3)


@query(FRAMES + """, v AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM f WHERE value < 50)
SELECT stream_id, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, count(*) AS frames FROM v GROUP BY stream_id, g HAVING count(*) >= 3""")
def nonspeech_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.threshold_runs(frames(spark, d), K, ~voiced(), "prob", 3).select(*K, "frame_start", "frame_end", "frames")


def _bounds(f: DataFrame) -> DataFrame:
    return f.groupBy(*K).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))


@query(MERGED + """, e AS (SELECT stream_id, max(frame_idx) AS last FROM f GROUP BY stream_id),
n AS (SELECT stream_id, coalesce(lag(frame_end) OVER (PARTITION BY stream_id ORDER BY frame_start) + 1, 0) AS frame_start, frame_start - 1 AS frame_end FROM s
  UNION ALL SELECT e.stream_id, coalesce((SELECT max(frame_end) FROM s WHERE s.stream_id = e.stream_id) + 1, 0), e.last FROM e)
SELECT stream_id, frame_start, frame_end, 'speech' AS type, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY frame_start) AS INTEGER) AS num FROM s WHERE false
UNION ALL SELECT stream_id, frame_start, frame_end, type, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY frame_start) AS INTEGER) FROM (
  SELECT stream_id, frame_start, frame_end, 'speech' AS type FROM s UNION ALL SELECT stream_id, frame_start, frame_end, 'non_speech' FROM n WHERE frame_end >= frame_start)""")
def segments_all(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    speech = G.merge_gaps(G.threshold_runs(f, K, voiced(), "prob"), K, 2, 3).select(*K, "frame_start", "frame_end")
    rest = G.complement(speech, K, _bounds(f)).withColumn("type", F.lit("non_speech"))
    return G.number(speech.withColumn("type", F.lit("speech")).unionByName(rest), K, ["frame_start"])


WAVES = FRAMES + """, n AS (SELECT *, lag(prob) OVER w AS before, lead(prob) OVER w AS after FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx)),
v AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM n WHERE prob >= 0.5),
w0 AS (SELECT stream_id, min(frame_idx) AS frame_start, max(frame_idx) + 1 AS frame_end, count(*) AS frame_len, min(prob) AS mn, max(prob) AS mx, avg(prob) AS av,
  arg_min_null(before, frame_idx) AS entry_prob, arg_max_null(after, frame_idx) AS exit_prob FROM v GROUP BY stream_id, g),
w1 AS (SELECT *, mx - (coalesce(entry_prob, 0) + coalesce(exit_prob, 0)) / 2 AS prominence, mx - least(mn, coalesce(entry_prob, 0), coalesce(exit_prob, 0)) AS excursion FROM w0),
w2 AS (SELECT * FROM w1 WHERE entry_prob IS NOT NULL AND exit_prob IS NOT NULL AND frame_len > 1 AND prominence >= 0.05 AND excursion >= 0.04 AND mx >= 0.55 AND frame_len >= 3)"""


@query(WAVES + " SELECT stream_id, frame_start, frame_end, frame_len, round(av, 6) AS avg_prob, round(prominence, 6) AS prominence FROM w2")
def waves_valid(spark: SparkSession, d: str) -> DataFrame:
    waves = G.speech_waves(frames(spark, d), K).where("is_valid")
    return waves.select(*K, "frame_start", "frame_end", "frame_len", r6("avg_prob").alias("avg_prob"), r6("prominence").alias("prominence"))


@query(WAVES + """ SELECT stream_id, frame_start, frame_len, round(prominence * ln(1 + 0.5 * frame_len * 0.01), 6) AS score FROM w2
ORDER BY prominence * ln(1 + 0.5 * frame_len * 0.01) DESC, stream_id, frame_start LIMIT 5""")
def waves_top5(spark: SparkSession, d: str) -> DataFrame:
    top = G.top_waves(G.speech_waves(frames(spark, d), K).where("is_valid"), order=["stream_id", "frame_start"])
    return top.select(*K, "frame_start", "frame_len", r6("score").alias("score"))


PAUSES = FRAMES + """, v AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM f WHERE rms < 0.05),
l AS (SELECT stream_id, max(frame_idx) AS last FROM f GROUP BY stream_id),
p AS (SELECT v.stream_id, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, count(*) AS frames, avg(rms) AS avg_rms FROM v GROUP BY v.stream_id, g HAVING count(*) >= 3)"""


@query(PAUSES + " SELECT stream_id, frame_start, frame_end, frames FROM p JOIN l USING (stream_id) WHERE frame_end < last")
def pauses_energy(spark: SparkSession, d: str) -> DataFrame:
    return G.pauses(frames(spark, d), K, "rms", 0.05, 3).select(*K, "frame_start", "frame_end", "frames")


@query(PAUSES + """ SELECT stream_id, frame_start, frame_end, CASE WHEN avg_rms < 0.001 THEN 'silent' WHEN avg_rms < 0.03 THEN 'very_quiet' WHEN avg_rms < 0.12 THEN 'normal'
 WHEN avg_rms < 0.25 THEN 'loud' ELSE 'very_loud' END AS loudness FROM p""")
def pauses_classified(spark: SparkSession, d: str) -> DataFrame:
    found = G.pauses(frames(spark, d), K, "rms", 0.05, 3, include_open=True)
    return found.select(*K, "frame_start", "frame_end", S.bucket(F.col("mean_prob"), S.LOUDNESS).alias("loudness"))


@query(FRAMES + """, l AS (SELECT stream_id, max(frame_idx) AS last FROM f GROUP BY stream_id),
v AS (SELECT stream_id, frame_idx, frame_idx - lag(frame_idx) OVER (PARTITION BY stream_id ORDER BY frame_idx) > 4 AS b FROM f WHERE value >= 60),
c AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM v),
u AS (SELECT stream_id, min(frame_idx) AS s, max(frame_idx) AS e FROM c WHERE g = 0 GROUP BY stream_id)
SELECT stream_id, coalesce(s, 0) AS frame_start, coalesce(least(e + 4, last), last) AS frame_end FROM l LEFT JOIN u USING (stream_id)""")
def hangover_bounds(spark: SparkSession, d: str) -> DataFrame:
    return G.hangover_bounds(frames(spark, d), K, F.col("value") >= 60, 4)


@query(FRAMES + """, v AS (SELECT stream_id, event_type AS speaker, frame_idx FROM f WHERE value >= 20),
b AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w - 1 < 3 AND speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS b FROM v WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx)),
c AS (SELECT *, sum(b) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM b)
SELECT stream_id, speaker, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, count(*) AS parts FROM c GROUP BY stream_id, speaker, g""")
def merge_same_key_gap(spark: SparkSession, d: str) -> DataFrame:
    turns = frames(spark, d).where("value >= 20").select(*K, F.col("event_type").alias("speaker"), F.col("frame_idx").alias("frame_start"), F.col("frame_idx").alias("frame_end"))
    return G.merge_gaps(turns, K, 3, same="speaker", replace_end=True)


@query(FRAMES + """, b AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY stream_id ORDER BY frame_idx) - 1 < 3 THEN 0 ELSE 1 END AS b FROM f WHERE value >= 80),
c AS (SELECT *, sum(b) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM b)
SELECT stream_id, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, count(*) AS parts FROM c GROUP BY stream_id, g HAVING max(frame_idx) - min(frame_idx) + 1 >= 4""")
def merge_gap_filter(spark: SparkSession, d: str) -> DataFrame:
    points = frames(spark, d).where("value >= 80").select(*K, F.col("frame_idx").alias("frame_start"), F.col("frame_idx").alias("frame_end"))
    return G.merge_gaps(points, K, 3, 4)


@query(FRAMES + """, i AS (SELECT stream_id, event_id, frame_idx * 10 AS s, frame_idx * 10 + CAST(floor(value) AS INTEGER) AS e FROM f),
m AS (SELECT *, max(e) OVER (PARTITION BY stream_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
SELECT stream_id, event_id, greatest(s, seen) AS s, e FROM m WHERE seen IS NULL OR e > seen""")
def overlap_clip(spark: SparkSession, d: str) -> DataFrame:
    spans = frames(spark, d).select(*K, "event_id", (F.col("frame_idx") * 10).alias("s"), (F.col("frame_idx") * 10 + F.floor("value").cast("int")).alias("e"))
    return G.clip_overlaps(spans, K, "s", "e", ["event_id"])


@query(FRAMES + """, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY stream_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS b FROM f),
g AS (SELECT *, sum(b) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM c),
t AS (SELECT stream_id, g, any_value(event_type) AS event_type, min(frame_idx) AS "start", max(frame_idx) AS last, count(*) AS rows FROM g GROUP BY stream_id, g)
SELECT stream_id, event_type, "start", coalesce(lead("start") OVER (PARTITION BY stream_id ORDER BY g), last) AS "end", rows FROM t""")
def text_change_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.text_runs(frames(spark, d), K, ["frame_idx"], "event_type", "frame_idx").select(*K, "event_type", "start", "end", "rows")


@query(FRAMES + """, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY stream_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS b FROM f),
g AS (SELECT *, sum(b) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM c),
t AS (SELECT stream_id, g, any_value(event_type) AS event_type, min(frame_idx) AS "start", max(frame_idx) AS last FROM g GROUP BY stream_id, g),
u AS (SELECT stream_id, event_type, "start", coalesce(lead("start") OVER (PARTITION BY stream_id ORDER BY g), last) AS "end" FROM t)
SELECT * FROM u WHERE "end" - "start" >= 2 AND length(event_type) >= 5""")
def text_change_runs_long(spark: SparkSession, d: str) -> DataFrame:
    return G.text_runs(frames(spark, d), K, ["frame_idx"], "event_type", "frame_idx", least_length=5, least_duration=2).select(*K, "event_type", "start", "end")


def _chunk_sql(mode: str) -> str:
    stop = "CASE WHEN n > 2500 THEN CAST(ceil((n - 2500) / 2100.0) AS BIGINT) * 2100 ELSE 0 END" if mode == "stop" else "n - 1"
    padded = "n - s < 1250" if mode == "pad" else "false"
    tail = " AND least(s + 2500, n) - s >= 312" if mode == "drop" else ""
    return f"""WITH n AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents), g AS (SELECT doc_id, n, unnest(range(0, CAST({stop} AS BIGINT) + 1, 2100)) AS s FROM n WHERE n > 0)
SELECT doc_id, CAST(s // 2100 AS INTEGER) AS chunk, s AS "start", least(s + 2500, n) AS "end", {padded} AS padded,
  CASE WHEN {padded} THEN 2500 ELSE least(s + 2500, n) - s END AS samples FROM g WHERE true{tail}"""


def _chunks(mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return G.chunks(table(spark, d, "documents", "doc_id", "text").select("doc_id", F.length("text").alias("n")), F.col("n"), 2500, 400, mode).drop("n")

    run.__name__ = f"chunk_grid_{mode}"
    return run


for _mode in ("pad", "stop", "plain", "drop"):
    query(_chunk_sql(_mode))(_chunks(_mode))


@query("""WITH n AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents)
SELECT doc_id, s AS "start", s + 2000 AS "end", s + 1000.0::DOUBLE AS mid FROM (SELECT doc_id, unnest(range(0, n - 2000 + 1, 500)) AS s FROM n WHERE n >= 2000)""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return G.full_windows(table(spark, d, "documents", "doc_id", "text").select("doc_id", F.length("text").alias("n")), F.col("n"), 2000, 500).drop("n")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), l AS (SELECT user_id, n, unnest(range(10, least(40, n) + 1, 10)) AS length FROM n WHERE n >= 10)
SELECT user_id, CAST(length AS INTEGER) AS length, CAST(unnest(range(0, n - length + 1, 10)) AS INTEGER) AS "start" FROM l""")
def sub_signals(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return G.sub_signals(sizes, F.col("n"), 10, 40, 10).drop("n")


@query("""SELECT CAST(floor(epoch(ts)) AS BIGINT) // 600 * 600 AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.machines import windowed_counts

    out = windowed_counts(table(spark, d, "events", "ts", "event_type", "value"), "ts", "event_type", "value", "10 minutes")
    return out.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "n", r6("total").alias("total"))


@query("""WITH o AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type FROM events), w AS (SELECT (t // 300 - unnest([0, 1])) * 300 AS s, t, event_type FROM o)
SELECT s AS window_start, event_type, count(*) AS n FROM w WHERE t >= s AND t < s + 600 GROUP BY ALL""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    out = table(spark, d, "events", "ts", "event_type").groupBy(F.window("ts", "10 minutes", "5 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "n")


@query(FRAMES + """ SELECT stream_id, min(frame_idx) AS frame_start, max(frame_idx) AS frame_end, max(frame_idx) - min(frame_idx) + 1 AS frames FROM f WHERE rms >= 0.1 GROUP BY stream_id""")
def trim_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.trim_edges(frames(spark, d), K, "rms", 0.1)


@query(FRAMES + """ SELECT event_id, CASE WHEN regexp_matches(event_type, '^[[:punct:]]+$') THEN 0.02 ELSE least(greatest(round(value / 100, 6), 0.02), 1.0) END AS duration FROM f""")
def word_clamp(spark: SparkSession, d: str) -> DataFrame:
    w = frames(spark, d).select("event_id", F.col("event_type").alias("word"), F.lit(0.0).alias("s"), r6(F.col("value") / 100).alias("e"))
    return G.clamp_words(w, "word", "s", "e").select("event_id", "duration")


@query(FRAMES + """, o AS (SELECT *, lag(event_type, 3) OVER w AS a, lag(event_type, 2) OVER w AS b, lag(event_type) OVER w AS c FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx))
SELECT event_id, right(coalesce(a, '') || coalesce(b, '') || coalesce(c, ''), 12) AS context FROM o""")
def context_tail(spark: SparkSession, d: str) -> DataFrame:
    return G.context_tail(frames(spark, d), K, ["frame_idx"], "event_type", 3, 12).select("event_id", "context")


@query("""SELECT conv_id, turn, md5(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS digest FROM conversations""")
def progressive_text(spark: SparkSession, d: str) -> DataFrame:
    return G.progressive_text(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", F.md5("text_so_far").alias("digest"))


@query(FRAMES + """, w AS (SELECT stream_id, event_id, CAST(frame_idx AS DOUBLE) * 5 AS o, value / 100 AS v FROM f)
SELECT event_id, round(o, 6) AS "start", round(o + v, 6) AS "end", CAST(row_number() OVER (PARTITION BY stream_id ORDER BY o, event_id) AS INTEGER) AS "index" FROM w""")
def offset_words(spark: SparkSession, d: str) -> DataFrame:
    w = frames(spark, d).select(*K, "event_id", (F.col("frame_idx") * 5.0).alias("o"), F.lit(0.0).alias("start"), (F.col("value") / 100).alias("end"))
    return G.offset_words(w, K, ["start", "event_id"], "o", "start", "end").select("event_id", r6("start").alias("start"), r6("end").alias("end"), "index")


# --- windows -----------------------------------------------------------------------------------------------------------


def _smooth(name: str, apply: Callable[[DataFrame], DataFrame], out: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return apply(frames(spark, d)).select("event_id", r6(out).alias(out))

    run.__name__ = name
    query(FRAMES + sql)(run)


_smooth("smooth_centered", lambda f: G.smooth_centered(f, K, ["frame_idx"], "prob"), "smoothed",
        """ SELECT event_id, round(CASE WHEN count(*) OVER (PARTITION BY stream_id) < 5 THEN prob ELSE sum(prob) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END, 6) AS smoothed FROM f""")  # fmt: skip
_smooth("smooth_trailing", lambda f: G.smooth_trailing(f, K, ["frame_idx"], "prob"), "smoothed",
        """ SELECT event_id, round(avg(prob) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM f""")  # fmt: skip
_smooth("norm_energy", lambda f: G.normalise_by_max(f, K, "rms"), "normalised",
        """ SELECT event_id, round(least(greatest(rms / greatest(max(rms) OVER (PARTITION BY stream_id), 0.12), 0), 1), 6) AS normalised FROM f""")  # fmt: skip


@query(FRAMES + """, x AS (SELECT stream_id, rms - lag(rms) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS x, row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx DESC) AS r FROM f)
SELECT stream_id, round(coalesce(avg(x) FILTER (WHERE r <= 3), 0), 6) AS slope FROM x GROUP BY stream_id""")
def rms_delta(spark: SparkSession, d: str) -> DataFrame:
    return G.recent_slope(frames(spark, d), K, ["frame_idx"], "rms").select(*K, r6("slope").alias("slope"))


@query(FRAMES + """, g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id, value < 50 ORDER BY frame_idx) AS g FROM f),
n AS (SELECT event_id, CASE WHEN value < 50 THEN row_number() OVER (PARTITION BY stream_id, value < 50, g ORDER BY frame_idx) ELSE 0 END AS n FROM g)
SELECT event_id, CAST(n AS INTEGER) AS run_length, n >= 10 AS is_extended FROM n""")
def pause_run_length(spark: SparkSession, d: str) -> DataFrame:
    return G.run_counter(frames(spark, d), K, ["frame_idx"], F.col("value") < 50).select("event_id", "run_length", "is_extended")


@query("""WITH o AS (SELECT user_id, event_id, epoch(ts) AS s, event_type FROM events),
m AS (SELECT *, CASE WHEN s - lag(s + 1.0) OVER w > 3600.0 OR lag(event_type) OVER w = 'purchase' THEN 1 ELSE 0 END AS r FROM o WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))
SELECT user_id, event_id, CAST(sum(r) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS session FROM m""")
def session_reset_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "user_id", "event_id", "ts", "event_type").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("e", F.col("s") + 1.0)
    return G.session_ids(rows, ["user_id"], ["s", "event_id"], "s", "e", "event_type", 3600.0, "purchase").select("user_id", "event_id", "session")


@query(FRAMES + """ SELECT event_id, max(CASE WHEN prob < 0.25 AND rms >= 0.001 AND rms < 0.04 THEN frame_idx END) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING) AS last_low FROM f""")
def last_low_frame(spark: SparkSession, d: str) -> DataFrame:
    return G.last_low_frame(frames(spark, d), K, ["frame_idx"], (F.col("prob") < 0.25) & (F.col("rms") >= 0.001) & (F.col("rms") < 0.04)).select("event_id", "last_low")


@query(FRAMES + """, g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id, prob < 0.65 ORDER BY frame_idx) AS g FROM f),
n AS (SELECT *, CASE WHEN prob < 0.65 THEN row_number() OVER (PARTITION BY stream_id, prob < 0.65, g ORDER BY frame_idx) ELSE 0 END AS n FROM g)
SELECT event_id, max(CASE WHEN n >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) = 1 AS has_valley FROM n""")
def valley_test(spark: SparkSession, d: str) -> DataFrame:
    return G.has_valley(frames(spark, d), K, ["frame_idx"], "prob", within=20).select("event_id", "has_valley")


# --- budgets, ranking, sets --------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, o_orderkey, round(running, 6) AS running FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS running FROM orders)
WHERE running <= 300000""")
def retention_budget(spark: SparkSession, d: str) -> DataFrame:
    kept = O.keep_within_budget(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice", 300000)
    return kept.select("o_custkey", "o_orderkey", r6("running").alias("running"))


PAIRS = """WITH t AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pair, text AS user_text, nt AS assistant_text FROM t WHERE role = 'user' AND nr = 'assistant')"""


@query(PAIRS + """, c AS (SELECT *, (length(user_text) // 3 + 10) * (length(user_text) > 0)::INT + (length(assistant_text) // 3 + 10) * (length(assistant_text) > 0)::INT AS tokens FROM p)
SELECT conv_id, CAST(pair AS INTEGER) AS pair, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pair DESC ROWS UNBOUNDED PRECEDING) AS running FROM c) WHERE running <= 1000""")
def token_budget_history(spark: SparkSession, d: str) -> DataFrame:
    pairs = O.turn_pairs(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")
    costed = pairs.withColumn("tokens", S.token_estimate_llm(F.col("user_text")) + S.token_estimate_llm(F.col("assistant_text")))
    return O.keep_within_budget(costed, ["conv_id"], [F.desc("pair")], "tokens", 1000).select("conv_id", "pair", "running")


@query("""SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 5 OR r <= 1 OR r > n - 3""")
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    return O.last_turns(table(spark, d, "conversations", "conv_id", "turn"), ["conv_id"], "turn", 5, 1, 3)


@query(PAIRS + """ SELECT conv_id, CAST(pair AS INTEGER) AS pair FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) AS r FROM p) WHERE r <= 2 AND trim(user_text) <> '' AND trim(assistant_text) <> ''""")
def last_n_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = O.turn_pairs(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")
    return O.last_full_pairs(pairs, ["conv_id"], 2).select("conv_id", "pair")


@query("""WITH n AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS s FROM n)
SELECT conv_id, md5(s[-1]) AS digest FROM s""")
def last_sentence(spark: SparkSession, d: str) -> DataFrame:
    out = O.last_non_empty(table(spark, d, "conversations"), ["conv_id"], "turn", "text", F.split("text", "\n"))
    return out.select("conv_id", F.md5("last_part").alias("digest"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\r\n\f]+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, md5(array_to_string(w[-25:], ' ')) AS digest FROM w""")
def context_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(O.context_words(F.col("text"))).alias("digest"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) AS rank FROM orders""")
def sort_na_last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").withColumn("shown", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    return O.global_rank(rows, [F.col("shown").desc_nulls_last(), F.asc("o_orderkey")]).select("o_orderkey", "rank")


@query("""SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events""")
def global_ranking(spark: SparkSession, d: str) -> DataFrame:
    return O.global_rank(table(spark, d, "events", "event_id", "value"), [F.desc("value"), F.asc("event_id")]).select("event_id", "rank")


@query("""SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source""")
def best_per_group(spark: SparkSession, d: str) -> DataFrame:
    return O.best_per_group(table(spark, d, "documents", "source", "doc_id", "n_chars"), ["source"], "n_chars", ["doc_id"])


@query("""SELECT md5(text) AS digest, min(doc_id) AS first_seen FROM documents GROUP BY text""")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return O.ordered_distinct(table(spark, d, "documents", "doc_id", "text"), ["text"], "doc_id").select(F.md5("text").alias("digest"), "first_seen")


@query("""WITH l AS (SELECT o_custkey, string_agg(o_orderpriority, ';' ORDER BY o_orderkey) AS p FROM orders GROUP BY o_custkey), u AS (SELECT o_custkey, unnest(string_split(p, ';')) AS x, generate_subscripts(string_split(p, ';'), 1) AS i FROM l)
SELECT o_custkey, string_agg(x, ';' ORDER BY i) AS path FROM (SELECT o_custkey, x, min(i) AS i FROM u WHERE x <> '' GROUP BY ALL) GROUP BY o_custkey""")
def path_distinct(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    joined = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ";").alias("p"))
    return joined.select("o_custkey", O.path_distinct(F.col("p")).alias("path"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3""")
def keep_newest(spark: SparkSession, d: str) -> DataFrame:
    return O.keep_newest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-06-01' - 14""")
def age_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return O.within_age(rows, "day", "1997-06-01").select("o_orderkey")


@query("""SELECT n_regionkey, max(n_name) AS n_name FROM nation WHERE ends_with(n_name, 'A') GROUP BY n_regionkey""")
def latest_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    return O.latest_by_suffix(table(spark, d, "nation"), ["n_regionkey"], "n_name", "A")


@query("""SELECT 'e' AS kind, event_id AS id FROM events UNION ALL SELECT 'd', doc_id FROM documents""")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id").select(F.lit("e").alias("kind"), F.col("event_id").alias("id"))
    return e.unionByName(table(spark, d, "documents", "doc_id").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id")))


# --- joins -------------------------------------------------------------------------------------------------------------


@query(RUNS + """, s AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY frame_start) AS num FROM r WHERE frames >= 2)
SELECT f.stream_id, f.frame_idx, CAST(coalesce(min(s.num), 0) AS INTEGER) AS segment_num FROM f LEFT JOIN s ON f.stream_id = s.stream_id AND f.frame_idx BETWEEN s.frame_start AND s.frame_end GROUP BY ALL""")
def interval_first_match(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    segments = G.number(G.threshold_runs(f, K, voiced(), "prob", 2), K, ["frame_start"])
    return O.interval_first_match(f.select(*K, "frame_idx"), segments, K, "frame_idx", "frame_start", "frame_end", "num")


@query("""SELECT o_orderkey, coalesce(c_mktsegment, 'N/A') AS segment, coalesce(c_acctbal, 0.0) AS balance FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey""")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    out = O.lookup(table(spark, d, "orders", "o_orderkey", "o_custkey"), rich, ["o_custkey"], {"segment": F.lit("N/A"), "balance": F.lit(0.0)})
    return out.select("o_orderkey", "segment", "balance")


@query(FRAMES + """ SELECT event_id, lag(event_type) OVER w AS prev_event_type, lag(value) OVER w AS prev_value FROM f WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx)""")
def previous_row(spark: SparkSession, d: str) -> DataFrame:
    return O.previous_row(frames(spark, d), K, ["frame_idx"], ["event_type", "value"]).select("event_id", "prev_event_type", "prev_value")


@query("""WITH p AS (SELECT user_id, event_id, (event_id * 7919) % 1000 AS seq FROM events), m AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p)
SELECT user_id, event_id, seq FROM m WHERE seen IS NULL OR seq > seen""")
def seq_late_drop(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events", "user_id", "event_id").withColumn("seq", F.col("event_id") * 7919 % 1000)
    return O.late_drop(p, ["user_id"], ["event_id"], "seq")


@query(FRAMES + """, c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY stream_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS b FROM f),
g AS (SELECT *, sum(b) OVER (PARTITION BY stream_id ORDER BY frame_idx) - 1 AS g FROM c)
SELECT stream_id, CAST(g AS BIGINT) AS "group", event_type, count(*) AS parts, string_agg(event_id::VARCHAR, ' ' ORDER BY frame_idx) AS joined FROM g GROUP BY stream_id, g, event_type""")
def utterance_group(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("t", F.col("event_id").cast("string"))
    return O.utterance_groups(f, K, ["frame_idx"], "event_type", "t").withColumn("group", F.col("group").cast("long"))


@query(r"""WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS a, string_split(text, ' ') AS b FROM conversations),
z AS (SELECT conv_id, turn, a, b, unnest(range(0, least(len(a), len(b)))) AS pos FROM l)
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, md5(a[pos + 1]) AS line, b[pos + 1] AS word FROM z""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("a"), F.split("text", " ").alias("b"))
    return O.zip_columns(rows, "a", "b", ("line", "word")).select("conv_id", "turn", "pos", F.md5("line").alias("line"), "word")
