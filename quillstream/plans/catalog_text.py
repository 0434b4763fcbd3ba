"""Registered queries: aggregates, buckets, text, vectors, evaluation, messages and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import textual as T
from ..operators import aggregates as A
from ..operators import ordered as O
from ..operators import seams as M
from ..operators import signals as X
from ..operators import vectors as V
from ..session import table
from ..sources import files as IO
from ..streaming import machines as R
from . import sql_folds as Q
from .catalog import FRAMES, RUNS, K, frames, query, r6

# --- aggregates --------------------------------------------------------------------------------------------------------


@query(FRAMES + """ SELECT stream_id, CAST(frame_idx // 8 AS BIGINT) AS frame, round(sqrt(avg(rms * rms)), 6) AS rms FROM f GROUP BY ALL""")
def frame_rms(spark: SparkSession, d: str) -> DataFrame:
    return A.framed_rms(frames(spark, d), K, "frame_idx", "rms", 8).select(*K, "frame", r6("rms").alias("rms"))


@query(FRAMES + """, z AS (SELECT *, abs(sign(value - 50) - lag(sign(value - 50)) OVER (PARTITION BY stream_id ORDER BY frame_idx)) AS z FROM f)
SELECT stream_id, round(sqrt(avg((value - 50) * (value - 50))), 6) AS rms, round(max(abs(value - 50)), 6) AS peak, round(coalesce(sum(z), 0) / (2 * count(*)), 6) AS zcr FROM z GROUP BY stream_id""")
def signal_stats(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("x", F.col("value") - 50)
    return A.signal_stats(f, K, ["frame_idx"], "x").select(*K, r6("rms").alias("rms"), r6("peak").alias("peak"), r6("zcr").alias("zcr"))


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)), 6) AS rms, round(sqrt(list_sum(list_transform(v[17:32], lambda x: x * x)) / 16), 6) AS second_frame,
 round(list_sum(list_transform(range(1, len(v)), lambda i: abs(sign(v[i + 1]) - sign(v[i])))) / (2 * len(v)), 6) AS zcr FROM a""")
def array_signal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    v = F.col("embedding")
    return e.select("vec_id", r6(S.rms(v)).alias("rms"), r6(F.element_at(S.framed_rms(v, 16, 16), 2)).alias("second_frame"), r6(S.zero_crossing_rate(v)).alias("zcr"))


@query(FRAMES + """ SELECT stream_id, count(prob) AS n, round(avg(prob), 6) AS mean, round(max(prob), 6) AS max, round(min(prob), 6) AS min, round(stddev_pop(prob), 6) AS std, round(median(prob), 6) AS median FROM f GROUP BY stream_id""")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    out = A.series_stats(frames(spark, d), K, "prob")
    return out.select(*K, "n", *[r6(c).alias(c) for c in ("mean", "max", "min", "std", "median")])


@query(RUNS + """ SELECT count(*) AS segments, round(coalesce(sum(frames * 0.01), 0), 6) AS total, round(coalesce(avg(frames * 0.01), 0), 6) AS avg_duration, round(coalesce(avg(mean_prob), 0), 6) AS avg_prob,
 round(coalesce(avg(mean_prob * 0.2), 0), 6) AS avg_rms FROM r""")
def session_summary(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import threshold_runs

    runs = threshold_runs(frames(spark, d), K, F.col("value") >= 50, "prob").withColumn("duration", F.col("frames") * 0.01).withColumn("energy", F.col("mean_prob") * 0.2)
    out = A.summary(runs, "duration", "mean_prob", "energy")
    return out.select("segments", *[r6(c).alias(c) for c in ("total", "avg_duration", "avg_prob", "avg_rms")])


@query("""WITH x AS (SELECT user_id, -value / 100 AS lp, greatest(1, length(event_type) // 2) AS n FROM events), m AS (SELECT user_id, sum(lp * n) / sum(n) AS m FROM x GROUP BY user_id)
SELECT user_id, round(m, 6) AS avg_logprob, round(exp(m), 6) AS confidence,
 CASE WHEN m > -0.3 THEN 'Very High' WHEN m > -0.7 THEN 'High' WHEN m > -1.2 THEN 'Medium' WHEN m > -2 THEN 'Low' ELSE 'Very Low' END AS quality FROM m""")
def weighted_logprob(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events", "user_id", "value", "event_type").withColumn("lp", -F.col("value") / 100)
    out = A.token_weighted_logprob(x, ["user_id"], "lp", F.floor(F.length("event_type") / 2))
    return out.select("user_id", r6("avg_logprob").alias("avg_logprob"), r6("confidence").alias("confidence"), S.bucket(F.col("avg_logprob"), S.ASR_LOGPROB, "N/A").alias("quality"))


@query("""SELECT event_id, round(least(greatest(exp(-value / greatest(length(event_type), 1)), 0), 1), 6) AS confidence FROM events""")
def geo_mean_conf(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "value", "event_type")
    return e.select("event_id", r6(S.geometric_mean_probability(-F.col("value"), F.length("event_type"))).alias("confidence"))


@query("""SELECT user_id, round(avg(exp(least(greatest(-value / 20, -5), 0))) * 100, 6) AS confidence FROM events GROUP BY user_id""")
def clipped_prob(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events", "user_id", "value").withColumn("lp", -F.col("value") / 20)
    return A.clipped_probability(x, ["user_id"], "lp").select("user_id", r6("confidence").alias("confidence"))


@query("""WITH m AS (SELECT user_id, avg(-value / 60) AS m FROM events GROUP BY user_id), c AS (SELECT user_id, m, least(greatest((m + 3) / 3, 0), 1) AS c FROM m)
SELECT user_id, round(m, 6) AS mean_logprob, round(c, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM c""")
def llm_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events", "user_id", "value").withColumn("lp", -F.col("value") / 60)
    return A.llm_logprob(x, ["user_id"], "lp").select("user_id", r6("mean_logprob").alias("mean_logprob"), r6("confidence").alias("confidence"), "label")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 10) AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v),
p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, round(list_max(p), 6) AS max_prob, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)), 6) AS entropy, round(-ln(list_max(p)), 6) AS surprisal, list_max(p) < 0.5 AS is_risky FROM p""")
def logit_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))
    out = A.logit_stats(e, "logits")
    return out.select("vec_id", r6("max_prob").alias("max_prob"), r6("entropy").alias("entropy"), r6("surprisal").alias("surprisal"), "is_risky")


@query(FRAMES + """ SELECT event_type, round(max(prob), 6) AS max_score, round(avg(prob), 6) AS mean_score, round(avg(CASE WHEN prob > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS active_share FROM f GROUP BY event_type""")
def speaker_scores(spark: SparkSession, d: str) -> DataFrame:
    out, _ = A.speaker_scores(frames(spark, d), "event_type", "frame_idx", "prob")
    return out.select("event_type", *[r6(c).alias(c) for c in ("max_score", "mean_score", "active_share")])


@query(FRAMES + """ SELECT frame_idx, round(max(prob), 6) AS max_score, sum(prob) > 1.1 AS overlap FROM f GROUP BY frame_idx""")
def frame_overlap(spark: SparkSession, d: str) -> DataFrame:
    _, out = A.speaker_scores(frames(spark, d), "event_type", "frame_idx", "prob")
    return out.select("frame_idx", r6("max_score").alias("max_score"), "overlap")


@query("""SELECT round(coalesce(sum(value), 0) / 1000000 * 100, 6) AS coverage_pct FROM events""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return A.coverage(table(spark, d, "events", "value"), "value", 1_000_000).select(r6("coverage_pct").alias("coverage_pct"))


@query("""WITH s AS (SELECT lang, source, min(doc_id) AS o FROM documents GROUP BY ALL) SELECT lang, string_agg(source, ',' ORDER BY o, source) AS sources FROM s GROUP BY lang""")
def label_text_map(spark: SparkSession, d: str) -> DataFrame:
    out = A.map_of_lists(table(spark, d, "documents", "lang", "source", "doc_id"), [], "lang", "source", "doc_id")
    return out.select("lang", F.array_join("values", ",").alias("sources"))


@query(r"""WITH u AS (SELECT doc_id, 'text' AS "column", text AS value FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY doc_id) AS r FROM u WHERE trim(coalesce(value, '')) <> '')
SELECT "column", count(*) FILTER (WHERE len(list_filter(regexp_split_to_array(value, '[ \t\r\n\f]+'), lambda x: x <> '')) > 3 AND regexp_matches(value, '\p{L}')) AS votes, count(*) AS checked FROM r WHERE r <= 50 GROUP BY "column" """)
def column_vote(spark: SparkSession, d: str) -> DataFrame:
    return A.column_vote(table(spark, d, "documents", "doc_id", "text", "lang", "source"), ["text", "lang", "source"], "doc_id").select("column", "votes", "checked")


@query("""WITH t AS (SELECT user_id, epoch(ts) AS t FROM events), a AS (SELECT user_id, min(t) AS a, max(t) AS b, count(*) AS n FROM t GROUP BY user_id)
SELECT user_id, n AS completion_tokens, round(1.5, 6)::DOUBLE AS ttft, round(b - a + 1.5, 6) AS latency, round((n - 1) / nullif(b - a, 0), 6) AS decode_tps, round(100 / 1.5, 6)::DOUBLE AS prompt_tps, round((n + 100) / (b - a + 1.5), 6) AS total_tps FROM a""")
def llm_latency(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events", "user_id", "ts").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("s", F.col("t") - 1.5).withColumn("p", F.lit(100))
    out = A.llm_latency(t, "user_id", "t", "s", "p")
    return out.select("user_id", "completion_tokens", *[r6(c).alias(c) for c in ("ttft", "latency", "decode_tps", "prompt_tps", "total_tps")])


@query("""WITH p AS (SELECT 'r/' || o_orderpriority[1:1] || '/' || o_orderstatus AS dir, o_orderkey AS size FROM orders), u AS (
 SELECT dir, size, true AS own FROM p UNION ALL SELECT dir[1:3], size, false FROM p UNION ALL SELECT 'r', size, false FROM p)
SELECT dir, CAST(sum(CASE WHEN own THEN size ELSE 0 END) AS BIGINT) AS direct_bytes, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) AS files FROM u GROUP BY dir""")
def dir_rollup(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    path = F.concat_ws("/", F.lit("r"), F.left("o_orderpriority", F.lit(1)), F.col("o_orderstatus"), F.col("o_orderkey").cast("string"))
    return A.directory_rollup(files.select(path.alias("path"), F.col("o_orderkey").alias("size")), "path", "size")


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS joined FROM orders GROUP BY o_custkey""")
def joined_distinct(spark: SparkSession, d: str) -> DataFrame:
    return A.joined_distinct(table(spark, d, "orders", "o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus")


@query("""SELECT count(DISTINCT user_id) AS clients, count(DISTINCT (user_id, event_type)) AS utterances, count(*) AS chunks FROM events""")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    return A.stream_counters(table(spark, d, "events", "user_id", "event_type"), "user_id", "event_type")


# --- buckets and predicates --------------------------------------------------------------------------------------------


def _case(column: str, scale) -> str:
    steps, last = scale
    return "CASE " + " ".join(f"WHEN {column} {op} {bound} THEN '{label}'" for op, bound, label in steps) + f" ELSE '{last}' END"


@query(f"""SELECT event_id, {_case("value / 1000", S.LOUDNESS)} AS loudness, {_case("-value / 100", S.ASR_LOGPROB)} AS asr, {_case("-value / 100", S.TRANSLATION_LOGPROB)} AS translation,
 {_case("-value / 100", S.LOGPROB_STEPS)} AS steps, {_case("value / 5", S.CONFIDENCE_PERCENT)} AS percent, {_case("value / 5", S.COVERAGE)} AS coverage, {_case("value / 500", S.RATING)} AS rating FROM events""")
def buckets(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events", "event_id", "value").select(
        "event_id", S.bucket(v / 1000, S.LOUDNESS).alias("loudness"), S.bucket(-v / 100, S.ASR_LOGPROB).alias("asr"), S.bucket(-v / 100, S.TRANSLATION_LOGPROB).alias("translation"),
        S.bucket(-v / 100, S.LOGPROB_STEPS).alias("steps"), S.bucket(v / 5, S.CONFIDENCE_PERCENT).alias("percent"), S.bucket(v / 5, S.COVERAGE).alias("coverage"), S.bucket(v / 500, S.RATING).alias("rating"),
    )


@query("""SELECT o_orderkey, CASE WHEN s >= 1073741824 THEN printf('%.2f', s / 1073741824.0) || ' GB' WHEN s >= 104857600 THEN printf('%.1f', s / 1048576.0) || ' MB' WHEN s >= 1048576 THEN printf('%.2f', s / 1048576.0) || ' MB'
 WHEN s >= 1024 THEN printf('%.1f', s / 1024.0) || ' KB' ELSE s || ' B' END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 7 AS s FROM orders)""")
def size_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", S.byte_size(F.col("o_orderkey") * F.col("o_orderkey") * 7).alias("size"))


@query("""SELECT event_id, value / 1000 >= 0.001 AS has_sound, value / 1000 > 0.01 AS has_sound_strict, round(20 * log10(greatest(value / 1000, 1e-10)), 6) AS db, round(least(greatest(value / 200, 0.1), 1.0), 6) AS clipped FROM events""")
def sound_thresholds(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value") / 1000
    return table(spark, d, "events", "event_id", "value").select("event_id", (v >= 0.001).alias("has_sound"), (v > 0.01).alias("has_sound_strict"), r6(S.decibels(v)).alias("db"), r6(S.clip(F.col("value") / 200, 0.1, 1.0)).alias("clipped"))


SENTENCES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents), t AS (SELECT doc_id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS t FROM l),
w AS (SELECT doc_id, t, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS w FROM t),
v AS (SELECT doc_id, t, CASE WHEN length(t) <= 2 THEN false WHEN length(t) <= 6 THEN regexp_matches(t, '[.!?]$') WHEN w = 1 AND length(t) > 40 THEN false WHEN upper(t) = t AND lower(t) <> t AND length(t) < 60 THEN false
 WHEN lower(t) IN ('abstract', 'introduction', 'conclusion', 'references', 'table of contents', 'acknowledgements', 'appendix', 'chapter', 'figure', 'table', 'section', 'page', 'isbn', 'doi') THEN false WHEN left(t, 1) IN ('•', '○', '→', '▪', '*', '-', '–', '—') AND w <= 5 THEN false WHEN regexp_matches(t, '[-_=]{4}') THEN false WHEN regexp_matches(t, '[^\p{L}\p{N}_]{6}') THEN false
 WHEN right(t, 1) IN ('.', '!', '?', '…', '"', '''') OR right(t, 2) = '.”' THEN true ELSE regexp_matches(t, '\p{L}') AND contains(t, ' ') END AS ok FROM w)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE ok) AS valid FROM v GROUP BY doc_id"""


@query(SENTENCES)
def valid_sentences(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    trimmed = lines.select("doc_id", S.strip(F.col("s")).alias("s"))
    return trimmed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(S.is_valid_sentence(F.col("s"), trimmed=True)).alias("valid"))


@query("""SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR lower(text) LIKE 'the%.') AND NOT contains(lower(text), '@mail')""")
def content_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").where(S.matches_content(F.col("text"), ["license", "the*."], ["@mail"])).select("doc_id")


@query("""SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), 'i can''t|i cannot|i’m unable|i am unable|i won''t|sorry|as an ai|cannot assist|can''t help|not allowed|against the rules') AS is_refusal FROM conversations""")
def refusal_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", S.is_refusal(F.col("text")).alias("is_refusal"))


@query("""SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) >= 16""")
def valid_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").where(S.is_valid_embedding(F.col("embedding")) & (F.size("embedding") >= 16)).select("vec_id")


@query("""SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%1%' AND p_brand = 'Brand#11' OR p_size > 45 OR p_retailprice > 1900""")
def usage_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return p.where((F.lower("p_name").contains("1") & (F.col("p_brand") == "Brand#11")) | (F.col("p_size") > 45) | (F.col("p_retailprice") > 1900)).select("p_partkey")


@query("""SELECT o_orderkey % 50 AS image, string_agg(o_orderpriority, chr(10) ORDER BY (o_orderkey % 101 + 100) / 2.0, o_orderpriority) AS text FROM orders
WHERE (o_custkey % 100) / 100.0 > 0.5 AND (o_orderkey % 101 + 100) / 2.0 >= 100 * 0.65 AND abs((o_custkey % 97 + 40) / 2.0 - 50) <= 100 * 0.3 GROUP BY 1""")
def ocr_regions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    x, y = F.col("o_custkey") % 97, F.col("o_orderkey") % 101
    region = F.struct(F.col("o_orderpriority").alias("text"), (F.col("o_custkey") % 100 / 100.0).alias("score"), x.alias("x1"), y.alias("y1"), F.lit(40).alias("x2"), F.lit(100).alias("y2"))
    images = o.groupBy((F.col("o_orderkey") % 50).alias("image")).agg(F.collect_list(region).alias("regions"))
    return images.select("image", S.bottom_middle_text(F.col("regions"), F.lit(100), F.lit(100)).alias("text")).where("text <> ''")


# --- text --------------------------------------------------------------------------------------------------------------


def _html_sql(last: str, without: tuple[str, ...] = ()) -> str:
    t = "html"
    for name in without:
        t = rf"regexp_replace({t}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', chr(10), 'g')"
    for gone in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->"):
        t = f"regexp_replace({t}, '{gone}', '', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|section|article|header|footer|nav|title|body|head|html|main|aside|blockquote|pre|dl|dt|dd)\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{sign}')"
    return rf"""WITH t AS (SELECT page_id, string_split({t}, chr(10)) AS l FROM pages),
l AS (SELECT page_id, list_filter(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '') AS l FROM t) {last}"""


@query(_html_sql("SELECT page_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM l"))
def html_text(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pages", "page_id", "html").select("page_id", S.html_lines(F.col("html")).alias("l"))
    return lines.select("page_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query(_html_sql("SELECT page_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM l", S.SIDE_ELEMENTS))
def html_main(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "pages", "page_id", "html").select("page_id", S.html_main_lines(F.col("html")).alias("l"))
    return lines.select("page_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query(_html_sql("SELECT page_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS line, md5(unnest(l)) AS digest FROM l"))
def html_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "html").select("page_id", F.posexplode(S.html_lines(F.col("html"))).alias("line", "t")).select("page_id", "line", F.md5("t").alias("digest"))


@query(r"""WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^。！？…\n]*(?:[。！？…]+\n*|\n+|$)'), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s""")
def split_sentences_cjk(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents", "doc_id", "text").select("doc_id", S.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(r"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '\n\s*\n') AS p FROM documents)
SELECT doc_id, len(list_filter(p, lambda x: trim(x) <> '')) AS paragraphs FROM p""")
def paragraph_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.split("text", r"\n\s*\n").alias("p"))
    return p.select("doc_id", F.size(F.filter("p", lambda x: F.trim(x) != "")).cast("long").alias("paragraphs"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+(?:[''.&-]+[A-Za-z0-9_]+)*') AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM w""")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents", "doc_id", "text").select("doc_id", S.words(F.col("text"), ascii_only=True).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|''[\p{L}]+|[^\s\p{L}\p{N}_]') AS w FROM documents) SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM w""")
def split_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents", "doc_id", "text").select("doc_id", S.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"""SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+'), ' ')) AS clean, md5(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')) AS phrase,
 md5(lower(regexp_replace(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'), '^ | $', '', 'g'))) AS simple, md5(regexp_replace(text, '\n\s*\n+', chr(10), 'g')) AS squeezed FROM documents""")
def clean_alnum(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(S.alphanumeric(t)).alias("clean"), F.md5(S.normalise_phrase(t)).alias("phrase"), F.md5(S.normalise_simple(t)).alias("simple"), F.md5(S.squeeze_newlines(t)).alias("squeezed"))


@query("""SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) // 3 + 10 END AS BIGINT) AS tokens_llm FROM documents""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", S.token_estimate(F.col("text")).alias("tokens"), S.token_estimate_llm(F.col("text")).alias("tokens_llm"))


@query("""SELECT doc_id, md5(rtrim(text, '。、，．！？!?.,…・「」『』（）()[]【】　 ' || chr(9) || chr(13) || chr(10))) AS stripped, md5(trim(left(text, 180)) || '...') AS snippet, replace(lower(source || ' ' || lang), ' ', '_') AS label FROM documents""")
def trailing_punct(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text", "source", "lang").select("doc_id", F.md5(S.strip_trailing(t)).alias("stripped"), F.md5(S.snippet(t)).alias("snippet"), S.label_key(F.concat_ws(" ", "source", "lang")).alias("label"))


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents), g AS (SELECT doc_id, text, n, unnest(range(0, n, 360)) AS s FROM n WHERE n > 0),
c AS (SELECT doc_id, s // 360 AS chunk, text[s + 1:least(s + 400, n)] AS b FROM g), p AS (SELECT doc_id, chunk, lag(b) OVER (PARTITION BY doc_id ORDER BY chunk) AS a, b FROM c),
o AS (SELECT *, coalesce(list_max(list_filter(range(4, 41), lambda n: length(a) >= n AND length(b) >= n AND right(a, n) = left(b, n))), 0) AS n FROM p WHERE a IS NOT NULL)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(n AS INTEGER) AS overlap, md5(CASE WHEN n > 0 THEN a || b[n + 1:] ELSE a || ' ' || b END) AS digest FROM o""")
def overlap_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Every document in chunks of 400 characters that overlap by 40; each chunk stitched to the one before."""
    from ..operators.frames import chunks

    cut = chunks(table(spark, d, "documents", "doc_id", "text"), F.length("text"), 400, 40, "plain")
    cut = cut.select("doc_id", "chunk", F.col("text").substr((F.col("start") + 1).cast("int"), F.lit(400)).alias("b"))
    p = O.previous_row(cut, ["doc_id"], ["chunk"], ["b"]).where("prev_b IS NOT NULL")
    return p.select("doc_id", "chunk", S.overlap_length(F.col("prev_b"), F.col("b")).alias("overlap"), F.md5(S.stitch(F.col("prev_b"), F.col("b"))).alias("digest"))


@query("""WITH t AS (SELECT event_id, value * 37.123 AS s, value / 7 AS dur FROM events), m AS (SELECT event_id, CAST(floor(s * 1000) AS BIGINT) AS a, CAST(floor((s + dur) * 1000) AS BIGINT) AS b FROM t)
SELECT event_id, event_id || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || 'x' || chr(10) AS block FROM m""")
def srt_blocks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "value").select("event_id", (F.col("value") * 37.123).alias("s"), (F.col("value") / 7).alias("dur"), F.lit("x").alias("line"))
    return IO.srt_text(e, "event_id", "s", "dur", ["line"]).select(F.col("number").alias("event_id"), "block")


@query("""SELECT c_custkey, coalesce(CASE c_custkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' END, 'text') AS language FROM customer""")
def language_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey")
    path = F.concat(F.lit("a/b"), F.when(F.col("c_custkey") % 3 == 0, ".PY").when(F.col("c_custkey") % 3 == 1, ".js").otherwise(".none"))
    return c.select("c_custkey", S.language_of(path).alias("language"))


@query(r"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents)
SELECT d.doc_id, md5(regexp_replace(text, '\p{P}', '', 'g')) AS clean, CAST(coalesce(p.places, 0) AS BIGINT) AS places FROM documents d LEFT JOIN (SELECT doc_id, sum(i) AS places FROM c WHERE NOT regexp_matches(c, '^\p{P}$') GROUP BY doc_id) p USING (doc_id)""")
def punctuation_map(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents", "doc_id", "text").select("doc_id", S.punctuation_map(F.col("text")).alias("m"))
    place = lambda s, x: s + x["original"].cast("long") * x["length"] + (x["length"].cast("long") * (x["length"] - 1) / 2).cast("long")
    return m.select("doc_id", F.md5("m.clean").alias("clean"), F.aggregate("m.runs", F.lit(0).cast("long"), place).alias("places"))


# --- vectors and evaluation --------------------------------------------------------------------------------------------

COS = "list_cosine_similarity(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "label", "embedding")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {COS.format(a="q.embedding", b="e.embedding")} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM s) SELECT query_id, vec_id, CAST(r AS INTEGER) AS rank, round(s, 6) AS score FROM r WHERE r <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.search(e, queries, 5, "query_id", "vec_id", "q", "embedding").select("query_id", "vec_id", "rank", r6("score").alias("score"))


CENTRES = """WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY pos) AS c FROM m GROUP BY label)"""


@query("""WITH p AS (SELECT generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT pos, avg(x) AS m FROM p GROUP BY pos), c AS (SELECT list(m ORDER BY pos) AS c FROM m),
s AS (SELECT vec_id, round(1 - list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), c), 6) AS distance FROM embeddings, c)
SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) AS rank, distance FROM s""")
def rank_all(spark: SparkSession, d: str) -> DataFrame:
    """All vectors by their distance from the centre of all."""
    e = _vectors(spark, d).withColumn("one", F.lit(0))
    q = V.centroids(e, "one", "embedding", normalised=False).select(F.col("centroid").alias("q"))
    scored = V.pair_scores(e, q, "embedding", "q").select("vec_id", r6(1 - F.col("score")).alias("distance"))
    return O.global_rank(scored, [F.asc("distance"), F.asc("vec_id")]).select("vec_id", "rank", "distance")


@query(CENTRES + """, s AS (SELECT e.vec_id, c.label, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), c.c) AS s FROM embeddings e, c)
SELECT vec_id, arg_max(label, (s, -label)) AS label, round(max(s), 6) AS similarity FROM s GROUP BY vec_id""")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    return V.nearest_centroid(e.drop("label"), V.centroids(e, "label", "embedding"), "vec_id", "label", "embedding").select("vec_id", "label", r6("similarity").alias("similarity"))


@query(CENTRES + """, s AS (SELECT e.vec_id, c.label, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), c.c) AS s FROM embeddings e, c),
b AS (SELECT vec_id, CASE WHEN max(s) >= 0.55 THEN arg_max(label, (s, -label)) END AS label FROM s GROUP BY vec_id)
SELECT vec_id, CAST(coalesce(label, 1000 - 1 + row_number() OVER (PARTITION BY label IS NULL ORDER BY vec_id)) AS INTEGER) AS label FROM b""")
def nearest_with_reject(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    found = V.nearest_centroid(e.drop("label"), V.centroids(e, "label", "embedding"), "vec_id", "label", "embedding", reject_below=0.55)
    return V.fresh_ids(found, "vec_id", "label", 1000).select("vec_id", F.col("label").cast("int").alias("label"))


@query(CENTRES + """ SELECT e.vec_id, label, round(list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), c.c), 6) AS similarity FROM embeddings e JOIN c USING (label)""")
def centroid_similarity(spark: SparkSession, d: str) -> DataFrame:
    return V.centroid_similarity(_vectors(spark, d), "vec_id", "label", "embedding").select("vec_id", "label", r6("similarity").alias("similarity"))


@query(f"""SELECT a.vec_id, a.label, round(max({COS.format(a="a.embedding", b="b.embedding")}), 6) AS similarity FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL""")
def nn_similarity(spark: SparkSession, d: str) -> DataFrame:
    return V.neighbour_similarity(_vectors(spark, d), "vec_id", "label", "embedding").select("vec_id", "label", r6("similarity").alias("similarity"))


@query("""SELECT label, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS INTEGER) AS new_label FROM embeddings GROUP BY label""")
def relabel_by_size(spark: SparkSession, d: str) -> DataFrame:
    return V.relabel_by_size(_vectors(spark, d), "label")


TRIALS = f"""WITH t AS (SELECT vec_id AS id1, (vec_id * 7 + 13) % (SELECT count(*) FROM embeddings) AS id2 FROM embeddings),
s AS (SELECT id1, id2, 1 - {COS.format(a="a.embedding", b="b.embedding")} AS distance, a.label = b.label AS same FROM t JOIN embeddings a ON a.vec_id = id1 JOIN embeddings b ON b.vec_id = id2)"""


def _trials(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    n = e.agg(F.count(F.lit(1)).alias("n"))
    t = e.select(F.col("vec_id").alias("id1")).crossJoin(F.broadcast(n)).select("id1", ((F.col("id1") * 7 + 13) % F.col("n")).alias("id2"))
    return V.trial_scores(t, e, "vec_id", "embedding", carry=("label",)).withColumn("same", F.col("label_1") == F.col("label_2"))


@query(TRIALS + " SELECT id1, id2, round(distance, 6) AS distance, distance < 0.7 AS is_same FROM s")
def trial_scores(spark: SparkSession, d: str) -> DataFrame:
    return _trials(spark, d).select("id1", "id2", r6("distance").alias("distance"), (F.col("distance") < 0.7).alias("is_same"))


@query(TRIALS + """, c AS (SELECT count(*) FILTER (WHERE same AND distance < 0.7) AS tp, count(*) FILTER (WHERE NOT same AND distance < 0.7) AS fp, count(*) FILTER (WHERE NOT same AND distance >= 0.7) AS tn, count(*) FILTER (WHERE same AND distance >= 0.7) AS fn FROM s),
p AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM c)
SELECT tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1 FROM p""")
def confusion_prf(spark: SparkSession, d: str) -> DataFrame:
    out = A.confusion(_trials(spark, d), F.col("same"), F.col("distance") < 0.7)
    return out.select("tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(TRIALS + """, g AS (SELECT unnest(range(0, 1000)) AS k), r AS (SELECT k, k * (2.0::DOUBLE / 999) AS threshold, avg(CASE WHEN NOT same THEN (distance < k * (2.0::DOUBLE / 999))::INT END) AS far, avg(CASE WHEN same THEN (distance >= k * (2.0::DOUBLE / 999))::INT END) AS frr FROM g, s GROUP BY k),
b AS (SELECT * FROM r WHERE far IS NOT NULL AND frr IS NOT NULL ORDER BY round(abs(far - frr), 12), k LIMIT 1) SELECT round(threshold, 6) AS threshold, round(abs(far - frr), 6) AS gap, round((far + frr) / 2, 6) AS eer FROM b""")
def eer_sweep(spark: SparkSession, d: str) -> DataFrame:
    return A.eer_sweep(_trials(spark, d), "distance", "same").select(r6("threshold").alias("threshold"), r6("gap").alias("gap"), r6("eer").alias("eer"))


@query("""WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') AS a, lag(regexp_replace(text, '[^ -~]', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, round(levenshtein(a, b) / length(a)::DOUBLE, 6) AS cer FROM a WHERE b IS NOT NULL AND length(a) > 0""")
def cer_ascii(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace("text", "[^ -~]", "")
    pairs = O.previous_row(table(spark, d, "conversations").withColumn("a", text), ["conv_id"], ["turn"], ["a"]).where("prev_a IS NOT NULL AND length(a) > 0")
    return pairs.select("conv_id", "turn", r6(A.character_error_rate(F.col("a"), F.col("prev_a"))).alias("cer"))


@query("""WITH r AS (SELECT vec_id, label, sum(vec_id % 40 + 1) OVER (PARTITION BY label ORDER BY (vec_id % 10) / 10.0 * CASE WHEN vec_id % 3 = 0 THEN 1.0 WHEN vec_id % 3 = 1 THEN 0.7 ELSE 0.4 END DESC, vec_id ROWS UNBOUNDED PRECEDING) AS t FROM embeddings)
SELECT label, vec_id FROM r WHERE t <= 256""")
def tiered_retrieval(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select("vec_id", "label", (F.col("vec_id") % 10 / 10.0).alias("relevance"), F.element_at(F.array(F.lit("short"), F.lit("medium"), F.lit("long")), (F.col("vec_id") % 3 + 1).cast("int")).alias("tier"), (F.col("vec_id") % 40 + 1).alias("tokens"))
    return V.tiered_retrieval(e, ["label"], "relevance", "tier", "tokens", "vec_id").select("label", "vec_id")


@query("""SELECT vec_id, round((embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[3]::DOUBLE + embedding[4]::DOUBLE) / 4, 6) AS first, len(embedding) // 4 AS blocks FROM embeddings""")
def block_pooling(spark: SparkSession, d: str) -> DataFrame:
    p = _vectors(spark, d).select("vec_id", S.pool(F.col("embedding")).alias("p"))
    return p.select("vec_id", r6(F.element_at("p", 1)).alias("first"), F.size("p").cast("long").alias("blocks"))


# --- messages ----------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, event_id % 1000 AS seq, event_type AS payload FROM events WHERE event_id % 10 <> 3""")
def packet_parse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type")
    packet = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("x|"), "event_type")).otherwise(F.concat((F.col("event_id") % 1000).cast("string"), F.lit("|"), "event_type"))
    return IO.parse_packets(e.select("event_id", packet.alias("packet")), "packet").select("event_id", "seq", "payload")


@query("""SELECT event_id, event_type AS type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('click', 'purchase')""")
def message_route(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type", "props")
    message = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return IO.route_messages(e.select("event_id", message.alias("m")), "m", "type string, k bigint", ["click", "purchase"]).select("event_id", "type", "k")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT * FROM (VALUES (0, 'doc_id', 'bigint'), (1, 'text', 'string'), (2, 'lang', 'string'), (3, 'source', 'string'), (4, 'n_chars', 'bigint')) v("position", name, type),
 (SELECT count(*) AS rows FROM documents), (SELECT CAST(0 AS BIGINT) AS nulls)""")
def parquet_inspect(spark: SparkSession, d: str) -> DataFrame:
    return IO.inspect(table(spark, d, "documents"))


@query("""SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, n_nationkey, n_name FROM nation WHERE n_name IS NOT NULL""")
def json_columns_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    wide = IO.column_json(table(spark, d, "nation", "n_nationkey", "n_name"), ["n_nationkey", "n_name"], "n_nationkey")
    return IO.rows_of_columns(wide, ["n_nationkey", "n_name"], ["n_name"])


@query(Q.CONFIG_HASH)
def config_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", S.config_hash("n_nationkey", "n_name", "n_regionkey").alias("digest"))


# --- rows only: sequence matching, state machines, seams ----------------------------------------------------------------


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = O.previous_row(table(spark, d, "conversations"), ["conv_id"], ["turn"], ["text"]).where("prev_text IS NOT NULL")
    return pairs.select("conv_id", "turn", F.col("prev_text").alias("a"), F.col("text").alias("b"))


@query(Q.NEW_TEXT)
def new_text_prefix(spark: SparkSession, d: str) -> DataFrame:
    p = _turn_pairs(spark, d)
    return p.select("conv_id", "turn", S.common_prefix(F.col("a"), F.col("b")).alias("prefix"), F.md5(S.new_text(F.col("a"), F.col("b"))).alias("new_text"), F.md5(S.new_sentences(F.col("a"), F.col("b"))).alias("new_sentences"))


@query()
def similarity_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = _turn_pairs(spark, d)
    return p.select("conv_id", "turn", r6(T.similarity_udf()(F.col("a"), F.col("b"))).alias("similarity"), F.md5(T.appended_text_udf()(F.col("a"), F.col("b"))).alias("appended"))


@query()
def wer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _turn_pairs(spark, d).select("conv_id", "turn", r6(A.word_error_rate(F.col("a"), F.col("b"))).alias("wer"))


@query()
def fuzzy_window(spark: SparkSession, d: str) -> DataFrame:
    """The last sentence of each turn looked for in the sentences of the next one."""
    sentences = lambda t: F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    p = _turn_pairs(spark, d).withColumn("q", F.element_at(sentences(F.col("a")), -1)).where("q IS NOT NULL")
    return p.select("conv_id", "turn", T.fuzzy_window_udf()(F.col("q"), sentences(F.col("b"))).alias("m")).select("conv_id", "turn", "m.*")


@query(Q.HYBRID_VAD)
def hybrid_vad(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select(*K, F.col("frame_idx").alias("idx"), "prob")
    step = R.hybrid_vad({"start_frames": 3, "end_silence": 4, "soft_limit": 20, "hard_limit": 40, "threshold": 0.4, "pad": 1})
    return R.fold_batch(f, K, ["idx"], step, "start int, end int, reason string")


@query(Q.CHUNK_ACCUMULATE)
def chunk_accumulate(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select(*K, F.col("frame_idx").alias("idx"), (F.col("value") >= 50).alias("speech"))
    return R.fold_batch(f, K, ["idx"], R.chunk_accumulator(12, 2), "start int, end int, reason string")


@query(Q.CHUNK_CLASSIFY)
def chunk_classify(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select(*K, F.col("frame_idx").alias("idx"), "prob", "rms")
    return R.fold_batch(f, K, ["idx"], R.chunk_classifier(), "start int, end int, reason string")


@query(Q.HOTWORDS)
def hotwords_decay(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("idx"), S.words(F.col("text")).alias("tokens"))
    return R.fold_batch(t, ["conv_id"], ["idx"], R.decayed_words(), "idx int, rank int, word string, weight double").withColumn("weight", r6("weight"))


@query(Q.SPEAKERS)
def incremental_speakers(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select((F.col("vec_id") % 20).alias("session"), F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return R.fold_batch(e, ["session"], ["idx"], R.speaker_ids(0.5), "idx long, speaker int, similarity double").withColumn("similarity", r6("similarity"))


@query(Q.MEMORY_TIERS)
def memory_tiers(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select("label", F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    return R.fold_batch(e, ["label"], ["idx"], R.memory_tiers(), "idx long, short int, medium int, long int")


@query()
def cluster_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select((F.col("vec_id") % 20).alias("session"), "vec_id", "embedding")
    return V.threshold_clusters(e, ["session"], "vec_id", "embedding", 0.6)


@query()
def embedding_seam(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return M.apply(docs, "embedding", M.stub_embedding("text")).select("doc_id", "embedding", "success")


@query(Q.LANGUAGE)
def language_seam(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return M.apply(docs, "language", M.stub_language("text")).select("doc_id", "lang", "lang_label", "lang_score")


@query()
def offset_search(spark: SparkSession, d: str) -> DataFrame:
    """The second quarter of each vector looked for in the vector itself."""
    e = _vectors(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"), F.transform(F.slice("embedding", 17, 16), lambda x: x.cast("double")).alias("b"))
    return X.find_offsets(e, "a", "b", "all").select("vec_id", "matches")


@query()
def partial_search(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    pairs = e.select("vec_id", "a", F.concat(F.slice("a", 9, 24), F.array_repeat(F.lit(0.0), 8)).alias("b"))
    return X.find_offsets(pairs, "a", "b", "partial", 0.75).select("vec_id", "matches")


@query(Q.LONG_SPLIT)
def long_segment_split(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import merge_gaps, threshold_runs

    f = frames(spark, d)
    return X.split_long(merge_gaps(threshold_runs(f, K, F.col("value") >= 30, "prob"), K, 3, 3), f, K, 8)


@query(RUNS + """ SELECT r.stream_id, r.frame_start, r.frame_end, count(*) AS frames, round(avg(f.prob), 6) AS mean, round(min(f.prob), 6) AS min, round(max(f.prob), 6) AS max, round(stddev_pop(f.prob), 6) AS std,
 round(median(f.prob), 6) AS median, round(sqrt(avg(f.rms * f.rms)), 6) AS rms FROM r JOIN f ON f.stream_id = r.stream_id AND f.frame_idx BETWEEN r.frame_start AND r.frame_end GROUP BY ALL""")
def segment_slices(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import threshold_runs

    f = frames(spark, d)
    runs = threshold_runs(f, K, F.col("value") >= 50, "prob").select(*K, "frame_start", "frame_end")
    out = X.slice_stats(runs, f, K)
    return out.select(*K, "frame_start", "frame_end", "frames", *[r6(c).alias(c) for c in ("mean", "min", "max", "std", "median", "rms")])


@query(Q.PHRASES)
def phrase_alignment(spark: SparkSession, d: str) -> DataFrame:
    """A stream's event types as words, in phrases of four."""
    f = frames(spark, d)
    words = f.select(*K, F.col("frame_idx").alias("n"), F.col("event_type").alias("word"), F.col("frame_idx").cast("double").alias("start"), (F.col("frame_idx") + 1.0).alias("end"))
    item = F.array_sort(F.collect_list(F.struct("n", "word")))
    phrases = words.groupBy(*K, F.floor(F.col("n") / 4).cast("int").alias("n4")).agg(F.array_join(F.transform(item, lambda x: x["word"]), "").alias("phrase")).withColumnRenamed("n4", "n")
    return X.align_phrases(phrases, words, K, "n")


@query("""SELECT event_id FROM events WHERE ts > (SELECT TIMESTAMP '2024-01-15 00:00:00') - INTERVAL 300 SECOND""")
def recent_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.recent_rows(e, "ts", "2024-01-15 00:00:00").select("event_id")


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS text FROM events WHERE event_id % 3 > 0 GROUP BY user_id""")
def event_token_fold(spark: SparkSession, d: str) -> DataFrame:
    """Messages of which every third is a partial one: the last finished one of each user."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    kind = F.when(F.col("event_id") % 3 == 0, "partial").otherwise("done")
    message = F.to_json(F.struct(kind.alias("type"), F.col("event_type").alias("text")))
    return R.event_tokens(e.select("user_id", F.struct("ts", "event_id").alias("at"), message.alias("m")), "user_id", "at", "m")


@query(Q.PENDING_PAIRS)
def pending_pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns as early halves, the next assistant turns as late ones."""
    t = table(spark, d, "conversations").where("role <> 'system'")
    halves = t.select("conv_id", F.col("turn").alias("idx"), F.floor(F.col("turn") / 2).alias("id"), F.when(F.col("role") == "assistant", "final").otherwise("early").alias("kind"), "text")
    return R.fold_batch(halves, ["conv_id"], ["idx"], R.pending_pairs(), "id long, early string, late string")


@query(Q.PARTIAL_FINAL)
def partial_final(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select(*K, F.col("frame_idx").alias("idx"), (F.col("value") / 100).alias("seconds"), (F.col("event_type") == "purchase").alias("end"))
    return R.fold_batch(f, K, ["idx"], R.partial_final(), "idx int, kind string, seconds double").withColumn("seconds", r6("seconds"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\n[^\n]*[ \t]+$') THEN md5(rtrim(text, ' ' || chr(9))) ELSE md5(text) END AS digest FROM documents""")
def trailing_blank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(S.strip_trailing_blank(F.col("text"))).alias("digest"))


@query(Q.WER_TEXT)
def normalised_wer_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(T.normalise_wer_udf()(F.col("text"))).alias("digest"))


@query(Q.JAPANESE)
def split_sentences_ja(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(S.split_sentences_ja(F.col("text"))).alias("n"))


@query("""SELECT a.label, count(*) AS pairs, count(*) FILTER (WHERE list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)) > 0.5) AS accepted
FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label) GROUP BY a.label""")
def store_verify(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    store = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    out = V.verify(e, store, "label", "embedding", 0.5)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("accepted").alias("accepted"))
