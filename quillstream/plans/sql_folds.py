"""SQL for the state machines and other folds (recursive queries that take each stream one row further per round), and for text steps."""

from __future__ import annotations

from .catalog import FRAMES, RUNS

FOLD = FRAMES.replace("WITH", "WITH RECURSIVE", 1)

CHUNK_ACCUMULATE = RUNS + """, n AS (SELECT stream_id, max(frame_idx) AS last FROM f GROUP BY stream_id)
SELECT stream_id, CAST(frame_start + 12 * i AS INTEGER) AS "start", CAST(frame_start + 12 * i + 11 AS INTEGER) AS "end", 'flush' AS reason FROM r, unnest(range(frames // 12)) AS u(i)
UNION ALL SELECT stream_id, CAST(frame_end - frames % 12 + 1 AS INTEGER), frame_end, 'end' FROM r JOIN n USING (stream_id) WHERE frames % 12 >= 2 AND frame_end < last"""

CHUNK_CLASSIFY = FOLD + """, k AS (SELECT stream_id, frame_idx, CASE WHEN prob >= 0.5 THEN 'speech' WHEN rms >= 0.001 THEN 'sound' END AS kind, rms >= 0.12 AS loud FROM f),
t AS (SELECT DISTINCT stream_id, -1 AS frame_idx, NULL::VARCHAR AS held, 0 AS since, NULL::VARCHAR AS reason, 0 AS "start", 0 AS "end" FROM f
UNION ALL SELECT stream_id, frame_idx, CASE WHEN done THEN NULL ELSE kind END, since, CASE WHEN broke THEN held WHEN done THEN kind END,
  CASE WHEN broke THEN held_since ELSE since END, CASE WHEN broke THEN frame_idx - 1 ELSE frame_idx END
  FROM (SELECT *, kind IS NOT NULL AND (frame_idx - since >= 29 OR frame_idx - since >= 9 AND loud) AS done
    FROM (SELECT k.stream_id, k.frame_idx, k.kind, k.loud, t.held, t.since AS held_since, t.held IS NOT NULL AND t.held IS DISTINCT FROM k.kind AS broke,
      CASE WHEN t.held = k.kind THEN t.since ELSE k.frame_idx END AS since
      FROM t JOIN k ON k.stream_id = t.stream_id AND k.frame_idx = t.frame_idx + 1)))
SELECT stream_id, "start", "end", reason FROM t WHERE reason IS NOT NULL"""

# States: 0 silence, 1 possible speech, 2 speech or possible silence. dips: frames below the valley up to now, dipped: five of them in a row were seen.
VAD = FOLD + """, l AS (SELECT stream_id, frame_idx, list(prob) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS 4 PRECEDING) AS p FROM f),
x AS (SELECT stream_id, frame_idx, list_aggregate(p, 'fsum') / len(p) AS x FROM l),
t AS (SELECT DISTINCT stream_id, -1 AS frame_idx, 0 AS state, 0 AS since, 0 AS seen, 0 AS hits, 0 AS silent, 0 AS dips, false AS dipped, 0 AS "start", 0 AS "end", NULL::VARCHAR AS reason FROM f
UNION ALL SELECT stream_id, frame_idx,
  CASE WHEN state = 0 THEN speech::INTEGER WHEN state = 1 AND hits >= 3 AND hits / seen >= 0.6 THEN 2 WHEN state = 1 AND hits / seen < 0.6 AND seen >= 3 THEN 0 WHEN state = 1 THEN 1 WHEN why = 'silence' THEN 0 ELSE 2 END,
  CASE WHEN state = 0 AND speech THEN greatest(0, frame_idx - 1) WHEN why IN ('hard', 'valley') THEN frame_idx + 1 ELSE since END,
  seen, hits, CASE WHEN why IS NULL AND state = 2 THEN silent ELSE 0 END, CASE WHEN why IS NULL THEN dips ELSE 0 END, why IS NULL AND dipped,
  since, CASE WHEN why = 'silence' THEN frame_idx - silent + 1 ELSE frame_idx END, why
  FROM (SELECT *, CASE WHEN state < 2 THEN NULL WHEN silent >= 4 THEN 'silence' WHEN frame_idx - since + 1 >= 40 THEN 'hard' WHEN frame_idx - since + 1 > 20 AND dipped THEN 'valley' END AS why
    FROM (SELECT *, state > 0 AND (was_dipped OR dips >= 5) AS dipped
      FROM (SELECT x.stream_id, x.frame_idx, t.state, t.since, t.dipped AS was_dipped, x.x >= 0.4 AS speech,
        CASE WHEN t.state = 0 THEN 1 ELSE t.seen + 1 END AS seen, CASE WHEN t.state = 0 THEN 1 ELSE t.hits + (x.x >= 0.4)::INTEGER END AS hits,
        CASE WHEN x.x >= 0.4 THEN 0 ELSE t.silent + 1 END AS silent, CASE WHEN x.x >= 0.65 THEN 0 WHEN t.state = 0 THEN 1 ELSE t.dips + 1 END AS dips
        FROM t JOIN x ON x.stream_id = t.stream_id AND x.frame_idx = t.frame_idx + 1))))"""

HYBRID_VAD = VAD + """ SELECT stream_id, "start", "end", reason FROM t WHERE reason IS NOT NULL"""

SPEECH_EVENTS = VAD + """, s AS (SELECT stream_id, "start", "end", reason, lag("end") OVER w AS before, coalesce(lag(reason) OVER w IN ('hard', 'valley'), false) AS forced
  FROM t WHERE reason IS NOT NULL WINDOW w AS (PARTITION BY stream_id ORDER BY "start"))
SELECT stream_id, 'start' AS event, CASE WHEN forced THEN "start" ELSE greatest(coalesce(before, -1) + 1, "start" - 5, 0) END AS frame, NULL AS reason FROM s UNION ALL SELECT stream_id, 'end', "end", reason FROM s"""

HOTWORDS = r"""WITH RECURSIVE r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+(?:[''.&-]+[\p{L}\p{M}\p{N}_]+)*') AS w FROM conversations),
p AS (SELECT conv_id, n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM r),
c AS (SELECT conv_id, n, word, count(*) AS times, min(pos) AS pos FROM p WHERE length(word) > 1 AND NOT regexp_full_match(word, '\p{Nd}+') GROUP BY ALL),
t AS (SELECT DISTINCT conv_id, word, 0::BIGINT AS n, NULL::BIGINT AS turn, 0.0::DOUBLE AS kept, NULL::BIGINT AS born, 0.0::DOUBLE AS weight FROM c
UNION ALL SELECT conv_id, word, n, turn, CASE WHEN weight * 0.85::DOUBLE >= 0.5 THEN weight * 0.85::DOUBLE ELSE 0 END, born, weight
  FROM (SELECT t.conv_id, t.word, r.n, r.turn, CASE WHEN t.kept > 0 THEN t.born ELSE r.n * 1000000 + c.pos END AS born,
    CASE WHEN c.times IS NULL THEN t.kept ELSE list_reduce(list_concat([t.kept], list_transform(range(c.times), lambda i: 1.0::DOUBLE)), lambda a, b: a + b) END AS weight
    FROM t JOIN r ON r.conv_id = t.conv_id AND r.n = t.n + 1 LEFT JOIN c ON c.conv_id = t.conv_id AND c.n = t.n + 1 AND c.word = t.word)),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, n ORDER BY weight DESC, born) AS k FROM t WHERE weight > 0)
SELECT conv_id, CAST(turn AS INTEGER) AS idx, CAST(k AS INTEGER) AS rank, word, round(weight, 6) AS weight FROM k WHERE k <= 20"""

SPEAKERS = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id % 20 AS session, vec_id, row_number() OVER (PARTITION BY vec_id % 20 ORDER BY vec_id) AS n, sqrt(list_dot_product(v, v)) AS norm, v FROM e),
t AS (SELECT DISTINCT session, 0::BIGINT AS n, []::DOUBLE[][] AS held, NULL::BIGINT AS idx, 0::INTEGER AS speaker, 0.0::DOUBLE AS similarity FROM u
UNION ALL SELECT session, n, CASE WHEN known THEN held ELSE list_append(held, v) END, vec_id, CASE WHEN known THEN list_position(scores, list_max(scores)) - 1 ELSE len(held) END::INTEGER, CASE WHEN known THEN list_max(scores) ELSE 1.0 END
  FROM (SELECT *, len(held) > 0 AND (list_max(scores) >= 0.5 OR len(held) >= 10) AS known
    FROM (SELECT *, list_transform(held, lambda h: list_dot_product(h, v)) AS scores
      FROM (SELECT t.session, u.n, t.held, u.vec_id, list_transform(u.v, lambda x: x / u.norm) AS v FROM t JOIN u ON u.session = t.session AND u.n = t.n + 1))))
SELECT session, idx, speaker, round(similarity, 6) AS similarity FROM t WHERE n > 0"""

MEMORY_TIERS = """WITH RECURSIVE e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
t AS (SELECT 0 AS n, 0 AS short, 0 AS medium, 0 AS long
UNION ALL SELECT n + 1, CASE WHEN short = 11 THEN 8 ELSE short + 1 END, CASE WHEN short < 11 THEN medium WHEN medium = 11 THEN 8 ELSE medium + 1 END, CASE WHEN short = 11 AND medium = 11 THEN least(8, long + 1) ELSE long END
  FROM t WHERE n < (SELECT max(n) FROM e))
SELECT label, vec_id AS idx, short, medium, long FROM e JOIN t USING (n)"""

PENDING_PAIRS = """WITH h AS (SELECT conv_id, turn // 2 AS id, role, text, lag(role) OVER w AS role_before, lag(text) OVER w AS text_before FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id, turn // 2 ORDER BY turn))
SELECT conv_id, id, CASE WHEN role_before <> 'assistant' THEN text_before END AS early, text AS late FROM h WHERE role = 'assistant'"""

PARTIAL_FINAL = FOLD + """, t AS (SELECT DISTINCT stream_id, -1 AS idx, 0.0::DOUBLE AS held, 0.0::DOUBLE AS sent, NULL::VARCHAR AS kind, 0.0::DOUBLE AS seconds FROM f
UNION ALL SELECT stream_id, frame_idx, CASE WHEN ends THEN 0 ELSE h END, CASE WHEN ends THEN 0 WHEN h - sent >= 4.5 THEN h ELSE sent END, CASE WHEN ends AND h >= 0.25 THEN 'final' WHEN NOT ends AND h - sent >= 4.5 THEN 'partial' END, h
  FROM (SELECT *, is_end OR h > 20 AS ends FROM (SELECT f.stream_id, f.frame_idx, t.sent, t.held + f.value / 100 AS h, f.event_type = 'purchase' AS is_end FROM t JOIN f ON f.stream_id = t.stream_id AND f.frame_idx = t.idx + 1)))
SELECT stream_id, idx, kind, round(seconds, 6) AS seconds FROM t WHERE kind IS NOT NULL"""

LONG_SPLIT = FOLD + """, v AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY stream_id ORDER BY frame_idx) AS g FROM f WHERE value >= 30),
r AS (SELECT stream_id, min(frame_idx) AS a, max(frame_idx) AS b FROM v GROUP BY stream_id, g),
m AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY stream_id ORDER BY a) - 1 < 3 THEN 0 ELSE 1 END AS first FROM r),
c AS (SELECT *, sum(first) OVER (PARTITION BY stream_id ORDER BY a) AS m FROM m),
p AS (SELECT stream_id, list(prob ORDER BY frame_idx) AS p FROM f GROUP BY stream_id),
s AS (SELECT stream_id, min(a) AS a, max(b) AS b FROM c GROUP BY stream_id, m HAVING max(b) - min(a) + 1 >= 3
UNION ALL SELECT stream_id, unnest([a, cut]), unnest([cut - 1, b])
  FROM (SELECT stream_id, a, b, CAST(a + n // 4 + list_position(middle, list_min(middle)) - 1 AS INTEGER) AS cut
    FROM (SELECT s.stream_id, s.a, s.b, s.b - s.a + 1 AS n, p.p[s.a + (s.b - s.a + 1) // 4 + 1 : s.b + 1 - (s.b - s.a + 1) // 4] AS middle FROM s JOIN p ON p.stream_id = s.stream_id WHERE s.b - s.a + 1 > 8)))
SELECT stream_id, a AS frame_start, b AS frame_end FROM s WHERE b - a + 1 <= 8"""

CONFIG_HASH = """SELECT n_nationkey, md5('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation"""

SEGMENT_METADATA = RUNS + """ SELECT stream_id, frame_start, '{"filename":"segment_' || frame_start || '","utterance_id":' || stream_id || ',"duration_sec":' || round(frames * 0.01::DOUBLE, 3) || ',"sample_rate":16000'
 || CASE WHEN frames > 3 THEN ',"vad_stats":{"mean":' || round(mean_prob + 3e-9, 4) || ',"std":' || round(std_prob + 3e-9, 4) || '}' ELSE '' END || '}' AS meta FROM r WHERE frames >= 2"""

PHRASES = FRAMES + """, g AS (SELECT stream_id, frame_idx // 4 AS k, list(event_type ORDER BY frame_idx) AS words, min(frame_idx) AS first, max(frame_idx) AS last FROM f GROUP BY ALL)
SELECT stream_id, CAST(k AS INTEGER) AS "index", array_to_string(words, '') AS phrase, words, first::DOUBLE AS "start", last + 1.0::DOUBLE AS "end" FROM g"""

# Marks at which a text is cut become a control character that no text holds.
JAPANESE = r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'), '[\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F300}-\x{1FAFF}]+', chr(1), 'g'), '([。！？、…])', '\1' || chr(1), 'g') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(string_split(t, chr(1)), lambda s: trim(s) <> '')) AS INTEGER) AS n FROM m"""

PAIRS = """WITH p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, text AS b FROM conversations)"""

NEW_TEXT = PAIRS + r""", n AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS n,
  list_filter(regexp_extract_all(a, '[^。！？…\n]*(?:[。！？…]+\n*|\n+|$)'), lambda s: s <> '') AS x, list_filter(regexp_extract_all(b, '[^。！？…\n]*(?:[。！？…]+\n*|\n+|$)'), lambda s: s <> '') AS y FROM p WHERE a IS NOT NULL),
z AS (SELECT *, list_filter(range(1, least(len(x), len(y)) + 1), lambda i: rtrim(x[i], '。、，．！？!?.,…・「」『』（）()[]【】　 ' || chr(9) || chr(13) || chr(10)) <> rtrim(y[i], '。、，．！？!?.,…・「」『』（）()[]【】　 ' || chr(9) || chr(13) || chr(10))) AS other FROM n)
SELECT conv_id, turn, CAST(n AS INTEGER) AS prefix, md5(regexp_replace(substr(b, n + 1), '^[\s\x{0B}]+', '')) AS new_text, md5(coalesce(array_to_string(y[coalesce(list_min(other), least(len(x), len(y)) + 1):], ''), '')) AS new_sentences FROM z"""

# NFKC is not in SQL; these tables hold no characters that it changes beyond the canonical form.
WER_TEXT = r"""SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(nfc_normalize(text), '\p{P}', ' ', 'g')), '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))) AS digest FROM documents"""

# The small words and scripts are the stand-in's, spelled out.
LANGUAGE = r"""WITH t AS (SELECT doc_id, lang, text, array_to_string(regexp_extract_all(text, '\p{L}'), '') AS l FROM documents),
c AS (SELECT doc_id, lang, length(l) AS letters, [len(regexp_extract_all(l, '[\x{3040}-\x{30FF}]')), len(regexp_extract_all(l, '[\x{4E00}-\x{9FFF}]')), len(regexp_extract_all(l, '[\x{AC00}-\x{D7AF}]')),
   len(regexp_extract_all(l, '[\x{0400}-\x{04FF}]')), len(regexp_extract_all(l, '[\x{0600}-\x{06FF}]'))] AS n,
  list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''), lambda w: trim(w, '.,!?;:')) AS words FROM t),
h AS (SELECT *, list_transform([['fr', 'le', 'la', 'les', 'des', 'est', 'dans', 'que', 'pour', 'qui', 'une'], ['es', 'el', 'la', 'de', 'que', 'los', 'en', 'por', 'una', 'con', 'las'],
  ['en', 'the', 'and', 'of', 'to', 'in', 'is', 'that', 'it', 'was', 'for'], ['de', 'der', 'die', 'und', 'das', 'den', 'ist', 'von', 'nicht', 'mit', 'auf']], lambda l: len(list_filter(words, lambda w: list_contains(l[2:], w)))) AS hits FROM c),
s AS (SELECT *, coalesce(list_position([n[1] > letters * 0.1, n[2] > letters * 0.3, n[3] > letters * 0.3, n[4] > letters * 0.3, n[5] > letters * 0.3], true), 0) AS script FROM h)
SELECT doc_id, lang, CASE WHEN letters = 0 THEN 'unknown' WHEN script > 0 THEN ['ja', 'zh', 'ko', 'ru', 'ar'][script] WHEN list_max(hits) = 0 THEN 'unknown' ELSE ['fr', 'es', 'en', 'de'][list_position(hits, list_max(hits))] END AS lang_label,
 CASE WHEN letters = 0 THEN 0.0 WHEN script > 0 THEN n[script] / letters WHEN list_max(hits) = 0 THEN 0.0 ELSE list_max(hits) / list_sum(hits) END AS lang_score FROM s"""

# A statement that calls a logger goes as its first line; these tables hold none that runs over several.
TEXT_STEPS = r"""WITH c AS (SELECT doc_id, text,
  regexp_replace(text, '(\x22{3}(?s:.*?)(?:\x22{3}|\z)|''''''(?s:.*?)(?:''''''|\z)|\x22(?:\\(?s:.)|[^\x22\\\n])*\x22?|''(?:\\(?s:.)|[^''\\\n])*''?)|#[^\n]*', '\1', 'g') AS code FROM documents)
SELECT doc_id, md5(replace(replace(trim(regexp_replace(text, '[\s\x{0B}]+', ' ', 'g')), ' .', '.'), '. ', '.')) AS dots,
 CAST(len(regexp_extract_all(text, '\n+')) + 1 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS segments,
 CAST(len(list_filter(regexp_split_to_array(text, '[\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F300}-\x{1FAFF}]+'), lambda s: regexp_matches(s, '[^\s\x{0B}\x{85}\p{Z}]'))) AS INTEGER) AS symbols,
 md5(array_to_string(list_filter(list_transform(string_split(code, chr(10)), lambda l: regexp_replace(l, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '')), lambda l: NOT regexp_matches(l, '^\s*(logger\.|logging\.|print\(|console\.)')), chr(10))) AS code FROM c"""
