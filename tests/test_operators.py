"""Operators on small tables, against plain loops and worked examples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import scalar as S
from quillstream.functions import textual as T
from quillstream.operators import aggregates as A
from quillstream.operators import frames as G
from quillstream.operators import ordered as O
from quillstream.operators import seams as M
from quillstream.operators import signals as X
from quillstream.operators import vectors as V
from quillstream.streaming import machines as R


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def texts(spark, rows, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    return [r["x"] for r in df.select("k", column.alias("x")).orderBy("k").collect()]


@pytest.fixture(autouse=True)
def _column(spark):
    global t
    t = F.col("t")


@pytest.mark.parametrize("value, label", [(-0.3, "very_high"), (-0.8, "high"), (-1.2, "medium"), (-2.1, "low"), (-4.5, "very_low"), (-0.95, "high"), (None, None), (float("nan"), None)])
def test_logprob_steps(spark, value, label):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(S.bucket(F.col("v"), S.LOGPROB_STEPS)).first()[0] == label


def test_token_estimate(spark):
    assert texts(spark, ["", "a", " " * 100, "hello" * 20, None], S.token_estimate(t)) == [0, 1, 25, 25, 0]


def test_energy(spark):
    wave = [float(np.sin(2 * np.pi * 440 * k / 16000)) for k in range(16000)]
    df = spark.createDataFrame([(0, [0.0] * 1000), (1, [1.0] * 1000), (2, wave), (3, [])], "k int, s array<double>")
    got = [r["x"] for r in df.select("k", S.rms(F.col("s")).alias("x")).orderBy("k").collect()]
    assert got == [0.0, 1.0, pytest.approx(0.7071, abs=1e-3), 0.0]
    assert df.where("k = 3").select(F.size(S.framed_rms(F.col("s"))), S.zero_crossing_rate(F.col("s"))).first()[:] == (0, 0.0)


def test_html_lines(spark):
    pages = ["<html><head><style>p{}</style></head><body><script>var a;</script><p>Hello <b>big</b>   world</p><ul><li>One</li><li>Two &amp; three</li></ul><!-- no --></body>", "plain", ""]
    assert texts(spark, pages, S.html_lines(t)) == [["Hello big world", "One", "Two & three"], ["plain"], []]


def test_sentences(spark):
    assert texts(spark, ["今日は。\n元気?はい！そう…", "", "no end"], S.split_sentences(t)) == [["今日は。\n", "元気?はい！", "そう…"], [], ["no end"]]
    assert texts(spark, ["あ、い☀う。え"], S.split_sentences_ja(t)) == [["あ、", "い", "う。", "え"]]
    valid = ["Ok", "Yes!", "x" * 41, "ALL CAPS", "Contents", "- a b", "a ==== b", "Fine text here", "word", "Ends here.", None]
    assert texts(spark, valid, S.is_valid_sentence(t)) == [False, True, False, False, False, False, False, True, False, True, False]


def test_text_scalars(spark):
    assert texts(spark, ["abc。、! \n", "dogs"], S.strip_trailing(t)) == ["abc", "dogs"]
    assert texts(spark, ["dogs"], S.strip_trailing(t, compat=True)) == ["dog"]
    assert texts(spark, ["a .b c. d e", "x"], S.merge_dot_words(t)) == ["a.b c.d e", "x"]
    assert texts(spark, ["a  \nb \t", "a  "], S.strip_trailing_blank(t)) == ["a  \nb", "a  "]
    assert texts(spark, ["a\n\n \nb"], S.squeeze_newlines(t)) == ["a\nb"]
    assert texts(spark, ["It's a dog-house, ok."], S.tokens(t)) == [["It", "'s", "a", "dog", "-", "house", ",", "ok", "."]]
    m = texts(spark, ["a,b!!cd", "...", ""], S.punctuation_map(t))
    assert [x["clean"] for x in m] == ["abcd", "", ""] and [tuple(r) for r in m[0]["runs"]] == [(0, 0, 1), (1, 2, 1), (2, 5, 2)]
    df = spark.createDataFrame([(["a\n\n", "b"],)], "s array<string>")
    assert df.select(S.newline_expansion(F.col("s"))).first()[0] == ["a", "", "", "b"]
    assert texts(spark, ["3661.2345", "0", "359999.9999"], S.srt_time(t.cast("double"))) == ["01:01:01,234", "00:00:00,000", "99:59:59,999"]
    assert texts(spark, ["x/a.PY", "b.unknown"], S.language_of(t)) == ["python", "text"]
    assert texts(spark, ["Report 12.txt", "x"], S.matches_content(t, ["report*"], [])) == [True, False]


def test_common_prefix_at_random(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("ab", k=rng.randint(0, 12))), "".join(rng.choices("ab", k=rng.randint(0, 12)))) for _ in range(300)]
    got = [r["n"] for r in spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a string, b string").select("k", S.common_prefix(F.col("a"), F.col("b")).alias("n")).orderBy("k").collect()]
    import os

    assert got == [len(os.path.commonprefix(r)) for r in rows]


def test_new_text(spark):
    df = spark.createDataFrame([("今日は。元気。", "今日は！元気。はい。"), ("", "a b"), ("a", "a  b")], "a string, b string")
    got = [tuple(r) for r in df.select(S.new_text(F.col("a"), F.col("b")), S.new_sentences(F.col("a"), F.col("b"))).collect()]
    assert got == [("！元気。はい。", "はい。"), ("a b", "a b"), ("b", "a  b")]
    assert df.select(S.stitch(F.lit("one two three"), F.lit("three four")), S.stitch(F.lit("one"), F.lit("two")), S.stitch(F.lit(""), F.lit("x")), S.stitch(F.lit("x"), F.lit(""))).first()[:] == ("one two three four", "one two", "x", "x")


def test_textual_functions():
    assert T.normalise_wer("Ｈello， World。 x") == "hello world x"
    assert T.similarity("abc。", "abc") == 1.0
    assert T.appended_text("I am", "I am here now") == "here now" and T.appended_text("a b c", "a x c d e") == "d e"
    assert T.appended_word_count("a", "a b c。") == 2
    assert T.appended_restored("今日は。", "今日は、元気です。") == "元気です。"
    assert T.ratio("abcd", "abxd") == 75.0 and T.partial_ratio("bcd", "abcde") == 100.0
    best = T.fuzzy_window("good morning", ["well good mornin to you", "nothing"], 75, 5)
    assert best["text"].startswith("well") and best["score"] > 90
    assert T.fuzzy_window("zzz", ["abc"]) is None and T.fuzzy_window("", ["abc"]) is None
    assert T.strip_comments("a = '#x' # c\n# whole\nb") == "a = '#x'\n\nb"
    assert T.remove_calls("a\nlogger.info(\n  1,\n)\nb") == "a\nb"
    assert [o["tag"] for o in T.opcodes("abc", "abd")] == ["equal", "replace"]


def test_lcs_ratio_equals_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert T.ratio(a, b) == pytest.approx(200 * row[-1] / (len(a) + len(b)))


def frames(spark, probs):
    return spark.createDataFrame([(1, k, float(p)) for k, p in enumerate(probs)], "s int, frame_idx int, p double")


def runs_plain(flags):
    out, start = [], None
    for k, f in enumerate([*flags, False]):
        if f and start is None:
            start = k
        if not f and start is not None:
            out.append((start, k - 1))
            start = None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_merge_and_complement_equal_loops(spark, seed):
    rng = random.Random(seed)
    probs = [rng.random() for _ in range(80)]
    f = frames(spark, probs)
    runs = G.threshold_runs(f, ["s"], F.col("p") >= 0.5, "p")
    plain = runs_plain([p >= 0.5 for p in probs])
    assert sorted((r["frame_start"], r["frame_end"]) for r in runs.collect()) == plain
    merged = []
    for a, b in plain:
        if merged and a - merged[-1][1] - 1 < 2:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    got = G.merge_gaps(runs, ["s"], 2)
    assert sorted((r["frame_start"], r["frame_end"]) for r in got.collect()) == merged
    bounds = f.groupBy("s").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))
    rest = G.complement(got.select("s", "frame_start", "frame_end"), ["s"], bounds)
    covered = sorted([k for a, b in merged for k in range(a, b + 1)] + [k for r in rest.collect() for k in range(r["frame_start"], r["frame_end"] + 1)])
    assert covered == list(range(80))


def test_waves(spark):
    w = {r["frame_start"]: r for r in G.speech_waves(frames(spark, [0.9, 0.9, 0.1, 0.6, 0.9, 0.7, 0.1, 0.8, 0.8]), ["s"], "p").collect()}
    assert not w[0]["has_risen"] and w[3]["is_valid"] and w[3]["frame_end"] == 6 and not w[7]["has_fallen"]


def test_clip_overlaps_equals_loop(spark):
    rng = random.Random(5)
    rows = [(1, k, a, a + rng.randint(0, 9)) for k, a in enumerate(sorted(rng.randint(0, 60) for _ in range(40)))]
    got = sorted((r["k"], r["a"], r["b"]) for r in G.clip_overlaps(spark.createDataFrame(rows, "s int, k int, a int, b int"), ["s"], "a", "b", ["k"]).collect())
    last, want = None, []
    for _, k, a, b in rows:
        if last is None or b > last:
            want.append((k, a if last is None else max(a, last), b))
            last = b
    assert got == want


@pytest.mark.parametrize("n, mode, want", [(0, "pad", []), (10, "pad", [(0, 10, 10), (7, 10, 10)]), (10, "stop", [(0, 10, 10)]), (25, "plain", [(0, 10, 10), (7, 17, 10), (14, 24, 10), (21, 25, 4)]), (18, "stop", [(0, 10, 10), (7, 17, 10), (14, 18, 4)])])
def test_chunks(spark, n, mode, want):
    got = G.chunks(spark.createDataFrame([(n,)], "n int"), F.col("n"), 10, 3, mode).orderBy("start").collect()
    assert [(r["start"], r["end"], r["samples"]) for r in got] == want
    with pytest.raises(ValueError):
        G.chunks(spark.createDataFrame([(n,)], "n int"), F.col("n"), 3, 3)


def test_budget_keeps_newest(spark):
    df = spark.createDataFrame([(1, k, 120.0) for k in range(3)] + [(2, k, 100.0) for k in range(4)], "g int, k int, d double")
    kept = O.keep_within_budget(df, ["g"], [F.desc("k")], "d", 300.0)
    assert sorted((r["g"], r["k"]) for r in kept.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]


def test_global_rank_and_interval_join(spark):
    df = spark.createDataFrame([(k, (k * 37) % 101) for k in range(300)], "k int, v int")
    got = {r["k"]: r["rank"] for r in O.global_rank(df, [F.desc("v"), F.asc("k")]).collect()}
    assert got == {k: n + 1 for n, k in enumerate(sorted(range(300), key=lambda k: (-(k * 37 % 101), k)))}
    assert O.global_rank(df.limit(0), [F.asc("k")]).count() == 0
    segments = spark.createDataFrame([(1, 5, 200, 1), (1, 100, 110, 2)], "s int, a int, b int, n int")
    points = spark.createDataFrame([(1, x) for x in (0, 5, 105, 200, 201)], "s int, x int")
    assert {r["x"]: r["segment_num"] for r in O.interval_first_match(points, segments, ["s"], "x", "a", "b", "n").collect()} == {0: 0, 5: 1, 105: 1, 200: 1, 201: 0}


def test_within_age(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-20",), ("notes",)], "d string")
    assert sorted(r["d"] for r in O.within_age(df, "d", "2024-01-25").collect()) == ["2024-01-20", "notes"]


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c d", "a x c"), ("日本", "日体"), ("", "a"), (None, "a")], "a string, b string")
    got = [tuple(r) for r in df.select(A.word_error_rate(F.col("a"), F.col("b")), A.character_error_rate(F.col("a"), F.col("b"))).collect()]
    assert got[0][0] == 0.5 and got[1] == (1.0, 0.5) and got[2] == (None, None) and got[3][0] is None


def test_confusion_without_positives(spark):
    df = spark.createDataFrame([(False, False)], "t boolean, p boolean")
    r = A.confusion(df, F.col("t"), F.col("p")).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"]) == (1, None, None, None)


def test_search_in_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(k, int(k % 3), x.tolist()) for k, x in enumerate(v)], "id long, g int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    got = {}
    for r in V.search(df, df.select(F.col("id").alias("q"), "g", "v"), 3, "q", "id", "v", "v", "g", True, part=25, block=30).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"]))
    for q in range(120):
        same = [k for k in range(120) if k % 3 == q % 3 and k != q]
        assert [i for _, i in sorted(got[q])] == sorted(same, key=lambda k: (-s[q, k], k))[:3]


def test_vector_helpers(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert df.select(S.masked_mean(F.col("v"), F.col("m"))).first()[0] == [2.0, 3.0]
    store = spark.createDataFrame([(1, 1, [1.0, 0.0])], "id int, ver int, v array<double>")
    new = spark.createDataFrame([(1, 2, [0.0, 1.0]), (2, 1, [1.0, 1.0])], "id int, ver int, v array<double>")
    assert {r["id"]: r["v"] for r in V.enrol(store, new, "id", "ver").collect()} == {1: [0.0, 1.0], 2: [1.0, 1.0]}
    claims = spark.createDataFrame([(1, [1.0, 0.1]), (3, [1.0, 0.0])], "id int, v array<double>")
    assert {r["id"]: r["accepted"] for r in V.verify(claims, store, "id", "v").collect()} == {1: True, 3: False}
    nan = float("nan")
    marks = spark.createDataFrame([(1, 1, 0.5, 0.5), (1, 2, 0.5, 0.5), (1, 1, nan, 0.5), (1, 1, -0.1, 0.5), (1, None, 0.5, 0.5)], "a int, b int, x double, y double")
    assert [r[0] for r in marks.select(V.same_cluster(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).collect()] == [True, False, False, False, False]
    two = spark.createDataFrame([(0, k, v) for k, v in enumerate([[1.0, 0.0], [0.99, 0.1], [0.0, 1.0]])], "s int, k int, v array<double>")
    assert [r["cluster"] for r in V.threshold_clusters(two, ["s"], "k", "v").orderBy("k").collect()] == [0, 0, 1]


def test_offsets():
    rng = np.random.default_rng(2)
    long = rng.normal(size=500)
    assert X.best_offset(long, long[200:260])[0] == 200 and X.best_offset(long, rng.normal(size=60)) is None
    twice = np.concatenate([long[:100], long[:100]])
    assert [a for a, _ in X.all_offsets(twice, long[10:90])] == [10, 110]
    plain = [np.corrcoef(long[k : k + 40], long[7:47])[0, 1] for k in range(461)]
    assert np.allclose(X.correlation(long, long[7:47]), plain)
    assert not X.correlation(np.ones(50), long[:10]).any() and len(X.correlation(long[:3], long)) == 0
    half = np.concatenate([long[100:180], rng.normal(size=40)])
    assert any(m["a_start"] == 100 for m in X.partial_matches(long, half))


def test_machines_batch_equals_loop_and_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(c, k, rng.random() * 0.3 + (0.6 if (k // 15) % 2 else 0.0)) for c in range(4) for k in range(120)]
    df = spark.createDataFrame(rows, "c int, idx int, prob double")
    step = R.hybrid_vad({"start_frames": 3, "end_silence": 4, "soft_limit": 40, "hard_limit": 60})
    want = []
    for c in range(4):
        state = {}
        for _, k, p in (r for r in rows if r[0] == c):
            state, out = step(state, {"idx": k, "prob": p})
            want += [(c, o["start"], o["end"], o["reason"]) for o in out]
    outputs = "start int, end int, reason string"
    assert want and sorted(tuple(r) for r in R.fold_batch(df, ["c"], ["idx"], step, outputs).collect()) == sorted(want)
    for part in range(3):
        df.where(f"idx div 40 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = R.fold_stream(stream, ["c"], ["idx"], step, outputs).writeStream.format("memory").queryName("vad").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM vad").collect()) == sorted(want)
    with pytest.raises(ValueError):
        step({}, {"idx": 0, "prob": 1.5})


def test_small_machines():
    def run(step, rows):
        state, out = {}, []
        for r in rows:
            state, made = step(state, r)
            out += made
        return out

    words = run(R.decayed_words(0.9, 0.1), [{"idx": 0, "tokens": ["東京", "大阪", "東京", "a", "12"]}, {"idx": 1, "tokens": ["京都"]}])
    assert [(w["word"], round(w["weight"], 2)) for w in words] == [("東京", 2.0), ("大阪", 1.0), ("東京", 1.8), ("京都", 1.0), ("大阪", 0.9)]
    ids = run(R.speaker_ids(0.9, 2), [{"idx": k, "vector": v} for k, v in enumerate([[1, 0], [0, 1], [0.9, 0.1], [-1, 0]])])
    assert [i["speaker"] for i in ids] == [0, 1, 0, 1]
    pairs = run(R.pending_pairs(1), [{"id": 1, "kind": "early", "text": "a"}, {"id": 2, "kind": "early", "text": "b"}, {"id": 1, "kind": "final", "text": "c"}, {"id": 2, "kind": "final", "text": "d"}])
    assert [(p["id"], p["early"], p["late"]) for p in pairs] == [(1, None, "c"), (2, "b", "d")]
    spoken = run(R.partial_final(1.0, 3.0), [{"idx": k, "seconds": 0.5, "end": k == 9} for k in range(10)])
    assert [s["kind"] for s in spoken] == ["partial", "partial", "partial", "final", "partial", "final"]
    acc = run(R.chunk_accumulator(4, 2), [{"idx": k, "speech": k in (0, 2, 3, 5, 6, 7, 8)} for k in range(10)])
    assert [(a["start"], a["end"], a["reason"]) for a in acc] == [(2, 3, "end"), (5, 8, "flush")]


def test_seams(spark):
    df = spark.createDataFrame([(1, "der Hund und die Katze"), (2, "the dog and the cat"), (3, ""), (4, "ねこがすき"), (5, None)], "k int, t string")
    assert {r["k"]: r["lang_label"] for r in M.apply(df, "language", M.stub_language("t")).collect()} == {1: "de", 2: "en", 3: "unknown", 4: "ja", 5: "unknown"}

    def picky(part):
        if (part["k"] == 2).any():
            raise RuntimeError("no")
        return M.stub_embedding("t", 4)(part)

    rows = {r["k"]: r for r in M.apply(df, "embedding", picky).collect()}
    assert not rows[2]["success"] and rows[2]["error"] == "no" and rows[1]["success"] and len(rows[1]["embedding"]) == 4


def test_interval_join_keeps_repeated_points(spark):
    points = spark.createDataFrame([(1, 5), (1, 5), (1, 99), (2, 5)], "k int, at int")
    segments = spark.createDataFrame([(1, 0, 9, 2), (1, 4, 70, 1)], "k int, s int, e int, num int")
    got = O.interval_first_match(points, segments, ["k"], "at", "s", "e", "num").collect()
    assert sorted(r["segment_num"] for r in got) == [0, 0, 1, 1]


def test_word_error_rate_over_many_words(spark):
    """More different words than lie below the surrogates, and more than three bytes reach."""
    for n in (36_000, 44_000):
        a, b = " ".join(f"w{k}" for k in range(n)), " ".join(f"w{k}" for k in range(n) if k % 1000 != 999)
        ends = spark.createDataFrame([(a[-300:] + " x", a[-300:])], "a string, b string")
        assert ends.select(A.word_error_rate(F.col("a"), F.col("b"))).first()[0] > 0
        spelled = spark.range(n).select(A.code_point(A.word_place(F.col("id"))).alias("c"))
        assert spelled.distinct().count() == n and spelled.where("c IS NULL OR length(c) <> 1").count() == 0


def test_save_by_suffix(spark, tmp_path):
    from quillstream.sources import files

    df = spark.createDataFrame([(1, "é")], "a int, b string")
    for name, read in (("x.json", spark.read.json), ("x.csv", lambda p: spark.read.csv(p, header=True, inferSchema=True)), ("x.parquet", spark.read.parquet), ("plain", spark.read.parquet)):
        assert read(files.save(df, f"{tmp_path}/{name}")).select("a", "b").first()[:] == (1, "é")


def test_incremental_transcript():
    step, state, made = R.incremental_transcript(), {}, []
    for k, text in enumerate(["hello there", "hello there my friend", None, "hello", "a quite different text"]):
        state, out = step(state, {"idx": k, "text": text})
        made += [(o["is_continued"], o["new_text"]) for o in out]
    assert made == [(False, "hello there"), (True, "my friend"), (False, ""), (False, "hello"), (False, "a quite different text")]


def test_seeded_sample(spark):
    rows = spark.range(500).withColumnRenamed("id", "k")
    taken = [r["k"] for r in O.seeded_sample(rows, "k", 100).collect()]
    assert len(set(taken)) == 100 and taken == [r["k"] for r in O.seeded_sample(rows.repartition(7), "k", 100).collect()]
    assert taken != [r["k"] for r in O.seeded_sample(rows, "k", 100, seed=7).collect()]
    assert O.seeded_sample(rows.limit(0), "k", 100).count() == 0
