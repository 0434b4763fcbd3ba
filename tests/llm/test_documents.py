"""Operators on documents: held against brute force, round trips, and edge rows."""

import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import media, mixing, packing, pii, queries, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "a", "a a a a", "x@y.example.com", "<|endoftext|>", "é" * 50, "１２３ ＡＢ", "word " * 30_000, "9" * 40_000, "@" * 5000, "a." * 20_000, "+1 " * 5000, "k=1 " * 2000]


def edge(spark):
    rows = [(k, t, None if k % 3 else "en", None if k % 2 else f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(ODD)]
    rows += [rows[4], rows[4], (None, "a a a a", None, None, 7), (None, None, None, None, None)]
    # Columns with names that operators use inside, or add.
    return spark.createDataFrame(rows, SCHEMA).withColumn("_fp", F.lit(1)).withColumn("size", F.lit("x")).withColumn("length", F.lit(2)).withColumn("key", F.lit(3))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(800)]
    out = []
    for k in range(n):
        text = " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 80, 300])))
        if k % 5 == 4:
            text = out[rng.randrange(len(out))][1]
            if k % 2:
                w = text.split()
                w[rng.randrange(len(w))] = "changed"
                text = " ".join(w)
        out.append((k, text, "en", f"s{k % 7}" if k % 11 else None, len(text)))
    return out


# --- personal data


PII_TEXTS = [
    "mail a.b@c.de. or x@y", "a@b.com_x@d.com and a@b@c.org", "1.2.3.4.5.6.7.8 then 256.1.1.1 and 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485 or +49 30 12",
    "4539578763621486 0000000000000000000", "+1234567890123456", "é +1 800 555 1234 é a@b.co", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "..a@b..c x%+@-.-", "12@3.4 1.1.1.1@a.b",
]


def test_pii_matches_brute_force(spark):
    rng = random.Random(1)
    alphabet = "a1.@+ -()_%9é\n"
    texts = PII_TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(600)] + [t for t in ODD if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] != "cue"] for r in pii.find_pii(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [(a, kind, b) for a, _, kind, b in brute.pii_spans(t)], t[:80]


def test_pii_bootstraps_unseen_identifiers(spark):
    seeds = [f"please note account: user{k}@mail.example.com thanks" for k in range(6)]
    unseen, noise = "the account: AB-99812-XY is closed", [f"note: word{k} and item= {k}x" for k in range(9)]
    df = spark.createDataFrame(list(enumerate([*seeds, unseen, *noise])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert [(s["kind"], unseen[s["start"] : s["end"]]) for s in got[6]["spans"]] == [("cue", "AB-99812-XY")]
    assert all(not got[k]["spans"] for k in range(7, 16))
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[6] == "the account: [cue] is closed"


def test_pii_edges(spark):
    got = pii.find_pii(edge(spark)).collect()
    assert len(got) == len(ODD) + 4 and all(r["spans"] == [] for r in got if not r["text"])
    assert pii.find_pii(empty(spark)).count() == 0 and pii.redact(empty(spark)).count() == 0


def test_redact_keeps_rows_and_counts(spark):
    df = spark.createDataFrame([(1, "é a@b.co +1 800 555 1234.", "en", "s", 25)], SCHEMA)
    row = pii.redact(df).first()
    assert row["text"] == "é [email] [phone]." and row["n_chars"] == len(row["text"])


# --- SimHash


def test_simhash_matches_brute_force(spark):
    rows = corpus() + [(1000 + k, t, None, None, None) for k, t in enumerate(ODD)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [brute.simhash(r[1]) for r in rows]
    assert [got[r[0]]["fp"] & (1 << 64) - 1 for r in rows] == prints
    assert [got[r[0]]["component_id"] for r in rows] == brute.components([r[0] for r in rows], prints)


def test_links_lose_none_in_dense_groups(spark):
    """A ball of fingerprints around one, larger than a run that is cut, and a chain that only neighbours hold together."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(6000)}
    chain, at = set(), int(rng.integers(0, 2**63))
    for k in range(40):
        at ^= 0b1111 << (k % 16 * 4)
        chain.add(at ^ k << 20)
    every = sorted(fps | chain | {int(x) for x in rng.integers(0, 2**63, 2000)})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in every]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    root = {x: x for x in every}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e in edges:
        root[find(e["u"] & (1 << 64) - 1)] = find(e["v"] & (1 << 64) - 1)
    want = brute.components(list(range(len(every))), every)
    groups = {}
    for k, x in enumerate(every):
        groups.setdefault(find(x), set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


@pytest.mark.parametrize("distance", [2, 6, 11])
def test_link_run_equals_brute_force_when_cut(monkeypatch, distance):
    monkeypatch.setattr(simhash, "LONG_RUN", 16)
    rng = np.random.default_rng(3)
    width = 14 if distance == 2 else 40
    fps = np.unique(rng.integers(0, 2**width, 400).astype(np.uint64) << np.uint64(20))
    table = simhash.distance_table(fps, simhash.pivots(6))
    edges = list(simhash.link_run(fps, table, distance, 0))
    want = brute.components(list(range(len(fps))), fps.tolist(), distance)
    assert len(edges) == len(fps) - len(set(want))  # a spanning forest
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert (a ^ b).bit_count() <= distance
        root[find(a)] = find(b)
    assert len({find(int(x)) for x in fps}) == len(set(want))


def test_keep_one(spark):
    kept = simhash.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    groups = {r["component_id"] for r in simhash.near_duplicates(edge(spark)).collect()}
    rows = kept.collect()
    assert len(rows) == len(groups) and {r["doc_id"] for r in rows} == groups
    nulls = spark.createDataFrame([(None, "a b c d e", None, None, None)] * 3 + [(None, "f g h i j", None, None, None)], SCHEMA)
    assert sorted(r["text"] for r in simhash.keep_one(nulls).collect()) == ["a b c d e", "f g h i j"]
    assert simhash.keep_one(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0


# --- toxicity


def test_counterfactual_term_lowers_false_positives():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    text = lambda *extra: " ".join([*rng.choices(words, k=12), *extra])
    # Toxic texts name one group far more often than clean ones do.
    bad = [text(rng.choice(["scum", "vermin"]), "muslim" if k % 10 else "") for k in range(120)]
    good = [text("muslim" if k % 12 == 0 else "") for k in range(360)]
    neutral = [text("muslim") for _ in range(60)]
    fit = lambda weight: toxicity.fit(bad + good, [1] * 120 + [0] * 360, counterfactual=weight)
    plain, regular = fit(0.0), fit(10.0)
    score = lambda m: np.mean([m.score_text(t) for t in neutral])
    assert score(regular) < score(plain) / 2
    assert abs(regular.score_text("a muslim") - regular.score_text(toxicity.swap_identity("a muslim"))) < 0.05
    assert min(regular.score_text(text("scum")) for _ in range(20)) > 0.5


def test_terms_are_induced_from_the_labels():
    """A name in any language that both classes mention is found without a list, and its swap hardly moves the score."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    names = ["ñandes", "éluards", "zoltans", "quechs"]
    text = lambda *extra: " ".join([*rng.choices(words, k=8), *extra])
    bad = [text(rng.choice(["scum", "vermin"]), names[0] if k % 3 else names[k % 4]) for k in range(150)]
    good = [text(names[k % 4] if k % 2 else names[0]) for k in range(450)]
    y = np.array([1] * 150 + [0] * 450)
    groups = toxicity.induced_terms(bad + good, y, ratio=2.0)
    assert {t for g in groups for t in g} >= set(names[:1])
    fit = lambda **p: toxicity.fit(bad + good, y.tolist(), groups=(), **p)
    on, off = fit(), fit(counterfactual=0.0)
    assert on.touched > 400 and on.change < off.change / 2 and min(on.score_text(text("scum")) for _ in range(20)) > 0.5


def test_toxicity_edges(spark):
    docs = edge(spark)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(1, None, 0), (5, 1, 1), (5, 1, 0), (None, 1, 1), (77, 0, 1), (6, 0, None), (7, 0, 2)], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs.withColumn("score", F.lit("clash")), toxicity.train(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(empty(spark), none).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op1_toxicity(spark, sf).join(queries.read(spark, sf, "labels"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85 and n.get((0, 1), 0) / n[0, 0] < 0.01


# --- mixing


def test_targets():
    got = mixing.targets([100, 100, 100, 0], [3, 1, 2, 3], 1.5, 2.0)
    assert got[0] == 200 and got[3] == 0 and sum(got) == pytest.approx(450) and got[2] == pytest.approx(2 * got[1])


def test_targets_of_a_table_equal_those_of_a_list(spark):
    rng = random.Random(2)
    sizes = [(f"s{k:02}", rng.choice([0, 1, 5, 400, 90_000])) for k in range(40)] + [(None, 77)]
    got = {r["source"]: r["target"] for r in mixing.shared_targets(spark.createDataFrame(sizes, "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()}
    want = mixing.targets([n for _, n in sizes], [float((3, 1, 2)[k % 3]) for k in range(41)], 1.5, 2.0)
    assert [got[s] for s, _ in sizes] == pytest.approx(want)


def best_sum(counts, budget):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * j for s in sums for j in range(n + 1)}
    return max(s for s in sums if s <= budget)


def test_fit_budget_reaches_the_best_sum():
    rng = random.Random(6)
    cases = [({500_000: 3, 400_000: 3}, 1_000_000), ({300_000: 1, 310_000: 1}, 305_000), ({7_000_001: 2, 3_000_017: 3, 5: 1}, 13_000_040)]
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        cases.append((counts, rng.randint(0, sum(k * n for k, n in counts.items()))))
    for counts, budget in cases:
        got = mixing.fit_budget(counts, budget)
        assert all(0 < n <= counts[k] for k, n in got.items())
        assert sum(k * n for k, n in got.items()) == best_sum(counts, budget), (counts, budget)


def test_fit_budget_beyond_its_reach(monkeypatch):
    """Large budgets are met by even shares and a program over what is left; with every size present the sum is met exactly."""
    rng = random.Random(8)
    counts = {k: rng.randint(1, 400) for k in range(1, 900)}
    budget = sum(k * n for k, n in counts.items()) * 3 // 7
    got = mixing.fit_budget(counts, budget)
    assert sum(k * n for k, n in got.items()) == budget > mixing.REACH
    assert all(abs(got.get(k, 0) / n - 3 / 7) < 0.2 for k, n in counts.items() if n > 200)
    monkeypatch.setattr(mixing, "REACH", 100)
    monkeypatch.setattr(mixing, "SUMS", 64)
    for _ in range(50):
        counts = {rng.randint(50, 4000): rng.randint(1, 3) for _ in range(12)}
        budget = rng.randint(1, sum(k * n for k, n in counts.items()))
        got = mixing.fit_budget(counts, budget)
        reached = sum(k * n for k, n in got.items())
        assert all(n <= counts[k] for k, n in got.items()) and reached <= budget and budget - reached <= max(counts)


def test_hot_size_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 8)
    df = spark.range(3000).selectExpr("if(id % 7 = 0, null, id) AS doc_id", "concat('w', id) AS text", "'en' AS lang", "if(id < 2000, 's', 't') AS source", "4L AS n_chars")
    rows = mixing.mix(df).collect()
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["copies"]
    assert len(rows) == 3000 and {s: taken[s] for s in "st"} == {r["source"]: round(r["target"]) for r in rows}


def test_mix(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    rows = mixing.mix(df).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(df.repartition(3)).collect()), key=str)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["source_size"] >= r["size"] and 0 <= r["copies"] <= 2
    assert all(abs(taken[s] - target[s]) <= 2 for s in size), (taken, target)
    assert Counter(r["doc_id"] for r in mixing.take(df).collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})


def test_mix_edges(spark):
    rows = mixing.mix(edge(spark)).collect()
    assert len(rows) == len(ODD) + 4
    taken = mixing.take(edge(spark))
    assert taken.columns == edge(spark).columns and taken.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.take(empty(spark)).count() == 0
    words = spark.createDataFrame([(1, None, None, "a", None), (2, "", None, None, 0)], SCHEMA)
    assert {r["size"] for r in mixing.mix(words).collect()} == {0}


# --- packing


def test_word_tokenizer_equals_the_library():
    coder = packing.WordTokenizer(queries.tokenizer_path())
    texts = ["a<|endoftext|>b It's don't ÀÉ é x\x85y ﬁ '' .'s foo.'s é,é İI Σς", "日本語 テスト。１２３ 12a3", "x​y ́a á.", "l'été, d'où? (ok)...", *[t for t in ODD if t], *[r[1] for r in corpus(60)]]
    for t, raw in zip(texts, coder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == coder.inner.encode(t, add_special_tokens=False).ids, t[:60]


def check_packed(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = 60
    lengths = [rng.randint(1, 60) for _ in range(300)]
    runs = packing.plan_runs(dict(Counter(lengths)), capacity)
    fill = {}
    for length, _, number, first, each, offset in runs:
        for k in range(number):
            fill.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert sorted(n for parts in fill.values() for _, n in parts) == sorted(lengths)
    gaps = []
    for n in sorted(lengths, reverse=True):  # one by one
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    assert len(fill) == len(gaps)
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def test_pack_documents(spark):
    df = edge(spark).select("doc_id", "text").unionByName(spark.createDataFrame(corpus(), SCHEMA).select("doc_id", "text"))
    path = queries.tokenizer_path()
    rows = packing.pack_documents(df, path, with_ids=True).collect()
    check_packed(rows, 2048)
    coder = packing.WordTokenizer(path)
    want = Counter()
    for r in df.collect():
        ids = coder.inner.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            raw = np.array(ids[k : k + 2048], dtype="<u4").tobytes()
            want[r["doc_id"], k // 2048, k, len(raw) // 4, zlib.crc32(raw), raw] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want
    assert packing.pack_documents(empty(spark), path).count() == 0


# --- token counts


def test_token_counts_match_plain_dynamic_programming(spark):
    path = queries.tokenizer_path(queries.PIECES)
    scores = token_counts.zipf_scores(token_counts.pieces_of(path))
    unknown = min(scores.values()) - 10.0

    def plain(word):
        text = token_counts.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode())
            options = [(best[end - 1][0] + unknown * size, -(best[end - 1][1] + size))]
            options += [(best[s][0] + scores[text[s:end]], -(best[s][1] + 1)) for s in range(end) if text[s:end] in scores]
            top = max(options)
            best.append((top[0], -top[1]))
        return best[-1][1]

    rows = [(k, t) for k, (_, t, *_) in enumerate(corpus(80))] + [(900, "naïve 日本語 x​y"), (901, None), (902, ""), (903, "hello hello hell")]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for k, t in rows:
        words = (t or "").split()
        assert got[k]["n_words"] == len(words) and got[k]["n_tokens"] == sum(map(plain, words)), t
    assert token_counts.count_tokens(edge(spark), path).count() == len(ODD) + 4
    assert token_counts.count_tokens(empty(spark), path).count() == 0


# --- TIFF


@pytest.mark.parametrize("compression", [media.NONE, media.PACKBITS, media.LZW, media.DEFLATE, media.OLD_DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("planar", [1, 2])
def test_tiff_round_trip(compression, order, tile, planar):
    rng = np.random.default_rng(8)
    pages = []
    for bits, samples, predictor in ((8, 1, 1), (8, 3, 2), (16, 2, 2), (32, 1, 2)):
        image = rng.integers(0, 2**bits, (37, 45, samples), dtype=np.uint64) // rng.choice([1, 2 ** (bits - 2)])
        pages.append(media.Page(45, 37, samples, bits, compression, predictor, image.astype(f"{order}u{bits // 8}").tobytes()))
    assert list(media.read_tiff(media.write_tiff(pages, order, 10, tile, planar))) == pages


@pytest.mark.parametrize("data", [b"", b"a", b"aaaaaaa", b"abababab" * 900, bytes(range(256)) * 40, b"\0" * 70_000, np.random.default_rng(1).bytes(30_000)])
def test_codecs(data):
    assert media.unpack_bits(media.pack_bits(data)) == data
    assert media.lzw_decode(media.lzw_encode(data)) == data


def test_tiff_damage(spark):
    good = media.write_tiff([media.Page(4, 2, 1, 8, media.DEFLATE, 2, bytes(range(8)))] * 2)
    circle = bytearray(good)
    circle[-4:] = good[4:8]
    cases = [good, None, b"", b"II*\0", b"GIF89a", good[:40], bytes(circle), good[:8] + b"\xff" * 40 + good[48:]]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in enumerate(cases)], "id int, media binary").withColumn("width", F.lit("clash"))
    rows = media.tiff_pages(df).collect()
    by = {k: [r for r in rows if r["id"] == k] for k in range(len(cases))}
    assert [r["page"] for r in by[0]] == [0, 1] and all(r["error"] is None and bytes(r["pixels"]) == bytes(range(8)) for r in by[0])
    assert all(by[k][-1]["error"] and by[k][-1]["pixels"] is None for k in (1, 2, 3, 4, 5, 6))
    assert len(by[6]) == 3
    assert media.tiff_pages(df.limit(0)).count() == 0


def test_tiff_query_reads_back_the_payload(spark, sf):
    rows = queries.op6_tiff(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.read(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    stored = media.features(media.tiff_pages(media.texts_to_tiff(edge(spark))))
    assert stored.count() == len(ODD) + 4 and stored.where("error IS NOT NULL OR feature IS NULL").count() == 0
    assert media.texts_to_tiff(empty(spark)).count() == 0
