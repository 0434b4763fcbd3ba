"""Cases that a review found missing."""

import random

import brute
import numpy as np

import corpus_pipeline
from quillstream.llm import pii, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_ip_parts_of_zeros(spark):
    rng = random.Random(3)
    texts = ["10.0.0.1", "0.0.0.0", "000.1.2.3 and 127.0.0.1, 192.168.0.1; 1.2.3.0", "00256.0.0.1 0.0.0.256 1.2.3.000255", "0" * 4000 + ".0.0.1"]
    texts += ["".join(rng.choices("0012.. ", k=rng.randint(7, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] != "cue"] for r in pii.find_pii(df).collect()}
    for k, t in enumerate(texts):
        assert got[k] == [(a, kind, b) for a, _, kind, b in brute.pii_spans(t)], t[:80]
    assert pii.redact(df).where("doc_id < 2").select("text").distinct().first()["text"] == "[ip]"


def shingle_set(text):
    w = text.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_at_similarity_of_four_fifths(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    texts = ["", " \t", "a b", "A  b", "a b c"]
    for _ in range(40):
        base = rng.choices(words, k=rng.choice([30, 120, 300]))
        texts.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(1, 4) * len(w) // 100 + 1):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    odd = spark.createDataFrame([(None, "a b", None, None, None)] * 2 + [(7, None, None, None, None), (7, "", None, None, 0)], SCHEMA)
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()))) == ["7", "None"]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_search_in_a_run_equals_brute_force():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[rng.permutation(60)[: rng.integers(50, 60)]], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(8)]
    root = {k: k for k in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in similar.link_sets(list(range(len(sets))), list(range(len(sets))), sets, [similar.wide_fingerprint(x) for x in sets], 0.8):
        assert jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8
        root[find(a)] = find(b)
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8:
                assert find(i) == find(j)
