"""Toxicity by a counterfactually regularised linear classifier.

A document is the set of its lower-cased words and their leading letters. A logistic model over those features that the
labels tell apart is fitted so that it (1) follows the labels and (2) scores a text and its counterfactual alike, in
which every identity term is swapped for another of its group. The second term takes weight from neutral mentions of
groups that toxic texts happen to name more often.

Identity terms are a list of group names, and terms induced from the labelled texts, in whatever language they are: words that at least ``share``
of both classes hold, neither class more than ``ratio`` times as often, are names and topics that both kinds of text
mention; those of like frequency form groups to swap within.

The model is fitted on the driver over at most ``positives`` and ``negatives`` labelled documents (documented bound; a
seeded hash of doc_id chooses them), every document is scored. The executors reduce those texts to their different words, so what
reaches the driver does not grow with the length of a text.

Nulls: null and empty texts get the score of a text without features; rows with a null doc_id are scored too. Labels
that are null or not 0 or 1 are not used, nor are those of unknown documents; a doc_id with several labels counts as toxic if one of them
says so, and if it has several texts the least counts. Without labels of both classes the model gives every text the score 0. Repeated rows get equal scores, as the score
depends on the text alone. Further columns of the input pass through ``score`` untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
LEADING = (4, 5, 6)

#: Identity terms by group; a term is swapped for the next one of its group.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "people"),
    ("woman", "man", "person"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)


def features(text: str | None) -> set[str]:
    """Words, and with a leading mark their first 4, 5 and 6 letters."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for n in LEADING:
        out.update(["^" + w[:n] for w in words if len(w) >= n])
    return out


def swap_identity(text: str | None, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> str:
    """The text's counterfactual."""
    other = {t: g[(k + 1) % len(g)] for g in groups for k, t in enumerate(g)}
    return WORD.sub(lambda m: other.get(m[0].lower(), m[0]), text or "")


@dataclass
class ToxicityModel:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)
    #: Of the fit: labelled texts that hold an identity term, and the mean absolute change of their scores under the swap.
    touched: int = 0
    change: float = 0.0

    def score_text(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        get, total = self.weights.get, self.bias
        words = set(WORD.findall((text or "").lower()))
        for w in words:
            total += get(w, 0.0)
        for n in LEADING:
            for p in {w[:n] for w in words if len(w) >= n}:
                total += get("^" + p, 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))


def select_features(texts: list[str | None], y: np.ndarray, limit: int, always: set[str]) -> list[str]:
    """Those seen in toxic texts that tell the classes apart most, by the likelihood ratio, and all of ``always`` that occur.
    One text's features are held at a time; of clean texts only features that toxic ones have are counted."""
    one: Counter[str] = Counter()
    for t, toxic in zip(texts, y):
        if toxic:
            one.update(features(t))
    one = Counter({f: n for f, n in one.items() if n >= 2 or f in always})
    zero: Counter[str] = Counter()
    for t, toxic in zip(texts, y):
        if not toxic:
            zero.update([f for f in features(t) if f in one or f in always])
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    scored = []
    for f in {*one, *zero}:
        a, b = one[f], zero[f]
        p, q, m = a / n1, b / n0, (a + b) / (n1 + n0)
        if f in always:
            scored.append((np.inf, f))
        elif p > q and a + b >= 3:
            terms = ((a, p, m), (n1 - a, 1 - p, 1 - m), (b, q, m), (n0 - b, 1 - q, 1 - m))
            scored.append((sum(k * np.log(u / v) for k, u, v in terms if k > 0), f))
    scored = [x for x in scored if x[0] > 4.0]
    return [f for _, f in sorted(scored, key=lambda x: (-x[0], x[1]))[:limit]]


def induced_terms(texts: list[str | None], y: np.ndarray, share: float = 0.02, ratio: float = 1.5, size: int = 4, most: int = 400) -> tuple[tuple[str, ...], ...]:
    """Groups of words that toxic and clean texts hold about as often. Digits are no names."""
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for t, toxic in zip(texts, y):
        seen[int(toxic)].update(set(WORD.findall((t or "").lower())))
    n0, n1 = max(1, int((1 - y).sum())), max(1, int(y.sum()))
    shares = {w: (seen[0][w] / n0, n / n1) for w, n in seen[1].items() if len(w) >= 3 and w.isalpha()}
    even = [w for w, (p, q) in shares.items() if min(p, q) >= share and max(p, q) <= ratio * min(p, q)]
    even = sorted(even, key=lambda w: (-sum(shares[w]), w))[:most]
    return tuple(tuple(even[k : k + size]) for k in range(0, len(even) - 1, size))


def fit(texts: list[str | None], toxic: list[int], groups=IDENTITY_TERMS, induce: bool = True, counterfactual: float = 10.0, ridge: float = 1e-4, swaps: int = 1500, limit: int = 6000, rounds: int = 300) -> ToxicityModel:
    """Fit on labelled texts. counterfactual: weight of the mean squared change of the logit under the swap of identity terms,
    over at most ``swaps`` of the texts that hold one."""
    y = np.asarray(toxic, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    if induce:
        named = {t for g in groups for t in g}
        groups = (*groups, *(g for g in (tuple(t for t in some if t not in named) for some in induced_terms(texts, y)) if len(g) > 1))
    terms = {t for g in groups for t in g}
    always = terms | {"^" + t[:n] for t in terms for n in LEADING if len(t) >= n}
    names = select_features(texts, y, limit, always)
    at = {f: k for k, f in enumerate(names)}

    def matrix(rows) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(sorted(at[f] for f in features(t) if f in at), dtype=np.int32) for t in rows]
        return np.repeat(np.arange(len(found)), [len(x) for x in found]), np.concatenate([*found, np.empty(0, np.int32)])

    r, c = matrix(texts)
    touched = [i for i, t in enumerate(texts) if not terms.isdisjoint(WORD.findall((t or "").lower()))]
    touched = touched[:: max(1, -(-len(touched) // swaps))]  # evenly spread
    swapped = matrix(swap_identity(texts[i], groups) for i in touched)
    own = matrix(texts[i] for i in touched)
    w, b, n = np.zeros(len(names)), float(np.log(y.mean() / (1 - y.mean()))), len(y)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(r, w[c], n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad, gb = np.bincount(c, g[r], len(w)) + ridge * w, g.sum()
        if touched:
            change = np.bincount(own[0], w[own[1]], len(touched)) - np.bincount(swapped[0], w[swapped[1]], len(touched))
            change *= 2 * counterfactual / len(touched)
            grad += np.bincount(own[1], change[own[0]], len(w)) - np.bincount(swapped[1], change[swapped[0]], len(w))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        u, d = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m / u) / (np.sqrt(v / d) + 1e-8)
        b -= 0.1 * (mb / u) / (np.sqrt(vb / d) + 1e-8)
    model = ToxicityModel(float(b), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-4}, len(touched))
    if touched:
        scores = (1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], len(touched)), -30, 30))) for rows, cols in (own, swapped))
        model.change = float(np.abs(next(scores) - next(scores)).mean())
    return model


def train(docs: DataFrame, labels: DataFrame, positives: int = 2500, negatives: int = 5000, seed: int = 11, **params) -> ToxicityModel:
    """Fit on a bounded sample of the labelled documents. labels: doc_id, toxic."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    part = lambda t, n: known.where(F.col("toxic") == t).orderBy("_h", "doc_id").limit(n)
    sample = part(1, positives).unionByName(part(0, negatives)).select("doc_id", "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most positives + negatives doc_ids

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [" ".join(sorted(set(WORD.findall((x.as_py() or "").lower())))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), batch.column(2)], names=["doc_id", "words", "toxic"])

    schema = rows.selectExpr("doc_id", "text AS words", "toxic").schema
    found = rows.mapInArrow(words, schema).groupBy("doc_id").agg(F.min("words").alias("words"), F.max("toxic").alias("toxic")).orderBy("doc_id").toArrow().to_pylist()
    return fit([r["words"] for r in found], [r["toxic"] for r in found], **params)


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """docs with the model's score of each text; a column of that name is replaced."""
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # its features are limited
    docs = docs.drop(name)
    schema = docs.withColumn(name, F.lit(0.0)).schema
    names, at = docs.columns, docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ToxicityModel(*held.value).score_text
        for batch in batches:
            made = pa.array([of(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*names, name])

    return docs.mapInArrow(work, schema)
