"""Signals as arrays: cross-correlation search, long segment splitting, slices with statistics, phrase alignment.

Each works on one row or one key's rows at a time, so keys are worked on side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- normalised cross-correlation -----------------------------------------------------------------------------------------


def correlation(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Zero-mean normalised cross-correlation of the short signal with each window of the long one, within [-1, 1]; 0 for constant windows."""
    n, m = len(long), len(short)
    if m == 0 or n < m:
        return np.zeros(0)
    x, y = np.asarray(long, float), np.asarray(short, float)
    y = y - y.mean()
    size = 1 << (n + m - 1).bit_length()
    dots = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(y[::-1], size), size)[m - 1 : n]
    s1, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    spread = s2[m:] - s2[:-m] - (s1[m:] - s1[:-m]) ** 2 / m
    scale = np.sqrt(np.maximum(spread, 0) * (y @ y))
    return np.where(scale > 1e-12, np.clip(dots / np.where(scale > 1e-12, scale, 1), -1, 1), 0.0)


def best_offset(long: np.ndarray, short: np.ndarray, least: float = 0.8, tie: float = 1e-9) -> tuple[int, float] | None:
    """The earliest offset whose score is within ``tie`` of the best, if the best is high enough."""
    c = correlation(long, short)
    if not len(c) or c.max() < least:
        return None
    at = int(np.flatnonzero(c >= c.max() - tie)[0])
    return at, float(c[at])


def all_offsets(long: np.ndarray, short: np.ndarray, least: float = 0.8, distance: int | None = None) -> list[tuple[int, float]]:
    """Offsets by score, each suppressing others nearer than ``distance`` (the short length less 50 if not given); in order of place."""
    c = correlation(long, short)
    distance = max(1, len(short) - 50) if distance is None else distance
    free, out = np.ones(len(c), bool), []
    for at in sorted(np.flatnonzero(c >= least).tolist(), key=lambda k: (-c[k], k)):
        if free[at]:
            out.append((at, float(c[at])))
            free[max(0, at - distance + 1) : at + distance] = False
    return sorted(out)


def partial_matches(long: np.ndarray, short: np.ndarray, least: float = 0.75, low: float = 0.5, step: float = 0.1, clips: int = 60, whole: float = 0.92) -> list[dict]:
    """A match of the whole short signal with a score of at least ``whole`` ends the search; else parts of it, from full length down to
    ``low``, by start, longer and higher ones first, without overlap in the long signal."""
    found = best_offset(long, short, whole)
    if found:
        return [{"a_start": found[0], "b_start": 0, "length": len(short), "score": found[1]}]
    m, tried, options = len(short), 0, []
    for share in np.arange(1.0, low - 1e-9, -step):
        size = max(2, int(m * share))
        for start in range(0, m - size + 1, max(1, size // 4)):
            if tried >= clips:
                break
            tried += 1
            options += [{"a_start": a, "b_start": start, "length": size, "score": s} for a, s in all_offsets(long, short[start : start + size], least)]
    out: list[dict] = []
    for o in sorted(options, key=lambda o: (o["a_start"], -o["length"], -o["score"])):
        if not out or o["a_start"] >= out[-1]["a_start"] + out[-1]["length"]:
            out.append(o)
    return out


MATCHES = "array<struct<a_start:int,b_start:int,length:int,score:double>>"


def find_offsets(pairs: DataFrame, long: str, short: str, mode: str = "all", least: float = 0.8, name: str = "matches") -> DataFrame:
    """pairs with the matches of two array columns. mode: best, all or partial."""

    @F.pandas_udf(MATCHES)
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            out = []
            for x, y in zip(a, b):
                if x is None or y is None:
                    out.append([])
                elif mode == "partial":
                    out.append(partial_matches(np.asarray(x, float), np.asarray(y, float), least))
                else:
                    found = [best_offset(x, y, least)] if mode == "best" else all_offsets(np.asarray(x, float), np.asarray(y, float), least)
                    out.append([{"a_start": f[0], "b_start": 0, "length": len(y), "score": f[1]} for f in found if f])
            yield pd.Series(out)

    return pairs.withColumn(name, apply(F.col(long), F.col(short)))


# --- segments -------------------------------------------------------------------------------------------------------------


def split_long(segments: DataFrame, frames: DataFrame, key: list[str], most: int, score: str = "prob") -> DataFrame:
    """Segments longer than ``most`` frames are cut at the least probable frame of their middle half, again and again.

    Joined with their frames by key and range, then cut per segment: a task holds one segment's probabilities."""
    f = frames.select(*key, F.col("frame_idx").alias("_i"), F.col(score).alias("_p"))
    inside = segments.select(*key, "frame_start", "frame_end").join(f, key).where("_i BETWEEN frame_start AND frame_end")
    packed = inside.groupBy(*key, "frame_start", "frame_end").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda x: x["_p"]).alias("probs"))

    def cut(start: int, end: int, probs: np.ndarray) -> list[tuple[int, int]]:
        n = end - start + 1
        if n <= most or n < 4:
            return [(start, end)]
        low, high = n // 4, n - n // 4
        at = low + int(np.argmin(probs[low:high]))
        return [*cut(start, start + at - 1, probs[:at]), *cut(start + at, end, probs[at:])]

    @F.pandas_udf("array<struct<frame_start:int,frame_end:int>>")
    def apply(start: pd.Series, end: pd.Series, probs: pd.Series) -> pd.Series:
        return pd.Series([[{"frame_start": a, "frame_end": b} for a, b in cut(int(s), int(e), np.asarray(p, float))] for s, e, p in zip(start, end, probs)])

    return packed.select(*key, F.inline(apply("frame_start", "frame_end", "probs")))


def slice_stats(segments: DataFrame, frames: DataFrame, key: list[str], score: str = "prob", energy: str = "rms") -> DataFrame:
    """Segments with the statistics of their frames."""
    f = frames.select(*key, F.col("frame_idx").alias("_i"), F.col(score).alias("_p"), F.col(energy).alias("_e"))
    inside = segments.join(f, key).where("_i BETWEEN frame_start AND frame_end")
    return inside.groupBy(*key, "frame_start", "frame_end").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("_p").alias("mean"), F.min("_p").alias("min"), F.max("_p").alias("max"), F.stddev_pop("_p").alias("std"), F.median("_p").alias("median"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rms"),
    )


def align_phrases(phrases: DataFrame, words: DataFrame, key: list[str], order: str, text: str = "phrase", word: str = "word") -> DataFrame:
    """Each phrase takes the next words until their letters reach its length; letters beyond are trimmed from its last word, and
    words once taken are not given back. Per key: phrase index, its words, start and end."""
    both = phrases.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p")).join(
        words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, word, "start", "end"))).alias("w")), key, "left"
    )

    @F.pandas_udf("array<struct<index:int,phrase:string,words:array<string>,start:double,end:double>>")
    def apply(ps: pd.Series, ws: pd.Series) -> pd.Series:
        out = []
        for p, w in zip(ps, ws):
            rest, rows = list(w if w is not None else []), []
            for k, one in enumerate(p):
                need, taken = len(one[text] or ""), []
                while rest and need > 0:
                    nxt = rest.pop(0)
                    taken.append((nxt[word][:need], nxt["start"], nxt["end"]))
                    need -= len(nxt[word])
                rows.append({"index": k, "phrase": one[text], "words": [t[0] for t in taken], "start": taken[0][1] if taken else None, "end": taken[-1][2] if taken else None})
            out.append(rows)
        return pd.Series(out)

    return both.select(*key, F.inline(apply("p", "w")))
