r"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words (``[^\x20\x09-\x0D]+``). Sources, by code point and null last, get weights
from a repeating list and share a budget of ``budget`` times all sizes; no target exceeds ``cap`` times its source's size, and
what a source can't take is shared again by weight. A source first takes every document as often as fits its whole
target. For the rest, its documents are counted by exact size; each size gives its even share of documents, and a bounded
knapsack program (reachable sums as bits, counts in powers of two) fits the budget that remains: exactly where the budget lies within
its reach, and else to less than the smallest size that is left. The documents of a size are then chosen by a seeded hash.

Counts per source and size reach one task per source; they are counts, so a hot source costs its number of different
sizes. Within a source and size, counts per hash slice say which slices are taken whole; only the slice on the border is ranked, and the
number of slices follows the largest count, so a hot size is spread.

Nulls: a null text has size 0, a null source is a source of its own, null doc_ids stay. Documents of size 0 take 0.
Ties in the hash fall to doc_id; rows that are equal in all three can't be told apart. An empty table gives an empty table. Further
columns are not read by ``mix``; ``take`` keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import global_rank
from .common import written

#: Reach of the knapsack program, in words (or in their common divisor): up to this budget it holds all documents of a source.
REACH = 1 << 20
#: Sums that the program holds where a few very long documents need more than that.
SUMS = 1 << 14
#: Rows of one source and size that a hash slice holds, about; only the slice on the border of a share is ranked.
SLICE_ROWS = 1 << 15


def size_of(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+``."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Shares of ``budget`` x all sizes by weight, at most ``cap`` x its size each, the excess shared again."""
    total, fixed = budget * sum(sizes), [None] * len(sizes)
    while True:
        free = [k for k, x in enumerate(fixed) if x is None]
        left, weight = total - sum(x for x in fixed if x is not None), sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / weight > cap * sizes[k]]
        if not over:
            return [left * weights[k] / weight if x is None else x for k, x in enumerate(fixed)]
        for k in over:
            fixed[k] = cap * sizes[k]


def shared_targets(totals: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """``targets`` over a table of source and source_size: adds target. Only sums come to the driver, so there may be any number of sources.

    With a share of ``level`` for each unit of weight, sources over their cap are fixed; what they leave raises the level, until no further one is over."""
    order = [F.asc_nulls_last("source")]
    kind = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_k") - 1) % len(weights) + 1).cast("int"))
    table = written(global_rank(totals, order, "_k").select("source", "source_size", kind.alias("_w"), (F.col("source_size") * float(cap)).alias("_most")))
    all_sizes = table.agg(F.sum("source_size")).first()[0]
    total, level, fixed = budget * float(all_sizes or 0), 0.0, -1
    while True:
        over = F.col("_w") * F.lit(level) > F.col("_most")
        sums = table.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0.0)).alias("held"), F.sum(F.when(~over, F.col("_w"))).alias("weight")).first()
        if sums["n"] == fixed or not sums["weight"]:
            break
        fixed, level = sums["n"], (total - sums["held"]) / sums["weight"]
    return table.select("source", "source_size", F.least(F.col("_w") * F.lit(level), F.col("_most")).alias("target"))


def reach_dense(spare: dict[int, int], left: int) -> dict[int, int]:
    """The bounded knapsack program: of ``spare`` documents by size, those whose sizes sum to the greatest sum up to ``left``. Sums are bits, counts go in
    powers of two, and each sum keeps the step that reached it first, so memory is a few bytes for each unit of ``left``."""
    mask, sums = (1 << left + 1) - 1, 1
    first, parts = np.zeros(left + 1, np.int32), [(0, 0)]
    for k in sorted(spare):
        rest, part = min(spare[k], left // k), 1
        while rest > 0:
            n = min(part, rest)
            new = sums << k * n & mask & ~sums
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(parts)
                parts.append((k, n))
                sums |= new
            rest, part = rest - n, part * 2
        if sums >> left & 1:
            break
    out: dict[int, int] = {}
    at = sums.bit_length() - 1
    while at:
        k, n = parts[first[at]]
        out[k], at = out.get(k, 0) + n, at - k * n
    return out


def reach_sparse(spare: dict[int, int], left: int) -> dict[int, int]:
    """The same for a ``left`` of any size, over the sums themselves: exact up to ``SUMS`` of them; beyond, sums that lie within one ``SUMS``-th of
    ``left`` of each other are kept once, the greatest, so that each part of a size can lose that much at most."""
    sums, came = {0}, {0: (0, 0)}
    for k in sorted(spare, reverse=True):
        rest, part = min(spare[k], left // k), 1
        while rest > 0:
            n = min(part, rest)
            new = {s + k * n for s in sums if s + k * n <= left} - came.keys()
            came.update((s, (k, n)) for s in new)
            sums |= new
            if len(sums) > SUMS:
                width = left // SUMS + 1
                sums = {0, *({s // width: s for s in sorted(sums)}.values())}
            rest, part = rest - n, part * 2
        if left in came:
            break
    out: dict[int, int] = {}
    at = max(came)
    while at:
        k, n = came[at]
        out[k], at = out.get(k, 0) + n, at - k * n
    return out


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each size to take so that the sizes sum as near to the budget as can be, and not beyond it.

    Every size first gives its even share. The program then chooses among the documents that are left and some that the share gives back, small
    sizes first, ever more of them until the budget is met. A budget of up to ``REACH`` (in units of the sizes' common divisor) ends with all
    documents in the program, so the sum is the best there is. Beyond, what can be missed is less than the smallest size still left."""
    total = sum(k * n for k, n in counts.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(counts)
    unit = math.gcd(*counts)
    every, whole = {k // unit: n for k, n in counts.items()}, budget // unit
    best: dict[int, int] = {}
    got, back, most = -1, 2, max(every)
    while True:
        out = {k: n * budget // total for k, n in every.items()}
        left = whole - sum(k * n for k, n in out.items())
        for k in sorted(every, reverse=True):  # what rounding down left goes to one more of the large sizes each
            if left > 2 * most and out[k] < every[k]:
                out[k], left = out[k] + 1, left - k
        window, given = min(REACH, left + back * most), False
        for k in sorted(every):
            some = min(out[k], back, max(0, window - left) // k)
            given |= some < out[k] and left + k <= REACH
            out[k], left = out[k] - some, left + some * k
        spare = {k: min(n - out[k], 2 * back) for k, n in every.items() if n > out[k]}
        more = reach_dense(spare, left) if left <= REACH else reach_sparse(spare, left)
        now = {k: n + more.get(k, 0) for k, n in out.items()}
        if (total_now := sum(k * n for k, n in now.items())) > got:
            got, best = total_now, now
        if got == whole or not given and 2 * back >= max(every.values()):
            break
        back *= 8
    if got < whole:
        more = reach_dense(every, whole) if whole <= REACH else reach_sparse(every, whole)
        if sum(k * n for k, n in more.items()) > got:
            best = more
    return {k * unit: n for k, n in best.items() if n}


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source, source_size, target, copies for each row of ``docs``. copies: how often the mix takes it."""
    keyed = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")), F.lit(seed))
    rows = written(docs.select(F.col("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), keyed.alias("_h"), F.xxhash64("text").alias("_t")))
    return _mixed(rows, weights, budget, cap)


def _mixed(rows: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    by_size = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = shared_targets(totals, weights, budget, cap)

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        counts = {int(k): int(n) for k, n in zip(part["size"], part["n"]) if k > 0}
        whole, want = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        base = min(math.floor(want / whole), int(cap)) if whole else 0
        more = fit_budget(counts, round(want) - base * whole) if whole and base < cap else {}
        out = part[["source", "size"]].copy()
        out["base"] = base
        out["more"] = [more.get(int(k), 0) for k in part["size"]]
        return out

    counted = by_size.alias("b").join(sources.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "t.source_size", "t.target")
    plan = written(counted.groupBy("source").applyInPandas(fitted, "source string, size long, base long, more long"))

    most = by_size.agg(F.max("n")).first()[0] or 0
    bits = max(4, (most // SLICE_ROWS).bit_length())
    sliced = rows.withColumn("_slice", F.shiftrightunsigned("_h", 64 - bits).cast("long"))
    slices = sliced.groupBy("source", "size", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    p, s = plan.alias("p"), slices.withColumn("_before", F.coalesce(before, F.lit(0))).alias("s")
    offsets = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size"))).select("s.source", "s.size", "s._slice", "s._n", "s._before", "p.base", "p.more")
    # A slice lies within the share, beyond it, or on its border; only rows of border slices are ranked.
    rest = F.col("more") - F.col("_before")
    offsets = offsets.withColumn("_one", F.when(rest >= F.col("_n"), 1).when(rest <= 0, 0))
    t = written(offsets.join(sources.alias("t"), offsets["source"].eqNullSafe(F.col("t.source"))).select(offsets["*"], "t.source_size", "t.target")).alias("o")
    r = sliced.alias("r")
    joined = r.join(t, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.size") == F.col("o.size")) & (F.col("r._slice") == F.col("o._slice")))
    joined = joined.select("r.*", "o._before", "o.base", "o.more", "o._one", "o.source_size", "o.target")
    names = ["doc_id", "source", "size", "source_size", "target", "copies", "_t"]
    clear = joined.where("_one IS NOT NULL").withColumn("copies", (F.col("base") + F.col("_one")).cast("int")).select(*names)
    rank = F.row_number().over(Window.partitionBy("source", "size", "_slice").orderBy("_h", "doc_id", "_t"))
    border = joined.where("_one IS NULL").withColumn("copies", (F.col("base") + F.when(F.col("_before") + rank <= F.col("more"), 1).otherwise(0)).cast("int"))
    return clear.unionByName(border.select(*names))


def take(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns."""
    copies = mix(docs, **params).where("copies > 0").groupBy("doc_id", "source", "_t").agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")).alias("c")
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")
    d = docs.select(F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("_t"), whole).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d._t") == F.col("c._t"))
    found = d.join(copies, same).select("d.*", "c.all", "c.rows")
    # Rows equal in all that chooses them share what they take, the first ones the remainder. Only those with a remainder are numbered.
    even = found.where("all % rows = 0").withColumn("n", F.expr("cast(all div rows as int)"))
    number = F.row_number().over(Window.partitionBy("doc_id", "source", "_t").orderBy("_t"))
    odd = found.where("all % rows > 0").withColumn("k", number)
    odd = odd.withColumn("n", F.expr("cast(all div rows as int) + CASE WHEN k <= all % rows THEN 1 ELSE 0 END")).where("n > 0")
    both = even.unionByName(odd.drop("k"))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select(*[F.col(f"row.`{n}`").alias(n) for n in docs.columns])
