"""Approximate nearest neighbours by an inverted multi-index.

The halves of the normalised vectors are quantised separately; a vector's cell is its pair of centroids. A query walks the
pairs in the order of their summed squared distance with a heap until the cells seen hold ``share`` of all vectors (or
``least`` of them, whichever is more), and its candidates are ranked again by the exact cosine of the original vectors.

Centroids are fitted on a bounded sample (``sample`` vectors by seeded hash, a documented parameter); every vector is indexed. Only
cell counts (at most ``centroids`` squared) and centroids are broadcast. Vectors of a first-half centroid are cut
into blocks of about ``part`` by hash, so a hot cell is spread. Vectors are shuffled once and never copied: a query goes to the blocks whose cells it walks, a
task holds one block at a time and streams its queries past it, a few at a time, and each block answers with at most ``k``
rows per query. No pair of query and vector becomes a row.

``share`` sets recall against work. Where neighbours cluster, few cells hold them; vectors without structure need many.

Nulls: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor
do rows with a null id. Ties in the score go to the smaller id. Rows that repeat an id count once in a result, with the best of their scores,
and never for themselves; a repeated query is answered once. Fewer vectors than ``k`` give what there is; an empty table gives an
empty table. Further columns of the input are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        n = np.bincount(of, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :])


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(points, centres).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells (first x number of second + second) in the order of summed distance until they hold ``wanted`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db = first[a].tolist(), second[b].tolist()
    heap, reached, out, held = [(da[0] + db[0], 0, 0)], {0: 0}, [], 0
    width = len(db)
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * width + int(b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if j + 1 < width:
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
    return out


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col(f"`{column}`").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    kept = kept.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0.0))
    sizes = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding",
    centroids: int = 128, sample: int = 16_384, share: float = 0.35, least: int = 2_000, part: int = 16_384,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. is_query: a condition on ``id``."""
    result = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column)
    fitted = [r["v"] for r in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h", "v").limit(sample).collect()]
    if not fitted:
        return spark.createDataFrame([], result)
    points = np.array(fitted)
    points /= np.linalg.norm(points, axis=1)[:, None]
    half = points.shape[1] // 2 or points.shape[1]
    one, two = kmeans(points[:, :half], centroids), kmeans(points[:, half:], centroids) if half < points.shape[1] else np.zeros((1, 0))
    del points, fitted
    width = len(two)
    tables = spark.sparkContext.broadcast((one, two))

    def halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        v = column.flatten().to_numpy().reshape(len(column), -1)
        unit = v / np.sqrt((v**2).sum(1))[:, None]
        return v, unit

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tables.value
        for batch in batches:
            v, unit = halves(batch.column(1))
            cell = nearest(unit[:, :half], one) * len(two) + nearest(unit[:, half:], two)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(cell.astype(np.int32))], names=["id", "raw", "cell"])

    indexed = written(rows.mapInArrow(quantise, "id long, raw binary, cell int"))
    counted = indexed.groupBy("cell").count().collect()  # at most centroids squared
    counts = np.zeros(len(one) * width, np.int64)
    for r in counted:
        counts[r["cell"]] = r["count"]
    total = int(counts.sum())
    wanted = max(least, int(share * total))
    by_first = counts.reshape(len(one), width).sum(1)
    parts = np.maximum(1, -(-by_first // part))
    held = spark.sparkContext.broadcast((counts, parts))
    asked = rows.where(is_query).dropDuplicates(["id"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = tables.value
        counts, parts = held.value
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                some = batch.slice(low, 128)
                v, unit = halves(some.column(1))
                d1, d2 = distances(unit[:, :half], one), distances(unit[:, half:], two)
                out: list[tuple] = []
                for n, (id_, raw) in enumerate(zip(some.column(0).to_pylist(), v)):
                    cells = np.array(walk(d1[n], d2[n], counts, wanted), dtype=np.int32)
                    data, which = raw.tobytes(), cells // len(two)
                    for i in np.unique(which).tolist():
                        mine = cells[which == i].tobytes()
                        out += [(i * 1_000_003 + p, 1, id_, data, None, mine) for p in range(int(parts[i]))]
                        if len(out) >= 20_000:  # a query may visit many blocks
                            yield rows_of(out)
                            out = []
                if out:
                    yield rows_of(out)

    kinds = {"block": pa.int64(), "asks": pa.int32(), "id": pa.int64(), "raw": pa.binary(), "cell": pa.int32(), "cells": pa.binary()}

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))

    questions = asked.mapInArrow(visit, "block long, asks int, id long, raw binary, cell int, cells binary")
    cuts = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), (F.col("cell") / width).cast("int") + 1)
    block = (F.col("cell") / width).cast("int").cast("long") * 1_000_003 + F.pmod(F.xxhash64("id"), cuts)
    stored = indexed.select(block.alias("block"), F.lit(0).alias("asks"), "id", "raw", "cell", F.lit(None).cast("binary").alias("cells"))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)

    def held_block(stored: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        """ids, vectors and norms by cell and id, the cells, and where each begins and ends."""
        data = pa.Table.from_batches(stored).combine_chunks()
        ids, cell, v = data.column("id").to_numpy(), data.column("cell").to_numpy(), matrix(data.column("raw"))
        order = np.lexsort((ids, cell))
        at, first, n = np.unique(cell[order], return_index=True, return_counts=True)
        return ids[order], v[order], np.sqrt((v[order] ** 2).sum(1)), at, first, first + n

    def ranked(index: tuple[np.ndarray, ...], asked: pa.RecordBatch) -> pa.RecordBatch:
        ids, v, v_norm, at, first, last = index
        q, q_ids = matrix(asked.column("raw")), asked.column("id").to_numpy()
        q_norm = np.sqrt((q**2).sum(1))
        cells = [np.frombuffer(c, np.int32) for c in asked.column("cells").to_pylist()]
        who, which = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells)
        order = np.argsort(which, kind="stable")
        who, which = who[order], which[order]
        low, high = np.searchsorted(which, at), np.searchsorted(which, at, side="right")
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for c in np.flatnonzero(high > low).tolist():
            sel, a, b = who[low[c] : high[c]], first[c], last[c]
            s = np.einsum("id,jd->ij", q[sel], v[a:b]) / (q_norm[sel][:, None] * v_norm[a:b][None, :])
            s[q_ids[sel][:, None] == ids[a:b][None, :]] = -np.inf
            # All up to the first k different ids: repeated rows of an id lie side by side, as ids are sorted.
            twin = np.zeros(b - a, bool)
            twin[1:] = ids[a + 1 : b] == ids[a : b - 1]
            own = ids[a:b]
            if twin.any():
                starts = np.flatnonzero(~twin)
                s, own = np.maximum.reduceat(s, starts, axis=1), own[starts]
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(sel, top.shape[1]), own[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        row, near, score = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        order = np.lexsort((near, -score, row))
        order = order[score[order] > -np.inf]
        row, near, score = row[order], near[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k  # an id lies in one cell only, unless its rows differ; the rest of its rows are dropped by Spark
        pairs = np.lexsort((near, row))
        if ((np.diff(row[pairs]) == 0) & (np.diff(near[pairs]) == 0)).any():
            keep[:] = True
        return pa.RecordBatch.from_arrays([pa.array(q_ids[row[keep]]), pa.array(near[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, index = None, [], None
        for batch in batches:
            block, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy()
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
                if low == high:
                    continue
                if block[low] != now:
                    now, stored, index = block[low], [], None
                some = batch.slice(low, high - low)
                if not asks[low]:
                    stored.append(some)
                    continue
                if index is None:
                    if not stored:
                        continue
                    index, stored = held_block(stored), []
                for at in range(0, some.num_rows, 256):
                    yield ranked(index, some.slice(at, 256))

    met = stored.unionByName(questions).repartition("block").sortWithinPartitions("block", "asks")
    near = met.mapInArrow(answer, "query_id long, vec_id long, score double")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(f"rank <= {int(k)}").select("query_id", "rank", "vec_id", "score")
