"""SimHash near-duplicates by pivot distance tables.

A fingerprint bit is set if it is set in over half the hashes of a text's word shingles. Equal fingerprints are folded
into one row first, so copies cost nothing further. Pairs of different fingerprints that share the bits of enough blocks
meet in one run (with B blocks and at most D differing bits, B - D blocks agree). In a run, a table of Hamming distances
to reference fingerprints, computed once, discards every pair whose largest coordinate difference exceeds D, as by the triangle
inequality no such pair can be close; the survivors are verified on the fingerprints. Runs yield a spanning forest
rather than all close pairs, and the forests are joined to components.

Nulls: a null text counts as empty; a text without words has fingerprint zero, linked like any other. Null doc_ids get a
fingerprint and the least non-null doc_id of their component (null if it has none). Repeated rows stay repeated. An empty
table gives an empty table. Further columns of the input are not read. No run, pair or partner is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import ASCII_LOWER, documents_of, free, written
from .components import connected_components

#: Runs longer than this are cut by further bits before pairs are looked at.
LONG_RUN = 2048
#: Members of a long run that are compared with all others before it is cut.
SWEEPS = 16


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of one text, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8")
    total = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65_536):  # bounds memory for very long texts
        total += np.unpackbits(hashes[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return documents_of(docs, "doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def pivots(number: int, seed: int = 7) -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(seed).integers(0, 2**64, number, dtype=np.uint64)


def distance_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :])


def block_masks(blocks: int, distance: int, bits: np.ndarray | None = None) -> list[int]:
    """Masks such that any two fingerprints that differ in at most ``distance`` of the bits agree under one of them."""
    bits = np.arange(64) if bits is None else bits
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)]
    return [sum(some) for some in combinations(parts, blocks - distance)]


def link_run(fps: np.ndarray, table: np.ndarray, distance: int, known: int = 0) -> Iterator[tuple[int, int]]:
    """A spanning forest of the close pairs of one run of different fingerprints. known: bits that all share.

    Long runs are swept by a few members first, which settles balls around them, and then cut by further bits into runs that overlap; a
    union over the whole run lets a cut run start from what is joined already, so n members yield n - 1 edges at most."""
    up = list(range(len(fps)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def near(at: int, some: np.ndarray) -> np.ndarray:
        """Those of some members that are close to one: discarded by one coordinate after the other, then verified."""
        for k in range(table.shape[1]):
            if not len(some):
                break
            some = some[np.abs(table[some, k].astype(np.int16) - int(table[at, k])) <= distance]
        return some[np.bitwise_count(fps[some] ^ fps[at]) <= distance]

    def join(at: int, found: np.ndarray) -> Iterator[tuple[int, int]]:
        for x in found.tolist():
            a, b = top(at), top(x)
            if a != b:
                up[max(a, b)] = min(a, b)
                yield int(fps[at]), int(fps[x])

    def search(idx: np.ndarray, known: int) -> Iterator[tuple[int, int]]:
        labels = np.array([top(x) for x in idx.tolist()])
        if (labels == labels[0]).all():
            return
        free = np.array([b for b in range(64) if not known >> b & 1])
        if len(idx) > LONG_RUN and len(free) >= distance + 2:
            for at in idx[np.linspace(0, len(idx) - 1, SWEEPS).astype(int)].tolist():
                yield from join(at, near(at, idx))
            cuts, cost = [], 0
            for mask in block_masks(distance + 2, distance, free):
                key = fps[idx] & np.uint64(mask)
                order = np.argsort(key, kind="stable")
                parts = [p for p in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(p) > 1]
                cuts += [(idx[p], known | mask) for p in parts]
                cost += sum(len(p) ** 2 for p in parts)
            if 2 * cost <= len(idx) ** 2:  # else the bits left hardly tell the members apart, and one search is less work
                for part, bits in cuts:
                    yield from search(part, bits)
                return
            labels = np.array([top(x) for x in idx.tolist()])
        rest, queue = np.arange(len(idx)), []
        while len(rest):
            if not queue:
                queue.append(int(rest[0]))
                rest = rest[1:]
            at = queue.pop()
            same = labels[rest] == labels[at]  # reached without an edge
            if same.any():
                queue += rest[same].tolist()
                rest = rest[~same]
            found = np.searchsorted(idx, near(int(idx[at]), idx[rest]))
            if len(found):
                yield from join(int(idx[at]), idx[found])
                queue += found.tolist()
                rest = np.setdiff1d(rest, found, assume_unique=True)

    yield from search(np.arange(len(fps)), known)


def links(distinct: DataFrame, distance: int = 4, references: int = 16, expected: int | None = None) -> DataFrame:
    """Edges (u, v) between different fingerprints that hold together all that lie within ``distance``.

    The number of blocks follows the number of fingerprints: more blocks share more bits, so a run of unrelated
    fingerprints stays short. Any number gives the same components."""
    expected = distinct.count() if expected is None else expected
    blocks = distance + 2
    while 64 * (blocks - distance) // blocks < np.log2(max(2, expected)) and blocks < distance + 4:
        blocks += 1
    masks = block_masks(blocks, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])).alias("k"))
    keyed = keyed.select("fp", "k.b", "k.key").repartition("b", "key").sortWithinPartitions("b", "key")
    marks = pivots(references)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # the last run, which the next batch may continue

        def flush(fp: np.ndarray, b: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(key) != 0)) + 1
            first = np.concatenate([[0], cuts])
            size = np.diff(np.append(first, len(fp)))
            keep = size > 1
            found: list[tuple[int, int]] = []
            if keep.any():
                table = distance_table(fp, marks)
                two = first[size == 2]  # most runs
                far = np.abs(table[two].astype(np.int16) - table[two + 1]).max(axis=1, initial=0) > distance
                two = two[~far]
                two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
                found += zip(fp[two].tolist(), fp[two + 1].tolist())
                for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                    found += link_run(fp[a : a + n], table[a : a + n], distance, masks[int(b[a])])
            edges = np.array(found, dtype=np.uint64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, k].copy().view(np.int64)) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            now = (batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy())
            fp, b, key = now if held is None else (np.concatenate(x) for x in zip(held, now))
            if not len(fp):
                continue
            last = np.flatnonzero((b != b[-1]) | (key != key[-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = (fp[cut:], b[cut:], key[cut:])
            if cut:
                yield flush(fp[:cut], b[:cut], key[:cut])
        if held is not None and len(held[0]):
            yield flush(*held)

    return keyed.mapInArrow(pairs, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, references: int = 16) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of the component) for each row of ``docs``."""
    rows = written(fingerprints(docs, width))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = written(connected_components(links(distinct.select("fp"), distance, references)).withColumnRenamed("node", "fp"))
    labelled = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = written(labelled.join(least, "root").select("fp", "component_id"))
    return rows.join(by_print, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp) -> F.Column:
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4, references: int = 16, least: float | None = None) -> DataFrame:
    """One row of each component stays, with all its columns: that of the least doc_id (nulls last; of equal doc_ids and
    fingerprints any one). least: link by this similarity of the texts' shingles, not by ``distance`` differing bits."""
    if least is not None:
        return similar.keep_one(docs, width, least)
    columns, fp = docs.columns, free(docs, "_fp")
    schema = docs.withColumn(fp, F.lit(0).cast("long")).schema
    at = columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made.view(np.int64))], names=[*columns, fp])

    marked = written(docs.mapInArrow(work, schema))
    rows = marked.select("doc_id", F.col(fp).alias("fp"))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = written(connected_components(links(distinct.select("fp"), distance, references)).withColumnRenamed("node", "fp"))
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("w")
    winners = written(labelled.groupBy("root").agg(first).select(F.col("w.fp").alias("fp"), F.col("w.least").alias("least"))).alias("w")
    kept = marked.alias("m").join(winners, (F.col(f"m.{fp}") == F.col("w.fp")) & F.col("m.doc_id").eqNullSafe(F.col("w.least")), "left_semi")
    again = rows.alias("r").join(winners, (F.col("r.fp") == F.col("w.fp")) & F.col("r.doc_id").eqNullSafe(F.col("w.least")), "left_semi")
    if again.groupBy("doc_id", "fp").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", fp])
    return kept.select(*[F.col(f"`{c}`") for c in columns])
