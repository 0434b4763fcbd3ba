"""SimHash near-duplicates by pivot distance tables where shingle similarity, not a few bits, decides: one document kept of each group.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is ``least`` (0.8) or more; groups are the
components of the links. Texts of equal sets fold into one row first. Pairs meet in runs: a row has a key in each of
``bands`` bands, the least hashes of its shingles under ``rows`` functions, so a pair of similarity s meets with
probability 1 - (1 - s^rows)^bands (0.9996 at 0.8, all but certain above). Bands only bring rows together; each pair of a run then goes
through SimHash fingerprints (512 bits) and tables of their Hamming distances to reference fingerprints of the run, and only what these leave is
verified by the exact similarity of the sets. Nothing is capped or guessed:

1. two rows of each run are its first references: the table holds every row's distance to both, rows beyond what linked fingerprints
   differ by are discarded, the others verified, which settles the groups of copies of one text;
2. runs that still hold several groups are searched by a table of distances to more references of the run, which discards every pair
   whose largest coordinate difference is beyond that limit; the survivors are verified. A run yields a spanning forest.

Fingerprints are wide because 64 bits can't tell 0.8 from chance within a run (about 10 bits differ, 17 must be allowed, and
distances to a reference then differ by less than that for unrelated texts too). With 512 bits a pair at 0.8 differs in 78 bits
(96 for the smallest sets); the limit of 149 lies six standard deviations above, while a reference tells its own
group from unrelated texts by about 178. Blocks of bits can't find the pairs at this distance, so the bands do.

Nulls: a null text counts as empty; texts without words are equal. Fewer than five words are one shingle. Shingles are
held as 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free, written
from .components import connected_components

#: Width of a fingerprint, in words of 64 bits.
WORDS = 8


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted different hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width].tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The SimHash of a set over 64 x ``words`` bits, as that many unsigned integers."""
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(64 * words, np.int64)
    for low in range(0, len(hashes), 4096):  # bounds memory for very long texts
        mixed = (hashes[low : low + 4096, None] ^ salts) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        total += np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)


def hamming_limit(least: float, words: int = WORDS) -> int:
    """Bits by which fingerprints of linked sets differ at most: the expected share by the angle between the sets, and a margin."""
    return int(64 * words * (math.acos(min(1.0, 2 * least / (1 + least))) / math.pi + 0.14))


def band_keys(hashes: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """One key per band. An empty set has keys of its own."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for low in range(0, len(hashes), 4096):  # bounds memory for very long texts
        mixed = hashes[low : low + 4096, None] * factor + shift
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(0))
    least = least.reshape(bands, rows)
    key = np.zeros(bands, np.uint64)
    for k in range(rows):
        key = (key ^ least[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


def link_sets(ids: list[int], roots: list[int], sets: list[np.ndarray], prints: list[np.ndarray], least: float, references: int = 16) -> Iterator[tuple[int, int]]:
    """Edges that hold together the similar pairs of one run; pairs with equal roots are held together already."""
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)

    def to(at: int, some: np.ndarray) -> np.ndarray:
        """Similarities of one row to some others (none is empty)."""
        if len(some) == len(sets):
            values, whose = flat, owner
        else:
            values = np.concatenate([flat[start[k] : start[k + 1]] for k in some.tolist()])
            whose = np.repeat(np.arange(len(some)), size[some])
        own = sets[at]
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        both = np.bincount(whose[hit], minlength=len(some))
        return both / (size[at] + size[some] - both)

    every = np.arange(len(sets))
    fps, limit = np.stack(prints), hamming_limit(least, len(prints[0]))
    marks = fps[np.linspace(0, len(sets) - 1, min(references, len(sets))).astype(int)]
    table = np.stack([np.bitwise_count(fps ^ m).sum(1, dtype=np.int32) for m in marks], 1)
    label = np.unique(np.array(roots), return_inverse=True)[1]
    queue: list[int] = []
    rest = every
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
        at = queue.pop()
        same = rest[label[rest] == label[at]]  # reached without an edge
        if len(same):
            queue += same.tolist()
            rest = rest[label[rest] != label[at]]
        near = rest[np.minimum(size[rest], size[at]) >= least * np.maximum(size[rest], size[at]) - 1e-9]
        for k in range(table.shape[1]):
            near = near[np.abs(table[near, k] - table[at, k]) <= limit]
        if len(near):
            near = near[to(at, near) >= least]
        if len(near):
            for x in near.tolist():
                yield ids[at], ids[x]
            queue += near.tolist()
            rest = np.setdiff1d(rest, near, assume_unique=True)


def in_runs(keyed: DataFrame) -> DataFrame:
    """The rows (id, b, key) that share their key with others. One shuffle; runs stream past in order, so one of any length takes no memory."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row so far
        given = False  # whether that row has been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            b, key = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            same = (b[1:] == b[:-1]) & (key[1:] == key[:-1])
            keep = np.zeros(len(b), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and last.column(1)[0].as_py() == b[0] and last.column(2)[0].as_py() == key[0]:
                keep[0] = True
                if not given:
                    yield last
            yield batch.filter(pa.array(keep))
            last, given = batch.slice(len(b) - 1), bool(keep[-1])

    ordered = keyed.select("id", "b", "key").repartition("b", "key").sortWithinPartitions("b", "key")
    return ordered.mapInArrow(shared, "id long, b int, key long")


def links(sets: DataFrame, keyed: DataFrame, least: float = 0.8) -> DataFrame:
    """Edges (u, v) over ids. keyed: the rows of ``in_runs``; sets (id, hashes: the bytes of a sorted set) holds the sets of their ids, which
    are different, and their fingerprints (print: the bytes)."""
    limit = hamming_limit(least)

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, reference = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in batch.columns[2:])
            far = np.bitwise_count(own ^ reference).sum(1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(far <= limit))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2), batch.column(3))
            good = [similarity(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) >= least for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    # The first references of a run: its rows of the least and the greatest hash. Rows beyond the limit from them are discarded before any set is read.
    mark = F.struct(F.xxhash64("id").alias("h"), "id")
    heads = keyed.groupBy("b", "key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).select("b", "key", F.col("low.id").alias("low"), F.col("high.id").alias("high"))
    met = keyed.select("id", "b", "key").join(heads, ["b", "key"])
    star = met.select("id", F.explode(F.array("low", "high")).alias("v")).where("id <> v").select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v")).distinct()
    star = star.join(sets.select(F.col("id").alias("u"), F.col("print").alias("p")), "u").join(sets.select(F.col("id").alias("v"), F.col("print").alias("q")), "v")
    star = written(star.select("u", "v", "p", "q").mapInArrow(tabled, "u long, v long"))
    star = star.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("x")), "u").join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("y")), "v")
    roots = written(connected_components(star.select("u", "v", "x", "y").mapInArrow(compared, "u long, v long")).withColumnRenamed("node", "id"))
    # The two references are compared with all of the run; among the others, a run with one group left is settled, and runs of the same rows are one.
    others = met.where("id <> low AND id <> high").select("id", "b", "key")
    labelled = written(others.join(roots, "id", "left").select("id", "b", "key", F.coalesce("root", "id").alias("root")))
    same = [F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (0, 1))]
    open_runs = labelled.groupBy("b", "key").agg(F.min("root").alias("least"), F.max("root").alias("most"), *same).where("least < most")
    open_runs = open_runs.groupBy("n", "x0", "x1").agg(F.min(F.struct("b", "key")).alias("run")).select("run.*")
    searched = written(labelled.join(open_runs, ["b", "key"]))
    searched = searched.join(sets, "id").select("b", "key", "id", "root", "hashes", "print")
    searched = searched.repartition("b", "key").sortWithinPartitions("b", "key", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, ids, tops, held, prints = None, [], [], [], []

        def flush() -> pa.RecordBatch:
            edges = np.array(list(link_sets(ids, tops, held, prints, least)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, k].copy()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for b, key, i, root, raw, wide in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, key) != run:
                    if len(ids) > 1:
                        yield flush()
                    run, ids, tops, held, prints = (b, key), [], [], [], []
                ids.append(i)
                tops.append(root)
                held.append(np.frombuffer(raw, np.uint64))
                prints.append(np.frombuffer(wide, np.uint64))
        if len(ids) > 1:
            yield flush()

    settled = roots.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
    return settled.unionByName(searched.mapInArrow(search, "u long, v long"))


def of_rows(table: DataFrame, row: str, some: DataFrame) -> DataFrame:
    """The rows of ``table`` whose number ``row`` is in ``some`` (r). One row of bits stands for 64 numbers, so that Spark can send them to
    all tasks, and needn't shuffle whole texts, for a far larger table."""
    bits = some.groupBy(F.expr("shiftright(r, 6)").alias("_block")).agg(F.expr("bit_or(shiftleft(1L, cast(r & 63 AS int)))").alias("_bits"))
    t, b = table.alias("t"), written(bits).alias("b")
    own = F.expr(f"shiftright(t.`{row}`, 6) = b._block AND shiftright(b._bits, cast(t.`{row}` & 63 AS int)) & 1 = 1")
    return t.join(b, own, "left_semi")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, bands: int = 20, rows: int = 5) -> DataFrame:
    """One row of each group stays, with all its columns: that of the least doc_id (nulls last; of equal doc_ids any one)."""
    columns, mark, held = docs.columns, free(docs, "_set"), free(docs, "_keys")
    text = docs.columns.index("text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(x.as_py(), width) for x in batch.column(text)]
            fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), 5) for x in made], np.uint64).view(np.int64)
            keys = [band_keys(x, bands, rows).tobytes() if len(x) else b"" for x in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp), pa.array(keys, pa.binary())], names=[*columns, mark, held])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.greater(pc.binary_length(batch.column(1)), 0))
            ids, flat = some.column(0).to_numpy(), np.frombuffer(b"".join(some.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))), pa.array(flat)], names=["id", "b", "key"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(x.as_py(), width) for x in batch.column(1)]
            columns = [[x.tobytes() for x in made], [wide_fingerprint(x).tobytes() for x in made]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in columns)], names=["id", "hashes", "print"])

    # Of rows with one set, the row of the least doc_id; a row's own number tells equal doc_ids apart.
    row = free(docs, "_row")
    marked = docs.mapInArrow(digests, docs.withColumn(mark, F.lit(0).cast("long")).withColumn(held, F.lit(b"")).schema)
    marked = written(marked.withColumn(row, F.monotonically_increasing_id()))
    ids = marked.select(F.col("doc_id").alias("d"), F.col(mark).alias("id"), F.col(row).alias("r"), F.col(held).alias("keys"))
    first = F.min(F.struct(F.col("d").isNull(), "d", "r")).alias("w")
    folded = written(ids.groupBy("id").agg(first, F.first("keys").alias("keys")))
    keyed = written(in_runs(folded.select("id", "keys").mapInArrow(spread, "id long, b int, key long")))
    # Only texts that meet another are cut into shingles again, for their sets and fingerprints.
    meeting = folded.join(keyed.select("id").distinct(), "id", "left_semi").select(F.col("w.r").alias("r"))
    chosen = of_rows(marked, row, meeting).select(F.col(mark).alias("id"), "text")
    sets = written(chosen.mapInArrow(hashed, "id long, hashes binary, print binary"))
    roots = written(connected_components(links(sets, keyed, least)).withColumnRenamed("node", "id"))
    grouped = folded.join(roots, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("w").alias("w"))
    return of_rows(marked, row, grouped.select(F.col("w.r").alias("r"))).select(*[F.col(f"`{c}`") for c in columns])
