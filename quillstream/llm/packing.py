"""Best-fit packing of token sequences, bulk-synchronously.

Documents are tokenised, cut into pieces of at most ``capacity`` ids, and the pieces are packed into as few sequences
as best fit decreasing finds. Pieces of equal length are interchangeable, so the range-sorted table of pieces is held as
runs (length, first rank, number) and the range-sorted table of gaps as runs of equal gaps over consecutive sequence
numbers; both have a size bound by ``capacity``, not by the data. A round takes the longest length that is left, sweeps
the gaps for their successors (the smallest gap that still holds it), gives each gap the next ranks, which resolves
conflicts as no rank is given twice, and updates the gaps. The rounds end when no run is left. Spark then ranks the
pieces of each length and joins every piece with the run that holds its rank.

Nulls: a null text counts as empty; a null doc_id stays null. Empty texts hold the end id alone and are packed. Repeated rows are packed once
each. An empty table gives an empty table. Further columns of the input are not read.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_LOWER, documents_of, written

PUNCTUATION = b'.,;:!?#$%&*()[]"-+=/'
#: Entries of a worker's word cache; it is emptied when full.
CACHE = 600_000


class WordTokenizer:
    """Ids of texts under a word-level BPE file. Words repeat, so each is tokenised once for as long as the cache holds it.

    White space is dropped before the vocabulary is applied and no token spans it, hence the ids of a text are those of
    its white-space separated words in order. A word with ASCII punctuation behind a letter falls into two parts there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.cache: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> WordTokenizer:
        """One for each worker process and file; it outlives the task."""
        home = sys.modules.setdefault("_quillstream_worker", types.ModuleType("_quillstream_worker"))
        held = home.__dict__.setdefault("tokenizers", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _one(self, word: bytes) -> bytes:
        return np.array(self.inner.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        cache = self.cache
        cores = {w: w.rstrip(PUNCTUATION) for w in words}
        parts = {w: c for w, c in cores.items() if c and len(c) < len(w) and c[-1:].isalpha()}
        need = (words - parts.keys()).union(parts.values(), (w[len(c) :] for w, c in parts.items())).difference(cache)
        plain: list[str] = []
        mixed: list[str] = []
        for word in need:
            if word.isalpha():  # ASCII letters only
                plain.append(word.decode())
                continue
            text = word.decode()
            if not unicodedata.is_normalized("NFC", text) or "<|" in text:
                cache[word] = self._one(word)
            else:
                (plain if text.isalpha() else mixed).append(text)
        for k in range(0, len(mixed), 20_000):  # of several runs of tokens each: told apart by their places
            some = mixed[k : k + 20_000]
            made = self.inner.encode(" ".join(some), add_special_tokens=False)
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            starts = np.cumsum(lengths + 1) - lengths - 1
            of = np.searchsorted(starts, np.array([o[0] for o in made.offsets], dtype=np.int64), side="right") - 1
            ends = np.searchsorted(of, np.arange(len(some)), side="right")
            raw, at = np.array(made.ids, dtype="<u4").tobytes(), 0
            for text, end in zip(some, (ends * 4).tolist()):
                cache[text.encode()] = raw[at:end]
                at = end
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            made = self.inner.encode(" ".join(some), add_special_tokens=False)
            of = np.array(made.word_ids, dtype=np.int64)
            ends = np.flatnonzero(np.diff(of, append=-1)) + 1  # each word is one run of tokens
            if len(ends) == len(some):
                raw, at = np.array(made.ids, dtype="<u4").tobytes(), 0
                for text, end in zip(some, (ends * 4).tolist()):
                    cache[text.encode()] = raw[at:end]
                    at = end
            else:
                for text in some:
                    cache[text.encode()] = self._one(text.encode())
        for word, core in parts.items():
            cache[word] = cache[core] + cache[word[len(core) :]]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text. The texts of one call are held together."""
        split: list[list[bytes]] = []
        cache, new = self.cache, set()
        if len(cache) > CACHE:
            cache.clear()
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if b"<|" not in raw:
                raw = raw.translate(ASCII_LOWER)
            split.append(raw.split())
            new |= set(split[-1]).difference(cache)
        self._learn(new)
        for words in split:
            yield b"".join([cache[w] for w in words])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian) of each piece of each document."""
    end = np.array([end_id], dtype="<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.shared(tokenizer_path)
        step = capacity * 4
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows: list[tuple] = []
                texts = part.column(1)
                for doc, raw in zip(part.column(0).to_pylist(), coder.encode(x.as_py() for x in texts)):
                    raw += end
                    for k in range(0, len(raw), step):
                        some = raw[k : k + step]
                        rows.append((doc, k // step, k // 4, len(some) // 4, zlib.crc32(some), *([some] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return documents_of(docs, "doc_id", "text").mapInArrow(cut, ddl)


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over runs of equal lengths. Returns (length, first rank, number, first sequence, each, offset):
    the pieces with these ranks go, ``each`` to a sequence, to consecutive sequences, from this offset on."""
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted distinct gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences that have it
    opened = 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(gaps, length)
            if k == len(gaps):  # no gap holds it: new sequences
                gap, each = capacity, capacity // length
                first, number = opened, -(-left // each)
                opened += number
            else:
                gap = gaps[k]
                each = gap // length
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(k)
            full = min(number, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - gap))
                rank, left = rank + full * each, left - full * each
                put(gap - each * length, first, full)
            if full < number and left:  # fewer are left than a sequence takes
                out.append((length, rank, left, first + full, each, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < number:
                put(gap, first + full, number - full)
    return out


def pack(cut: DataFrame, capacity: int = 2048, salts: int = 256) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` must be reliable (written): it is read twice."""
    spark = cut.sparkSession
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    by_salt = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # At most capacity x salts rows, whatever the data.
    table = by_salt.toArrow()
    number = np.zeros((capacity + 1, salts), np.int64)
    number[table.column("length").to_numpy(), table.column("_salt").to_numpy()] = table.column("_n").to_numpy()
    before = np.cumsum(number, axis=1) - number
    counts = {int(k): int(number[k].sum()) for k in np.flatnonzero(number.any(axis=1))}
    plan = plan_runs(counts, capacity)
    by_length: dict[int, list[tuple]] = {}
    for row in plan:
        by_length.setdefault(row[0], []).append(row[1:])
    starts = {k: np.array([r[0] for r in v]) for k, v in by_length.items()}
    runs = {k: np.array(v, dtype=np.int64) for k, v in by_length.items()}
    held = spark.sparkContext.broadcast((before, starts, runs))  # one number for each length and salt, and the plan

    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_rank", rank)
    names = cut.columns
    schema = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, starts, runs = held.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            salt, rank = batch.column("_salt").to_numpy(), batch.column("_rank").to_numpy().astype(np.int64)
            rank = rank + before[length, salt]
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                run = runs[int(size)][np.searchsorted(starts[int(size)], rank[at], side="right") - 1]
                inside = rank[at] - run[:, 0]
                sequence[at] = run[:, 2] + inside // run[:, 3]
                offset[at] = run[:, 4] + inside % run[:, 3] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack. Returns a row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(written(pieces(docs, tokenizer_path, capacity, end_id, with_ids)), capacity)
