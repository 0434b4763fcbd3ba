"""Token counts under a unigram model by trie-shared dynamic programming.

A text's white-space separated words, each with a leading mark, are its pre-tokens. The different pre-tokens of a batch
form a trie; a walk in depth-first order (the sorted words, each continued from the prefix it shares with the one before) computes
the best score of every prefix once, and stores the token number of the best segmentation where a word ends. Counts of
words that were seen stay with the worker.

The pieces come from a public SentencePiece file. Its scores are merge ranks, so a piece's log probability follows
Zipf's law over its rank. A character that no piece covers costs one token for each of its UTF-8 bytes. Of segmentations with equal scores the
shorter counts.

Nulls: a null text counts as empty and has no tokens; null doc_ids stay. Repeated rows get equal counts. An empty table gives
an empty table. Further columns of the input are not read. Texts are read whole; a word of any length takes time in proportion to it.
"""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_of

MARK = "▁"
#: Entries of a worker's count cache; it is emptied when full.
CACHE = 600_000


def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Log probability of each piece: in proportion to 1 / (rank + 3)."""
    ranked = list(dict.fromkeys(pieces))
    total = sum(1 / (k + 3) for k in range(len(ranked)))
    return {p: -math.log((k + 3) * total) for k, p in enumerate(ranked)}


def pieces_of(path: str) -> list[str]:
    """The pieces of a SentencePiece file in rank order, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [model.id_to_piece(k) for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.cache: dict[str, int] = {}

    @classmethod
    def shared(cls, path: str) -> TrieCounter:
        """One for each worker process and file."""
        home = sys.modules.setdefault("_quillstream_worker", types.ModuleType("_quillstream_worker"))
        held = home.__dict__.setdefault("tries", {})
        if path not in held:
            held[path] = cls(zipf_scores(pieces_of(path)))
        return held[path]

    def learn(self, words: Iterable[str]) -> None:
        """Store the token number of each word."""
        get, longest, unknown, cache = self.scores.get, self.longest, self.unknown, self.cache
        best: list[float] = [0.0]  # of the prefix walked so far, by its length
        number: list[int] = [0]
        before = ""
        for word in sorted(words):
            text = MARK + word
            shared, limit = 0, min(len(text), len(before))
            while shared < limit and text[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                top, tokens = best[end - 1] + unknown * size, number[end - 1] + size
                for start in range(max(0, end - longest), end):
                    s = get(text[start:end])
                    if s is not None:
                        x, n = best[start] + s, number[start] + 1
                        if x > top or x == top and n < tokens:
                            top, tokens = x, n
                best.append(top)
                number.append(tokens)
            cache[word] = number[-1]
            before = text

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        split = [(t or "").split() for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new: set[str] = set()
        for words in split:
            new.update([w for w in words if w not in cache])
        self.learn(new)
        return [len(w) for w in split], [sum([cache[x] for x in w]) for w in split]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter.shared(model_path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                words, tokens = counter.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return documents_of(docs, "doc_id", "text").mapInArrow(work, "doc_id long, n_words long, n_tokens long")
