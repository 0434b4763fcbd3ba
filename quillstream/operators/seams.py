"""Where models plug in: each seam maps a table to the table with a model's columns.

A model is a function from an iterator of pandas frames to one with further columns. None is bundled; the stand-ins
below are deterministic and serve tests and dry runs. A row whose model call fails keeps its place with ``success`` false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Seam: columns that a model of this kind adds.
OUTPUTS = {
    "asr": "text string, words array<struct<word:string,start:double,end:double>>, avg_logprob double",
    "translation": "translation string, logprob double",
    "vad": "speech_prob double",
    "embedding": "embedding array<float>",
    "ner": "entities array<struct<text:string,label:string,score:double,start:int,end:int>>",
    "annotation": "sentences array<string>, tokens array<string>",
    "diarization": "turns array<struct<speaker:string,start:double,end:double>>",
    "emotion": "emotion string, emotion_score double",
    "features": "features array<float>",
    "language": "lang_label string, lang_score double",
    "punctuation": "punctuated string",
    "chat": "answer string",
    "sentences": "sentence_list array<string>",
}

Model = Callable[[pd.DataFrame], pd.DataFrame]


def apply(rows: DataFrame, kind: str, model: Model) -> DataFrame:
    """rows with the seam's columns, ``success`` and ``error``. A failing batch is tried again row by row."""
    names = [f.split(" ")[0] for f in _fields(OUTPUTS[kind])]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {OUTPUTS[kind]}, success boolean, error string"

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                made = model(part)
                yield part.assign(**{n: made[n].tolist() for n in names}, success=True, error=None)
            except Exception:  # noqa: BLE001  the row tells
                for k in range(len(part)):
                    one = part.iloc[k : k + 1]
                    try:
                        made = model(one)
                        yield one.assign(**{n: made[n].tolist() for n in names}, success=True, error=None)
                    except Exception as why:  # noqa: BLE001
                        yield one.assign(**{n: [None] for n in names}, success=False, error=str(why)[:200])

    return rows.mapInPandas(work, ddl)


def _fields(ddl: str) -> list[str]:
    """The top-level fields of a DDL string."""
    out, depth, now = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def stub_embedding(column: str, size: int = 16) -> Model:
    """Character counts by code point, normalised."""

    def model(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in part[column]:
            v = np.bincount([ord(c) % size for c in (text or "")], minlength=size).astype(np.float32)
            rows.append((v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
        return pd.DataFrame({"embedding": rows})

    return model


#: Scripts by code point range, and small words that tell languages with one script apart.
SCRIPTS = (("ja", 0x3040, 0x30FF), ("zh", 0x4E00, 0x9FFF), ("ko", 0xAC00, 0xD7AF), ("ru", 0x0400, 0x04FF), ("ar", 0x0600, 0x06FF))
SMALL_WORDS = {
    "en": {"the", "and", "of", "to", "in", "is", "that", "it", "was", "for"},
    "de": {"der", "die", "und", "das", "den", "ist", "von", "nicht", "mit", "auf"},
    "es": {"el", "la", "de", "que", "los", "en", "por", "una", "con", "las"},
    "fr": {"le", "la", "les", "des", "est", "dans", "que", "pour", "qui", "une"},
}


def stub_language(column: str) -> Model:
    """The script's language, else that of the most small words; (unknown, 0) for texts without letters."""

    def one(text: str | None) -> tuple[str, float]:
        letters = [c for c in (text or "") if c.isalpha()]
        if not letters:
            return "unknown", 0.0
        for name, low, high in SCRIPTS:
            n = sum(low <= ord(c) <= high for c in letters)
            if n > len(letters) * (0.1 if name == "ja" else 0.3):
                return name, n / len(letters)
        words = (text or "").lower().split()
        hits = {k: sum(w.strip(".,!?;:") in s for w in words) for k, s in SMALL_WORDS.items()}
        best = max(hits, key=lambda k: (hits[k], k))
        return (best, hits[best] / max(1, sum(hits.values()))) if hits[best] else ("unknown", 0.0)

    return lambda part: pd.DataFrame([one(t) for t in part[column]], columns=["lang_label", "lang_score"])
