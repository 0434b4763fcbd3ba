"""Text operations that expressions can't state: Unicode normal forms, sequence matching, fuzzy windows, code cleaning.

Each is a plain Python function with an Arrow UDF around it.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from .scalar import SENTENCE_ENDS, TRAILING


def normalise_wer(text: str | None) -> str | None:
    """Compatibility form, lower case, without punctuation, single spaces."""
    if text is None:
        return None
    t = unicodedata.normalize("NFKC", text).lower()
    return " ".join("".join(" " if unicodedata.category(c)[0] == "P" else c for c in t).split())


def similarity(a: str | None, b: str | None) -> float:
    """Sequence matcher's ratio of the texts without closing marks."""
    return difflib.SequenceMatcher(None, (a or "").rstrip(TRAILING), (b or "").rstrip(TRAILING)).ratio()


def opcodes(a: str | None, b: str | None) -> list[dict]:
    return [dict(zip(("tag", "i1", "i2", "j1", "j2"), o)) for o in difflib.SequenceMatcher(None, a or "", b or "").get_opcodes()]


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+|[^\w\s]", text)


def appended_text(a: str | None, b: str | None) -> str:
    """What b has beyond a: the rest after a as a prefix, else b's inserted and replaced tokens behind the last match."""
    a, b = a or "", b or ""
    if b.startswith(a):
        return b[len(a) :].lstrip()
    x, y = _tokens(a), _tokens(b)
    blocks = [m for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size]
    if not blocks:
        return b
    rest = y[blocks[-1].b + blocks[-1].size :]
    if not rest:
        return ""
    at = len(b)
    for token in reversed(rest):
        at = b.rindex(token, 0, at)
    return b[at:]


def appended_word_count(a: str | None, b: str | None) -> int:
    return sum(t not in SENTENCE_ENDS for t in _tokens(appended_text(a, b)))


def appended_restored(a: str | None, b: str | None) -> str:
    """The appended part of b, with punctuation left aside for the comparison and restored in the result."""
    clean = lambda t: [(c, k) for k, c in enumerate(t) if unicodedata.category(c)[0] != "P"]
    x, y = clean(a or ""), clean(b or "")
    new = appended_text("".join(c for c, _ in x), "".join(c for c, _ in y))
    at = "".join(c for c, _ in y).rfind(new) if new else -1
    return (b or "")[y[at][1] :] if at >= 0 else ""


def ratio(a: str, b: str) -> float:
    """Percent of equal characters by longest common subsequence, a row of the table at a time as one integer's bits."""
    if not a and not b:
        return 100.0
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    free = full
    for y in b:
        hit = free & at.get(y, 0)
        free = (free + hit | free - hit) & full
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


def partial_ratio(query: str, text: str) -> float:
    """The best ratio of the shorter text and a window of the other of the same length."""
    a, b = sorted((query, text), key=len)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    return max(ratio(a, b[k : k + len(a)]) for k in range(max(1, len(b) - len(a) + 1)))


def fuzzy_window(query: str | None, texts: list[str] | None, cutoff: float = 75.0, extra: int = 20) -> dict | None:
    """The window of a text most like the query: score, then shorter, then earlier. Texts below the cutoff are passed over."""
    query, best = query or "", None
    for n, text in enumerate(texts if texts is not None else []):
        text = text or ""
        if not query or partial_ratio(query, text) < cutoff:
            continue
        for size in range(min(len(query), len(text)), min(len(query) + extra, len(text)) + 1):
            for start in range(len(text) - size + 1):
                score = ratio(query, text[start : start + size])
                key = (-score, size, n, start)
                if score >= cutoff and (best is None or key < best[0]):
                    best = (key, {"match": text[start : start + size], "score": score, "start": start, "end": start + size, "text": text})
    return best[1] if best else None


#: Triple-quoted blocks, strings within a line, comments.
CODE = re.compile(r"(\"\"\"|\'\'\').*?(?:\1|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|#[^\n]*", re.S)


def strip_comments(code: str | None, triple: bool = False) -> str | None:
    """Without # comments outside strings; triple: without triple-quoted blocks that begin a line too."""
    if code is None:
        return None

    def keep(m: re.Match) -> str:
        if m[0][0] == "#":
            return ""
        bare = triple and m[1] and not code[code.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        return "" if bare else m[0]

    return "\n".join(line.rstrip() for line in CODE.sub(keep, code).split("\n"))


def remove_calls(code: str | None, names: tuple[str, ...] = ("logger.", "logging.", "print(", "console.")) -> str | None:
    """Without statements that call one of these; brackets are matched over lines."""
    if code is None:
        return None
    out, depth, skipping = [], 0, False
    for line in code.split("\n"):
        if not skipping and line.lstrip().startswith(names):
            skipping, depth = True, 0
        if skipping:
            depth += line.count("(") - line.count(")")
            skipping = depth > 0
            continue
        out.append(line)
    return "\n".join(out)


def _map1(f, kind: str):
    @F.pandas_udf(kind)
    def apply(a: pd.Series) -> pd.Series:
        return a.map(lambda x: f(x))

    return apply


def _map2(f, kind: str):
    @F.pandas_udf(kind)
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return apply


def normalise_wer_udf():
    return _map1(normalise_wer, "string")


def similarity_udf():
    return _map2(similarity, "double")


def appended_text_udf():
    return _map2(appended_text, "string")


def appended_restored_udf():
    return _map2(appended_restored, "string")


def appended_count_udf():
    return _map2(appended_word_count, "int")


def opcodes_udf():
    return _map2(opcodes, "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>")


def strip_comments_udf():
    return _map1(strip_comments, "string")


def remove_calls_udf():
    return _map1(remove_calls, "string")


def fuzzy_window_udf(cutoff: float = 75.0, extra: int = 20):
    @F.pandas_udf("match string, score double, start int, end int, text string")
    def apply(query: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [fuzzy_window(q, t, cutoff, extra) or {} for q, t in zip(query, texts)]
        return pd.DataFrame({c: [f.get(c) for f in found] for c in ("match", "score", "start", "end", "text")})

    return apply
