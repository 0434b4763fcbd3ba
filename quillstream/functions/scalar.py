"""Scalar expressions over columns: buckets, predicates, text rules, vector products. No user code runs in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- buckets -----------------------------------------------------------------------------------------------------------

#: Fixed values: (operator, bound, label) tables of the quality scales, checked in order; the last label is what is left.
LOUDNESS = ([("<", 0.001, "silent"), ("<", 0.03, "very_quiet"), ("<", 0.12, "normal"), ("<", 0.25, "loud")], "very_loud")
ASR_LOGPROB = ([(">", -0.3, "Very High"), (">", -0.7, "High"), (">", -1.2, "Medium"), (">", -2.0, "Low")], "Very Low")
TRANSLATION_LOGPROB = ([(">", -0.4, "High"), (">", -1.0, "Good"), (">", -2.0, "Medium")], "Low")
LOGPROB_STEPS = ([(">=", -0.5, "very_high"), (">=", -0.95, "high"), (">=", -1.55, "medium"), (">=", -2.5, "low")], "very_low")
CONFIDENCE_PERCENT = ([("<", 20.0, "very_low"), ("<", 40.0, "low"), ("<", 60.0, "medium"), ("<", 80.0, "high")], "very_high")
COVERAGE = ([(">=", 92.0, "excellent"), (">=", 82.0, "very_good"), (">=", 65.0, "good"), (">=", 40.0, "fair"), (">=", 15.0, "poor")], "very_poor")
RATING = ([(">=", 0.8, "HIGH"), (">=", 0.5, "MED")], "LOW")


def bucket(value: Column, scale: tuple[list[tuple[str, float, str]], str], missing: str | None = None) -> Column:
    """The first label whose bound holds. missing: the label of null and non-finite values (null if not given)."""
    steps, last = scale
    test = {"<": lambda c, b: c < b, ">": lambda c, b: c > b, ">=": lambda c, b: c >= b, "<=": lambda c, b: c <= b}
    bad = value.isNull() | F.isnan(value.cast("double")) | (F.abs(value.cast("double")) == float("inf"))
    out = F.when(bad, F.lit(missing))
    for op, bound, label in steps:
        out = out.when(test[op](value, F.lit(bound)), label)
    return out.otherwise(last)


def byte_size(size: Column) -> Column:
    """Human size: GB with two places, MB with one from 100 MB on and two below, KB with one, bytes."""
    s = size.cast("double")
    number = lambda x, places: F.format_string(f"%.{places}f", x)
    return (
        F.when(size.isNull(), None)
        .when(s >= 1024.0**3, F.concat(number(s / 1024.0**3, 2), F.lit(" GB")))
        .when(s >= 100 * 1024.0**2, F.concat(number(s / 1024.0**2, 1), F.lit(" MB")))
        .when(s >= 1024.0**2, F.concat(number(s / 1024.0**2, 2), F.lit(" MB")))
        .when(s >= 1024.0, F.concat(number(s / 1024.0, 1), F.lit(" KB")))
        .otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))
    )


# --- numbers -----------------------------------------------------------------------------------------------------------


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def decibels(value: Column) -> Column:
    return 20 * F.log10(F.greatest(value, F.lit(1e-10)))


def geometric_mean_probability(logprob: Column, tokens: Column, least_tokens: int = 1, fallback: float = 0.0) -> Column:
    """exp(logprob / tokens), within [0, 1]."""
    return F.coalesce(clip(F.exp(logprob / F.greatest(tokens, F.lit(least_tokens))), 0.0, 1.0), F.lit(fallback))


def rms(samples: Column) -> Column:
    """Root mean square of an array; 0 for an empty one."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def framed_rms(samples: Column, frame: int = 160, hop: int = 160) -> Column:
    """One value for each full frame: 1 + (n - frame) div hop of them, none if there is no full frame."""
    starts = F.when(F.size(samples) >= frame, F.sequence(F.lit(1), F.size(samples) - frame + 1, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: rms(F.slice(samples, s, frame)))


def zero_crossing_rate(samples: Column) -> Column:
    pairs = F.zip_with(F.slice(samples, 1, F.size(samples) - 1), F.slice(samples, 2, F.size(samples)), lambda a, b: F.abs(F.signum(b) - F.signum(a)))
    return F.when(F.size(samples) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (2 * F.size(samples))).otherwise(0.0)


# --- predicates --------------------------------------------------------------------------------------------------------


def is_missing(value: Column, kind: str = "scalar") -> Column:
    """Null, NaN (kind number) or empty (kind array or map)."""
    if kind == "number":
        return value.isNull() | F.isnan(value)
    if kind in ("array", "map"):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


#: Headings that are no sentences, marks of list items, ends of sentences, and phrases of refusals.
STOP_HEADINGS = (
    "abstract", "introduction", "conclusion", "references", "table of contents", "acknowledgements", "appendix", "chapter", "figure", "table", "section", "page", "isbn", "doi",
)
BULLETS = ("•", "○", "→", "▪", "*", "-", "–", "—")
ENDINGS = (".", "!", "?", '."', ".”", "…", '"', "'")
REFUSALS = (
    "i can't", "i cannot", "i’m unable", "i am unable", "i won't", "sorry", "as an ai", "cannot assist", "can't help", "not allowed", "against the rules",
)


def is_valid_sentence(text: Column, trimmed: bool = False) -> Column:
    """Ordered rules of what counts as a sentence. trimmed: the text has no white space at its ends."""
    t = text if trimmed else strip(text)
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    starts_with = lambda marks: reduce(lambda a, b: a | b, (t.startswith(m) for m in marks))
    ends_with = lambda marks: reduce(lambda a, b: a | b, (t.endswith(m) for m in marks))
    return (
        F.when(text.isNull() | (F.length(t) <= 2), False)
        .when(F.length(t) <= 6, ends_with(ENDINGS[:3]))
        .when((words == 1) & (F.length(t) > 40), False)
        .when((F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) < 60), False)
        .when(F.lower(t).isin(*STOP_HEADINGS), False)
        .when(starts_with(BULLETS) & (words <= 5), False)
        .when(t.rlike(r"[-_=]{4}"), False)
        .when(t.rlike(r"[^\p{L}\p{N}_]{6}"), False)
        .when(ends_with(ENDINGS), True)
        .otherwise(t.rlike(r"\p{L}") & t.contains(" "))
    )


def glob_to_regex(pattern: str) -> str:
    special = set(".+()[]{}^$|\\")
    return "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in pattern)


def matches_content(text: Column, include: list[str], exclude: list[str], case_sensitive: bool = False) -> Column:
    """Some include pattern (all, if there is none) and no exclude pattern holds. A pattern with * or ? must match the whole text."""
    held = text if case_sensitive else F.lower(text)

    def one(pattern: str) -> Column:
        p = pattern if case_sensitive else pattern.lower()
        return held.rlike(f"(?s)^{glob_to_regex(p)}$") if "*" in p or "?" in p else held.contains(p)

    any_of = lambda patterns: reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))
    return F.coalesce((any_of(include) if include else F.lit(True)) & ~any_of(exclude), F.lit(False))


def is_refusal(text: Column) -> Column:
    held = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (held.contains(p) for p in REFUSALS))


def is_valid_embedding(v: Column) -> Column:
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: F.isnan(x.cast("double"))), F.lit(True))


def bottom_middle_text(regions: Column, height: Column, width: Column, bottom: float = 0.65, tolerance: float = 0.3, least: float = 0.5) -> Column:
    """Texts of regions (text, score, x1, y1, x2, y2) with a score above ``least`` in the lower middle of an image, from top to bottom, a line each."""
    y = lambda r: (r["y1"] + r["y2"]) / 2
    x = lambda r: (r["x1"] + r["x2"]) / 2
    kept = F.filter(regions, lambda r: (r["score"] > least) & (y(r) >= height * bottom) & (F.abs(x(r) - width / 2) <= width * tolerance))
    ordered = F.array_sort(F.transform(kept, lambda r: F.struct(y(r).alias("y"), r["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda r: r["text"]), "\n")


# --- text --------------------------------------------------------------------------------------------------------------

#: Closing marks, Japanese sentence ends, symbol blocks that part sentences.
TRAILING = "。、，．！？!?.,…・「」『』（）()[]【】　 \t\r\n"
SENTENCE_ENDS = "。！？…"
SYMBOL_BLOCKS = r"[\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F300}-\x{1FAFF}]+"
WORD = r"(?U)\b[\w'.&-]+\b"
ASCII_WORD = r"[A-Za-z0-9_]+(?:['.&-]+[A-Za-z0-9_]+)*"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_trailing(text: Column, compat: bool = False) -> Column:
    """Without closing marks and white space at the end. compat: the set also holds a backslash and the letter s, and no ASCII space."""
    marks = (TRAILING.replace(" ", "") + "\\s") if compat else TRAILING
    return F.rtrim(text, F.lit(marks))


def html_lines(html: Column) -> Column:
    """Lines of a page's text: scripts, styles, comments and heads' titles go, block elements part lines, inline text is merged, white space collapses."""
    t = html
    for gone in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", r"(?s)<!--.*?-->"):
        t = F.regexp_replace(t, gone, "")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|td|th|table|section|article|header|footer|nav|title|body|head|html|main|aside|blockquote|pre|dl|dt|dd)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f]+", " "), r"^ | $", ""))
    return F.filter(lines, lambda x: x != "")


#: Elements whose text is not a page's main text.
SIDE_ELEMENTS = ("head", "nav", "header", "footer", "aside", "form", "button", "select", "noscript")


def html_main_lines(html: Column) -> Column:
    """Lines of a page without menus, headers, footers, side parts and forms: a rule for pages that mark these by element."""
    t = html
    for name in SIDE_ELEMENTS:
        t = F.regexp_replace(t, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "\n")
    return html_lines(t)


def split_sentences(text: Column) -> Column:
    """After 。！？…, which stay with the line ends behind them."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^。！？…\n]*(?:[。！？…]+\n*|\n+|$)"), F.lit(0)), lambda s: s != "")


def split_symbols(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SYMBOL_BLOCKS), strip), lambda s: s != "")


def split_sentences_ja(text: Column) -> Column:
    """At symbol blocks, then after sentence ends, then after 、 and …; white space collapsed."""
    parts = F.flatten(F.transform(split_symbols(F.regexp_replace(text, r"(?U)\s+", " ")), lambda p: F.split(p, r"(?<=[。！？])")))
    return F.filter(F.transform(F.flatten(F.transform(parts, lambda p: F.split(p, r"(?<=[、…])"))), strip), lambda s: s != "")


def words(text: Column, ascii_only: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(ASCII_WORD if ascii_only else WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Words, the ends of contractions, and single marks."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|'[\p{L}]+|[^\s\p{L}\p{N}_]"), F.lit(0))


def alphanumeric(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def normalise_simple(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\n\f]+", " "), r"^ | $", ""))


def normalise_phrase(text: Column) -> Column:
    """Letters, digits and underscores only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "")


def strip_trailing_blank(text: Column) -> Column:
    """Spaces and tabs go after the last line end; a text without one stays."""
    return F.regexp_replace(text, r"(\n[^\n]*?)[ \t]+\z", "$1")


def newline_expansion(segments: Column) -> Column:
    """n line ends at a segment's end add n empty segments."""
    return F.flatten(F.transform(segments, lambda s: F.concat(F.array(F.rtrim(s, F.lit("\n"))), F.array_repeat(F.lit(""), F.length(s) - F.length(F.rtrim(s, F.lit("\n")))))))


def merge_dot_words(text: Column) -> Column:
    """A word that begins with a dot, or follows one that ends in a dot, is glued to the one before: no space stays beside a dot."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r" (?=\.)|(?<=\.) ", "")


def snippet(text: Column, size: int = 180) -> Column:
    return F.concat(F.trim(F.left(text, F.lit(size))), F.lit("..."))


def label_key(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def token_estimate(text: Column) -> Column:
    """Tokens where no tokenizer is at hand: a quarter of the characters, at least one, none for the empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def token_estimate_llm(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.floor(n / 3) + 10).cast("long")


def overlap_length(before: Column, after: Column, longest: int = 40, shortest: int = 4) -> Column:
    """The longest end of one text that begins the other, between the bounds; else 0."""
    sizes = F.sequence(F.lit(longest), F.lit(shortest), F.lit(-1))
    hits = F.filter(sizes, lambda n: (F.length(before) >= n) & (F.length(after) >= n) & (F.right(before, n) == F.left(after, n)))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def stitch(before: Column, after: Column) -> Column:
    """Both texts without what they share where they meet, else with a space between; an empty or null side leaves the other."""
    n = overlap_length(before, after)
    empty = lambda t: F.coalesce(t, F.lit("")) == ""
    return F.when(empty(before), after).when(empty(after), before).when(n > 0, F.concat(before, after.substr(n + 1, F.length(after)))).otherwise(F.concat_ws(" ", before, after))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning, by bisection, so that long texts take few comparisons."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.struct(F.lit(0).alias("low"), n.alias("high")),
        lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(
            F.when(
                F.left(a, F.ceil((s["low"] + s["high"]) / 2).cast("int")) == F.left(b, F.ceil((s["low"] + s["high"]) / 2).cast("int")),
                F.struct(F.ceil((s["low"] + s["high"]) / 2).cast("int").alias("low"), s["high"].alias("high")),
            ).otherwise(F.struct(s["low"].alias("low"), (F.ceil((s["low"] + s["high"]) / 2).cast("int") - 1).alias("high")))
        ),
    )["low"]


def new_text(a: Column, b: Column) -> Column:
    """What b adds to a: b after their common beginning, from where white space ends."""
    n = common_prefix(a, b)
    return F.regexp_replace(b.substr(n + 1, F.length(b)), r"^\s+", "")


def new_sentences(a: Column, b: Column) -> Column:
    """b's sentences after those that equal a's from the start on, closing marks aside."""
    x, y = (F.transform(split_sentences(t), lambda s: strip_trailing(s)) for t in (a, b))
    same = F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda p, q: p == q)
    first = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0))
    n = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    return F.array_join(F.slice(split_sentences(b), n + 1, F.greatest(F.size(y) - n, F.lit(0))), "")


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; fractions of a millisecond are cut off."""
    ms = F.floor(seconds * 1000).cast("long")
    part = lambda c, w: F.lpad(c.cast("string"), w, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(
        F.when(hours < 100, part(hours, 2)).otherwise(hours.cast("string")), F.lit(":"), part(F.floor(ms / 60_000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit(","), part(ms % 1000, 3)
    )


def srt_block(number: Column, start: Column, duration: Column, *lines: Column) -> Column:
    times = F.concat(srt_time(start), F.lit(" --> "), srt_time(start + duration))
    return F.concat(F.concat_ws("\n", number.cast("string"), times, *lines), F.lit("\n"))


#: Languages by file suffix.
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".md": "markdown", ".json": "json", ".html": "html", ".css": "css", ".sh": "bash", ".ps1": "powershell", ".sql": "sql", ".txt": "text", ".yml": "yaml", ".yaml": "yaml"}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))), F.lit("text"))


def config_hash(*columns: str) -> Column:
    """md5 of the key-sorted JSON of the columns."""
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def squeeze_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\s*\n+", "\n")


def punctuation_map(text: Column) -> Column:
    """The text without punctuation, and the runs of kept characters as (start in the clean text, start in the original, length), so that
    a place in one is found in the other."""
    found = F.regexp_extract_all(text, F.lit(r"\P{P}+"), F.lit(0))
    gaps = F.transform(F.split(text, r"\P{P}+", -1), lambda g: F.length(g))
    runs = F.aggregate(
        F.zip_with(F.transform(found, lambda r: F.length(r)), F.slice(gaps, 1, F.size(found)), lambda n, g: F.struct(n.alias("n"), g.alias("g"))),
        F.struct(F.lit(0).alias("clean"), F.lit(0).alias("at"), F.array().cast("array<struct<clean:int,original:int,length:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["clean"] + x["n"]).alias("clean"),
            (s["at"] + x["g"] + x["n"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(s["clean"].alias("clean"), (s["at"] + x["g"]).alias("original"), x["n"].alias("length")))).alias("out"),
        ),
    )["out"]
    return F.struct(F.array_join(found, "").alias("clean"), runs.alias("runs"))


# --- vectors -----------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, form: str = "normalised") -> Column:
    """form: normalised (each norm at least 1e-12), eps (product of norms + 1e-8), or max (product of norms at least 1e-8)."""
    if form == "normalised":
        return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))
    if form == "eps":
        return dot(a, b) / (norm(a) * norm(b) + 1e-8)
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1 (an array of arrays and an array of 0 and 1)."""
    kept = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double"))
    width = F.size(F.element_at(vectors, 1))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double")))
    zero = F.array_repeat(F.lit(0.0), width)
    return F.transform(F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)), lambda x: x / F.greatest(kept, F.lit(1e-9)))


def pool(values: Column, block: int = 4) -> Column:
    """Means of full blocks; what is left over goes."""
    starts = F.sequence(F.lit(0), F.floor(F.size(values) / block).cast("int") - 1)
    means = F.transform(starts, lambda k: F.aggregate(F.slice(values, k * block + 1, block), F.lit(0.0), lambda s, x: s + x.cast("double")) / block)
    return F.when(F.size(values) >= block, means).otherwise(F.array().cast("array<double>"))
