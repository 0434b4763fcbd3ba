r"""Personal data by fixed patterns and by bootstrapped contextual extraction, in SQL expressions only.

Base kinds (leftmost, non-overlapping, each kind for itself; a match that fails its check is dropped, without retry):
email, ip (parts at most 255), card (14 to 19 digits that pass Luhn's check), phone (10 to 15 digits).

The method adds spans of kinds ``key`` (access keys of a published form, seeds like the base kinds) and ``cue``. A lexical pattern (a cue) is what stands before a value: a word and a sign (``:``, ``=``
or ``#``), or two plain words ("me at"). Seed entities are the base spans, as a whole and with their spaces, and secrets of a shape that leaves
no doubt (16 or more letters and digits in one run, three digits at least among them); a value that overlaps a base span and does not start
with it is none. The graph of cues and different values is scored in rounds: a cue's support is the sum of its values'
scores and its confidence their mean, with a prior of one bad value; a cue with enough of both is trusted and lends its confidence to
its values, so values found under one cue let another be trusted in the next round. Seeds keep the score 1. Every value of a
cue that is trusted at the end is a span, up to white space, a quote, a comma or a semicolon, however long it is; seeds of no trusted cue are none.
Values hold a digit and at least four characters, or are seeds.

All tables that the rounds work on are counts per pattern and value; no group is gathered. The found values are
written to the shared folder, and Spark broadcasts them only if the written size is under its own threshold.

Nulls: a null text counts as empty: no spans. A null doc_id stays null. Ties and repeated rows: spans depend on the text
alone. An empty table gives an empty table. Further columns pass through; the columns added are ``spans`` (array of kind, start, end; code
points, end exclusive; by start, then kind as listed above).

Regular expressions are possessive wherever the greedy form gives the same matches, as Java's backtracking loops would
overflow its stack on very long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written

KINDS = ("email", "ip", "card", "phone", "key", "cue")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CUE = r"(?<![\p{L}_-])[\p{L}_-]{2,}+\x20?[:=#]\x20?[\x22']?[^\s\x22',;]++"
#: Access keys of a published fixed form.
KEY = r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36})(?![A-Za-z0-9_])"
#: Shape of a secret that may seed: long, letters and digits in one run.
SECRET = r"^(?=(?:[A-Za-z]*+[0-9]){3})(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+$"
WORDS = r"(?<![\p{L}\p{N}_])\p{L}++\s{1,3}\p{L}++\s{1,3}(?=[^\s0-9@]*+[0-9@])[^\s\x22',;]++"
CUE_PARTS = r"^([\p{L}_-]++\x20?[:=#]\x20?|\p{L}++\s{1,3}\p{L}++\s{1,3})[\x22']?(.*)$"
PART = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})|0++)"
OCTETS = r"^" + PART + r"(?:\." + PART + "){3}$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    backwards = F.reverse(number)
    odd = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda total, k: total
        + F.when(k % 2 == 1, backwards.substr(k, F.lit(1)).cast("int")).otherwise(
            backwards.substr(k, F.lit(1)).cast("int") * 2 - F.when(backwards.substr(k, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return odd % 10 == 0


def _any(c: Column) -> Column:
    return F.lit(True)


def _valid_ip(c: Column) -> Column:
    return c.rlike(OCTETS)


def _valid_card(c: Column) -> Column:
    return F.when(F.length(_digits(c)).between(14, 19), luhn(_digits(c))).otherwise(False)


def _valid_phone(c: Column) -> Column:
    return F.length(_digits(c)).between(10, 15)


#: kind: pattern, check, a cheap condition that texts with a valid match fulfil.
BASE = {
    "email": (EMAIL, _any, lambda t: t.contains("@")),
    "ip": (IP, _valid_ip, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (CARD, _valid_card, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")),
    "phone": (PHONE, _valid_phone, lambda t: t.contains("+")),
}
#: What seeds the graph and is a span wherever it stands.
SEEDS = BASE | {"key": (KEY, _any, lambda t: t.rlike("AKIA|ASIA|ghp_"))}
SPAN = "array<struct<kind:string,start:int,end:int>>"
HIT = "array<struct<start:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """start and value of the leftmost non-overlapping matches: the text between them gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    folded = F.aggregate(
        F.arrays_zip(found.alias("m"), between.alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("out")),
        lambda s, x: F.when(x["m"].isNull(), s).otherwise(
            F.struct(
                (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + F.length(x["g"])).alias("start"), x["m"].alias("value")))).alias("out"),
            )
        ),
    )
    return folded["out"]


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds and of access keys, by start, then kind as listed."""

    def check(valid):
        return lambda h: valid(h["value"])

    def placed(k: int):
        return lambda h: F.struct(h["start"].alias("start"), F.lit(k).alias("k"), (h["start"] + F.length(h["value"])).alias("end"))

    parts = []
    for k, (pattern, valid, cheap) in enumerate(SEEDS.values()):
        good = F.filter(matches(text, pattern), check(valid))
        spans = F.transform(good, placed(k))
        parts.append(F.when(cheap(text), spans).otherwise(F.array().cast("array<struct<start:int,k:int,end:int>>")))
    return as_spans(F.concat(*parts))


def as_spans(coded: Column) -> Column:
    return F.transform(F.array_sort(coded), lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def coded(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]) - 1).cast("int").alias("k"), s["end"].alias("end")))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cue_hits(docs: DataFrame, key: Column) -> DataFrame:
    """key, cue, value, start, end, base, seed of every cue and value in the texts. A base span that starts where the
    value does is the value, as a whole. Only texts with a digit or an @ are read closely."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(F.when(text.rlike("[:=#]"), matches(text, CUE)).otherwise(F.array().cast(HIT)), matches(text, WORDS))
    hits = docs.where(text.rlike("[0-9@]")).select(key.alias("key"), text.alias("t"), found.alias("found"), base_spans(text).alias("spans"))
    hits = hits.select("key", "t", "spans", F.explode("found").alias("h"))
    front, value = F.regexp_extract("h.value", CUE_PARTS, 1), F.regexp_extract("h.value", CUE_PARTS, 2)
    end = F.col("h.start") + F.length("h.value")
    hits = hits.select("key", "t", "spans", front.alias("front"), (end - F.length(value)).alias("start"), end.alias("token_end"))
    whole = F.array_max(F.transform(F.filter("spans", lambda s: s["start"] == F.col("start")), lambda s: s["end"]))
    crossed = F.exists("spans", lambda s: (s["start"] < F.col("token_end")) & (s["end"] > F.col("start")))
    hits = hits.withColumn("base", whole.isNotNull()).withColumn("end", F.coalesce(whole, "token_end")).where(F.col("base") | ~crossed)
    hits = hits.withColumn("value", F.col("t").substr(F.col("start") + 1, F.col("end") - F.col("start")))
    hits = hits.where(F.col("base") | (F.length("value") >= 4) & F.col("value").rlike("[0-9]"))
    hits = hits.where(F.col("front").rlike("[:=#]") | ~F.col("value").rlike(r"^[\p{L}_-]{2,}+[:=#]."))  # such a value has a cue of its own
    cue = F.lower(F.trim(F.regexp_replace("front", r"\s++", " ")))
    return hits.select("key", cue.alias("cue"), "value", "start", "end", "base", (F.col("base") | F.col("value").rlike(SECRET)).alias("seed"))


def bootstrap(graph: DataFrame, rounds: int = 3, least_score: float = 0.5, least_support: float = 3.0) -> DataFrame:
    """cue, support and confidence of the cues to trust. graph: cue, value, seed, each pair once."""
    values = graph.groupBy("value").agg(F.max("seed").alias("seed")).select("value", F.col("seed").cast("double").alias("score"), "seed")
    for k in range(rounds):
        scored = graph.select("cue", "value").join(values, "value").groupBy("cue").agg(F.sum("score").alias("support"), F.count(F.lit(1)).alias("n"))
        scored = scored.select("cue", "support", (F.col("support") / (F.col("n") + 1)).alias("confidence"))
        trusted = written(scored.where((F.col("support") >= least_support) & (F.col("confidence") >= least_score)))
        if k + 1 == rounds:
            break
        reached = graph.select("cue", "value").join(trusted, "cue").groupBy("value").agg(F.max("confidence").alias("reached"))
        score = F.when(F.col("seed"), 1.0).otherwise(F.greatest("score", F.coalesce("reached", F.lit(0.0))))
        values = written(values.join(reached, "value", "left").select("value", score.alias("score"), "seed"))
    return trusted


def candidate_graph(hits: DataFrame, least_support: float) -> DataFrame:
    """The different pairs of cue and value. Cues with fewer values than the support they need can never be trusted, and are left out."""
    graph = hits.groupBy("cue", "value").agg(F.max("seed").alias("seed"))
    return graph.join(graph.groupBy("cue").count().where(F.col("count") >= least_support).select("cue"), "cue", "left_semi")


def find_pii(docs: DataFrame, rounds: int = 3, least_score: float = 0.5, least_support: float = 3.0, name: str = "spans") -> DataFrame:
    """docs with a column of spans."""
    text = F.coalesce("text", F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("n"))
    hits = written(cue_hits(docs, key).distinct())
    trusted = bootstrap(written(candidate_graph(hits, least_support)), rounds, least_score, least_support)
    coded_span = F.struct("start", F.lit(KINDS.index("cue")).alias("k"), "end")
    extra = written(hits.where(~F.col("base")).join(trusted.select("cue"), "cue").groupBy("key").agg(F.collect_set(coded_span).alias("extra")))
    based = docs.withColumn(name, base_spans(text))
    if extra.limit(1).count() == 0:
        return based
    # Only texts that hold a digit can have more; the others need no join.
    plain = based.where(~text.rlike("[0-9]"))
    k, e = free(based, "_key"), free(based, "_extra")
    rest = based.where(text.rlike("[0-9]")).withColumn(k, key)
    joined = rest.join(extra.select(F.col("key").alias(k), F.col("extra").alias(e)), k, "left")
    both = F.when(F.col(e).isNull(), F.col(name)).otherwise(as_spans(F.concat(coded(F.col(name)), F.col(e))))
    return plain.unionByName(joined.withColumn(name, both).select(*[F.col(f"`{c}`") for c in plain.columns]))


def redact(docs: DataFrame, **params) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, of the first one's kind. n_chars follows the text."""
    spans = free(docs, "_spans")
    found = find_pii(docs, name=spans, **params)
    text = F.coalesce("text", F.lit(""))
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"))
        ),
    )
    changed = F.size(spans) > 0
    clean = F.when(changed, F.concat(folded["out"], text.substr(folded["at"] + 1, F.length(text)))).otherwise(F.col("text"))
    columns = {"text": clean.alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length(clean).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])
