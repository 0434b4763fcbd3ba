"""Aggregates: confidence, statistics, votes, latency, roll-ups, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = list[str]


def series_stats(rows: DataFrame, key: Keys, value: str) -> DataFrame:
    """count, mean, max, min, population deviation and median of each key."""
    return rows.groupBy(*key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_pop(value).alias("std"), F.median(value).alias("median")
    )


def signal_stats(rows: DataFrame, key: Keys, order: Keys, value: str) -> DataFrame:
    """rms, peak and zero crossing rate of each key's ordered samples."""
    w = Window.partitionBy(*key).orderBy(*order)
    crossed = rows.withColumn("_z", F.abs(F.signum(F.col(value)) - F.lag(F.signum(F.col(value))).over(w)))
    return crossed.groupBy(*key).agg(
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("peak"), (F.coalesce(F.sum("_z"), F.lit(0.0)) / (2 * F.count(F.lit(1)))).alias("zcr")
    )


def framed_rms(rows: DataFrame, key: Keys, index: str, value: str, hop: int) -> DataFrame:
    return rows.groupBy(*key, F.floor(F.col(index) / hop).alias("frame")).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def summary(rows: DataFrame, duration: str, prob: str, energy: str) -> DataFrame:
    """One row; zeros if there are no rows."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("segments"), zero(F.sum(duration)).alias("total"), zero(F.avg(duration)).alias("avg_duration"), zero(F.avg(prob)).alias("avg_prob"), zero(F.avg(energy)).alias("avg_rms"))


def weighted_mean(value: str, weight: Column) -> Column:
    return F.try_divide(F.sum(F.col(value) * weight), F.sum(weight))


def token_weighted_logprob(rows: DataFrame, key: Keys, logprob: str, tokens: Column) -> DataFrame:
    """Mean log probability weighted by tokens (at least one each), and its exponential."""
    mean = weighted_mean(logprob, F.greatest(tokens, F.lit(1)))
    return rows.groupBy(*key).agg(mean.alias("avg_logprob")).withColumn("confidence", F.exp("avg_logprob"))


def clipped_probability(rows: DataFrame, key: Keys, logprob: str, low: float = -5.0, high: float = 0.0) -> DataFrame:
    clipped = F.least(F.greatest(F.col(logprob), F.lit(low)), F.lit(high))
    return rows.groupBy(*key).agg((F.avg(F.exp(clipped)) * 100).alias("confidence"))


def llm_logprob(rows: DataFrame, key: Keys, logprob: str) -> DataFrame:
    """Mean, confidence = (mean + 3) / 3 within [0, 1], and a label."""
    out = rows.groupBy(*key).agg(F.avg(logprob).alias("mean_logprob"))
    out = out.withColumn("confidence", F.least(F.greatest((F.col("mean_logprob") + 3) / 3, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("label", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))


def logit_stats(rows: DataFrame, logits: str, risky: float = 0.5) -> DataFrame:
    """Per row of logits: greatest probability, entropy and surprisal of the likeliest entry, and whether it is risky."""
    top = F.array_max(F.col(logits))
    exps = F.transform(F.col(logits), lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    probs = F.transform("_e", lambda x: x / F.col("_t"))
    out = rows.withColumn("_e", exps).withColumn("_t", total).withColumn("_p", probs)
    entropy = F.aggregate("_p", F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    out = out.withColumns({"max_prob": F.array_max("_p"), "entropy": entropy})
    return out.withColumns({"surprisal": -F.log("max_prob"), "is_risky": F.col("max_prob") < risky}).drop("_e", "_t", "_p")


def speaker_scores(rows: DataFrame, speaker: str, frame: str, score: str) -> tuple[DataFrame, DataFrame]:
    """Per speaker: greatest, mean, share above 0.5. Per frame: greatest and whether speakers overlap (scores sum above 1.1)."""
    per_speaker = rows.groupBy(speaker).agg(F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.avg((F.col(score) > 0.5).cast("double")).alias("active_share"))
    per_frame = rows.groupBy(frame).agg(F.max(score).alias("max_score"), (F.sum(score) > 1.1).alias("overlap"))
    return per_speaker, per_frame


def coverage(rows: DataFrame, duration: str, total: float) -> DataFrame:
    covered = F.coalesce(F.sum(duration), F.lit(0.0))
    return rows.agg((covered / total * 100 if total > 0 else F.lit(0.0)).alias("coverage_pct"))


def map_of_lists(rows: DataFrame, key: Keys, label: str, value: str, order: str) -> DataFrame:
    """Per key and label, its different values in the order of their first appearance."""
    seen = rows.groupBy(*key, label, value).agg(F.min(order).alias("_o"))
    return seen.groupBy(*key, label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))


def column_vote(rows: DataFrame, columns: Keys, order: str, first: int = 50, words: int = 3) -> DataFrame:
    """Per column, how many of its first non-empty values look like sentences (more than so many words and a letter); a column named
    reference wins outright."""
    long = rows.select(order, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([order], columns, "column", "value")
    full = long.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    ranked = full.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(order))).where(F.col("_r") <= first)
    vote = (F.size(F.filter(F.split("value", r"[ \t\r\n\f]+"), lambda w: w != "")) > words) & F.col("value").rlike(r"\p{L}")
    return ranked.groupBy("column").agg(F.count_if(vote).alias("votes"), F.count(F.lit(1)).alias("checked")).withColumn("wins", F.col("column") == "reference")


def llm_latency(tokens: DataFrame, request: str, time: str, started: str, prompt_tokens: str) -> DataFrame:
    """Per request: time to the first token, decoding and prompt speed, latency, throughput; null where a time is zero."""
    out = tokens.groupBy(request).agg(F.min(time).alias("_a"), F.max(time).alias("_b"), F.min(started).alias("_s"), F.count(F.lit(1)).alias("completion_tokens"), F.max(prompt_tokens).alias("_p"))
    seconds = lambda x, y: F.col(y) - F.col(x)
    return out.select(
        request, "completion_tokens", seconds("_s", "_a").alias("ttft"), seconds("_s", "_b").alias("latency"),
        F.try_divide((F.col("completion_tokens") - 1).cast("double"), seconds("_a", "_b")).alias("decode_tps"), F.try_divide(F.col("_p").cast("double"), seconds("_s", "_a")).alias("prompt_tps"),
        F.try_divide((F.col("completion_tokens") + F.col("_p")).cast("double"), seconds("_s", "_b")).alias("total_tps"),
    )


def directory_rollup(files: DataFrame, path: str, size: str, separator: str = "/") -> DataFrame:
    """Bytes of each folder: of its own files, and with all folders below it."""
    parts = F.split(path, separator)
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), separator).alias("dir"), (n == F.size(parts) - 1).alias("own")))
    spread = files.select(F.explode(up).alias("u"), F.col(size).alias("_s"))
    return spread.groupBy(F.col("u.dir").alias("dir")).agg(F.sum(F.when(F.col("u.own"), F.col("_s")).otherwise(0)).alias("direct_bytes"), F.sum("_s").alias("total_bytes"), F.count(F.lit(1)).alias("files"))


def joined_distinct(rows: DataFrame, key: Keys, value: str, separator: str = ", ") -> DataFrame:
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(value)), lambda x: x.cast("string")), separator).alias("joined"))


def stream_counters(rows: DataFrame, client: str, utterance: str) -> DataFrame:
    return rows.agg(F.countDistinct(client).alias("clients"), F.countDistinct(client, utterance).alias("utterances"), F.count(F.lit(1)).alias("chunks"))


# --- evaluation --------------------------------------------------------------------------------------------------------


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn; precision, recall and F1 are null where their denominators are zero."""
    hit = lambda t, p: F.count_if((truth == t) & (predicted == p))
    out = rows.agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(False, False).alias("tn"), hit(True, False).alias("fn"))
    out = out.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def eer_sweep(trials: DataFrame, distance: str, same: str, steps: int = 1000, top: float = 2.0) -> DataFrame:
    """The first threshold of an even grid at which false acceptance and false rejection differ least, with gap and mean rate.

    Trials are first counted per grid cell, so the sweep is a running sum over at most ``steps`` rows, whatever their number."""
    spark = trials.sparkSession
    cell = F.least(F.greatest(F.floor(F.col(distance) / (top / (steps - 1))) + 1, F.lit(0)), F.lit(steps)).cast("int")
    cells = trials.where(F.col(distance).isNotNull()).groupBy(cell.alias("k")).agg(F.count_if(F.col(same)).alias("pos"), F.count_if(~F.col(same)).alias("neg"))
    # The last cell holds what no threshold reaches; totals and running sums are windows over these rows alone.
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("k"), (F.col("id") * (top / (steps - 1))).alias("threshold"))
    w = Window.orderBy("k")
    so_far, every = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    swept = grid.join(cells, "k", "left").na.fill(0, ["pos", "neg"])
    swept = swept.withColumns({"tp": F.sum("pos").over(so_far), "fp": F.sum("neg").over(so_far), "p": F.sum("pos").over(every), "n": F.sum("neg").over(every)}).where(F.col("k") < steps)
    rates = swept.withColumns({"far": F.try_divide(F.col("fp").cast("double"), F.col("n")), "frr": 1 - F.try_divide(F.col("tp").cast("double"), F.col("p"))})
    rates = rates.withColumn("gap", F.abs(F.col("far") - F.col("frr")))
    best = F.min_by(F.struct("threshold", "far", "frr", "gap"), F.struct("gap", "k"))
    return rates.where("gap IS NOT NULL").agg(best.alias("b")).select(F.col("b.threshold").alias("threshold"), F.col("b.gap").alias("gap"), ((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"))


def character_error_rate(reference: Column, prediction: Column) -> Column:
    return F.when(F.length(reference) > 0, F.levenshtein(reference, prediction) / F.length(reference))


def word_error_rate(reference: Column, prediction: Column) -> Column:
    """Words become single characters by their place in the two texts' vocabulary, so the built-in edit distance counts words.

    Each step hands its result on as a struct field, so that it is worked out once and not for every word. The two texts may hold a
    million different words; the places that UTF-16 keeps for surrogates are left out."""
    split = lambda t: F.filter(F.split(t, r"[ \t\r\n\f]+"), lambda w: w != "")
    once = lambda c, then: F.element_at(F.transform(F.array(c), then), 1)

    def spelled(ws: Column, places: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: code_point(word_place(F.element_at(places, w)))), "")

    def rate(s: Column) -> Column:
        return F.when(F.size(s["a"]) > 0, F.levenshtein(spelled(s["a"], s["p"]), spelled(s["b"], s["p"])) / F.size(s["a"]))

    def placed(s: Column) -> Column:
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), F.map_from_entries(F.transform(s["n"], lambda w, k: F.struct(w, k))).alias("p"))

    named = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_distinct(F.concat(s["a"], s["b"])).alias("n"))
    start = F.struct(split(F.coalesce(reference, F.lit(""))).alias("a"), split(F.coalesce(prediction, F.lit(""))).alias("b"))
    return once(start, lambda s: once(named(s), lambda t: once(placed(t), rate)))


def word_place(k: Column) -> Column:
    """A code point for the k-th word: from 0x4E00 on, without 0xD800 to 0xDFFF."""
    n = k + 0x4E00
    return F.when(n < 0xD800, n).otherwise(n + 0x800)


def code_point(n: Column) -> Column:
    """The character of a code point from 0x800 on, by its three or four UTF-8 bytes."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    part = lambda bits: F.shiftright(n, bits).bitwiseAND(63) + 0x80
    three = [F.shiftright(n, 12) + 0xE0, part(6), part(0)]
    four = [F.shiftright(n, 18) + 0xF0, part(12), part(6), part(0)]
    return F.decode(F.unhex(F.when(n < 0x10000, F.concat(*map(byte, three))).otherwise(F.concat(*map(byte, four)))), "UTF-8")


def best_throughput(trials: DataFrame, key: list[str], size: str, items: str, seconds: str, memory: str, limit: float) -> DataFrame:
    """The batch size of the greatest items per second of each key among trials within the memory limit; the lesser size wins ties, and 1 stands where no trial fits."""
    rate = F.col(items) / F.col(seconds)
    fits = (F.col(memory) <= limit) & (F.col(seconds) > 0)
    best = F.max_by(F.struct(F.col(size).alias("s"), rate.alias("r")), F.when(fits, F.struct(rate, -F.col(size))))
    any_fits = F.max(fits.cast("int")) == 1
    chosen = trials.groupBy(*key).agg(F.when(any_fits, best).alias("b"))
    return chosen.select(*key, F.coalesce(F.col("b.s").cast("long"), F.lit(1).cast("long")).alias("batch_size"), F.coalesce("b.r", F.lit(0.0)).alias("throughput"))


def mean_valid(rows: DataFrame, value: str) -> DataFrame:
    """Mean without nulls and NaN, and how many were valid."""
    good = F.when(~F.isnan(value), F.col(value))
    return rows.agg(F.avg(good).alias("mean"), F.count(good).alias("valid"))
