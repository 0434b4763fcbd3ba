"""Runs in ordered rows: segments, waves, pauses, merges, windows over frames.

Every operator takes a key (one or more columns) and a total order, and partitions by the key alone, so streams are
worked on side by side. A run is found by a running sum over change marks, never by a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = list[str]


def frame_index(df: DataFrame, key: Keys, order: Keys, name: str = "frame_idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def mark_runs(df: DataFrame, key: Keys, order: Keys, value: Column, name: str = "run") -> DataFrame:
    """Number the runs of rows with equal values, from 0 in each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn(name, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_c")


def number(df: DataFrame, key: Keys, order: Keys, name: str = "num") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def threshold_runs(frames: DataFrame, key: Keys, flag: Column, score: str, least_frames: int = 1) -> DataFrame:
    """Runs of frames whose flag holds: frame_start, frame_end (inclusive), frames, mean_prob, std_prob (0 for one frame), min, max."""
    marked = mark_runs(frames.withColumn("_f", F.coalesce(flag, F.lit(False))), key, ["frame_idx"], F.col("_f"))
    runs = marked.where("_f").groupBy(*key, "run").agg(
        F.min("frame_idx").alias("frame_start"), F.max("frame_idx").alias("frame_end"), F.count(F.lit(1)).alias("frames"), F.avg(score).alias("mean_prob"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_prob"), F.min(score).alias("min_prob"), F.max(score).alias("max_prob"),
    )
    return runs.where(F.col("frames") >= least_frames).drop("run")


def merge_gaps(segments: DataFrame, key: Keys, max_gap: int, least_frames: int = 0, start: str = "frame_start", end: str = "frame_end", same: str | None = None, replace_end: bool = False) -> DataFrame:
    """Join neighbours whose gap (start - previous end - 1 in frames) is below ``max_gap``, then drop short ones.

    same: neighbours must also agree in this column. replace_end: the end is that of the last one merged, even if
    an earlier one ends later."""
    w = Window.partitionBy(*key).orderBy(start, end)
    gap = F.col(start) - F.lag(end).over(w) - 1
    breaks = F.coalesce(gap >= max_gap, F.lit(True))
    if same:
        breaks = breaks | ~F.col(same).eqNullSafe(F.lag(same).over(w))
    grouped = segments.withColumn("_b", breaks.cast("int")).withColumn("_g", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(end, F.struct(start, end)) if replace_end else F.max(end)
    merged = grouped.groupBy(*key, "_g", *([same] if same else [])).agg(F.min(start).alias(start), last.alias(end), F.count(F.lit(1)).alias("parts")).drop("_g")
    return merged.where(F.col(end) - F.col(start) + 1 >= least_frames)


def complement(segments: DataFrame, key: Keys, bounds: DataFrame, least: int = 1, start: str = "frame_start", end: str = "frame_end") -> DataFrame:
    """What lies before, between and behind the segments (inclusive frames). bounds: key, first, last."""
    w = Window.partitionBy(*key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    between = segments.join(bounds, key).withColumn("_s", F.coalesce(seen + 1, F.col("first"))).select(*key, F.col("_s").alias(start), (F.col(start) - 1).alias(end))
    behind = bounds.join(segments.groupBy(*key).agg(F.max(end).alias("_e")), key, "left").select(*key, F.coalesce(F.col("_e") + 1, F.col("first")).alias(start), F.col("last").alias(end))
    return between.unionByName(behind).where(F.col(end) - F.col(start) + 1 >= least)


def speech_waves(frames: DataFrame, key: Keys, score: str = "prob", threshold: float = 0.5, prominence: float = 0.05, excursion: float = 0.04, peak: float = 0.55, least: int = 3) -> DataFrame:
    """Runs at or above the threshold with their rise, fall, and whether their shape is prominent.

    A run that begins at the first frame has not risen and one that reaches the last frame has not fallen; neither is valid."""
    w = Window.partitionBy(*key).orderBy("frame_idx")
    edged = frames.withColumns({"_before": F.lag(score).over(w), "_after": F.lead(score).over(w), "_f": F.coalesce(F.col(score) >= threshold, F.lit(False))})
    marked = mark_runs(edged, key, ["frame_idx"], F.col("_f")).where("_f")
    waves = marked.groupBy(*key, "run").agg(
        F.min("frame_idx").alias("frame_start"), (F.max("frame_idx") + 1).alias("frame_end"), F.count(F.lit(1)).alias("frame_len"),
        F.min(score).alias("min_prob"), F.max(score).alias("max_prob"), F.avg(score).alias("avg_prob"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_prob"),
        F.min_by("_before", "frame_idx").alias("entry_prob"), F.max_by("_after", "frame_idx").alias("exit_prob"),
    ).drop("run")
    edge = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    waves = waves.withColumns({
        "has_risen": F.col("entry_prob").isNotNull(), "has_multi_passed": F.col("frame_len") > 1, "has_fallen": F.col("exit_prob").isNotNull(),
        "prominence": F.col("max_prob") - (edge("entry_prob") + edge("exit_prob")) / 2, "excursion": F.col("max_prob") - F.least(F.col("min_prob"), edge("entry_prob"), edge("exit_prob")),
    })
    shaped = (F.col("prominence") >= prominence) & (F.col("excursion") >= excursion) & (F.col("max_prob") >= peak) & (F.col("frame_len") >= least)
    return waves.withColumn("is_valid", F.col("has_risen") & F.col("has_multi_passed") & F.col("has_fallen") & shaped)


def top_waves(waves: DataFrame, k: int = 5, duration_weight: float = 0.5, hop_sec: float = 0.01, order: Keys | None = None) -> DataFrame:
    """The k waves with the greatest prominence x ln(1 + weight x duration)."""
    scored = waves.withColumn("score", F.col("prominence") * F.log1p(duration_weight * F.col("frame_len") * hop_sec))
    return scored.orderBy(F.desc("score"), *(order or [])).limit(k)


def pauses(frames: DataFrame, key: Keys, energy: str, threshold: float, least_frames: int, include_open: bool = False) -> DataFrame:
    """Runs below the threshold of at least so many frames. A pause that is open at the end counts only if asked for."""
    total = frames.groupBy(*key).agg(F.max("frame_idx").alias("_last"))
    runs = threshold_runs(frames, key, F.col(energy) < threshold, energy, least_frames)
    return runs if include_open else runs.join(total, key).where("frame_end < _last").drop("_last")


def hangover_bounds(frames: DataFrame, key: Keys, voiced: Column, hangover: int = 13) -> DataFrame:
    """The first utterance of each key: it ends ``hangover`` frames behind the last voiced frame before a longer break; a key without
    voiced frames gives its whole range."""
    size = frames.groupBy(*key).agg((F.max("frame_idx")).alias("_last"))
    w = Window.partitionBy(*key).orderBy("frame_idx")
    only = frames.where(voiced).select(*key, "frame_idx")
    only = only.withColumn("_b", F.coalesce((F.col("frame_idx") - F.lag("frame_idx").over(w) > hangover).cast("int"), F.lit(0)))
    first = only.withColumn("_g", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_g = 0")
    found = first.groupBy(*key).agg(F.min("frame_idx").alias("_s"), F.max("frame_idx").alias("_e"))
    return size.join(found, key, "left").select(*key, F.coalesce("_s", F.lit(0)).alias("frame_start"), F.coalesce(F.least(F.col("_e") + hangover, F.col("_last")), F.col("_last")).alias("frame_end"))


def clip_overlaps(segments: DataFrame, key: Keys, start: str, end: str, tie: Keys) -> DataFrame:
    """The earliest segment wins: what ends by the greatest end so far goes, and what begins before it is clipped."""
    w = Window.partitionBy(*key).orderBy(start, *tie)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = segments.withColumn("_seen", seen).where(F.col("_seen").isNull() | (F.col(end) > F.col("_seen")))
    return kept.withColumn(start, F.greatest(F.col(start), F.col("_seen"))).drop("_seen")


def text_runs(rows: DataFrame, key: Keys, order: Keys, text: str, time: str, least_length: int = 0, least_duration: float = 0.0) -> DataFrame:
    """Consecutive rows of one text become one: it ends where the next run begins, the last one at its last row. Blank texts break and go."""
    marked = mark_runs(rows, key, order, F.col(text))
    runs = marked.groupBy(*key, "run").agg(F.first(text).alias(text), F.min(time).alias("start"), F.max(time).alias("_last"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(*key).orderBy("run")
    runs = runs.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("_last")))
    good = (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.length(text) >= least_length) & (F.col("end") - F.col("start") >= least_duration)
    return runs.where(good).drop("_last")


def chunks(rows: DataFrame, size: Column, length: int, overlap: int, mode: str = "pad") -> DataFrame:
    """chunk, start, end (exclusive) and padded of overlapping chunks of a signal of ``size`` samples.

    mode: pad (until the start passes the end; a last chunk under half the length is padded to full), stop (until a chunk reaches
    the end), plain (as pad, without padding), or drop (the first chunk under an eighth of the length ends it)."""
    step = max(length - overlap, length // 2) if mode == "drop" else length - overlap
    if step <= 0:
        raise ValueError("the overlap must be less than the length")
    last = size - 1
    if mode == "stop":
        last = F.greatest(F.lit(0), F.ceil((size - length) / step).cast("long") * step)
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    out = rows.withColumn("_n", size.cast("long")).select("*", F.posexplode(starts).alias("chunk", "start")).withColumn("end", F.least(F.col("start") + length, F.col("_n")))
    short = F.col("end") - F.col("start")
    padded = (short < length // 2 + length % 2) & (mode == "pad")
    if mode == "drop":
        out = out.where(short >= length // 8)
    return out.withColumn("padded", padded).withColumn("samples", F.when(padded, F.lit(length).cast("long")).otherwise(short)).drop("_n")


def full_windows(rows: DataFrame, size: Column, window: int, step: int) -> DataFrame:
    """Only complete windows: start, end and middle."""
    starts = F.when(size >= window, F.sequence(F.lit(0).cast("long"), (size - window).cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    return rows.select("*", F.explode(starts).alias("start")).withColumn("end", F.col("start") + window).withColumn("mid", (F.col("start") + F.col("end")) / 2)


def sub_signals(rows: DataFrame, size: Column, shortest: int, longest: int, step: int) -> DataFrame:
    """All lengths from shortest to longest and all starts, by ``step``."""
    lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), size.cast("int")), F.lit(step))
    some = rows.where(size >= shortest).select("*", F.explode(lengths).alias("length"))
    return some.select("*", F.explode(F.sequence(F.lit(0), size.cast("int") - F.col("length"), F.lit(step))).alias("start"))


def trim_edges(frames: DataFrame, key: Keys, energy: str, least: float) -> DataFrame:
    """From the first to the last frame that is loud enough; keys without one give nothing."""
    bounds = frames.where(F.col(energy) >= least).groupBy(*key).agg(F.min("frame_idx").alias("frame_start"), F.max("frame_idx").alias("frame_end"))
    return bounds.withColumn("frames", F.col("frame_end") - F.col("frame_start") + 1)


def clamp_words(words: DataFrame, word: str, start: str, end: str, least: float = 0.02, most: float = 1.0) -> DataFrame:
    """Word durations within bounds, punctuation the least; the end follows."""
    mark = F.col(word).rlike(r"^[\p{P}\p{S}]+$")
    duration = F.when(mark, F.lit(least)).otherwise(F.least(F.greatest(F.col(end) - F.col(start), F.lit(least)), F.lit(most)))
    return words.withColumn("duration", duration).withColumn(end, F.col(start) + F.col("duration"))


def offset_words(chunk: DataFrame, key: Keys, order: Keys, offset: str, start: str, end: str) -> DataFrame:
    """Words of all chunks on one time line, numbered anew; overlaps stay."""
    moved = chunk.withColumn(start, F.col(start) + F.col(offset)).withColumn(end, F.col(end) + F.col(offset))
    return number(moved, key, order, "index")


def context_tail(rows: DataFrame, key: Keys, order: Keys, text: str, last_rows: int = 3, last_chars: int = 450) -> DataFrame:
    """The last characters of the last texts before each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-last_rows, -1)
    return rows.withColumn("context", F.right(F.array_join(F.collect_list(text).over(w), ""), F.lit(last_chars)))


def progressive_text(rows: DataFrame, key: Keys, order: Keys, text: str) -> DataFrame:
    """The texts so far, joined."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("text_so_far", F.array_join(F.collect_list(text).over(w), ""))


def session_ids(rows: DataFrame, key: Keys, order: Keys, start: str, end: str, reason: str | None = None, gap: float = 3.0, silence: str = "silence") -> DataFrame:
    """A session ends after a gap, or after a row whose reason is silence. Sessions are numbered per key."""
    w = Window.partitionBy(*key).orderBy(*order)
    reset = F.coalesce(F.col(start) - F.lag(end).over(w) > gap, F.lit(False))
    if reason:
        reset = reset | F.coalesce(F.lag(reason).over(w) == silence, F.lit(False))
    return rows.withColumn("_r", reset.cast("int")).withColumn("session", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")


def smooth_centered(frames: DataFrame, key: Keys, order: Keys, value: str, window: int = 5, name: str = "smoothed") -> DataFrame:
    """Sum of the window over its full length, at the edges too; keys shorter than the window stay as they are."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(window // 2), (window - 1) // 2)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return frames.withColumn(name, F.when(n < window, F.col(value)).otherwise(F.sum(value).over(w) / window))


def smooth_trailing(frames: DataFrame, key: Keys, order: Keys, value: str, window: int = 5, name: str = "smoothed") -> DataFrame:
    return frames.withColumn(name, F.avg(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - window, 0)))


def recent_slope(frames: DataFrame, key: Keys, order: Keys, value: str, last: int = 3) -> DataFrame:
    """Mean of the last first differences of each key; 0 for keys with one row."""
    w = Window.partitionBy(*key).orderBy(*order)
    back = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    stepped = frames.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_r", F.row_number().over(back))
    return stepped.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col("_r") <= last, F.col("_d"))), F.lit(0.0)).alias("slope"))


def normalise_by_max(frames: DataFrame, key: Keys, value: str, floor: float = 0.12, name: str = "normalised") -> DataFrame:
    top = F.greatest(F.max(value).over(Window.partitionBy(*key)), F.lit(floor))
    return frames.withColumn(name, F.least(F.greatest(F.col(value) / top, F.lit(0.0)), F.lit(1.0)))


def run_counter(frames: DataFrame, key: Keys, order: Keys, flag: Column, extended: int = 10) -> DataFrame:
    """How many flagged frames in a row so far (0 for others), and whether the run is an extended one."""
    marked = mark_runs(frames.withColumn("_f", flag), key, order, F.col("_f"))
    n = F.row_number().over(Window.partitionBy(*key, "run").orderBy(*order))
    counted = marked.withColumn("run_length", F.when(F.col("_f"), n).otherwise(0))
    return counted.withColumn("is_extended", F.col("run_length") >= extended).drop("_f", "run")


def has_valley(frames: DataFrame, key: Keys, order: Keys, value: str, below: float = 0.65, within: int = 200, least: int = 5) -> DataFrame:
    """Whether a run of at least so many low frames lies within the last frames, the current one included. Run lengths come
    from a running counter, so no window is gathered: a run of ``least`` ends in the window at least ``least`` rows behind its start."""
    counted = run_counter(frames, key, order, F.col(value) < below).drop("is_extended")
    w = Window.partitionBy(*key).orderBy(*order)
    # A run that began before the window counts only with its frames inside.
    inside = F.max(F.when(F.col("run_length") >= least, 1).otherwise(0)).over(w.rowsBetween(-(within - least), 0))
    return counted.withColumn("has_valley", inside == 1).drop("run_length")


def last_low_frame(frames: DataFrame, key: Keys, order: Keys, condition: Column, back: int = 200) -> DataFrame:
    """Index of the last frame before this one, at most ``back`` frames ago, for which the condition holds."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-back, -1)
    return frames.withColumn("last_low", F.max(F.when(condition, F.col("frame_idx"))).over(w))


def mask_segments(frames: DataFrame, key: Keys, active: Column, hop_sec: float, offset: str | None = None) -> DataFrame:
    """Runs of active frames as seconds [start, end), moved by a chunk's offset column."""
    cols = [*key, *([offset] if offset else [])]
    marked = mark_runs(frames.withColumn("_f", F.coalesce(active, F.lit(False))), key, ["frame_idx"], F.col("_f")).where("_f")
    runs = marked.groupBy(*cols, "run").agg(F.min("frame_idx").alias("_a"), (F.max("frame_idx") + 1).alias("_b")).drop("run")
    move = F.col(offset) if offset else F.lit(0.0)
    return runs.withColumn("start", F.col("_a") * hop_sec + move).withColumn("end", F.col("_b") * hop_sec + move).drop("_a", "_b")


def slice_by_time(samples: Column, start: float, end: float | None, rate: int) -> Column:
    """Samples of [start, end) seconds; to the end if it is not given."""
    a = int(start * rate)
    n = F.size(samples) - a if end is None else F.least(F.lit(int(end * rate)), F.size(samples)) - a
    return F.slice(samples, a + 1, F.greatest(n, F.lit(0)))


def finalise(segments: DataFrame, key: Keys, order: Keys, duration: str, least: float = 0.3) -> DataFrame:
    """Segments of at least so many seconds, numbered from 1."""
    return number(segments.where(F.col(duration) >= least), key, order, "num")


def paragraphs(lines: DataFrame, key: Keys, order: str, text: str) -> DataFrame:
    """Runs of non-blank lines: their number, first line and text, each line trimmed."""
    full = F.trim(F.coalesce(text, F.lit(""))) != ""
    marked = mark_runs(lines.withColumn("_f", full), key, [order], F.col("_f")).where("_f")
    item = F.array_sort(F.collect_list(F.struct(order, F.trim(text).alias("_t"))))
    return marked.groupBy(*key, "run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(item, lambda x: x["_t"]), "\n").alias("paragraph")).drop("run")


def last_n(rows: DataFrame, key: Keys, order: Keys, value: str, n: int, name: str = "recent") -> DataFrame:
    """The last n values up to each row, oldest first."""
    return rows.withColumn(name, F.collect_list(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - n, 0)))
