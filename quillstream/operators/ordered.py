"""Budgets, last rows, ranking, retention, ordered sets and joins over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir

Keys = list[str]


def keep_within_budget(rows: DataFrame, key: Keys, newest_first: list[Column], cost: str, budget: float) -> DataFrame:
    """Newest rows while their costs sum to at most the budget; the first overflow ends it (costs must not be negative)."""
    w = Window.partitionBy(*key).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(cost).over(w)).where(F.col("running") <= budget)


def last_turns(rows: DataFrame, key: Keys, order: str, most: int = 8, first: int = 2, last: int = 6) -> DataFrame:
    """Keys with more than ``most`` rows keep their first and last ones."""
    w = Window.partitionBy(*key)
    r, n = F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w)
    return rows.withColumns({"_r": r, "_n": n}).where((F.col("_n") <= most) | (F.col("_r") <= first) | (F.col("_r") > F.col("_n") - last)).drop("_r", "_n")


def turn_pairs(turns: DataFrame, key: Keys, order: str, role: str, text: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it at once: key, pair, user_text, assistant_text."""
    w = Window.partitionBy(*key).orderBy(order)
    paired = turns.withColumns({"_role": F.lead(role).over(w), "_text": F.lead(text).over(w)}).where((F.col(role) == "user") & (F.col("_role") == "assistant"))
    return paired.select(*key, (F.row_number().over(w) - 1).alias("pair"), F.col(text).alias("user_text"), F.col("_text").alias("assistant_text"))


def last_full_pairs(pairs: DataFrame, key: Keys, last: int = 5) -> DataFrame:
    """The last pairs first, then only those with both texts."""
    w = Window.partitionBy(*key).orderBy(F.desc("pair"))
    kept = pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).drop("_r")
    return kept.where((F.trim(F.coalesce("user_text", F.lit(""))) != "") & (F.trim(F.coalesce("assistant_text", F.lit(""))) != ""))


def last_non_empty(rows: DataFrame, key: Keys, order: str, text: str, split: Column) -> DataFrame:
    """Of each key's newest row, the last part that is not blank."""
    newest = rows.groupBy(*key).agg(F.max_by(text, order).alias(text))
    parts = F.filter(split, lambda s: F.trim(s) != "")
    return newest.select(*key, F.when(F.size(parts) > 0, F.element_at(parts, -1)).alias("last_part"))


def context_words(text: Column, most: int = 25) -> Column:
    """The last words in their order."""
    w = F.filter(F.split(text, r"[ \t\r\n\f]+"), lambda x: x != "")
    return F.array_join(F.when(F.size(w) > most, F.slice(w, -most, most)).otherwise(w), " ")


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank over all rows without a single-partition window: rows are range-partitioned by the order, and each partition's ranks
    go on from the number of rows before it."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    shared_dir(spark)
    placed = placed.checkpoint()  # ids must not change when a lost partition is made anew
    per = placed.groupBy("_p").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n")).orderBy("_p").collect()  # a row per partition
    before, table = 0, []
    for r in per:
        table.append((r["_p"], r["_first"], before))
        before += r["_n"]
    offsets = spark.createDataFrame(table, "_p int, _first long, _before long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_i") - F.col("_first") + F.col("_before") + 1).drop("_p", "_i", "_first", "_before")


def top_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def top_k_per(rows: DataFrame, key: Keys, k: int, order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(name) <= k)


def best_per_group(rows: DataFrame, key: Keys, score: str, first: list[str]) -> DataFrame:
    """The row with the greatest score of each key; the first one wins ties. An aggregate, so a hot key is combined before the shuffle."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(F.col(score), *[-F.col(c) for c in first]))
    return rows.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def ordered_distinct(rows: DataFrame, value: Keys, order: str) -> DataFrame:
    """Each value once, with the place of its first appearance."""
    return rows.groupBy(*value).agg(F.min(order).alias("first_seen"))


def path_distinct(text: Column, separator: str = ";") -> Column:
    return F.array_join(F.array_distinct(F.filter(F.split(text, separator), lambda x: x != "")), separator)


def keep_newest(rows: DataFrame, key: Keys, order: list[Column], most: int) -> DataFrame:
    return top_k_per(rows, key, most, order, "_r").drop("_r")


def within_age(rows: DataFrame, name: str, today: str, days: int = 14, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Rows whose name is no date stay; dates older than so many days go."""
    day = F.try_to_date(F.col(name), pattern)
    return rows.where(day.isNull() | (day >= F.date_sub(F.to_date(F.lit(today)), days)))


def latest_by_suffix(rows: DataFrame, key: Keys, name: str, suffix: str) -> DataFrame:
    return rows.where(F.col(name).endswith(suffix)).groupBy(*key).agg(F.max(name).alias(name))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def interval_first_match(points: DataFrame, segments: DataFrame, key: Keys, at: str, start: str, end: str, num: str, width: int = 64) -> DataFrame:
    """For each point the first segment (by ``num``) that holds it, else 0. Both sides meet in buckets of the time line, so the join is
    an equi-join and a long segment is spread over its buckets. The segments of a bucket are one sorted array, so each point, repeated or not,
    meets one row at most and points are never grouped."""
    cut = segments.select(*key, F.struct(F.col(num).alias("n"), F.col(start).alias("s"), F.col(end).alias("e")).alias("_c"))
    cut = cut.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_c.s") / width), F.floor(F.col("_c.e") / width))))
    held = cut.groupBy(*key, "_b").agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    joined = points.withColumn("_b", F.floor(F.col(at) / width)).join(held, [*key, "_b"], "left")
    hit = F.get(F.filter("_c", lambda x: (F.col(at) >= x["s"]) & (F.col(at) <= x["e"])), F.lit(0))
    return joined.select(*points.columns, F.coalesce(hit["n"], F.lit(0)).alias("segment_num"))


def batch_queue(rows: DataFrame, key: Keys, order: Keys, size: int) -> DataFrame:
    """Rows in batches of up to ``size`` in order of arrival: adds batch (from 0) and slot (place in the batch, from 0)."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return rows.withColumn("_at", at).withColumns({"batch": F.floor(F.col("_at") / size).cast("long"), "slot": (F.col("_at") % size).cast("int")}).drop("_at")


def previous_row(rows: DataFrame, key: Keys, order: Keys, columns: Keys) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def late_drop(packets: DataFrame, key: Keys, arrival: Keys, seq: str) -> DataFrame:
    """Only packets whose number exceeds all before them."""
    w = Window.partitionBy(*key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("_seen", F.max(seq).over(w)).where(F.col("_seen").isNull() | (F.col(seq) > F.col("_seen"))).drop("_seen")


def utterance_groups(rows: DataFrame, key: Keys, order: Keys, utterance: str, text: str) -> DataFrame:
    """A key's rows between changes of the utterance id, joined in order."""
    from .frames import mark_runs

    marked = mark_runs(rows, key, order, F.col(utterance), "group")
    item = F.struct(*order, F.col(text).alias("_t"))
    return marked.groupBy(*key, "group", utterance).agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_t"]), " ").alias("joined"))


def zip_columns(rows: DataFrame, left: str, right: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Two array columns side by side; the shorter one ends it."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.zip_with(F.slice(left, 1, n), F.slice(right, 1, n), lambda a, b: F.struct(a.alias(names[0]), b.alias(names[1])))
    return rows.select("*", F.posexplode(pairs).alias("pos", "_p")).select(*[c for c in rows.columns], "pos", "_p.*")


def lookup(rows: DataFrame, table: DataFrame, key: Keys, defaults: dict[str, Column]) -> DataFrame:
    return rows.join(table, key, "left").withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})
