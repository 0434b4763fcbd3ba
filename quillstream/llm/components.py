"""Connected components of an edge table, by alternating large-star and small-star rounds in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node points to two others, or both points and is pointed to. Edges lead from greater to lesser nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return bool(seen.where("out > 1 OR out = 1 AND into = 1").agg(F.count(F.lit(1))).first()[0])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) in any direction -> (node, root), root the least node of the component, for every node of an edge.

    A round lets every node point all its greater neighbours to the least one it sees, then all lesser ones; it works
    on minima, so no neighbourhood is ever gathered, and a hub's edges are joined with one row that holds its minimum.
    The rounds end once every node either points to one root or is one, which one count over the nodes tells, without a round that
    changes nothing. Each round is written to the shared folder. Nulls and self links are left out; an empty table gives an empty one.
    """
    now = written(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        if not _unfinished(now):
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Every edge now leads from a greater node to a lesser one; a node keeps its least and passes it to the others.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        now = written(small)
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
