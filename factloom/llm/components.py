"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: neighbours move to the least neighbour (small: only those below the centre).

    A centre's least neighbour is an aggregate that is joined back, so a hub
    with many neighbours is never gathered in one place.
    """
    e = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = e.join(least, "u")
    if small:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(space: Workspace, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): every node of an edge (u, v) with the least node that it reaches.

    Nulls and loops take no part. Each round is written to the shared folder.
    """
    now = space.write(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        # Done when every node has one neighbour below it at most, and none of those has one itself.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        per = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if per.where("below > 1 OR (below > 0 AND above > 0)").isEmpty():
            break
        after = space.write(_star(_star(now, small=False), small=True), "stars")
        space.drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
