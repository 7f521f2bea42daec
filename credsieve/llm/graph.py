"""Connected components of a graph that is held in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u long, v long): nodes have the same root where a path joins them.

    Every round each node points to the least node beside it, the graph is contracted along the pointers and written to
    the shared folder. Rounds take the order of the numbers first, under which a star falls in one round, then every
    second round an order by a hash, under which any graph shrinks by a constant factor. Self-links and repeated links
    do no harm; nulls are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    left, path = stash(_tidy(edges), "edges")
    steps: list[DataFrame] = []
    turn = 0
    while not left.isEmpty():
        near = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if turn < 2 or turn % 2:
            low = near.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        else:
            rank = F.xxhash64(F.col("v"), F.lit(turn))
            low = near.unionByName(left.select("u", F.col("u").alias("v"))).unionByName(left.select(F.col("v").alias("u"), "v"))
            low = low.groupBy("u").agg(F.min_by("v", rank).alias("to"))
        step, _ = stash(low, "steps")
        steps.append(step)
        a, b = step.select("u", F.col("to").alias("a")), step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        shrunk = left.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        before = path
        left, path = stash(_tidy(shrunk), "edges")
        forget(spark, before)
        turn += 1
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    out = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for k, step in enumerate(steps[1:]):
        then = step.select(F.col("u").alias("root"), F.col("to").alias("next"))
        out = out.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    # Pointers of one round form trees of depth over one where the least neighbour has a lesser one itself; the last
    # round leaves no edge, so by then each component has one root.
    return out


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
