"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (columns a, b).

    Each round every node takes the smallest root among its neighbours, and then the root of that root, so the number of
    rounds follows the logarithm of the longest path. Minima are combined before the shuffle, and the state is written
    each round, so a busy node is no hot task and a lost executor costs one round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = state.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        up = state.select(F.col("node").alias("next"), F.col("root").alias("up"))
        fresh = stored(step.join(up, "next", "left").select("node", F.col("root").alias("old"), F.least("next", F.coalesce("up", "next")).alias("root")), "roots")
        done = fresh.filter("old <> root").isEmpty()
        state = fresh.select("node", "root")
        if done:
            return state
