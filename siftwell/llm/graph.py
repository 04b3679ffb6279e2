"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its smallest reachable node, itself included) for every node of an edge (columns a, b).

    Each round shortens the paths to a component's smallest node; the number of rounds grows with the
    logarithm of the longest path. Neighbourhoods are reduced by ``min`` (pre-aggregated), never gathered.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialise(pairs, name)
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the joins meet plain shuffles, which may be split where a node has very many neighbours
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        before, pairs = pairs, materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        forget(before, least, large, low)
        now = _state(pairs)
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(pairs: DataFrame) -> tuple:
    r = pairs.agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h")).first()
    return r["n"], r["h"]
