"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins on the edge list; the list is
written to the shared scratch folder after a round, so lineage stays short. A
hub with very many neighbours is a skewed join key, which the runtime splits;
its minimum is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockyard.llm.common import stored


def _toward_least(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on (a, b) with a > b: hang neighbours on the least one."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least.select("a", F.least("a", "m").alias("m")), "a")
    if small:           # neighbours are all smaller than a
        hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            joined.select("a", F.col("m").alias("b")))
    else:               # only larger neighbours move
        hung = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.filter("a > b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): every node that has an edge, with the least node it reaches.

    ``edges``: (a, b) longs in any order; loops and repeats do no harm.
    """
    def state(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    current = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .distinct(), name)
    before = state(current)
    while before[0]:
        current = stored(_toward_least(_toward_least(current, small=False), small=True), name)
        now = state(current)
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
