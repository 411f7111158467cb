"""Connected components of a table of links, by alternating minimum labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import materialize


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b (long). (node, label) for each node of a link, the label the smallest node that it
    reaches. Links are rewritten round by round, each node linked to the smallest of its
    neighbourhood (large-star, then small-star), until nothing changes: about log2 of the longest
    path in rounds, and never more links than at first. Each round is a table of its own, so
    a lost executor costs one round at most. A hot node is pre-aggregated by minimum."""
    both = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(both, "links")
    while True:
        # large star: larger neighbours of a node are linked to the smallest neighbour (or itself)
        all_ways = now.select(F.col("a").alias("n"), F.col("b").alias("m")).union(now.select(F.col("b"), F.col("a")))
        least = all_ways.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("least"))
        large = now.join(least.withColumnRenamed("n", "b"), "b").select("a", F.col("least").alias("b")).distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of these
        small_least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(small_least.select("a", F.col("least").alias("b"))).filter("a != b").distinct()
        after = materialize(small, "links")
        changed = after.join(now, ["a", "b"], "left_anti").limit(1).count() or now.join(after, ["a", "b"], "left_anti").limit(1).count()
        now = after
        if not changed:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
