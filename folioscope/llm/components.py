"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, component), component being the least id reachable; run until nothing changes.

    Each step is a grouped minimum (combined before its shuffle) and a join of the
    edges with one row for each id. A hub's edges are the long side of that join, which
    adaptive execution splits; rounds grow with the logarithm of the longest path. The
    result is a written table; each round's edges go once the next are written.
    """
    edges = session.kept_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v"), F.col("u"), "m")
        after = session.kept_table(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        session.drop(edges)
        edges = after
