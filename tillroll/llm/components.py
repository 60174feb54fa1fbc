"""Connected components of a table of links, by jobs over written tables; no list of links or nodes reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.lineage import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of a link (a, b); ``component`` is the smallest id that can be reached.

    Each round links every neighbour to the smallest node of its neighbourhood, first towards larger and then towards smaller
    nodes. The number of links doesn't grow, and in a logarithmic number of rounds only stars are left. A node with many
    links is a group of an aggregation that combines on the map side, and of a join that adaptive execution can split.
    """
    now = written(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct())
    before = None
    while True:
        # Large star: neighbours above a node move to the least of its neighbourhood.
        ends = now.select(F.col("lo").alias("at"), F.col("hi").alias("near")).unionByName(
            now.select(F.col("hi").alias("at"), F.col("lo").alias("near")))
        least = ends.groupBy("at").agg(F.least(F.min("near"), F.col("at")).alias("least"))
        large = ends.filter("near > at").join(least, "at").select(F.col("least").alias("lo"), F.col("near").alias("hi"))
        large = large.filter("lo < hi").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        lowest = large.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("least"))
        small = large.join(lowest, large["hi"] == lowest["at"]).select(F.col("least").alias("lo"), F.col("lo").alias("hi"))
        small = small.filter("lo < hi").unionByName(lowest.select(F.col("least").alias("lo"), F.col("at").alias("hi")))
        now = written(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(
        now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
