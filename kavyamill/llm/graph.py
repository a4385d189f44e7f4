"""Connected components by alternating star contractions, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavyamill.llm.common import checkpointed


def connected_components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """(id, component): component is the least id that the undirected edges reach; ids are longs.

    Null ends and loops are left out, so an id without an edge to another has no row. Each round joins the edges with
    the least neighbour of each node: the join can be split where one node has very many edges, and the minimum is
    taken before the shuffle. Rounds grow with the logarithm of the longest path. Nothing but three numbers a round
    reaches the driver.
    """
    e = edges.select(F.greatest(source, target).alias("u"), F.least(source, target).alias("v")).where("u > v").distinct()
    e = checkpointed(e)
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v")  # larger neighbours go to the least
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.distinct())
