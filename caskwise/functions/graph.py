"""Connected components by alternating minimum labels and pointer jumps, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caskwise.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node that has a link, with the smallest node it is connected to.

    Every round links each node and its neighbours to the smallest among them (large and small star),
    until nothing changes; a node of very many links is only ever grouped by partial minima. Null
    ends are dropped, repeated and self links change nothing, an empty table gives an empty table.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(stars).distinct())
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
