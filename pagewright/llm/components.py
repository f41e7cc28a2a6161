"""Connected components of an edge table by alternating large and small stars.

Every round links each node's larger neighbours to its smallest one (large star), then
its smaller neighbours and itself to the smallest (small star), until nothing changes.
Minima are pre-aggregated before the shuffle and joined back, so a node with very many
neighbours is a join key that adaptive execution can split. Rounds are written to the
shared folder; no link or component reaches the driver, only a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, materialize, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.union(edges.select("dst", "src"))
        least = both.groupBy("src").agg(F.min("dst").alias("least")).select("src", F.least("src", "least").alias("least"))
        out = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("least"))
        out = down.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst")).union(least)
    return out.filter("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest node.

    edges is read several times: a written table of src and dst. Repeated edges and those of a node to itself may be in it.
    """
    spark = edges.sparkSession
    now, path, seen = edges.select("src", "dst").filter("src <> dst"), None, None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        after, there = materialize(few_files(_star(_star(now, True), False), state[0]), "edges")
        if path:
            remove(spark, path)
        now, path = after, there
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
