"""Where elements stand on their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .physical import settle


def top_left(l: Column, t: Column, r: Column, b: Column, origin: Column, height: Column) -> Column:  # noqa: E741
    """A box as (l, t, r, b) from the top left; null if it has no area or the page height is needed but unknown."""
    flip = F.upper(origin) == "BOTTOMLEFT"
    top, bottom = F.when(flip, height - t).otherwise(t), F.when(flip, height - b).otherwise(b)
    good = (r > l) & (bottom > top)
    return F.when(good, F.struct(l.alias("l"), top.alias("t"), r.alias("r"), bottom.alias("b")))


def page_list(provs: Column) -> Column:
    """Distinct page numbers in the order first seen."""
    return F.array_distinct(F.array_compact(F.transform(provs, lambda p: p["page_no"])))


def reading_order(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, node, ord): pre-order of trees, from edges (tree, parent, child, pos) and roots (tree, node).

    One join a level, whose result is written, so that no level is computed twice. A path that
    comes back to one of its own nodes ends there, which also ends cycles; of several paths to a
    node the first one in order counts.
    """
    found = level = settle(roots.select("tree", "node", F.array(F.lit(0)).alias("path"), F.array(F.col("node")).alias("chain")))
    below = edges.select("tree", F.col("parent").alias("node"), "child", F.col("pos").cast("int").alias("pos"))
    while True:
        nxt = level.join(below, ["tree", "node"]).filter(~F.array_contains("chain", F.col("child")))
        level = settle(nxt.select("tree", F.col("child").alias("node"), F.concat("path", F.array("pos")).alias("path"), F.concat("chain", F.array("child")).alias("chain")))
        if level.isEmpty():
            break
        found = found.union(level)
    once = found.groupBy("tree", "node").agg(F.min("path").alias("path"))
    return once.select("tree", "node", (F.row_number().over(Window.partitionBy("tree").orderBy("path")) - 1).alias("ord"))
