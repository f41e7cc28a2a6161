"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Every document of a source gets the same expected number of copies, its source's target
over its source's size. Within a source the documents are put in an order (size class,
block, size, then a hash of the id), so that copies spread evenly over sizes, the expected copies are summed along it, one random offset per
source is added, and a copy is emitted for every integer boundary that the sum crosses.
Since all steps of one source are equal, the sum before a document is its rank times the
step; ranks come from counts of small blocks, summed in two levels, and a rank inside a
block, so no source meets in one task, however large.

Blocks: a source's size classes (quarters of a power of two), each cut by a hash into
parts that hold about ``BLOCK_ROWS`` rows. A document gets at most the rounded-up step,
so never more than ``most`` times its size. Offsets are hashes of the source and a seed:
reruns agree. Targets need one ordered pass over the sources, a row each, in one task.

Defined cases: null texts and texts of white space have size 0; a null source is a
source of its own, last in order; repeated rows are separate rows; a source without
words has target 0; an empty table gives an empty result; texts of any length are counted
whole; rows of one id, or without one, are told apart by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, fresh_name, materialize

BLOCK_ROWS = 2_000
WEIGHTS = (5, 2, 1)


def _number(text, digits: int = 15) -> "F.Column":
    """A whole number from the first hex digits of a text's MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _salt(text_col: str) -> "F.Column":
    """Tells rows of one id, or without one, apart."""
    return _number(F.coalesce(F.col(text_col), F.lit("")))


def _size_class(size) -> "F.Column":
    """Quarters of a power of two: the number of bits and the two bits after the first, in falling order."""
    bits = F.bin(size + 1)
    return -(F.length(bits) * 4 + F.conv(F.substring(F.concat(bits, F.lit("00")), 2, 2), 2, 10).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Targets share all sizes by weight; those above most times their source's size stop
    there and the excess is shared again. The sources that stop are those with the
    smallest size to weight ratio, so one ordered pass finds them: a source stops when
    what is left, per weight left, is above its own limit per weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", pick.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    tight = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    all_rows = Window.partitionBy(F.lit(1))
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / weight_left).withColumn("stops", F.col("level") * F.col("w") > F.col("cap"))
    # the first source that does not stop fixes the level for it and all after it
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(all_rows)
    return level.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * final.getField("level")).alias("target"))


def expected_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target and copies for every row of docs."""
    base, _ = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"), _salt(text_col).alias("salt")), "sizes")
    return copies_of(base, weights, most, seed)


def copies_of(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """Adds source_size, target and copies to base, a written table with source, size, an id and a salt."""
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")
    targets = source_targets(totals.select("source", "source_size"), weights, most)
    sources, _ = materialize(targets.alias("t").join(totals.select("source", parts.alias("parts")).alias("n"), F.expr("t.source <=> n.source")).select("t.*", "n.parts"), "sources")
    h = _number(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("salt").cast("string"), F.lit(str(seed))))
    placed = (
        base.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("_h", h).withColumn("_c", _size_class(F.col("size"))).withColumn("_p", F.pmod(F.shiftright("_h", 8), F.col("parts").cast("long")).cast("int"))
    )
    blocks = placed.groupBy("source", "_c", "_p").agg(F.count("*").alias("n"))
    classes = blocks.groupBy("source", "_c").agg(F.sum("n").alias("n"))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("source", "_c", upto(Window.partitionBy("source").orderBy("_c")).alias("_class_before"))
    blocks = blocks.select("source", "_c", "_p", upto(Window.partitionBy("source", "_c").orderBy("_p")).alias("_part_before"))
    starts = blocks.alias("b").join(classes.alias("c"), F.expr("b.source <=> c.source and b._c = c._c")).select(F.col("b.source").alias("_s"), F.col("b._c").alias("_bc"), F.col("b._p").alias("_bp"), (F.col("_class_before") + F.col("_part_before")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("source", "_c", "_p").orderBy(F.col("size").desc(), "_h", "doc_id"))
    ranked = placed.withColumn("_r", inside).join(starts, F.expr("source <=> _s and _c = _bc and _p = _bp"))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, u = F.col("_before") + F.col("_r"), _number(F.concat(F.coalesce(F.col("source"), F.lit("")), F.when(F.col("source").isNull(), "1").otherwise("0"), F.lit(str(seed))), 13) / F.lit(float(1 << 52))
    crossed = F.floor(u + rank * step) - F.floor(u + (rank - 1) * step)
    return ranked.withColumn("copies", crossed.cast("long")).select(*base.columns, "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target and taken, the words that the mix takes."""
    out = expected_copies(docs, weights, most, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken, and copy_no from 1
    (with an underscore after it if docs has such a column)."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    base = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _salt(text_col).alias("salt"))
    taken = copies_of(base, weights, most, seed).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("no")).select("_row.*", F.col("no").alias(fresh_name(docs.columns, "copy_no")))
