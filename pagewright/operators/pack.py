"""Excerpts: elements of a unit packed into a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bm25, segment

#: Fixed values.
MAX_SPANS = 200
MIN_PARTIAL, TRUNCATED = 200, "\n\n[… excerpt truncated to fit the context budget …]"
OMITTED = "\n\n[… %d passage(s) of this section omitted; the ones matching the question are shown …]"


def _joined(column: str = "text") -> "F.Column":
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda s: s[column]), "\n\n")


PART = "struct<ref:string,text:string,node_id:string,page_no:int,bbox:struct<l:double,t:double,r:double,b:double>,graph_label:string>"


def located(elements: DataFrame) -> DataFrame:
    """Adds at, where an element is; sources without graph ids, boxes or graph labels get the plain id, null and an empty label."""
    have = elements.columns
    node = F.coalesce(F.col("node_id"), F.lit("")) if "node_id" in have else F.concat(F.lit("elem::"), "ref")
    box = F.col("bbox") if "bbox" in have else F.lit(None).cast("struct<l:double,t:double,r:double,b:double>")
    label = F.coalesce(F.col("graph_label"), F.lit("")) if "graph_label" in have else F.lit("")
    return elements.withColumn("at", F.struct(node.alias("node_id"), F.col("page_no").cast("int").alias("page_no"), box.alias("bbox"), label.alias("graph_label")))


def _at(members: DataFrame) -> list[str]:
    return ["at"] if "at" in members.columns else []


def _parts(pieces, at: list[str]) -> list:
    """The column parts, if members say where they are."""
    return [F.transform(pieces, lambda s: F.struct(s["ref"].alias("ref"), s["text"].alias("text"), *[s["at"][c].alias(c) for c in ("node_id", "page_no", "bbox", "graph_label")])).alias("parts")] if at else []


def spans(parts: "F.Column") -> "F.Column":
    """Where the first 200 parts are; offsets inside an element are not known."""
    none = F.lit(None).cast("int")
    return F.transform(F.slice(parts, 1, MAX_SPANS), lambda p: F.struct(p["ref"].alias("ref"), p["node_id"].alias("node_id"), p["page_no"].alias("page_no"), none.alias("char_start"), none.alias("char_end"), p["bbox"].alias("bbox")))


def pages_of(parts: "F.Column") -> "F.Column":
    """Pages in the order first met."""
    return F.array_distinct(F.filter(F.transform(parts, lambda p: p["page_no"]), lambda n: n.isNotNull()))


def node_ids(parts: "F.Column") -> "F.Column":
    return F.filter(F.transform(parts, lambda p: p["node_id"]), lambda n: n != "")


def head_first(members: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(keys, text, refs, truncated): elements in order until the first that does not fit.

    A head of that element is kept if more than 200 characters of the budget are left.
    members: keys, ord, ref, text; with at (see located) the result has parts too.
    """
    at = _at(members)
    order = Window.partitionBy(*keys).orderBy("ord")
    long = F.length("text")
    run = members.filter("text <> ''").withColumn("_upto", F.sum(long).over(order))
    over = F.col("_upto") > budget
    run = run.withColumn("_first", F.min(F.when(over, F.col("ord"))).over(Window.partitionBy(*keys)))
    left = budget - (F.col("_upto") - long)
    kept = run.withColumn("text", F.when(~over, F.col("text")).when((F.col("ord") == F.col("_first")) & (left > MIN_PARTIAL), F.substring("text", F.lit(1), left))).filter("_first is null or ord <= _first")
    some = F.col("text").isNotNull()
    out = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(some, F.struct("ord", "text", "ref", *at)))).alias("_p"), F.bool_or(F.col("_first").isNotNull()).alias("truncated"))
    body = F.array_join(F.transform("_p", lambda s: s["text"]), "\n\n")
    return out.select(*keys, F.concat(body, F.when(F.col("truncated"), TRUNCATED).otherwise("")).alias("text"), F.transform("_p", lambda s: s["ref"]).alias("refs"), "truncated", *_parts("_p", at))


def by_relevance(members: DataFrame, questions: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Like head_first where all fits or nothing matches; else the best matching elements.

    Elements are taken by falling score (ties and those without a match in order),
    skipping what does not fit, and put back in reading order. questions: keys, query.
    The fold runs over one unit's elements, whose number a document bounds.
    """
    members, at = members.filter("text <> ''"), _at(members)
    asked = questions.select(*keys, "query").withColumn("query_id", F.lit(0))
    found = bm25.hits(asked, members.select(*keys, "ref", "text"), keys, keys).select(*keys, "ref", "score")
    scored = members.join(found, [*keys, "ref"], "left").withColumn("_s", -F.round(F.coalesce("score", F.lit(0.0)), bm25.RANK_DECIMALS))
    item = F.struct(F.col("_s"), F.col("ord"), F.length("text").alias("n"), F.col("text"), F.col("ref"), *at)
    rows = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all"), F.sum(F.length("text")).alias("_total"), F.min("_s").alias("_best"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("took"))
    fits = lambda s, e: s["used"] + e["n"] <= budget
    fold = F.aggregate("_all", zero, lambda s, e: F.struct(F.when(fits(s, e), s["used"] + e["n"]).otherwise(s["used"]).alias("used"), F.when(fits(s, e), F.concat(s["took"], F.array(e["ord"]))).otherwise(s["took"]).alias("took")))
    rows = rows.withColumn("_took", fold["took"])
    use = (F.col("_total") > budget) & (F.col("_best") < 0) & (F.size("_took") > 0)
    kept = F.array_sort(F.transform(F.filter("_all", lambda e: F.array_contains("_took", e["ord"])), lambda e: F.struct(e["ord"].alias("ord"), e["text"].alias("text"), e["ref"].alias("ref"), *[e[c].alias(c) for c in at])))
    omitted = F.size("_all") - F.size("_took")
    body = F.array_join(F.transform(kept, lambda e: e["text"]), "\n\n")
    chosen = rows.filter(use).select(*keys, F.concat(body, F.when(omitted > 0, F.format_string(OMITTED, omitted)).otherwise("")).alias("text"), F.transform(kept, lambda e: e["ref"]).alias("refs"), (omitted > 0).alias("truncated"), *_parts(kept, at))
    rest = head_first(members.join(rows.filter(~use).select(*keys), keys, "left_semi"), keys, budget)
    return chosen.unionByName(rest)


def excerpts(units: DataFrame, elements: DataFrame, wanted: DataFrame, budget: int) -> DataFrame:
    """(doc_id, ref, focus, kind, text, parts, truncated), one for each distinct (doc_id, ref, focus) of ``wanted``.

    Equal requests are packed once. A null or empty focus packs head first; a ref that is no
    unit gives an empty section.
    """
    asked = wanted.select("doc_id", F.col("ref").alias("unit"), F.coalesce("focus", F.lit("")).alias("focus")).distinct()
    keys = ["doc_id", "unit", "focus"]
    places = units.join(asked.select("doc_id", F.col("unit").alias("ref")), ["doc_id", "ref"], "left_semi").select("doc_id", F.col("ref").alias("unit"), F.explode("element_refs").alias("ref"))
    members = places.join(located(elements).select("doc_id", "ref", "ord", "text", "at"), ["doc_id", "ref"]).join(asked, ["doc_id", "unit"])
    got = by_relevance(members, asked.withColumn("query", F.col("focus")), keys, budget).drop("refs")
    kinds = units.select("doc_id", F.col("ref").alias("unit"), "kind")
    out = asked.join(kinds, ["doc_id", "unit"], "left").join(got, keys, "left")
    return out.select(
        "doc_id", F.col("unit").alias("ref"), "focus", F.coalesce("kind", F.lit("section")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("parts", F.array().cast(f"array<{PART}>")).alias("parts"), F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )


def full_excerpts(elements: DataFrame, budget: int, furniture: bool = False) -> DataFrame:
    """(doc_id, ref, kind, text, parts, truncated): each document from its start, under the ref of its first readable element."""
    every = located(segment.readable(elements, furniture))
    anchor = every.groupBy("doc_id").agg(F.min_by("ref", "ord").alias("ref"))
    got = head_first(every.select("doc_id", "ref", "ord", "text", "at"), ["doc_id"], budget).drop("refs")
    none = F.array().cast(f"array<{PART}>")
    return anchor.join(got, "doc_id", "left").select("doc_id", "ref", F.lit("document").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("parts", none).alias("parts"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
