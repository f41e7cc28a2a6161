"""Views of units, reciprocal rank fusion and the signals of a shortlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bm25

#: Fixed values.
RRF_K, WEIGHTS, EXPANSION_WEIGHT, SHORTLIST = 60, {"text": 1.0, "heading": 1.0, "summary": 1.5}, 0.25, 8
MIN_COVERAGE, MIN_MARGIN, DECISIVE, FANOUT = 0.34, 1.15, 1.5, 3
_VIEW_ORDER = {"text": 0, "heading": 1, "summary": 2}


def views(units: DataFrame) -> DataFrame:
    """(doc_id, view, ref, text): full text, title, and summary with keywords of enriched units."""
    view = lambda name, text: units.select("doc_id", F.lit(name).alias("view"), "ref", text.alias("text"))
    enriched = (F.col("summary") != "") | (F.size("keywords") > 0)
    third = units.filter(enriched).select("doc_id", F.lit("summary").alias("view"), "ref", F.concat_ws(" ", F.col("summary"), F.array_join("keywords", " ")).alias("text"))
    return view("text", F.col("text")).unionByName(view("heading", F.col("title"))).unionByName(third)


def view_counts(units: DataFrame) -> DataFrame:
    """(doc_id, view, n): entries of every view that has any."""
    return views(units).groupBy("doc_id", "view").agg(F.count("*").alias("n"))


def uses_enrichment(units: DataFrame) -> DataFrame:
    """(doc_id, uses_enrichment): whether any unit has a summary or keywords."""
    return units.groupBy("doc_id").agg(F.bool_or((F.col("summary") != "") | (F.size("keywords") > 0)).alias("uses_enrichment"))


def view_hits(queries: DataFrame, units: DataFrame) -> DataFrame:
    """Ranked hits of every view; queries are limited to their doc_id."""
    return bm25.ranked(bm25.hits(queries, views(units), ["doc_id", "view"], ["doc_id"]), ["doc_id", "view"])


def _weight(view, expanded) -> "F.Column":
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.element_at(table, view) * F.when(expanded, EXPANSION_WEIGHT).otherwise(1.0)


def fuse(queries: DataFrame, units: DataFrame, limit: int = SHORTLIST, visited: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, place, ref, score, ranks, rationale), the best ``limit`` units a query.

    queries: query_id, doc_id, query and optionally expansion. Visited units (query_id,
    doc_id, ref) leave after positions are given.
    """
    found = view_hits(queries, units).withColumn("expanded", F.lit(False))
    if "expansion" in queries.columns:
        more = queries.filter("expansion <> ''").select("query_id", "doc_id", F.col("expansion").alias("query"))
        found = found.unionByName(view_hits(more, units).withColumn("expanded", F.lit(True)))
    if visited is not None:
        found = found.join(visited, ["query_id", "doc_id", "ref"], "left_anti")
    order_of = F.create_map(*[F.lit(x) for pair in _VIEW_ORDER.items() for x in pair])
    entry = F.struct(F.col("expanded"), F.element_at(order_of, F.col("view")).alias("o"), F.col("view"), F.col("position"))
    fused = found.groupBy("query_id", "doc_id", "ref").agg(F.sum(_weight(F.col("view"), F.col("expanded")) / (RRF_K + F.col("position"))).alias("score"), F.array_sort(F.collect_list(entry)).alias("ranks"))
    fused = fused.join(units.select("doc_id", "ref", F.col("ord").alias("_ord")), ["doc_id", "ref"])
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.round("score", bm25.RANK_DECIMALS).desc(), "_ord")
    said = F.array_join(F.transform(F.filter("ranks", lambda r: ~r["expanded"]), lambda r: F.concat(r["view"], F.lit(" rank "), r["position"].cast("string"))), ", ")
    return fused.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "doc_id", "place", "ref", "score", "ranks", F.concat(F.lit("lexical match ("), said, F.lit(")")).alias("rationale"))


def signals(shortlist: DataFrame, queries: DataFrame, units: DataFrame) -> DataFrame:
    """Per query with candidates: margin, coverage by the top unit, confident, fanout."""
    top = F.max(F.when(F.col("place") == 1, F.col("score")))
    second = F.max(F.when(F.col("place") == 2, F.col("score")))
    margin = F.when(second > 0, top / second).otherwise(F.lit(float("inf")))
    sums = shortlist.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"), margin.alias("margin"))
    asked = queries.select("query_id", "doc_id", F.concat_ws(" ", "query", *(["expansion"] if "expansion" in queries.columns else [])).alias("query"))
    body = units.select("doc_id", "ref", "text")
    picked = shortlist.filter("place = 1").select("query_id", "doc_id", "ref")
    cover = bm25.term_report(asked, body, picked, ["doc_id"]).select("query_id", "doc_id", "coverage")
    confident = (F.col("coverage") >= MIN_COVERAGE) & (F.col("margin") >= MIN_MARGIN)
    fanout = F.when((F.col("n") < 2) | (F.col("margin") >= DECISIVE), 1).otherwise(FANOUT)
    return sums.join(cover, ["query_id", "doc_id"]).select("query_id", "doc_id", "n", "margin", "coverage", confident.alias("confident"), fanout.alias("fanout"))
