"""Elements to units: sections by running sums, pages, or whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TITLE_LIMIT, clip, opening, tokenize

LEAD_SHARE = 0.5


def readable(elements: DataFrame, furniture: bool = False) -> DataFrame:
    return elements if furniture else elements.filter(~F.col("is_furniture"))


def section_numbers(elements: DataFrame) -> DataFrame:
    """Adds section_no: a heading opens a scope that runs to the next heading of any level; 0 is the preamble."""
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return readable(elements).withColumn("section_no", F.sum(F.col("is_section").cast("int")).over(upto))


def _ordered(column: str) -> "F.Column":
    return F.transform(F.array_sort(F.collect_list(F.struct("ord", column))), lambda s: s[column])


def _first_by_ord(value, condition) -> "F.Column":
    return F.min_by(F.when(condition, value), F.when(condition, F.col("ord")))


def _aggregates() -> list:
    lead_of = opening(F.col("text"))
    return [
        F.min_by("ref", "ord").alias("ref"), F.sum(F.length("text")).cast("long").alias("char_len"),
        F.array_sort(F.array_distinct(F.flatten(_ordered("pages")))).alias("pages"), F.min_by("page_no", "ord").alias("page_no"),
        F.coalesce(_first_by_ord(F.col("summary"), F.col("summary") != ""), F.lit("")).alias("summary"),
        F.array_distinct(F.flatten(_ordered("keywords"))).alias("keywords"), _ordered("ref").alias("element_refs"),
        F.coalesce(_first_by_ord(lead_of, ~F.col("is_section") & F.col("is_prose") & (lead_of != "")), F.lit("")).alias("lead"),
        F.array_join(F.filter(_ordered("text"), lambda t: t != ""), "\n\n").alias("text"),
    ]


def section_units(elements: DataFrame) -> DataFrame:
    """One row a section (preamble included) of documents that have headings."""
    numbered = section_numbers(elements)
    head = F.min_by(F.struct("text", "level", "is_section"), "ord")
    units = numbered.groupBy("doc_id", "section_no").agg(head.alias("_head"), *_aggregates())
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no")) - 1
    title = clip(F.col("_head.text"), TITLE_LIMIT)
    return units.select("doc_id", order.alias("ord"), "ref", F.lit("section").alias("kind"), F.when(title == "", "(untitled)").otherwise(title).alias("title"), F.when(F.col("_head.is_section"), F.col("_head.level")).alias("level"), "page_no", "pages", "char_len", "summary", "keywords", "lead", "element_refs", "text")


def node_id(ref) -> "F.Column":
    return F.concat(F.lit("elem::"), ref)


def page_ref(page_no) -> "F.Column":
    return F.concat(F.lit("#/pages/"), page_no.cast("string"))


def page_node_id(page_no) -> "F.Column":
    return F.concat(F.lit("page::"), page_no.cast("string"))


def page_units(elements: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row for every page that has readable elements; an element is on all of its pages.

    With documents (doc_id, page_nos) the pages are those listed there, which may have no
    element; they keep their places in the order. Else they are those of the elements.
    """
    on = readable(elements).withColumn("_page", F.explode("pages"))
    units = on.groupBy("doc_id", "_page").agg(F.slice(_ordered("text"), 1, 3).alias("_first"), *_aggregates())
    listed = elements.select("doc_id", F.explode("pages").alias("_page")) if documents is None else documents.select("doc_id", F.explode("page_nos").alias("_page"))
    places = listed.distinct().withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_page")) - 1)
    title = clip(F.array_join("_first", " "), TITLE_LIMIT)
    units = units.drop("ref", "lead", "page_no").join(places, ["doc_id", "_page"])
    return units.select("doc_id", "ord", page_ref(F.col("_page")).alias("ref"), F.lit("page").alias("kind"), F.when(title == "", F.concat(F.lit("Page "), F.col("_page").cast("string"))).otherwise(title).alias("title"), F.lit(None).cast("int").alias("level"), F.col("_page").alias("page_no"), F.array("_page").alias("pages"), "char_len", "summary", "keywords", F.lit("").alias("lead"), "element_refs", "text")


def document_units(elements: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row a document, titled by its name (documents: doc_id, name) or ``Document``."""
    units = readable(elements).groupBy("doc_id").agg(*_aggregates())
    name = F.lit("Document")
    if documents is not None:
        units = units.join(documents.select("doc_id", F.col("name").alias("_name")), "doc_id", "left")
        name = F.coalesce(F.nullif("_name", F.lit("")), name)
    return units.select("doc_id", F.lit(0).alias("ord"), "ref", F.lit("document").alias("kind"), name.alias("title"), F.lit(None).cast("int").alias("level"), "page_no", "pages", "char_len", "summary", "keywords", "lead", "element_refs", "text")


def build_units(elements: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Sections if a document has any heading, else pages if any listed page has readable elements, else the document.

    documents (doc_id, name, page_nos), one row each, gives names and the list of pages.
    """
    pages = F.when(F.col("is_furniture"), F.array().cast("array<int>")).otherwise(F.col("pages"))
    kinds = elements.groupBy("doc_id").agg(F.bool_or("is_section").alias("_s"), F.array_distinct(F.flatten(F.collect_set(pages))).alias("_p"))
    if documents is not None:
        kinds = kinds.join(documents.select("doc_id", "page_nos"), "doc_id", "left").withColumn("_p", F.array_intersect("_p", F.coalesce("page_nos", F.array().cast("array<int>"))))
    kinds = kinds.select("doc_id", F.when(F.col("_s"), "section").when(F.size("_p") > 0, "page").otherwise("document").alias("_kind"))
    pick = lambda kind: elements.join(kinds.filter(F.col("_kind") == kind).select("doc_id"), "doc_id", "left_semi")
    return section_units(pick("section")).unionByName(page_units(pick("page"), documents)).unionByName(document_units(pick("document"), documents))


def refs(units: DataFrame) -> DataFrame:
    """(doc_id, refs): the refs of every document's units, in order."""
    return units.groupBy("doc_id").agg(_ordered("ref").alias("refs"))


def unit(units: DataFrame, ref: str) -> DataFrame:
    """The unit with a ref, of every document that has one."""
    return units.filter(F.col("ref") == ref)


def unit_kind(units: DataFrame) -> DataFrame:
    """(doc_id, kind, n_units, total_chars) of documents with units: the kind is that of the first one."""
    return units.groupBy("doc_id").agg(F.min_by("kind", "ord").alias("kind"), F.count("*").alias("n_units"), F.sum("char_len").alias("total_chars"))


def prune_leads(units: DataFrame) -> DataFrame:
    """Blanks leads that hold no word which few other leads of the document and not the title have."""
    leads = units.filter("lead <> ''").select("doc_id", "ref", F.array_distinct(tokenize(F.col("lead"))).alias("_tokens"), F.array_distinct(tokenize(F.col("title"))).alias("_own"))
    n = leads.groupBy("doc_id").agg(F.count("*").alias("_n"))
    each = leads.select("doc_id", "ref", F.explode("_tokens").alias("_t"))
    df = each.groupBy("doc_id", "_t").agg(F.count("*").alias("_df"))
    rare = each.join(df, ["doc_id", "_t"]).join(n, "doc_id").filter(F.col("_df") <= F.greatest(F.lit(1), F.floor(F.col("_n") * LEAD_SHARE)))
    kept = rare.groupBy("doc_id", "ref").agg(F.collect_set("_t").alias("_rare"))
    judged = leads.join(n, "doc_id").join(kept, ["doc_id", "ref"], "left").select("doc_id", "ref", ((F.col("_n") < 2) | (F.size(F.array_except(F.coalesce("_rare", F.array().cast("array<string>")), "_own")) > 0)).alias("_keep"))
    return units.join(judged, ["doc_id", "ref"], "left").withColumn("lead", F.when(F.coalesce("_keep", F.lit(False)), F.col("lead")).otherwise("")).select(*units.columns)


def children_of(units: DataFrame) -> DataFrame:
    """(doc_id, parent, child): units after a levelled unit, up to one without level or of its level or above.

    One pass over a document's units keeps the chain of open parents; a pair is made for each
    parent that a unit has, and no other pair is looked at.
    """
    one = F.struct("ord", "ref", "level")
    listed = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_u"))
    chain, pairs = "array<struct<ref:string,level:int>>", "array<struct<parent:string,child:string>>"
    start = F.struct(F.array().cast(chain).alias("open"), F.array().cast(pairs).alias("out"))

    def step(state, u):
        above = F.filter(state["open"], lambda p: p["level"] < u["level"])  # none if the unit has no level
        own = F.when(u["level"].isNull(), F.array().cast(chain)).otherwise(F.concat(above, F.array(F.struct(u["ref"].alias("ref"), u["level"].alias("level")))))
        return F.struct(own.alias("open"), F.concat(state["out"], F.transform(above, lambda p: F.struct(p["ref"].alias("parent"), u["ref"].alias("child")))).alias("out"))

    return listed.select("doc_id", F.explode(F.aggregate("_u", start, step)["out"]).alias("p")).select("doc_id", "p.parent", "p.child")
