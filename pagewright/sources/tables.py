"""Elements (ordered, addressable pieces of a document) from plain tables.

An element has doc_id, ord, ref, text, label, level, is_section, is_prose, is_furniture,
page_no, pages, summary and keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_STRINGS, _NO_INTS = "array<string>", "array<int>"


def elements(rows: DataFrame, doc_id: Column, ord: Column, text: Column, label: Column, level: Column, furniture: Column, page: Column | None = None) -> DataFrame:
    """The fixed schema of elements from a few columns."""
    section = label.isin("title", "section_header")
    page = F.lit(None).cast("int") if page is None else page.cast("int")
    return rows.select(
        doc_id.alias("doc_id"), ord.cast("int").alias("ord"), F.concat(F.lit("#/texts/"), ord.cast("int").cast("string")).alias("ref"), F.coalesce(text, F.lit("")).alias("text"),
        label.alias("label"), level.cast("int").alias("level"), section.alias("is_section"), label.isin("text", "paragraph", "list_item", "inline").alias("is_prose"), furniture.alias("is_furniture"),
        page.alias("page_no"), F.array_compact(F.array(page)).alias("pages"), F.lit("").alias("summary"), F.array().cast(_NO_STRINGS).alias("keywords"),
    )


def from_lines(documents: DataFrame) -> DataFrame:
    """Every line of a text is an element; there are no headings."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    return elements(lines, F.col("doc_id"), F.col("i"), F.trim("line"), F.lit("text"), F.lit(None), F.lit(False))


def from_turns(conversations: DataFrame) -> DataFrame:
    """A user's turn is a heading, other turns are members; pages of four turns."""
    label = F.when(F.col("role") == "user", "section_header").otherwise("text")
    return elements(conversations, F.col("conv_id"), F.col("turn"), F.trim("text"), label, F.when(F.col("role") == "user", 1 + F.col("turn") % 2), F.lit(False), F.floor(F.col("turn") / 4) + 1)


def from_html(pages: DataFrame) -> DataFrame:
    """Blocks of a page: h1 is the title, p prose; list items of the navigation, footer and ads are furniture.

    Tags are cut where blocks open, since closing tags may be missing.
    """
    clean = F.regexp_replace("html", r"(?s)<(script|style)>.*?</(script|style)>|<!--.*?-->", "")
    pieces = F.split(F.regexp_replace(clean, "<(h1|p|li|footer|div)( [^>]*)?>", "\u0001$1>"), "\u0001")
    cut = pages.select("page_id", F.posexplode(F.slice(pieces, 2, 1 << 30)).alias("i", "piece"))
    tag = F.regexp_extract("piece", "^([a-z0-9]+)>", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("piece", "^[a-z0-9]+>", ""), "<[^>]*>", " "), r"\s+", " "))
    label = F.when(tag == "h1", "title").when(tag == "p", "text").when(tag == "li", "list_item").otherwise("page_footer")
    return elements(cut, F.col("page_id"), F.col("i"), text, label, F.when(tag == "h1", 0), ~tag.isin("h1", "p"))
