"""A map of a document's units that fits a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, human_size

#: Fixed values.
GIST_LIMIT, MIN_KEPT, MARKER_COST, BUDGET = 140, 8, 60, 6000
MARKER = "  […  %d section(s) omitted from this map — ask to widen the outline …]"


def lines(units: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """Adds rich and plain, a unit's line with and without its lead, and lvl."""
    u = units if visited is None else units.join(visited.select("doc_id", "ref", F.lit(True).alias("_v")), ["doc_id", "ref"], "left")
    seen = F.coalesce(F.col("_v"), F.lit(False)) if visited is not None else F.lit(False)
    lvl = F.greatest(F.coalesce("level", F.lit(0)), F.lit(0))
    indent = F.repeat(F.lit("  "), lvl)
    heading = F.when(F.col("level").isNull(), "section").when(F.col("level") == 0, "title").otherwise(F.concat(F.lit("h"), F.col("level").cast("string")))
    label = F.when(F.col("kind") == "section", heading).when(F.col("kind") == "page", F.concat(F.lit("page "), F.col("page_no").cast("string"))).otherwise("document")
    page = F.when(F.col("page_no").isNotNull(), F.concat(F.lit(", p."), F.col("page_no").cast("string"))).otherwise("")
    title = F.when(F.col("title") == "", "(untitled)").otherwise(F.col("title"))
    line = F.concat(indent, F.lit("- "), F.when(seen, "✓ ").otherwise(""), "ref", F.lit(" · "), label, page, F.lit(" · "), human_size(F.col("char_len")), F.lit(" · "), title)
    shows = (F.col("lead") != "") & (F.col("summary") == "") & ~seen
    words = F.when(F.size("keywords") > 0, clip(F.array_join("keywords", ", "), GIST_LIMIT)).otherwise("")
    bare = F.when(F.col("summary") != "", clip(F.col("summary"), GIST_LIMIT)).otherwise(words)
    rich = F.when(shows, clip(F.col("lead"), GIST_LIMIT)).otherwise(bare)
    with_gist = lambda gist: F.when(gist == "", line).otherwise(F.concat(line, F.lit("\n"), indent, F.lit("    ↳ "), gist))
    return u.select("doc_id", "ord", "ref", lvl.alias("lvl"), with_gist(rich).alias("rich"), with_gist(bare).alias("plain"), shows.alias("shows"))


def _fitted(lines: "F.Column", line: str, budget: int) -> "F.Column":
    """(text, refs, complete) of the fullest map of ``line`` that fits, from a document's ordered lines.

    Deepest levels go first while eight units stay; then the middle is left out, taking
    lines from head and tail in turn until the next one would not leave room for the marker.
    """
    # each step binds its result in an array of one, so that it is computed once
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    cost = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda n, s: n + F.length(s[line]) + 1)
    levels = F.array_distinct(F.transform(lines, lambda s: s["lvl"]))

    def per_level(lvl):
        kept = F.filter(lines, lambda s: s["lvl"] <= lvl)
        return F.struct(lvl.alias("lvl"), F.size(kept).alias("n"), (cost(kept) - 1).alias("size"))

    def cut(sizes):
        deepest = F.array_max(F.transform(sizes, lambda c: c["lvl"]))
        # a cutoff is open if it is the deepest level or leaves eight units
        free = F.filter(sizes, lambda c: (c["lvl"] == deepest) | (c["n"] >= MIN_KEPT))
        fits = F.array_max(F.transform(F.filter(free, lambda c: c["size"] <= budget), lambda c: c["lvl"]))
        return F.struct(deepest.alias("deepest"), fits.alias("fits"), F.array_min(F.transform(free, lambda c: c["lvl"])).alias("least"))

    def shown(c):
        kept = F.filter(lines, lambda s: s["lvl"] <= F.coalesce(c["fits"], c["least"]))
        return bind(kept, lambda k: F.struct(c.alias("c"), k.alias("kept"), F.when(c["fits"].isNotNull(), F.size(k)).otherwise(turns(k)).alias("took")))

    def turns(kept):
        def take(state, turn):
            at = F.when(turn % 2 == 0, (turn / 2).cast("int")).otherwise(F.size(kept) - 1 - ((turn - 1) / 2).cast("int"))
            n = F.length(F.get(kept, at)[line])
            going = state["going"] & (state["used"] + n + MARKER_COST <= budget)
            return F.struct((state["took"] + going.cast("int")).alias("took"), (state["used"] + F.when(going, n + 1).otherwise(0)).alias("used"), going.alias("going"))

        start = F.struct(F.lit(0).alias("took"), F.lit(0).alias("used"), F.lit(True).alias("going"))
        return F.aggregate(F.sequence(F.lit(0), F.size(kept) - 1), start, take)["took"]

    def made(x):
        n, took = F.size(x["kept"]), x["took"]
        tail = (took / 2).cast("int")
        head = F.when(took == n, n).otherwise(took - tail)
        rows = F.concat(F.slice(x["kept"], F.lit(1), head), F.when(took == n, F.slice(x["kept"], 1, 0)).otherwise(F.slice(x["kept"], n - tail + 1, tail)))
        marker = F.format_string(MARKER, n - took)
        text = lambda part: F.transform(part, lambda s: s[line])
        body = F.when(took == n, text(rows)).otherwise(F.concat(text(F.slice(rows, F.lit(1), head)), F.array(marker), text(F.slice(rows, head + 1, tail))))
        # what was left out on fewer levels but shown whole counts as complete
        complete = F.when(x["c"]["fits"].isNotNull(), x["c"]["fits"] == x["c"]["deepest"]).otherwise(took == n)
        return F.struct(F.array_join(body, "\n").alias("text"), F.transform(rows, lambda s: s["ref"]).alias("refs"), complete.alias("complete"))

    return bind(F.transform(levels, per_level), lambda sizes: bind(cut(sizes), lambda c: bind(shown(c), made)))


def render(units: DataFrame, budget: int = BUDGET, visited: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, refs, complete): with leads, or without if that shows more units.

    A document's lines are gathered once; both maps are folds over them.
    """
    one = F.struct("ord", "lvl", "ref", "rich", "plain")
    rows = lines(units, visited).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_lines"), F.bool_or("shows").alias("_some"))
    both = rows.select("doc_id", "_some", "_lines", _fitted(F.col("_lines"), "rich", budget).alias("_rich"))
    # without leads nothing changes where none is shown or all fits
    again = F.when(F.col("_some") & ~F.col("_rich.complete"), _fitted(F.col("_lines"), "plain", budget))
    both = both.select("doc_id", "_rich", again.alias("_plain"))
    best = F.when(F.size("_plain.refs") > F.size("_rich.refs"), F.col("_plain")).otherwise(F.col("_rich"))
    return both.select("doc_id", best.alias("_best")).select("doc_id", "_best.text", "_best.refs", "_best.complete")
