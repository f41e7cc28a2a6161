"""Tables and figures as text, from their parts: column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_escape

#: A table's shape (0: unknown) and its cells; an end of 0 is unknown.
GRID = "struct<caption:string,height:int,width:int,cells:array<struct<text:string,y:int,x:int,bottom:int,right:int,head:boolean>>>"
#: Fixed values.
MAX_CELLS, TOO_LARGE = 4000, "[table too large to lay out; cells listed in order]"


def figure(parts: Column) -> Column:
    return F.array_join(F.concat(F.array(F.lit("[figure]")), parts), " ")


def _end(cell: Column, start: str, end: str) -> Column:
    """Where a cell ends; at least one place on."""
    return F.greatest(F.when(cell[end] == 0, cell[start] + 1).otherwise(cell[end]), cell[start] + 1)


def _cell(cell: Column) -> Column:
    tag = F.when(cell["head"], "th").otherwise("td")
    span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    tall, wide = _end(cell, "y", "bottom") - cell["y"], _end(cell, "x", "right") - cell["x"]
    return F.concat(F.lit("<"), tag, span("rowspan", tall), span("colspan", wide), F.lit(">"), html_escape(cell["text"]), F.lit("</"), tag, F.lit(">"))


def _bind(value: Column, use) -> Column:
    """use(value), the value computed once: it is the only element that a lambda runs over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _firsts(cells: Column) -> Column:
    """The first cell at every place, standing for all that start there: where it begins and ends, and its HTML."""
    starts = F.transform(cells, lambda c: F.struct(c["y"], c["x"]))
    first = lambda s: F.filter(cells, lambda c, i: F.array_position(s, F.struct(c["y"], c["x"])) == i + 1)
    made = lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), _end(c, "y", "bottom").alias("bottom"), _end(c, "x", "right").alias("right"), _cell(c).alias("html"))
    return _bind(starts, lambda s: F.transform(first(s), made))


def _laid_out(caption: Column, shape: Column, firsts: Column) -> Column:
    """Every place of the grid in order: nothing under another cell's span, the cell that starts there, or a hole."""

    def place(y: Column, x: Column) -> Column:
        starts_here = lambda c: (c["y"] == y) & (c["x"] == x)
        covers = lambda c: (c["y"] <= y) & (y < c["bottom"]) & (c["x"] <= x) & (x < c["right"])
        own = F.get(F.filter(firsts, starts_here), F.lit(0))
        return F.when(F.exists(firsts, lambda c: covers(c) & ~starts_here(c)), "").otherwise(F.coalesce(own["html"], F.lit("<td></td>")))

    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(upto(shape["height"]), lambda y: F.concat(F.lit("<tr>"), F.array_join(F.transform(upto(shape["width"]), lambda x: place(y, x)), ""), F.lit("</tr>")))
    head = F.when(caption == "", "").otherwise(F.concat(F.lit("<caption>"), html_escape(caption), F.lit("</caption>")))
    return F.concat(F.lit("<table>"), head, F.array_join(rows, ""), F.lit("</table>"))


def _shape(grid: Column) -> Column:
    """Height and width as given, or as far as any cell reaches."""
    reach = lambda end: F.coalesce(F.array_max(F.transform(grid["cells"], lambda c: c[end])), F.lit(0))
    unknown = (grid["height"] <= 0) | (grid["width"] <= 0)
    sides = (("height", "bottom"), ("width", "right"))
    return F.struct(*[F.when(unknown, F.greatest(grid[side], reach(end))).otherwise(grid[side]).alias(side) for side, end in sides])


def table(grid: Column) -> Column:
    """A grid as HTML; a table without cells, or with too many places, as plain text."""
    cells, caption = grid["cells"], grid["caption"]
    listed = F.array_join(F.transform(F.slice(cells, 1, MAX_CELLS), lambda c: c["text"]), " | ")
    plain = F.trim(F.concat(F.lit(TOO_LARGE + " "), caption, F.lit(" "), listed))
    empty = F.trim(F.concat(F.lit("[table] "), caption))
    html = lambda shape: F.when(shape["height"].cast("long") * shape["width"].cast("long") > MAX_CELLS, plain).otherwise(_bind(_firsts(cells), lambda f: _laid_out(caption, shape, f)))
    return F.when(F.size(cells) == 0, empty).otherwise(_bind(_shape(grid), html))
