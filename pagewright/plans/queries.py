"""Queries over the tables, one an operator, and the same in SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip, collapse, flatten, grounded, html_escape, human_size, opening, tokenize
from ..operators import bm25, geometry, outline, pack, rank, reading, report, segment
from ..operators.physical import small, spread
from ..sources import docjson, tables
from ..sources.chat import RuleChat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    """doc_id and text, on all cores."""
    return spread(_t(s, d, "documents").select("doc_id", "text"))


def _turns(s, d):
    return tables.from_turns(_t(s, d, "conversations"))


def _units(s, d):
    return segment.section_units(_turns(s, d))


def _asked(s, d):
    """One question a conversation: the text of its last turn."""
    c = _t(s, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by("text", "turn").alias("query")).select(F.col("doc_id").alias("query_id"), "doc_id", "query")


# --- SQL building blocks ---

_NORM = "strip_accents(replace(lower(coalesce({x}, '')), 'ß', 'ss'))"
_FOLD = """CASE WHEN length(t) <= 3 OR regexp_matches(t, '[0-9]') THEN t ELSE regexp_replace(CASE
 WHEN suffix(t, 'aux') THEN left(t, length(t) - 3) || 'al' WHEN suffix(t, 'ies') THEN left(t, length(t) - 3) || 'y'
 WHEN regexp_matches(t, '(ch|sh|ss|x|z)es$') THEN left(t, length(t) - 2) WHEN suffix(t, 'ss') THEN t
 WHEN suffix(t, 's') OR (suffix(t, 'x') AND length(t) > 4) THEN left(t, length(t) - 1) ELSE t END, 'ail$', 'al') END"""


def _tok(x: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({_NORM.format(x=x)}, '[0-9a-z]+(?:[.,][0-9]+)*'), lambda t: length(t) >= 2 OR regexp_full_match(t, '[0-9]+')), lambda t: {_FOLD})"


def _flat(x: str) -> str:
    return rf"trim(regexp_replace({_NORM.format(x=x)}, '\s+', ' ', 'g'))"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_EL = """el AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS ord, '#/texts/' || turn AS ref, coalesce(trim(text), '') AS text, role = 'user' AS sec,
 CASE WHEN role = 'user' THEN CAST(1 + turn % 2 AS INT) END AS level, CAST(turn // 4 + 1 AS INT) AS page FROM conversations),
num AS (SELECT *, sum(CAST(sec AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS section_no FROM el)"""
_CLIP = "CASE WHEN length({f}) <= {n} THEN {f} ELSE left({f}, {n} - 1) || '…' END"
_OPEN = rf"CASE WHEN length(f) <= 140 THEN f WHEN length(regexp_extract(left(f, 141), '(?s)^(.*[.?!]) ', 1)) > 24 THEN regexp_extract(left(f, 141), '(?s)^(.*[.?!]) ', 1) ELSE left(f, 139) || '…' END"
_UN = rf"""{_EL},
pre AS (SELECT *, {_OPEN} AS opening FROM (SELECT *, {_collapse('text')} AS f FROM num)),
un0 AS (SELECT doc_id, section_no, arg_min(ref, ord) AS ref, arg_min(f, ord) AS f, arg_min(sec, ord) AS sec, arg_min(coalesce(level, -1), ord) AS lv, CAST(sum(length(text)) AS BIGINT) AS char_len,
  arg_min(page, ord) AS page_no, list_sort(list_distinct(list(page))) AS pages, string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY ord) AS text,
  coalesce(arg_min(opening, ord) FILTER (WHERE NOT sec AND opening <> ''), '') AS lead FROM pre GROUP BY 1, 2),
un AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no) - 1 AS INT) AS ord, ref, CASE WHEN f = '' THEN '(untitled)' ELSE {_CLIP.format(f='f', n=120)} END AS title,
  CASE WHEN sec AND lv >= 0 THEN lv END AS level, page_no, pages, char_len, lead, coalesce(text, '') AS text FROM un0)"""
_ASK = "ask AS (SELECT conv_id AS query_id, conv_id AS doc_id, arg_max(text, turn) AS query FROM conversations GROUP BY conv_id)"
_VIEWS = "vw AS (SELECT doc_id, 'text' AS view, ref, text FROM un UNION ALL SELECT doc_id, 'heading', ref, title FROM un)"


def _bm25(entries: str, by: str, asks: str) -> str:
    """CTEs ending in hits(query_id, by.., ref, score); by ends with a comma or is empty."""
    using = f"({by}token)"
    keyed = "doc_id, " if "doc_id" in by else ""
    group = by.rstrip(", ")
    stat = f"SELECT {by}count(*) AS n, sum(len(tk)) / count(*) AS avgdl FROM en" + (f" GROUP BY {group}" if group else "")
    join_stat = f"JOIN st USING ({group})" if group else ", st"
    return f"""en AS (SELECT *, {_tok('text')} AS tk FROM {entries}),
tf AS (SELECT {by}ref, token, count(*) AS tf FROM (SELECT {by}ref, unnest(tk) AS token FROM en) GROUP BY ALL),
df AS (SELECT {by}token, count(*) AS df FROM tf GROUP BY ALL), st AS ({stat}), ln AS (SELECT {by}ref, len(tk) AS dl FROM en),
qt AS (SELECT query_id, {keyed}unnest({_tok('query')}) AS token FROM {asks}),
hits AS (SELECT query_id, {by}ref, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING ({keyed}token) JOIN df USING {using} JOIN ln USING ({by}ref) {join_stat} GROUP BY ALL)"""


_DOCS = "dc AS (SELECT doc_id AS ref, text FROM documents), bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

# --- text ---


@query(f"SELECT doc_id, array_to_string({_tok('text')}, ' ') AS tokens FROM documents")
def tokenize_documents(s, d):
    return _docs(s, d).select("doc_id", F.array_join(tokenize(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, {_flat('text')} AS flat FROM documents")
def flatten_text(s, d):
    return _docs(s, d).select("doc_id", flatten(F.col("text")).alias("flat"))


@query(f"SELECT doc_id, {_CLIP.format(f='f', n=120)} AS clipped FROM (SELECT doc_id, {_collapse('text')} AS f FROM documents)")
def clip_text(s, d):
    return _docs(s, d).select("doc_id", clip(F.col("text")).alias("clipped"))


@query(f"SELECT doc_id, {_OPEN} AS opening FROM (SELECT doc_id, {_collapse('text')} AS f FROM documents)")
def lead_opening(s, d):
    return _docs(s, d).select("doc_id", opening(F.col("text")).alias("opening"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def escape_html(s, d):
    return _t(s, d, "pages").select("page_id", html_escape(F.col("html")).alias("escaped"))


@query("SELECT doc_id, CASE WHEN n_chars < 1000 THEN n_chars || ' chars' ELSE printf('%.1fk chars', n_chars / 1000.0) END AS size FROM documents")
def human_sizes(s, d):
    return _t(s, d, "documents").select("doc_id", human_size(F.col("n_chars")).alias("size"))


@query(f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({_flat('d.text')}, {_flat('b.text')}) AND {_flat('b.text')} <> ''")
def grounding(s, d):
    """Passages that occur in documents.

    The first and last token of a quote may be cut out of longer words; all tokens between stand in
    every text that holds it. So the rarest of these finds the candidates, which are compared. Quotes
    of fewer than three tokens, part of the stated query set, meet all documents.
    """
    docs = _docs(s, d)
    b = _t(s, d, "benchmark").select("item_id", flatten(F.col("text")).alias("quote"), tokenize(F.col("text")).alias("tk")).filter("quote <> ''")
    long = b.filter(F.size("tk") > 2).select("item_id", "quote", F.array_distinct(F.slice("tk", F.lit(2), F.size("tk") - 2)).alias("inner"))
    words = long.select("item_id", F.explode("inner").alias("token"))
    asked, few = words.select("token").distinct(), small(b)
    held = docs.select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token")).join(F.broadcast(asked) if few else asked, "token", "left_semi")
    df = held.groupBy("token").agg(F.count("*").alias("df"))
    # a token that no document holds has no row and finds nothing
    rarest = words.join(df, "token", "left").groupBy("item_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    pairs = held.join(F.broadcast(rarest) if few else rarest, "token").select("item_id", "doc_id")
    found = pairs.join(docs, "doc_id").join(long.select("item_id", "quote"), "item_id").filter(F.contains(flatten(F.col("text")), F.col("quote"))).select("item_id", "doc_id")
    short = b.filter(F.size("tk") <= 2).select("item_id", "quote")
    return found.unionAll(docs.select("doc_id", flatten(F.col("text")).alias("flat")).join(short, F.contains("flat", "quote")).select("item_id", "doc_id"))


# --- BM25 ---


@query(f"WITH {_EL} SELECT doc_id, ref, token, count(*) AS tf FROM (SELECT doc_id, ref, unnest({_tok('text')}) AS token FROM el) GROUP BY ALL")
def term_freq(s, d):
    return bm25.term_freq(_turns(s, d), ["doc_id"])


@query(f"SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_tok('text')}) AS token FROM documents) GROUP BY token")
def doc_freq(s, d):
    return bm25.doc_freq(bm25.term_freq(_docs(s, d).select(F.col("doc_id").alias("ref"), "text"), []), [])


@query(f"WITH {_EL} SELECT doc_id, count(*) AS n, round(sum(len({_tok('text')})) / count(*), 9) AS avgdl FROM el GROUP BY doc_id")
def bm25_stats(s, d):
    el = _turns(s, d)
    return bm25.stats(el, bm25.term_freq(el, ["doc_id"]), ["doc_id"]).select("doc_id", "n", F.round("avgdl", 9).alias("avgdl"))


@query(f"WITH {_DOCS}, {_bm25('dc', '', 'bq')} SELECT query_id, ref, round(score, 6) AS score FROM hits")
def bm25_score(s, d):
    return _corpus_hits(s, d).select("query_id", "ref", F.round("score", 6).alias("score"))


def _corpus_hits(s, d):
    docs = _docs(s, d).select(F.col("doc_id").alias("ref"), "text")
    return bm25.hits(_t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), docs, [], [])


_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, CAST(ref AS VARCHAR)) AS position"


@query(f"WITH {_DOCS}, {_bm25('dc', '', 'bq')} SELECT query_id, ref, position FROM (SELECT *, {_TOP} FROM hits) WHERE position <= 10")
def bm25_topk(s, d):
    return bm25.ranked(_corpus_hits(s, d), [], 10).select("query_id", "ref", "position")


@query(f"""WITH {_DOCS}, {_bm25('dc', '', 'bq')}, top AS (SELECT query_id, ref, position FROM (SELECT *, {_TOP} FROM hits) WHERE position <= 3)
SELECT query_id, ref, position, contains({_flat('dc.text')}, {_flat('bq.query')}) AND {_flat('bq.query')} <> '' AS grounded FROM top JOIN dc USING (ref) JOIN bq USING (query_id)""")
def grounded_topk(s, d):
    """The three best documents for each passage, and whether they hold it."""
    top = bm25.ranked(_corpus_hits(s, d), [], 3).select("query_id", "ref", "position")
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("ref"), "text")
    b = _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("quote"))
    return top.join(docs, "ref").join(b, "query_id").select("query_id", "ref", "position", grounded(F.col("text"), F.col("quote")).alias("grounded"))


@query(f"""WITH {_EL}, tk AS (SELECT DISTINCT doc_id, ref, unnest({_tok('text')}) AS token FROM el), n AS (SELECT doc_id, count(*) AS n FROM el GROUP BY doc_id),
df AS (SELECT doc_id, token, count(*) AS df FROM tk GROUP BY ALL) SELECT doc_id, ref, token FROM tk JOIN df USING (doc_id, token) JOIN n USING (doc_id) WHERE df <= greatest(1, floor(n * 0.5))""")
def rare_terms(s, d):
    return bm25.rare_terms(_turns(s, d), ["doc_id"])


_REPORT = f"""WITH {_EL}, {_ASK}, tk AS (SELECT DISTINCT doc_id, ref, unnest({_tok('text')}) AS token FROM el),
qt AS (SELECT DISTINCT query_id, doc_id, unnest({_tok('query')}) AS token FROM ask),
able AS (SELECT query_id, doc_id, token, bool_or(ref = '#/texts/0') AS held FROM qt JOIN tk USING (doc_id, token) GROUP BY ALL),
r AS (SELECT query_id, doc_id, string_agg(token, ' ' ORDER BY token) AS answerable, coalesce(string_agg(token, ' ' ORDER BY token) FILTER (WHERE NOT held), '') AS missing, count(*) FILTER (WHERE held) / count(*) AS coverage FROM able GROUP BY ALL)
SELECT query_id, coalesce(answerable, '') AS answerable, coalesce(missing, '') AS missing, round(coalesce(coverage, 1.0), 9) AS coverage FROM ask LEFT JOIN r USING (query_id, doc_id)"""


@query(_REPORT)
def term_coverage(s, d):
    """Answerable and missing terms of each conversation's question, and what its first turn covers."""
    el, asked = _turns(s, d), _asked(s, d)
    picked = asked.select("query_id", "doc_id", F.lit("#/texts/0").alias("ref"))
    out = bm25.term_report(asked, el, picked, ["doc_id"])
    return out.select("query_id", F.array_join("answerable", " ").alias("answerable"), F.array_join("missing", " ").alias("missing"), F.round("coverage", 9).alias("coverage"))


# --- segmentation ---


@query(f"WITH {_EL} SELECT doc_id, ord, ref, section_no FROM num")
def section_scope(s, d):
    return segment.section_numbers(_turns(s, d)).select("doc_id", "ord", "ref", "section_no")


@query(f"WITH {_UN} SELECT doc_id, ord, ref, title, level, page_no, array_to_string(pages, ',') AS pages, char_len, lead, text FROM un")
def unit_build(s, d):
    return _units(s, d).select("doc_id", "ord", "ref", "title", "level", "page_no", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "char_len", "lead", "text")


@query(rf"""WITH {_EL}, p AS (SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS char_len, list(text ORDER BY ord) AS tx FROM el GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS INT) AS ord, '#/pages/' || page AS ref, CASE WHEN f = '' THEN 'Page ' || page ELSE {_CLIP.format(f='f', n=120)} END AS title, char_len
FROM (SELECT *, {_collapse("array_to_string(tx[1:3], ' ')")} AS f FROM p)""")
def page_units(s, d):
    return segment.page_units(_turns(s, d)).select("doc_id", "ord", "ref", "title", "char_len")


@query(f"""WITH {_UN.replace("un AS (", "un1 AS (")}, un AS (SELECT doc_id, ord, ref, CASE WHEN char_len % 11 > 0 THEN 1 + char_len % 4 END AS level FROM un1),
x AS (SELECT p.doc_id, p.ref AS parent, c.ref AS child, c.ord, min(CASE WHEN c.level IS NULL OR c.level <= p.level THEN c.ord END) OVER (PARTITION BY p.doc_id, p.ord) AS stop
FROM un p JOIN un c ON p.doc_id = c.doc_id AND c.ord > p.ord WHERE p.level IS NOT NULL) SELECT doc_id, parent, child FROM x WHERE stop IS NULL OR ord < stop""")
def children_of(s, d):
    """Units below units, with levels made of their sizes, so that they nest four deep and some have none."""
    level = F.when(F.col("char_len") % 11 > 0, (1 + F.col("char_len") % 4).cast("int"))
    return segment.children_of(_units(s, d).withColumn("level", level))


_PRUNED = f"""ld AS (SELECT doc_id, ref, list_distinct({_tok('lead')}) AS tk, {_tok('title')} AS own FROM un WHERE lead <> ''), ln0 AS (SELECT doc_id, count(*) AS n FROM ld GROUP BY 1),
lt AS (SELECT doc_id, ref, own, unnest(tk) AS token FROM ld), ldf AS (SELECT doc_id, token, count(*) AS df FROM lt GROUP BY ALL),
keep AS (SELECT DISTINCT doc_id, ref FROM lt JOIN ldf USING (doc_id, token) JOIN ln0 USING (doc_id) WHERE n >= 2 AND df <= greatest(1, floor(n * 0.5)) AND NOT list_contains(own, token) UNION SELECT doc_id, ref FROM ld JOIN ln0 USING (doc_id) WHERE n < 2)"""


@query(f"WITH {_UN}, {_PRUNED} SELECT doc_id, ref, CASE WHEN k.ref IS NULL THEN '' ELSE lead END AS lead FROM un LEFT JOIN keep k USING (doc_id, ref)")
def boilerplate_prune(s, d):
    return segment.prune_leads(_units(s, d)).select("doc_id", "ref", "lead")


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<(h1|p|li|footer|div)( [^>]*)?>', chr(1) || '\1>', 'g') AS h FROM pages),
x AS (SELECT page_id, unnest(string_split(h, chr(1))[2:]) AS piece, generate_subscripts(string_split(h, chr(1))[2:], 1) - 1 AS ord FROM p)
SELECT page_id AS doc_id, CAST(ord AS INT) AS ord, CASE regexp_extract(piece, '^([a-z0-9]+)>', 1) WHEN 'h1' THEN 'title' WHEN 'p' THEN 'text' WHEN 'li' THEN 'list_item' ELSE 'page_footer' END AS label,
trim(regexp_replace(regexp_replace(regexp_replace(piece, '^[a-z0-9]+>', ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM x""")
def html_elements(s, d):
    return tables.from_html(_t(s, d, "pages")).select("doc_id", "ord", "label", "text")


# --- serialized trees ---


def _ref(path) -> "F.Column":
    return F.struct(path.alias("$ref"))


def _ordered_list(item) -> "F.Column":
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))), lambda s: s["x"])


def _turn_trees(s, d):
    """A conversation as a JSON tree: user turns are headings that hold the turns after them; pages of four turns."""
    from pyspark.sql import Window

    c = _t(s, d, "conversations").withColumn("user", F.col("role") == "user")
    upto = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("head", F.max(F.when(F.col("user"), F.col("turn"))).over(upto))
    path = F.concat(F.lit("#/texts/"), F.col("turn").cast("string"))
    box = F.struct(F.lit(0.0).alias("l"), (100.0 - F.col("turn")).alias("t"), F.lit(10.0).alias("r"), (90.0 - F.col("turn")).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    prov = F.array(F.struct((F.floor(F.col("turn") / 4) + 1).alias("page_no"), box.alias("bbox")))
    below = F.transform(F.array_sort(F.collect_list(F.when(~F.col("user"), F.col("turn"))).over(Window.partitionBy("conv_id", "head"))), lambda t: _ref(F.concat(F.lit("#/texts/"), t.cast("string"))))
    item = F.struct(
        path.alias("self_ref"), F.when(F.col("user"), "section_header").otherwise("text").alias("label"), F.col("text"), F.when(F.col("user"), 1 + F.col("turn") % 2).alias("level"),
        F.when(F.col("user"), F.col("below")).alias("children"), prov.alias("prov"), F.when(F.col("role") == "system", "furniture").alias("content_layer"),
    )
    top = F.when(F.col("user") | F.col("head").isNull(), _ref(path))
    rows = c.withColumn("below", below).groupBy("conv_id").agg(_ordered_list(item).alias("texts"), F.filter(_ordered_list(top), lambda x: x.isNotNull()).alias("roots"))
    pages = F.expr("map('1', named_struct('size', named_struct('height', 100.0D)))")
    tree = F.struct(F.lit("talk").alias("name"), F.struct(F.col("roots").alias("children")).alias("body"), "texts", pages.alias("pages"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.to_json(tree).alias("document_json"))


@query(r"""SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ord, '#/texts/' || turn AS ref, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text,
CASE WHEN role = 'user' THEN 'SectionHeader' ELSE 'Paragraph' END AS graph_label, CAST(CASE WHEN role = 'user' THEN 1 + turn % 2 END AS INT) AS level, role IS NOT DISTINCT FROM 'system' AS is_furniture,
CAST(turn // 4 + 1 AS INT) AS page_no, CASE WHEN turn < 4 THEN CAST(turn AS DOUBLE) END AS top FROM conversations""")
def json_elements(s, d):
    """Elements of JSON trees in reading order; boxes only on the page whose height is known."""
    found = docjson.elements(docjson.project(_turn_trees(s, d)))
    return found.select("doc_id", "ord", "ref", "text", "graph_label", "level", "is_furniture", "page_no", F.col("bbox.t").alias("top"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_returnflag) AS k, l_suppkey, l_returnflag FROM lineitem)
SELECT l_orderkey AS doc_id, '<table><tr><th colspan="2">supplier &amp; flag</th></tr>' || string_agg('<tr><td>' || l_suppkey || '</td><td>' || CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END || '</td></tr>', '' ORDER BY k) || '</table>' AS html FROM c GROUP BY l_orderkey""")
def json_tables(s, d):
    """An order's lines as a JSON table, rendered: a head over both columns, holes for returned lines."""
    from pyspark.sql import Window

    li = _t(s, d, "lineitem").withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_returnflag")))
    cell = lambda text, y, x, wide, head: F.struct(text.alias("text"), y.alias("start_row_offset_idx"), (y + 1).alias("end_row_offset_idx"), F.lit(x).alias("start_col_offset_idx"), F.lit(x + wide).alias("end_col_offset_idx"), F.lit(head).alias("column_header"))
    lines = F.array(cell(F.col("l_suppkey").cast("string"), F.col("k"), 0, 1, False), F.when(F.col("l_returnflag") != "R", cell(F.col("l_returnflag"), F.col("k"), 1, 1, False)))
    rows = li.groupBy("l_orderkey").agg(F.filter(F.flatten(F.collect_list(lines)), lambda x: x.isNotNull()).alias("cells"))
    cells = F.concat(F.array(cell(F.lit("supplier & flag"), F.lit(0), 0, 2, True)), "cells")
    item = F.struct(F.lit("#/tables/0").alias("self_ref"), F.lit("table").alias("label"), F.struct(cells.alias("table_cells")).alias("data"))
    trees = rows.select(F.col("l_orderkey").alias("doc_id"), F.to_json(F.struct(F.array(item).alias("tables"))).alias("document_json"))
    return docjson.elements(docjson.project(trees)).select("doc_id", F.col("text").alias("html"))


def _plain_trees(s, d):
    """Conversations as flat trees: with headings, with pages alone, or without either (by id modulo 3); pages 1, 2 and 7 are listed."""
    c, kind = _t(s, d, "conversations"), F.col("conv_id") % 3
    path = F.concat(F.lit("#/texts/"), F.col("turn").cast("string"))
    prov = F.when(kind < 2, F.array(F.struct((F.floor(F.col("turn") / 4) + 1).alias("page_no"))))
    item = F.struct(path.alias("self_ref"), F.when((kind == 0) & (F.col("role") == "user"), "section_header").otherwise("text").alias("label"), "text", prov.alias("prov"), F.when((kind == 1) & (F.col("role") == "system"), "furniture").alias("content_layer"))
    rows = c.groupBy("conv_id").agg(_ordered_list(item).alias("texts"), _ordered_list(_ref(path)).alias("roots"))
    size = F.struct(F.struct(F.lit(100.0).alias("height")).alias("size"))
    pages = F.create_map(*[x for n in ("7", "2", "1") for x in (F.lit(n), size.getField("size"))])
    tree = F.struct(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("talk "), F.col("conv_id").cast("string"))).alias("name"), F.struct(F.col("roots").alias("children")).alias("body"), "texts", pages.alias("pages"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.to_json(tree).alias("document_json"))


@query(rf"""WITH el AS (SELECT conv_id AS doc_id, turn AS ord, '#/texts/' || turn AS ref, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text, conv_id % 3 = 0 AND role = 'user' AS sec,
 CASE WHEN conv_id % 3 < 2 THEN turn // 4 + 1 END AS page, conv_id % 3 = 1 AND coalesce(role = 'system', false) AS fur FROM conversations),
kd AS (SELECT doc_id, CASE WHEN bool_or(sec) THEN 'section' WHEN bool_or(NOT fur AND page IN (1, 2, 7)) THEN 'page' ELSE 'document' END AS kind FROM el GROUP BY doc_id),
rd AS (SELECT el.*, kind, {_collapse('text')} AS f, sum(CAST(sec AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS sn FROM el JOIN kd USING (doc_id) WHERE NOT fur),
op AS (SELECT *, {_OPEN} AS opening FROM rd),
se AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sn) - 1 AS ord, arg_min(ref, ord) AS ref, 'section' AS kind, arg_min(f, ord) AS f, '(untitled)' AS other, sum(length(text)) AS char_len, coalesce(arg_min(opening, ord) FILTER (WHERE NOT sec AND opening <> ''), '') AS lead FROM op WHERE kind = 'section' GROUP BY doc_id, sn),
pg AS (SELECT doc_id, CASE page WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS ord, '#/pages/' || page AS ref, 'page' AS kind, {_collapse("array_to_string(list(text ORDER BY ord)[1:3], ' ')")} AS f, 'Page ' || page AS other, sum(length(text)) AS char_len, '' AS lead FROM op WHERE kind = 'page' AND page IN (1, 2, 7) GROUP BY doc_id, page),
dc AS (SELECT doc_id, 0 AS ord, arg_min(ref, ord) AS ref, 'document' AS kind, CASE WHEN doc_id % 2 = 0 THEN 'talk ' || doc_id ELSE 'Document' END AS f, '' AS other, sum(length(text)) AS char_len, coalesce(arg_min(opening, ord) FILTER (WHERE opening <> ''), '') AS lead FROM op WHERE kind = 'document' GROUP BY doc_id)
SELECT doc_id, CAST(ord AS INT) AS ord, ref, kind, CASE WHEN f = '' THEN other ELSE {_CLIP.format(f='f', n=120)} END AS title, CAST(char_len AS BIGINT) AS char_len, lead FROM (SELECT * FROM se UNION ALL SELECT * FROM pg UNION ALL SELECT * FROM dc)""")
def unit_kinds(s, d):
    """Units of trees that fall back from sections to pages to the whole document."""
    projected = docjson.project(_plain_trees(s, d))
    units = segment.build_units(docjson.elements(projected), projected)
    return units.select("doc_id", "ord", "ref", "kind", "title", "char_len", "lead")


@query(r"""WITH t AS (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM conversations),
g AS (SELECT doc_id, '#/groups/0' AS ref, regexp_replace(coalesce(string_agg(raw, ' ' ORDER BY turn) FILTER (WHERE raw <> ''), ''), '^\s+|\s+$', '', 'g') AS text, count(*) AS n_provs, '' AS summary, '' AS keywords FROM t WHERE turn < 3 GROUP BY doc_id),
p AS (SELECT doc_id, '#/pictures/0' AS ref, concat_ws(' ', '[figure]', max(text) FILTER (WHERE turn = 3 AND text <> ''), max(text) FILTER (WHERE turn = 4 AND text <> '')) AS text, 1 AS n_provs, 'seen' AS summary, 'a,b' AS keywords FROM t GROUP BY doc_id)
SELECT doc_id, ref, text, CAST(n_provs AS INT) AS n_provs, summary, keywords FROM (SELECT * FROM g UNION ALL SELECT * FROM p UNION ALL SELECT doc_id, '#/texts/' || turn, text, 1, '', '' FROM t WHERE turn IN (3, 4) OR turn > 5)""")
def json_groups(s, d):
    """Inline runs folded into their group; a picture with caption, annotation and summary, whose own child is hidden."""
    c = _t(s, d, "conversations")
    path = F.concat(F.lit("#/texts/"), F.col("turn").cast("string"))
    item = F.struct(path.alias("self_ref"), F.lit("text").alias("label"), "text", F.array(F.struct(F.lit(1).alias("page_no"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("bbox"))).alias("prov"))
    rows = c.groupBy("conv_id").agg(_ordered_list(item).alias("texts"), _ordered_list(F.when(F.col("turn") > 5, _ref(path))).alias("roots"), F.max(F.when(F.col("turn") == 4, F.col("text"))).alias("note"))
    ref = lambda p: _ref(F.lit(p))
    group = F.struct(F.lit("#/groups/0").alias("self_ref"), F.lit("inline").alias("label"), F.array(*[ref(f"#/texts/{k}") for k in range(3)]).alias("children"))
    meta = F.struct(F.struct(F.lit(" seen ").alias("text")).alias("summary"), F.struct(F.array(F.lit(" a"), F.lit(" "), F.lit("b")).alias("values")).alias("keywords"))
    picture = F.struct(
        F.lit("#/pictures/0").alias("self_ref"), F.lit("picture").alias("label"), F.array(ref("#/texts/3")).alias("captions"), F.array(ref("#/texts/5")).alias("children"),
        F.array(F.struct(F.col("note").alias("text"))).alias("annotations"), meta.alias("meta"), F.array(F.struct(F.lit(1).alias("page_no"))).alias("prov"),
    )
    body = F.struct(F.concat(F.array(ref("#/groups/0"), ref("#/pictures/0")), F.filter("roots", lambda x: x.isNotNull())).alias("children"))
    trees = rows.select(F.col("conv_id").alias("doc_id"), F.to_json(F.struct(body.alias("body"), "texts", F.array(group).alias("groups"), F.array(picture).alias("pictures"))).alias("document_json"))
    found = docjson.elements(docjson.project(trees))
    return found.select("doc_id", "ref", "text", F.size("provs").alias("n_provs"), "summary", F.array_join("keywords", ",").alias("keywords"))


# --- ranking ---

_FUSED = f"""{_UN}, {_ASK}, {_VIEWS}, {_bm25('vw', 'doc_id, view, ', 'ask')},
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, view ORDER BY round(score, 10) DESC, ref) AS position FROM hits),
fu AS (SELECT query_id, doc_id, ref, sum(1.0::DOUBLE / (60 + position)) AS score, 'lexical match (' || string_agg(view || ' rank ' || position, ', ' ORDER BY view DESC) || ')' AS rationale FROM pos GROUP BY ALL),
sl AS (SELECT f.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 10) DESC, un.ord) AS place FROM fu f JOIN un USING (doc_id, ref))"""


@query(f"WITH {_FUSED} SELECT query_id, doc_id, place, ref, round(score, 9) AS score, rationale FROM sl WHERE place <= 8")
def rrf_fusion(s, d):
    return rank.fuse(_asked(s, d), _units(s, d)).select("query_id", "doc_id", "place", "ref", F.round("score", 9).alias("score"), "rationale")


@query(f"""WITH {_FUSED}, m AS (SELECT query_id, doc_id, least(count(*), 8) AS n, max(score) FILTER (WHERE place = 1) AS a, max(score) FILTER (WHERE place = 2) AS b, max(ref) FILTER (WHERE place = 1) AS top FROM sl GROUP BY ALL),
ut AS (SELECT DISTINCT doc_id, ref, unnest({_tok('text')}) AS token FROM un), qd AS (SELECT DISTINCT query_id, doc_id, token FROM qt),
ab AS (SELECT query_id, doc_id, token, bool_or(ut.ref = m.top) AS held FROM qd JOIN m USING (query_id, doc_id) JOIN ut USING (doc_id, token) GROUP BY ALL),
cv AS (SELECT query_id, doc_id, count(*) FILTER (WHERE held) / count(*) AS c FROM ab GROUP BY ALL),
sg AS (SELECT query_id, n, CASE WHEN b > 0 THEN a / b END AS margin, coalesce(c, 1.0) AS coverage FROM m LEFT JOIN cv USING (query_id, doc_id))
SELECT query_id, n, round(coalesce(margin, -1), 9) AS margin, round(coverage, 9) AS coverage, coverage >= 0.34 AND coalesce(margin >= 1.15, true) AS confident,
CAST(CASE WHEN n < 2 OR coalesce(margin >= 1.5, true) THEN 1 ELSE 3 END AS INT) AS fanout FROM sg""")
def confidence_gate(s, d):
    asked, units = _asked(s, d), _units(s, d)
    out = rank.signals(rank.fuse(asked, units), asked, units)
    margin = F.when(F.col("margin") == float("inf"), F.lit(-1.0)).otherwise(F.col("margin"))
    return out.select("query_id", "n", F.round(margin, 9).alias("margin"), F.round("coverage", 9).alias("coverage"), "confident", "fanout")


_ENRICHED = f"""{_UN}, eu AS (SELECT *, CASE WHEN char_len % 3 = 0 THEN lead ELSE '' END AS summary, CASE WHEN char_len % 4 = 1 THEN string_split(title, ' ')[1:3] ELSE [] END AS kw FROM un),
vw AS (SELECT doc_id, 'text' AS view, ref, text FROM un UNION ALL SELECT doc_id, 'heading', ref, title FROM un UNION ALL SELECT doc_id, 'summary', ref, summary || ' ' || array_to_string(kw, ' ') FROM eu WHERE summary <> '' OR len(kw) > 0),
ask0 AS (SELECT conv_id, arg_max(text, turn) AS query, coalesce(arg_min(text, turn), '') AS expansion FROM conversations GROUP BY conv_id),
ask AS (SELECT conv_id * 2 AS query_id, conv_id AS doc_id, query FROM ask0 UNION ALL SELECT conv_id * 2 + 1, conv_id, expansion FROM ask0 WHERE expansion <> ''), {_bm25('vw', 'doc_id, view, ', 'ask')},
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, view ORDER BY round(score, 10) DESC, ref) AS position FROM hits),
fu AS (SELECT query_id // 2 AS query_id, doc_id, ref, sum(CASE WHEN view = 'summary' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN query_id % 2 = 1 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END / (60 + position)) AS score,
  'lexical match (' || coalesce(string_agg(view || ' rank ' || position, ', ' ORDER BY CASE view WHEN 'text' THEN 0 WHEN 'heading' THEN 1 ELSE 2 END) FILTER (WHERE query_id % 2 = 0), '') || ')' AS rationale FROM pos WHERE ref <> '#/texts/0' GROUP BY 1, 2, 3),
sl AS (SELECT f.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 10) DESC, un.ord) AS place FROM fu f JOIN un USING (doc_id, ref))"""


@query(f"WITH {_ENRICHED} SELECT query_id, doc_id, place, ref, round(score, 9) AS score, rationale FROM sl WHERE place <= 8")
def enriched_fusion(s, d):
    """Shortlists of units with summaries and keywords, for questions with expansions, without the first unit, which was visited."""
    units = _units(s, d)
    keywords = F.when(F.col("char_len") % 4 == 1, F.slice(F.split("title", " "), 1, 3)).otherwise(F.array().cast("array<string>"))
    units = units.withColumn("summary", F.when(F.col("char_len") % 3 == 0, F.col("lead")).otherwise("")).withColumn("keywords", keywords)
    first = _t(s, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.coalesce(F.min_by("text", "turn"), F.lit("")).alias("expansion"))
    asked = _asked(s, d).join(first, "query_id")
    visited = asked.select("query_id", "doc_id", F.lit("#/texts/0").alias("ref"))
    return rank.fuse(asked, units, visited=visited).select("query_id", "doc_id", "place", "ref", F.round("score", 9).alias("score"), "rationale")


# --- packing and maps ---

_CUT = "chr(10) || chr(10) || '[… excerpt truncated to fit the context budget …]'"


@query(f"""WITH {_EL}, r AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS upto FROM el WHERE text <> ''),
f AS (SELECT *, min(CASE WHEN upto > 800 THEN ord END) OVER (PARTITION BY doc_id) AS first FROM r),
k AS (SELECT doc_id, ord, first, CASE WHEN upto <= 800 THEN text WHEN ord = first AND 800 - (upto - length(text)) > 200 THEN left(text, CAST(800 - (upto - length(text)) AS BIGINT)) END AS text FROM f WHERE first IS NULL OR ord <= first)
SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ord), '') || CASE WHEN bool_or(first IS NOT NULL) THEN {_CUT} ELSE '' END AS text, bool_or(first IS NOT NULL) AS truncated FROM k GROUP BY doc_id""")
def head_first_pack(s, d):
    return pack.head_first(_turns(s, d), ["doc_id"], 800).select("doc_id", "text", "truncated")


@query(f"""WITH RECURSIVE {_EL}, {_ASK}, ne AS (SELECT doc_id, ord, ref, text FROM el WHERE text <> ''), {_bm25('ne', 'doc_id, ', 'ask')},
sc AS (SELECT doc_id, ord, text, coalesce(round(score, 10), 0) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(round(score, 10), 0) DESC, ord) AS i FROM ne LEFT JOIN hits USING (doc_id, ref)),
tot AS (SELECT doc_id FROM sc GROUP BY doc_id HAVING sum(length(text)) > 800 AND max(score) > 0),
g(doc_id, i, used, took, ord) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(-1 AS INT) FROM tot
  UNION ALL SELECT sc.doc_id, sc.i, CASE WHEN g.used + length(sc.text) <= 800 THEN g.used + length(sc.text) ELSE g.used END, g.used + length(sc.text) <= 800, sc.ord FROM g JOIN sc ON sc.doc_id = g.doc_id AND sc.i = g.i + 1),
kept AS (SELECT doc_id, ord FROM g WHERE took), cnt AS (SELECT doc_id, count(*) AS n FROM sc GROUP BY doc_id),
chosen AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) || CASE WHEN max(n) > count(*) THEN chr(10) || chr(10) || '[… ' || (max(n) - count(*)) || ' passage(s) of this section omitted; the ones matching the question are shown …]' ELSE '' END AS text, max(n) > count(*) AS truncated
  FROM kept JOIN sc USING (doc_id, ord) JOIN cnt USING (doc_id) GROUP BY doc_id),
r AS (SELECT doc_id, ord, text, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS upto FROM ne WHERE doc_id NOT IN (SELECT doc_id FROM chosen)),
f AS (SELECT *, min(CASE WHEN upto > 800 THEN ord END) OVER (PARTITION BY doc_id) AS first FROM r),
k AS (SELECT doc_id, ord, first, CASE WHEN upto <= 800 THEN text WHEN ord = first AND 800 - (upto - length(text)) > 200 THEN left(text, CAST(800 - (upto - length(text)) AS BIGINT)) END AS text FROM f WHERE first IS NULL OR ord <= first)
SELECT * FROM chosen UNION ALL SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ord), '') || CASE WHEN bool_or(first IS NOT NULL) THEN {_CUT} ELSE '' END, bool_or(first IS NOT NULL) FROM k GROUP BY doc_id""")
def relevance_pack(s, d):
    asked = _asked(s, d).select("doc_id", "query")
    return pack.by_relevance(_turns(s, d), asked, ["doc_id"], 800).select("doc_id", "text", "truncated")


_LINES = f"""ol AS (SELECT doc_id, ord, ref, greatest(coalesce(level, 0), 0) AS lvl, repeat('  ', CAST(greatest(coalesce(level, 0), 0) AS BIGINT)) || '- ' || ref || ' · ' || CASE WHEN level IS NULL THEN 'section' WHEN level = 0 THEN 'title' ELSE 'h' || level END
 || coalesce(', p.' || page_no, '') || ' · ' || CASE WHEN char_len < 1000 THEN char_len || ' chars' ELSE printf('%.1fk chars', char_len / 1000.0) END || ' · ' || title AS line, lead FROM un)"""


@query(f"WITH {_UN}, {_LINES} SELECT doc_id, ref, line || CASE WHEN lead = '' THEN '' ELSE chr(10) || repeat('  ', CAST(lvl AS BIGINT)) || '    ↳ ' || lead END AS rich, line AS plain FROM ol")
def outline_lines(s, d):
    return outline.lines(_units(s, d)).select("doc_id", "ref", "rich", "plain")


@query(f"""WITH {_UN.replace("un AS (", "un1 AS (")}, {_PRUNED.replace("FROM un ", "FROM un1 ")}, un AS (SELECT un1.* EXCLUDE (lead), CASE WHEN k.ref IS NULL THEN '' ELSE lead END AS lead FROM un1 LEFT JOIN keep k USING (doc_id, ref)), {_LINES},
vr AS (SELECT doc_id, ord, lvl, 'rich' AS var, line || CASE WHEN lead = '' THEN '' ELSE chr(10) || repeat('  ', CAST(lvl AS BIGINT)) || '    ↳ ' || lead END AS line, lead <> '' AS shows FROM ol UNION ALL SELECT doc_id, ord, lvl, 'plain', line, false FROM ol),
lc AS (SELECT var, doc_id, lvl, count(*) AS n, sum(length(line) + 1) AS c FROM vr GROUP BY ALL),
cm AS (SELECT *, sum(n) OVER w AS upto, sum(c) OVER w - 1 AS size, max(lvl) OVER (PARTITION BY var, doc_id) AS deepest FROM lc WINDOW w AS (PARTITION BY var, doc_id ORDER BY lvl)),
bs AS (SELECT var, doc_id, max(lvl) FILTER (WHERE size <= 400) AS fits, min(lvl) AS least, max(deepest) AS deepest FROM cm WHERE lvl = deepest OR upto >= 8 GROUP BY ALL),
kp AS (SELECT vr.*, fits, deepest, count(*) OVER (PARTITION BY var, doc_id) AS n, row_number() OVER (PARTITION BY var, doc_id ORDER BY ord) - 1 AS i FROM vr JOIN bs USING (var, doc_id) WHERE lvl <= coalesce(fits, least)),
tn AS (SELECT *, CASE WHEN i <= n - 1 - i THEN 2 * i ELSE 2 * (n - 1 - i) + 1 END AS turn FROM kp),
bf AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY var, doc_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM tn),
ct AS (SELECT *, coalesce(turn < min(CASE WHEN fits IS NULL AND used + length(line) + 60 > 400 THEN turn END) OVER (PARTITION BY var, doc_id), true) AS kept FROM bf),
mp AS (SELECT var, doc_id, count(*) FILTER (WHERE kept) AS shown, max(n) AS n, max(fits) AS fits, max(deepest) AS deepest, string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE kept AND turn % 2 = 0) AS head, string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE kept AND turn % 2 = 1) AS tail FROM ct GROUP BY ALL),
mt AS (SELECT var, doc_id, shown, CASE WHEN fits IS NOT NULL THEN fits = deepest ELSE shown = n END AS complete, concat_ws(chr(10), head, CASE WHEN shown < n THEN '  […  ' || (n - shown) || ' section(s) omitted from this map — ask to widen the outline …]' END, tail) AS text FROM mp),
sm AS (SELECT doc_id, bool_or(shows) AS leads FROM vr GROUP BY doc_id),
us AS (SELECT r.doc_id, NOT r.complete AND leads AND p.shown > r.shown AS u FROM mt r JOIN mt p ON r.doc_id = p.doc_id AND r.var = 'rich' AND p.var = 'plain' JOIN sm ON sm.doc_id = r.doc_id)
SELECT doc_id, text, CAST(shown AS INT) AS n_shown, complete FROM mt JOIN us USING (doc_id) WHERE (var = 'plain') = u""")
def outline_render(s, d):
    return outline.render(segment.prune_leads(_units(s, d)), budget=400).select("doc_id", "text", F.size("refs").alias("n_shown"), "complete")


# --- trees, boxes, records ---


@query("""WITH e AS (SELECT n_regionkey AS tree, 'n' || n_nationkey AS node, [0, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT)] AS path, n_nationkey FROM nation),
c AS (SELECT e.tree, 'c' || c_custkey AS node, list_append(path, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT)) AS path FROM customer JOIN e ON c_nationkey = n_nationkey),
a AS (SELECT r_regionkey AS tree, 'r' || r_regionkey AS node, [0] AS path FROM region UNION ALL SELECT tree, node, path FROM e UNION ALL SELECT * FROM c)
SELECT tree, node, CAST(row_number() OVER (PARTITION BY tree ORDER BY path) - 1 AS INT) AS ord FROM a""")
def dfs_order(s, d):
    """Pre-order of the trees region, nation, customer."""
    from pyspark.sql import Window

    n, c = _t(s, d, "nation"), _t(s, d, "customer")
    nth = lambda by, key: F.row_number().over(Window.partitionBy(by).orderBy(key))
    upper = n.select(F.col("n_regionkey").alias("tree"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), nth("n_regionkey", "n_nationkey").alias("pos"))
    lower = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("tree"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"), nth("c_nationkey", "c_custkey").alias("pos"))
    roots = _t(s, d, "region").select(F.col("r_regionkey").alias("tree"), F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return geometry.reading_order(upper.union(lower), roots)


@query("""SELECT l_orderkey, l_linenumber, l, CASE WHEN o THEN 100 - t ELSE t END AS t, r, CASE WHEN o THEN 100 - b ELSE b END AS b FROM
(SELECT l_orderkey, l_linenumber, l_quantity AS l, CAST(l_linenumber AS DOUBLE) AS t, l_quantity + l_linenumber - 3 AS r, l_discount * 100 AS b, l_linenumber % 2 = 0 AS o FROM lineitem)
WHERE r > l AND CASE WHEN o THEN 100 - b > 100 - t ELSE b > t END""")
def bbox_topleft(s, d):
    """Boxes made of order lines, turned to the top left corner; those without area go."""
    li = _t(s, d, "lineitem")
    origin = F.when(F.col("l_linenumber") % 2 == 0, "BOTTOMLEFT").otherwise("TOPLEFT")
    box = geometry.top_left(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_quantity") + F.col("l_linenumber") - 3, F.col("l_discount") * 100, origin, F.lit(100.0))
    return li.select("l_orderkey", "l_linenumber", box.alias("x")).filter("x is not null").select("l_orderkey", "l_linenumber", "x.*")


_STEPS = """st AS (SELECT conv_id AS run_id, turn, text, length(text) % 7 = 0 AS suff, length(text) % 3 = 0 AS absent, count(*) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS unread,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE text IS NOT NULL),
v AS (SELECT *, sum(CAST(absent AS INT)) OVER (PARTITION BY run_id ORDER BY turn) AS votes FROM st),
e AS (SELECT *, CASE WHEN suff THEN 'answered' WHEN votes >= 2 THEN 'not_in_document' WHEN k >= 6 THEN CASE WHEN unread > 0 THEN 'budget_exhausted' ELSE 'insufficient_evidence' END WHEN unread = 0 THEN 'insufficient_evidence' END AS status FROM v),
tr AS (SELECT run_id, arg_min(status, k) FILTER (WHERE status IS NOT NULL) AS status, arg_min(text, k) FILTER (WHERE status IS NOT NULL) AS answer, CAST(min(k) FILTER (WHERE status IS NOT NULL) AS INT) AS n_steps FROM e GROUP BY run_id)"""


def _steps(s, d):
    """Turns as reads; a turn without a text is none."""
    from pyspark.sql import Window

    c = _t(s, d, "conversations").filter("text is not null")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step_no"), (F.length("text") % 7 == 0).alias("sufficient"), (F.length("text") % 3 == 0).alias("absent"), F.col("text").alias("response"), (F.count("*").over(Window.partitionBy("conv_id")) - k).alias("unread"))


@query(f"WITH {_STEPS} SELECT run_id, status, answer, status = 'answered' AS converged, n_steps FROM tr")
def status_rollup(s, d):
    return report.rollup(_steps(s, d)).drop("notes")


@query(f"""WITH {_STEPS}, p AS (SELECT *, CASE status WHEN 'not_in_document' THEN '[not answered — this document does not cover the question]'
WHEN 'insufficient_evidence' THEN '[partial answer — the document did not fully answer this]' WHEN 'budget_exhausted' THEN '[partial answer — the run hit its budget before converging]' END AS prefix FROM tr)
SELECT run_id, status, CASE WHEN prefix IS NULL THEN answer WHEN answer = '' THEN prefix ELSE prefix || chr(10) || chr(10) || answer END AS answer FROM p""")
def flat_view(s, d):
    return report.flat_answers(report.rollup(_steps(s, d))).select("run_id", "status", "answer")


# --- reading runs with a model that goes by words ---


@query(f"""WITH {_EL}, tx AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (WHERE text <> '') AS t, arg_min(ref, ord) AS ref, list_sort(list_distinct(list(page) FILTER (WHERE text <> ''))) AS pages FROM el GROUP BY doc_id),
v AS (SELECT *, contains(coalesce(t, ''), 'ment') AS hit, contains(coalesce(t, ''), 'der') AS no FROM tx)
SELECT doc_id, CASE WHEN hit THEN 'answered' WHEN no THEN 'not_in_document' ELSE 'insufficient_evidence' END AS status, CASE WHEN hit THEN 'found' ELSE 'not here' END AS answer, CAST(1 AS INT) AS calls, hit AS converged, ref, CAST(length(coalesce(t, '')) AS INT) AS excerpt_chars, array_to_string(pages, ',') AS pages, CASE WHEN hit THEN true END AS grounded FROM v""")
def reading_direct(s, d):
    """Conversations short enough to be read whole: one call each."""
    runs = _asked(s, d).select(F.col("query_id").alias("run_id"), "doc_id", "query")
    got = reading.read(runs, _turns(s, d), RuleChat(("ment",), ("der",)), reading.Limits(direct_chars=100_000, excerpt_chars=100_000, deadline_s=36_000))
    step = F.get("steps", F.lit(0))
    return got.select("doc_id", "status", "answer", "calls", "converged", step["ref"].alias("ref"), step["excerpt_chars"].alias("excerpt_chars"), F.array_join(step["pages"].cast("array<string>"), ",").alias("pages"), step["grounded"].alias("grounded"))


@query("""WITH u AS (SELECT n_regionkey AS doc_id, n_name, '#/texts/' || 2 * n_nationkey AS ref, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation),
a AS (SELECT doc_id, max(ref) FILTER (WHERE n_name = 'NATION_7') AS hit, count(*) FILTER (WHERE i <= 2 AND (contains(n_name, 'NATION_1') OR contains(n_name, 'NATION_6'))) AS votes, string_agg(ref, ',' ORDER BY i) FILTER (WHERE i <= 2) AS two FROM u GROUP BY doc_id)
SELECT CAST(doc_id AS INT) AS doc_id, CASE WHEN hit IS NOT NULL THEN 'answered' WHEN votes >= 2 THEN 'not_in_document' ELSE 'budget_exhausted' END AS status, CASE WHEN hit IS NOT NULL THEN 'found' ELSE 'composed' END AS answer,
CAST(CASE WHEN hit IS NOT NULL THEN 1 ELSE 6 END AS INT) AS calls, hit IS NOT NULL AS converged, coalesce(hit, two) AS refs, CAST(CASE WHEN hit IS NOT NULL THEN 0 ELSE 2 END AS INT) AS n_notes FROM a""")
def reading_loop(s, d):
    """Regions as documents with a section a nation, read part by part: one is found by its words, one is voted out, the others run out of steps.

    Where no word of the question occurs the first round asks for words, has a part chosen and reads it. The second asks
    again and reads the part that the words of the note ("not here") find; with one step left it has none chosen. Two notes
    are composed: six calls.
    """
    n = _t(s, d, "nation").select(F.col("n_regionkey").cast("int").alias("doc_id"), (2 * F.col("n_nationkey")).alias("i"), "n_name")
    text = F.concat(F.col("n_name"), F.lit(" is told of here"))
    row = lambda at, text, label: n.select("doc_id", at.alias("i"), text.alias("text"), F.lit(label).alias("label"))
    both = row(F.col("i"), F.col("n_name"), "section_header").unionAll(row(F.col("i") + 1, text, "text"))
    el = tables.elements(both, F.col("doc_id"), F.col("i"), F.col("text"), F.col("label"), F.when(F.col("label") == "section_header", 1), F.lit(False), F.lit(1))
    runs = n.select("doc_id").distinct().select(F.col("doc_id").alias("run_id"), "doc_id", F.lit("number 7").alias("query"))
    got = reading.read(runs, el, RuleChat(("NATION_7",), ("NATION_1", "NATION_6")), reading.Limits(max_steps=2, direct_chars=0, deadline_s=36_000))
    return got.select("doc_id", "status", "answer", "calls", "converged", F.array_join(F.transform("steps", lambda x: x["ref"]), ",").alias("refs"), F.size("notes").alias("n_notes"))


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def digest_dedupe(s, d):
    """Equal texts by digest, the smallest id standing for them."""
    return _t(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string(list_distinct(list_sort({_tok('text')})), ' ') AS x FROM documents WHERE false UNION ALL SELECT doc_id, string_agg(token, ' ' ORDER BY i) AS x FROM (SELECT doc_id, token, min(i) AS i FROM (SELECT doc_id, unnest({_tok('text')}) AS token, generate_subscripts({_tok('text')}, 1) AS i FROM documents) GROUP BY 1, 2) GROUP BY doc_id")
def ordered_distinct(s, d):
    """Distinct tokens in the order first seen, of documents that have any."""
    return _docs(s, d).select("doc_id", F.array_join(F.array_distinct(tokenize(F.col("text"))), " ").alias("x")).filter("x <> ''")
