import math

from pagewright.operators import bm25, geometry, outline, pack, rank, report, segment
from pagewright.sources import tables
from pyspark.sql import functions as F

ELEMENT = "doc_id int, ord int, ref string, text string, label string, level int, is_section boolean, is_prose boolean, is_furniture boolean, page_no int, pages array<int>, summary string, keywords array<string>"


def elements(spark, rows):
    """rows: (doc_id, ord, label, level, text)."""
    full = [(d, o, f"#/texts/{o}", t, la, lv, la in ("title", "section_header"), la == "text", la == "page_header", 1 + o // 3, [1 + o // 3], "", []) for d, o, la, lv, t in rows]
    return spark.createDataFrame(full, ELEMENT)


REPORT = [(1, 0, "text", None, "Before any heading."), (1, 1, "section_header", 1, "Revenue"), (1, 2, "text", None, "Revenue was 12.4M EUR."), (1, 3, "page_header", None, "running head"), (1, 4, "section_header", 1, "Risks"), (1, 5, "section_header", 2, "Legal"), (1, 6, "text", None, "One lawsuit is open.")]


def test_sections_and_children(spark):
    units = segment.build_units(elements(spark, REPORT))
    rows = units.orderBy("ord").collect()
    assert [r.title for r in rows] == ["Before any heading.", "Revenue", "Risks", "Legal"]
    assert [r.level for r in rows] == [None, 1, 1, 2]
    assert rows[1].text == "Revenue\n\nRevenue was 12.4M EUR." and rows[1].char_len == 29
    assert {(r.parent, r.child) for r in segment.children_of(units).collect()} == {("#/texts/4", "#/texts/5")}


def test_headless_falls_back_to_pages_then_document(spark):
    rows = [(1, 0, "text", None, "one"), (1, 3, "text", None, "two")]
    units = segment.build_units(elements(spark, rows)).orderBy("ord").collect()
    assert [(u.ref, u.kind, u.lead) for u in units] == [("#/pages/1", "page", ""), ("#/pages/2", "page", "")]
    bare = elements(spark, rows).withColumn("pages", F.array().cast("array<int>"))
    assert [u.kind for u in segment.build_units(bare).collect()] == ["document"]


def test_equal_leads_are_pruned(spark):
    rows = [x for i in range(5) for x in ((1, 2 * i, "section_header", 1, f"Article {i}"), (1, 2 * i + 1, "text", None, "The present article has for object."))]
    pruned = segment.prune_leads(segment.build_units(elements(spark, rows)))
    assert {r.lead for r in pruned.collect()} == {""}


def test_bm25_ranks_and_reports(spark):
    entries = spark.createDataFrame([(1, "scope", "scope of the services"), (1, "penalties", "late delivery penalty applies"), (1, "payment", "invoice payment terms")], "doc_id int, ref string, text string")
    q = spark.createDataFrame([(9, 1, "what is the late delivery penalties")], "query_id int, doc_id int, query string")
    top = bm25.ranked(bm25.hits(q, entries, ["doc_id"], ["doc_id"]), ["doc_id"], 1).first()
    assert top.ref == "penalties"
    asked = spark.createDataFrame([(9, 1, "penalty invoices"), (8, 1, "zzz")], "query_id int, doc_id int, query string")
    picked = spark.createDataFrame([(9, 1, "penalties")], "query_id int, doc_id int, ref string")
    rows = {r.query_id: r for r in bm25.term_report(asked, entries, picked, ["doc_id"]).collect()}
    assert rows[9].missing == ["invoice"] and rows[9].coverage == 0.5
    assert rows[8].coverage == 1.0 and rows[8].answerable == []


def test_expansion_cannot_beat_an_original_first_rank():
    assert sum(rank.WEIGHTS.values()) * rank.EXPANSION_WEIGHT / (rank.RRF_K + 1) < 1 / (rank.RRF_K + 1)


def test_shortlist_signals(spark):
    units = segment.build_units(elements(spark, REPORT))
    q = spark.createDataFrame([(1, 1, "revenue")], "query_id int, doc_id int, query string")
    short = rank.fuse(q, units)
    assert short.first().rationale == "lexical match (text rank 1, heading rank 1)"
    s = rank.signals(short, q, units).first()
    assert s.margin == math.inf and s.coverage == 1.0 and s.confident and s.fanout == 1


def test_packs(spark):
    rows = [(1, i, "text", None, t) for i, t in enumerate(["x" * 100, "y" * 50, "match " * 13, "z" * 20])]
    el = elements(spark, rows)
    head = pack.head_first(el, ["doc_id"], 120).first()
    assert head.refs == ["#/texts/0"] and head.truncated and head.text.endswith("budget …]")
    q = spark.createDataFrame([(1, "match")], "doc_id int, query string")
    rel = pack.by_relevance(el, q, ["doc_id"], 150).first()
    assert rel.refs == ["#/texts/1", "#/texts/2", "#/texts/3"] and "1 passage(s)" in rel.text
    none = spark.createDataFrame([(1, "nothing")], "doc_id int, query string")
    assert pack.by_relevance(el, none, ["doc_id"], 150).first().refs == ["#/texts/0", "#/texts/1"]


def test_excerpts_say_where_their_parts_are(spark):
    el = elements(spark, [(1, 0, "section_header", 1, "Terms"), (1, 1, "text", None, "x" * 90), (1, 3, "text", None, "penalty of ten"), (1, 4, "text", None, "y" * 90)])
    units = segment.build_units(el)
    wanted = spark.createDataFrame([(1, "#/texts/0", "penalty"), (1, "#/texts/0", "penalty"), (1, "#/texts/0", None), (1, "nowhere", "penalty"), (2, "#/texts/0", "")], "doc_id int, ref string, focus string")
    places = [pack.pages_of(F.col("parts")).alias("pages"), pack.node_ids(F.col("parts")).alias("nodes"), pack.spans(F.col("parts")).alias("spans")]
    rows = {(r.doc_id, r.ref, r.focus): r for r in pack.excerpts(units, el, wanted, 120).select("*", *places).collect()}
    assert len(rows) == 4
    hit = rows[1, "#/texts/0", "penalty"]
    assert [p.ref for p in hit.parts] == ["#/texts/0", "#/texts/1", "#/texts/3"] and hit.pages == [1, 2] and hit.nodes == ["elem::#/texts/0", "elem::#/texts/1", "elem::#/texts/3"]
    assert [(s.ref, s.page_no, s.char_start, s.bbox) for s in hit.spans][2] == ("#/texts/3", 2, None, None) and hit.kind == "section" and hit.truncated
    assert rows[1, "#/texts/0", ""].parts[-1].ref == "#/texts/3" and rows[1, "#/texts/0", ""].truncated
    for gone in ((1, "nowhere", "penalty"), (2, "#/texts/0", "")):
        assert (rows[gone].text, rows[gone].parts, rows[gone].kind, rows[gone].truncated) == ("", [], "section", False)
    many = elements(spark, [(1, i, "text", None, "w") for i in range(250)])
    whole = pack.full_excerpts(many, 10_000).select("*", *places).first()
    assert (whole.ref, whole.kind, len(whole.parts), len(whole.spans), len(whole.nodes)) == ("#/texts/0", "document", 250, 200, 250)
    cut = pack.full_excerpts(elements(spark, [(1, 0, "text", None, "a" * 300), (1, 1, "text", None, "b" * 300)]), 550).first()
    assert [len(p.text) for p in cut.parts] == [300, 250] and cut.truncated


def test_outline_drops_levels_then_the_middle(spark):
    rows = []
    for i in range(30):
        rows += [(1, 2 * i, "section_header", 1, f"Chapter {i}"), (1, 2 * i + 1, "section_header", 2, f"Detail {i}")]
    units = segment.build_units(elements(spark, rows))
    whole = outline.render(units, 10_000).first()
    assert whole.complete and len(whole.refs) == 60
    fitted = outline.render(units, 2000).first()
    assert not fitted.complete and "Detail" not in fitted.text and len(fitted.text) <= 2000
    middle = outline.render(units, 500).first()
    assert "omitted" in middle.text and "Chapter 0" in middle.text and "Chapter 29" in middle.text and len(middle.text) <= 520


def test_records(spark):
    steps = spark.createDataFrame([(1, 1, False, True, "no", 3), (1, 2, False, True, "none", 2), (2, 1, True, False, "yes", 0), (3, 1, False, False, "", 0)], "run_id int, step_no int, sufficient boolean, absent boolean, response string, unread int")
    rows = {r.run_id: r for r in report.flat_answers(report.rollup(steps)).collect()}
    assert rows[1].status == "not_in_document" and rows[1].answer == report.PREFIXES["not_in_document"] + "\n\nnone" and rows[1].notes == ["no", "none"]
    assert rows[2].answer == "yes" and rows[2].notes == [] and rows[2].converged
    assert rows[3].answer == report.PREFIXES["insufficient_evidence"]
    got = report.verdicts(spark.createDataFrame([(True, "a b", "a  B"), (False, "a", "a"), (True, "a", None)], "sufficient boolean, excerpt string, quote string")).collect()
    assert [r.grounded for r in got] == [True, None, False]


def test_reading_order_and_boxes(spark):
    edges = spark.createDataFrame([(1, "r", "b", 2), (1, "r", "a", 1), (1, "a", "c", 1)], "tree int, parent string, child string, pos int")
    roots = spark.createDataFrame([(1, "r")], "tree int, node string")
    assert [r.node for r in geometry.reading_order(edges, roots).orderBy("ord").collect()] == ["r", "a", "c", "b"]
    df = spark.createDataFrame([(0.0, 90.0, 10.0, 80.0, "BOTTOMLEFT", 100.0), (0.0, 90.0, 10.0, 80.0, "BOTTOMLEFT", None), (0.0, 1.0, 0.0, 2.0, "TOPLEFT", 1.0)], "l double, t double, r double, b double, o string, h double")
    got = [x.y for x in df.select(geometry.top_left(*map(F.col, "ltrboh")).alias("y")).collect()]
    assert tuple(got[0]) == (0.0, 10.0, 10.0, 20.0) and got[1:] == [None, None]


def test_html_blocks(spark):
    html = "<html><script>var a='</p>';</script><body><nav><li>Home</li></nav><h1>Title</h1><p>One <b>two</b><p>Three</p><footer>f</footer></body>"
    rows = tables.from_html(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r.label, r.text, r.is_furniture) for r in rows] == [("list_item", "Home", True), ("title", "Title", False), ("text", "One two", False), ("text", "Three", False), ("page_footer", "f", True)]


def test_grounding_short_passages(spark, tmp_path):
    from pagewright.plans.queries import QUERIES

    docs = [(1, "The party went on"), (2, "What?! -- nothing"), (3, "one two three four")]
    items = [(1, "art"), (2, "?! --"), (3, "two three four"), (4, " "), (5, "arty wen"), (6, "absent")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, QUERIES["grounding"](spark, str(tmp_path)).collect()))
    assert got == [(1, 1), (2, 2), (3, 3), (5, 1)]
