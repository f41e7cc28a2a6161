"""Runs that read documents with a model: a question meets a document in rounds.

All runs of a batch go through each round together; the driver holds only the loop. A run
takes at most max_steps rounds, and its state (one row) is written to the checkpoint folder
after each, so that no model call is repeated when an executor is lost.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.replies import READING, SELECTION, TERMS, clip_titles
from ..functions.text import collapse, grounded
from ..sources.chat import message
from . import bm25, outline, pack, rank, segment
from .physical import settle

NOTE = "struct<ref:string,title:string,finding:string>"
SPAN = "struct<ref:string,node_id:string,page_no:int,char_start:int,char_end:int,bbox:struct<l:double,t:double,r:double,b:double>>"
STEP = f"struct<k:int,ref:string,title:string,reason:string,fallback:boolean,kind:string,excerpt_chars:int,pages:array<int>,spans:array<{SPAN}>,node_ids:array<string>,sufficient:boolean,absent:boolean,response:string,quote:string,grounded:boolean,error:string>"
#: Fixed value: why a short document is read.
READ_WHOLE = "Document is short enough to read in full"
MAX_TERMS, HEDGE, SLICE = 10, 2, 64
NOTHING_READABLE, NOTHING_FOUND = "The document contains no readable content.", "No relevant content was found in this document."
SYSTEM = "You answer questions from one document. Use only the text you are given, invent nothing, and say so if the answer is not there."


@dataclass(frozen=True)
class Limits:
    max_steps: int = 6
    max_calls: int = 20
    deadline_s: float = 180.0
    outline_chars: int = 6000
    excerpt_chars: int = 8000
    direct_chars: int = 6000
    note_chars: int = 600
    max_notes: int = 8
    max_tokens: int = 1024
    shortlist: int = 8
    fanout: int = 3
    gap_notes: int = 2
    expand: bool = True
    absent_votes: int = 2


@dataclass(frozen=True)
class Index:
    """What runs read of documents: units, and the located elements of each unit."""

    units: DataFrame
    members: DataFrame


def index(elements: DataFrame, documents: DataFrame | None = None, furniture: bool = False) -> Index:
    """Units and their members, written, of every document of elements; documents (doc_id, name, page_nos) may name them and list their pages.

    With furniture, running heads and footers are read too.
    """
    if furniture:
        elements = elements.withColumn("is_furniture", F.lit(False))
    units = settle(segment.prune_leads(segment.build_units(elements, documents)))
    places = units.select("doc_id", F.col("ref").alias("unit"), F.explode("element_refs").alias("ref"))
    parts = pack.located(elements).select("doc_id", "ref", "ord", "text", "at")
    return Index(units, settle(places.join(parts, ["doc_id", "ref"]).select("doc_id", "unit", "ord", "ref", "text", "at")))


def ask(rows: DataFrame, model, kind: dict | None, max_tokens: int | None = None) -> DataFrame:
    """(run_id, k, reply, calls, fallback, error) of rows (run_id, k, prompt, allowed).

    model is a Chat, or a function that makes one on the worker. reply is JSON, or text
    without a kind. With allowed refs, a choice outside them is corrected once; then the
    first allowed one is taken and marked as fallback. A failure fills error and no reply.
    """
    schema = StructType([StructField("run_id", rows.schema["run_id"].dataType), *_parse_datatype_string("struct<k:int,reply:string,calls:int,fallback:boolean,error:string>").fields])
    arrow = to_arrow_schema(schema)

    def one(chat, row):
        talk, out = [message("system", SYSTEM), message("user", row["prompt"])], {"run_id": row["run_id"], "k": row["k"], "reply": None, "calls": 1, "fallback": False, "error": None}
        try:
            if kind is None:
                return {**out, "reply": chat.complete(talk, None, None).strip()}
            got = chat.structured(talk, kind, max_tokens)
            allowed = row["allowed"]
            if allowed and got["ref"] not in allowed:
                out["calls"] = 2
                again = f"'{got['ref']}' is not a candidate. Choose exactly one of: {allowed}"
                got = chat.structured([*talk, message("assistant", json.dumps(got)), message("user", again)], kind, max_tokens)
                if got["ref"] not in allowed:
                    got, out["fallback"] = {"reason": "fallback: no valid ref returned", "ref": allowed[0]}, True
            return {**out, "reply": json.dumps(got)}
        except Exception as e:  # whatever a model raises belongs to its own run
            return {**out, "error": f"{type(e).__name__}: {e}"}

    def work(batches):
        chat = model() if not hasattr(model, "structured") else model
        with ThreadPoolExecutor(8) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    yield pa.RecordBatch.from_pylist(list(pool.map(lambda r: one(chat, r), batch.slice(at, SLICE).to_pylist())), schema=arrow)

    # a fixed number of partitions: prompts are small, calls are slow, so they must not be coalesced
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select("run_id", F.col("k").cast("int").alias("k"), "prompt", "allowed").repartition(n, "run_id", "k")
    return settle(spread.mapInArrow(work, schema))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _notes(notes: Column) -> Column:
    lines = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("["), n["ref"], F.lit(" — "), n["title"], F.lit("] "), n["finding"])), "\n\n")
    return F.when(F.size(notes) > 0, lines).otherwise("(nothing yet)")


def _reading_prompt(query: Column, title: Column, excerpt: Column, notes: Column) -> Column:
    body = F.when(F.coalesce(excerpt, F.lit("")) == "", "(this part of the document is empty)").otherwise(excerpt)
    rules = "sufficient: true only if the question can now be answered in full from what you read. response: the full answer, or else what is missing. absent: true only if the document is plainly not about this. quote: with sufficient, the sentence above that holds the answer, word for word."
    return F.concat(F.lit("Question: "), query, F.lit("\n\nKnown so far:\n"), _notes(notes), F.lit("\n\nThis part of the document, '"), title, F.lit("':\n\n"), body, F.lit("\n\nReply with\n" + rules))


def _start(runs: DataFrame, units: DataFrame, limits: Limits) -> DataFrame:
    """One row a run; route is empty, direct or loop."""
    sizes = units.groupBy(F.col("doc_id").alias("run_id")).agg(F.count("*").cast("int").alias("n_units"), F.sum("char_len").alias("chars"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda s: s["title"]).alias("titles"))
    got = runs.join(sizes, "run_id", "left")
    route = F.when(F.col("n_units").isNull(), "empty").when(F.col("chars") <= limits.direct_chars, "direct").otherwise("loop")
    status = F.when(F.col("n_units").isNull(), "not_in_document")
    zero = F.lit(0)
    return got.select(
        "run_id", "source_id", "name", "query", route.alias("route"), status.cast("string").alias("status"), F.when(status.isNotNull(), NOTHING_READABLE).otherwise("").alias("answer"), F.lit(None).cast("string").alias("error"),
        F.coalesce("n_units", zero).alias("n_units"), F.coalesce("titles", _none("array<string>")).alias("titles"), _none("array<string>").alias("visited"), _none(f"array<{NOTE}>").alias("notes"), _none(f"array<{STEP}>").alias("steps"),
        zero.alias("votes"), F.lit("").alias("expansion"), zero.alias("steps_used"), zero.alias("calls_used"),
    )


def _absorb(state: DataFrame, results: DataFrame, limits: Limits) -> DataFrame:
    """The state after a round's reads: results are (run_id, step) in the order of picks."""
    columns = state.columns
    got = results.groupBy("run_id").agg(F.array_sort(F.collect_list("step")).alias("r"))
    s = state.join(got, "run_id", "left").withColumn("r", F.coalesce("r", _none(f"array<{STEP}>"))).withColumn("ok", F.filter("r", lambda x: x["error"].isNull()))
    note = lambda x: F.struct(x["ref"].alias("ref"), x["title"].alias("title"), F.substring(x["response"], 1, limits.note_chars).alias("finding"))
    first = F.get(F.filter("ok", lambda x: x["sufficient"]), F.lit(0))
    failed = (F.size("r") > 0) & (F.size("ok") == 0)
    all_notes = F.concat("notes", F.transform("ok", note))
    new = {
        "votes": F.col("votes") + F.size(F.filter("ok", lambda x: x["absent"])), "visited": F.concat("visited", F.transform("ok", lambda x: x["ref"])), "steps": F.concat("steps", "ok"),
        "notes": F.slice(all_notes, F.greatest(F.size(all_notes) - limits.max_notes + 1, F.lit(1)), F.lit(limits.max_notes)),
        "steps_used": F.col("steps_used") + F.size("r"), "calls_used": F.col("calls_used") + F.size("r"), "error": F.when(failed, F.get("r", F.lit(0))["error"]),
    }
    s = s.select(*[new.get(c, F.col(c)).alias(c) for c in columns], first.alias("first"), failed.alias("failed"), (F.size("r") == 0).alias("idle"))
    stalled = F.when(F.size("visited") < F.col("n_units"), "budget_exhausted").otherwise("insufficient_evidence")
    done = F.when(F.col("failed"), "failed").when(F.col("first").isNotNull(), "answered").when(F.col("votes") >= limits.absent_votes, "not_in_document").when(F.col("idle") | (F.col("steps_used") >= limits.max_steps), stalled)
    return s.select(*[{"status": done, "answer": F.coalesce("first.response", F.lit(""))}.get(c, F.col(c)).alias(c) for c in columns])


def _read(picks: DataFrame, members: DataFrame, model, limits: Limits) -> DataFrame:
    """(run_id, step) of picks (run_id, k, ref, title, kind, reason, fallback, query, focus, notes)."""
    keys = ["doc_id", "unit"]
    wanted = picks.select(F.col("run_id").alias("doc_id"), F.col("ref").alias("unit"), F.col("focus").alias("query"))
    parts = F.col("parts")
    excerpts = pack.by_relevance(members.join(wanted.select(*keys), keys, "left_semi"), wanted, keys, limits.excerpt_chars).select(
        F.col("doc_id").alias("run_id"), F.col("unit").alias("ref"), F.col("text").alias("excerpt"), pack.pages_of(parts).alias("pages"), pack.spans(parts).alias("spans"), pack.node_ids(parts).alias("node_ids")
    )
    full = settle(picks.join(excerpts, ["run_id", "ref"], "left"))
    prompts = full.select("run_id", "k", _reading_prompt(F.col("query"), F.col("title"), F.col("excerpt"), F.col("notes")).alias("prompt"), F.lit(None).cast("array<string>").alias("allowed"))
    said = ask(prompts, model, READING, limits.max_tokens).drop("fallback", "calls")
    x = full.join(said, ["run_id", "k"]).withColumn("x", F.from_json("reply", "sufficient boolean, response string, absent boolean, quote string"))
    text = F.coalesce("excerpt", F.lit(""))
    verdict = F.when(F.col("x.sufficient"), grounded(text, F.coalesce("x.quote", F.lit(""))))
    places = [F.coalesce("pages", _none("array<int>")).alias("pages"), F.coalesce("spans", _none(f"array<{SPAN}>")).alias("spans"), F.coalesce("node_ids", _none("array<string>")).alias("node_ids")]
    step = F.struct(F.col("k").cast("int").alias("k"), "ref", "title", "reason", "fallback", "kind", F.length(text).alias("excerpt_chars"), *places, "x.sufficient", "x.absent", "x.response", "x.quote", verdict.alias("grounded"), "error")
    return x.select("run_id", step.alias("step"))


def _shortlists(live: DataFrame, units: DataFrame, visited: DataFrame, limits: Limits) -> DataFrame:
    """(run_id, cands, fan, trusted): candidates in order for live runs with a probe."""
    q = live.select(F.col("run_id").alias("query_id"), F.col("run_id").alias("doc_id"), F.col("probe").alias("query"), "expansion")
    short = settle(rank.fuse(q, units, limits.shortlist, visited))
    cands = short.groupBy(F.col("query_id").alias("run_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ref", "rationale"))), lambda s: F.struct(s["ref"].alias("ref"), s["rationale"].alias("reason"), F.lit(False).alias("fallback"))).alias("cands"))
    sig = rank.signals(short, q, units).select(F.col("query_id").alias("run_id"), F.col("fanout").alias("fan"), F.col("confident").alias("trusted"))
    return cands.join(sig, "run_id")


def _look(live: DataFrame, found: DataFrame) -> DataFrame:
    none = _none("array<struct<ref:string,reason:string,fallback:boolean>>")
    return live.join(found, "run_id", "left").withColumn("cands", F.coalesce("cands", none)).withColumn("fan", F.coalesce("fan", F.lit(1))).withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def _choose(asked: DataFrame, units: DataFrame, visited: DataFrame, model, limits: Limits) -> DataFrame:
    """(run_id, ref, reason, fallback, calls, shown) for runs (run_id, query, notes, tops): one pick over a map of the units in ``units``."""
    mine = units.join(asked.select(F.col("run_id").alias("doc_id")), "doc_id", "left_semi")
    maps = outline.render(mine, limits.outline_chars, visited.select("doc_id", "ref"))
    taken = visited.select("doc_id", "ref").unionByName(asked.select(F.col("run_id").alias("doc_id"), F.explode("tops").alias("ref")))
    open_refs = mine.join(taken, ["doc_id", "ref"], "left_anti").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda s: s["ref"]).alias("open"))
    rows = asked.join(maps.join(open_refs, "doc_id").withColumnRenamed("doc_id", "run_id"), "run_id")
    seen = F.array_intersect("open", "refs")
    allowed = F.when(F.size(seen) > 0, seen).otherwise(F.col("open"))
    prompt = F.concat(F.lit("Question: "), "query", F.lit("\n\nMap of the document (ref · kind · size · heading):\n"), "text", F.lit("\n\nKnown so far:\n"), _notes(F.col("notes")), F.lit("\n\nName the one part most likely to help. Its ref must be one of: "), F.array_join(allowed, ", "))
    rows = settle(rows.select("run_id", F.lit(0).alias("k"), prompt.alias("prompt"), allowed.alias("allowed"), F.col("refs").alias("shown")))
    said = ask(rows.drop("shown"), model, SELECTION, limits.max_tokens)
    x = F.from_json("reply", "ref string, reason string")
    # a failed selection spends its call and picks nothing
    return said.join(rows.select("run_id", "shown"), "run_id").withColumn("x", x).select("run_id", "x.ref", "x.reason", "fallback", "calls", "shown")


def _select(asked: DataFrame, units: DataFrame, visited: DataFrame, model, limits: Limits) -> DataFrame:
    """(run_id, pick, calls): a choice, then once among the children that its map had no room for."""
    first = _choose(asked, units, visited, model, limits)
    kids = segment.children_of(units).select(F.col("doc_id").alias("run_id"), F.col("parent").alias("ref"), "child")
    hidden = first.filter("ref is not null and not fallback").join(kids, ["run_id", "ref"]).filter(~F.array_contains("shown", F.col("child")))
    hidden = hidden.join(visited.select(F.col("doc_id").alias("run_id"), F.col("ref").alias("child")), ["run_id", "child"], "left_anti")
    left = asked.select("run_id", "calls_left").join(first.select("run_id", "calls"), "run_id").filter("calls_left > calls").select("run_id")
    hidden = settle(hidden.join(left, "run_id", "left_semi").select("run_id", "ref", "child"))
    out = first
    if not hidden.isEmpty():
        family = hidden.select(F.col("run_id").alias("doc_id"), "ref").unionByName(hidden.select(F.col("run_id").alias("doc_id"), F.col("child").alias("ref"))).distinct()
        deeper = _choose(asked.join(hidden.select("run_id").distinct(), "run_id", "left_semi"), units.join(family, ["doc_id", "ref"], "left_semi"), visited, model, limits)
        d = deeper.select("run_id", F.struct("ref", "reason", "fallback").alias("d"), F.col("calls").alias("more"))
        good = F.col("d.ref").isNotNull() & ~F.col("d.fallback")
        out = first.join(d, "run_id", "left").select("run_id", F.when(good, F.col("d.ref")).otherwise(F.col("ref")).alias("ref"), F.when(good, F.col("d.reason")).otherwise(F.col("reason")).alias("reason"), "fallback", (F.col("calls") + F.coalesce("more", F.lit(0))).alias("calls"))
    return out.select("run_id", F.when(F.col("ref").isNotNull(), F.struct("ref", "reason", "fallback")).alias("pick"), "calls")


def _round(live: DataFrame, units: DataFrame, members: DataFrame, model, limits: Limits) -> DataFrame:
    """One round of runs that are still open."""
    columns = live.columns
    visited = live.select(F.col("run_id").alias("query_id"), F.col("run_id").alias("doc_id"), F.explode("visited").alias("ref"))
    asked = live.select(F.col("run_id").alias("query_id"), F.col("run_id").alias("doc_id"), "query")
    report = bm25.term_report(asked, units.select("doc_id", "ref", "text"), visited, ["doc_id"]).select(F.col("query_id").alias("run_id"), "missing")
    gap = F.array_join(F.transform(F.slice("notes", F.greatest(F.size("notes") - limits.gap_notes + 1, F.lit(1)), F.lit(limits.gap_notes)), lambda n: n["finding"]), " ")
    probe = F.when(F.size("notes") == 0, F.col("query")).when(F.size(F.coalesce("missing", _none("array<string>"))) > 0, F.concat_ws(" ", "query", gap)).otherwise(gap)
    live = settle(live.join(report, "run_id", "left").withColumn("probe", probe).drop("missing"))
    look = settle(_look(live, _shortlists(live, units, visited, limits)))
    calls_left = limits.max_calls - F.col("calls_used")
    if limits.expand:
        need = look.filter(~F.col("trusted") & (F.col("expansion") == "") & (calls_left >= 2))
        prompt = F.concat(F.lit("Sections of the document:\n"), clip_titles(F.col("titles")), F.lit("\n\nQuestion: "), "query", F.lit("\n\nList 4 to 8 words or short phrases that the passage with the answer is likely to contain, as the document would write them."))
        said = ask(need.select("run_id", F.lit(0).alias("k"), prompt.alias("prompt"), F.lit(None).cast("array<string>").alias("allowed")), model, TERMS, limits.max_tokens)
        terms = F.filter(F.array_distinct(F.transform(F.from_json("reply", "terms array<string>")["terms"], collapse)), lambda t: t != "")
        said = said.select("run_id", F.coalesce(F.array_join(F.slice(terms, 1, MAX_TERMS), " "), F.lit("")).alias("_new"), F.lit(1).alias("_spent"))
        look = settle(look.join(said, "run_id", "left").withColumn("expansion", F.coalesce("_new", "expansion")).withColumn("calls_used", F.col("calls_used") + F.coalesce("_spent", F.lit(0))))
        again = look.filter("_new <> ''").drop("_new", "_spent", "cands", "fan", "trusted")
        if not again.isEmpty():
            found = _look(again, _shortlists(again, units, visited, limits))
            look = settle(look.filter("_new is null or _new = ''").drop("_new", "_spent").unionByName(found))
    steps_left = limits.max_steps - F.col("steps_used")
    room = F.least(F.lit(limits.fanout), steps_left, calls_left)
    look = look.withColumn("lex", F.when(F.col("trusted"), F.slice("cands", F.lit(1), F.greatest(F.least(room, F.col("fan")), F.lit(0)))).otherwise(F.slice("cands", 1, 1)))
    hedge = F.least(F.greatest(room, F.lit(HEDGE)), steps_left, calls_left)
    unread = F.col("n_units") - F.size("visited")
    wants = ~F.col("trusted") & (unread > F.size("lex")) & (hedge > F.size("lex")) & (calls_left >= F.size("lex") + 3)
    asked = settle(look.filter(wants).select("run_id", "query", "notes", F.transform("lex", lambda p: p["ref"]).alias("tops"), calls_left.alias("calls_left")))
    if asked.isEmpty():
        look = look.withColumn("picks", F.col("lex"))
    else:
        chosen = _select(asked, units, visited, model, limits)
        look = look.join(chosen, "run_id", "left").withColumn("calls_used", F.col("calls_used") + F.coalesce("calls", F.lit(0)))
        look = look.withColumn("picks", F.when(F.col("pick").isNotNull(), F.concat("lex", F.array("pick"))).otherwise(F.col("lex")))
    look = settle(look.withColumn("picks", F.slice("picks", F.lit(1), F.greatest(F.least(steps_left, calls_left), F.lit(0)))))
    picks = look.select("run_id", "query", F.col("query").alias("focus"), "notes", F.posexplode("picks").alias("k", "p")).select("run_id", "k", "query", "focus", "notes", "p.*")
    picks = picks.join(units.select(F.col("doc_id").alias("run_id"), "ref", "title", "kind"), ["run_id", "ref"])
    return _absorb(look.select(*columns), _read(picks, members, model, limits), limits)


def _direct(state: DataFrame, members: DataFrame, model, limits: Limits) -> DataFrame:
    """Short documents are read at once."""
    every = members.select("doc_id", F.lit("").alias("unit"), "ord", "ref", "text", "at").dropDuplicates(["doc_id", "ref"])
    anchor = every.groupBy(F.col("doc_id").alias("run_id")).agg(F.min_by("ref", "ord").alias("anchor"))
    picks = state.select("run_id", F.lit(0).alias("k"), F.lit("").alias("ref"), F.col("name").alias("title"), F.lit("document").alias("kind"), F.lit(READ_WHOLE).alias("reason"), F.lit(False).alias("fallback"), "query", F.lit("").alias("focus"), "notes")
    steps = _read(picks, every, model, limits).join(anchor, "run_id", "left").select("run_id", F.col("step").withField("ref", F.coalesce("anchor", F.lit(""))).alias("step"))
    out = _absorb(state, steps, limits)
    step = F.get("steps", F.lit(0))
    status = F.when(F.col("status") == "failed", "failed").when(step["sufficient"], "answered").when(step["absent"], "not_in_document").otherwise("insufficient_evidence")
    return out.withColumn("status", status).withColumn("answer", F.coalesce(step["response"], F.lit("")))


def _compose(state: DataFrame, model, late: bool) -> DataFrame:
    """An answer for loop runs that found none: one call over more than one note, else the last note."""
    last = F.when(F.size("notes") > 0, F.get("notes", F.size("notes") - 1)["finding"]).otherwise(NOTHING_FOUND)
    open_ = (F.col("route") == "loop") & ~F.col("status").isin("answered", "failed")
    more = state.filter(open_ & (F.size("notes") > 1) & F.col("can_call")) if not late else state.limit(0)
    prompt = F.concat(F.lit("Question: "), "query", F.lit("\n\nNotes from reading:\n"), _notes(F.col("notes")), F.lit("\n\nGive the fullest answer that these notes support, and say what stays unknown. Add nothing else."))
    said = ask(more.select("run_id", F.lit(0).alias("k"), prompt.alias("prompt"), F.lit(None).cast("array<string>").alias("allowed")), model, None)
    out = state.join(said.select("run_id", "reply", F.lit(1).alias("_c")), "run_id", "left")
    answer = F.when(open_, F.coalesce("reply", last)).otherwise(F.col("answer"))
    return out.withColumn("answer", answer).withColumn("calls_used", F.col("calls_used") + F.coalesce("_c", F.lit(0))).drop("reply", "_c", "can_call")


def _public(steps: Column) -> Column:
    """Steps as they are reported, numbered from 1; no run reads a unit twice."""
    same = ("ref", "reason", "excerpt_chars", "sufficient", "response", "kind", "title", "pages", "spans", "node_ids", "quote", "grounded")
    return F.transform(steps, lambda s, i: F.struct((i + 1).alias("index"), *[s[c].alias(c) for c in same], F.lit(False).alias("revisited"), s["fallback"].alias("fallback")))


def read(runs: DataFrame, source: DataFrame | Index, model, limits: Limits = Limits(), furniture: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """Traces of runs (run_id, doc_id, query): run_id, doc_id, query, status, answer, converged, steps, notes, calls, elapsed_s, error.

    source is an index, or elements from which one is built for the documents asked about. run_id
    must be unique; a column name of runs is the title of documents read whole (else Document).
    elapsed_s is the time of the batch. Documents without readable elements end as not_in_document;
    a run whose reads all fail in one round ends as failed with the first error. The deadline holds
    for the batch. Every round ranks the units of open runs anew.
    """
    began = time.monotonic()
    base = runs.select("run_id", F.col("doc_id").alias("source_id"), (F.coalesce("name", F.lit("Document")) if "name" in runs.columns else F.lit("Document")).alias("name"), F.coalesce("query", F.lit("")).alias("query"))
    if not isinstance(source, Index):
        source = index(source.join(base.select(F.col("source_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), documents, furniture)
    asked = base.select("source_id", F.col("run_id").alias("doc_id"))
    own = lambda table: settle(asked.join(table.withColumnRenamed("doc_id", "source_id"), "source_id"))
    units, members = own(source.units), own(source.members).drop("source_id")
    state = settle(_start(base, units, limits))
    direct = state.filter("route = 'direct'")
    done = [state.filter("route = 'empty'"), direct if direct.isEmpty() else settle(_direct(direct, members, model, limits))]
    live = state.filter("route = 'loop'")
    while not live.isEmpty():
        if time.monotonic() - began >= limits.deadline_s:
            done.append(live.withColumn("status", F.lit("budget_exhausted")))
            break
        after = settle(_round(live, units, members, model, limits))
        read_all = after.withColumn("status", F.when(F.col("status").isNull() & (F.size("visited") >= F.col("n_units")), "insufficient_evidence").otherwise(F.col("status")))
        done.append(read_all.filter("status is not null"))
        live = read_all.filter("status is null")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    late = time.monotonic() - began > limits.deadline_s - 5.0
    out = _compose(settle(out.withColumn("can_call", F.col("calls_used") < limits.max_calls)), model, late)
    answered = F.col("status") == "answered"
    notes = F.when(answered, _none(f"array<{NOTE}>")).otherwise(F.col("notes"))
    return out.select("run_id", F.col("source_id").alias("doc_id"), "query", "status", "answer", answered.alias("converged"), _public(F.col("steps")).alias("steps"), notes.alias("notes"), F.col("calls_used").alias("calls"), F.lit(round(time.monotonic() - began, 3)).alias("elapsed_s"), "error")
