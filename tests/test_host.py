import asyncio
import json

import pytest

from pagewright import __main__ as command
from pagewright import host
from pagewright.operators import reading, report
from pagewright.sources.chat import BackendError
from pagewright.sources.docjson import DocumentError


def _model(model_id="scripted"):
    """Made in a function, so that it goes to workers by value."""
    from pagewright.sources.chat import BackendError as Broken
    from pagewright.sources.chat import Chat

    class Model(Chat):
        def __init__(self, name):
            self.model_id = name

        def for_model(self, name):
            return type(self)(name)

        def complete(self, messages, kind=None, max_tokens=None):
            prompt = messages[1]["content"]
            if "BROKEN" in prompt:
                raise Broken("no server")
            if "GARBLED" in prompt:
                return "no object"
            hit = "ten euros" in prompt
            return '{"sufficient": %s, "response": "%s", "absent": false, "quote": "ten euros"}' % (("true", "Ten.") if hit else ("false", ""))

    return Model(model_id)


def document(*texts, name="Contract é"):
    items = [{"self_ref": f"#/texts/{i}", "label": "section_header" if i == 0 else "text", "text": t, "prov": [{"page_no": i + 1}]} for i, t in enumerate(texts)]
    return json.dumps({"name": name, "body": {"children": [{"$ref": i["self_ref"]} for i in items]}, "texts": items})


PENALTY = document("Penalty", "A day late costs ten euros.")


@pytest.fixture(scope="module")
def runner(spark):
    made = host.Runner(spark, _model(), cache_size=1)
    yield made
    made.close()


@pytest.fixture(scope="module")
def trace(runner):
    return runner.trace(PENALTY, "What does a day cost?", "other")


def test_the_record_of_a_run(trace):
    assert (trace.query, trace.answer, trace.status, trace.model_id, trace.llm_calls, trace.notes, trace.converged) == ("What does a day cost?", "Ten.", "answered", "other", 1, [], True)
    (s,) = trace.steps
    assert (s["index"], s.ref, s.title, s.pages, s.grounded, s.reason) == (1, "#/texts/0", "Contract é", [1, 2], True, reading.READ_WHOLE)


def test_records_as_json_and_text(trace):
    got = json.loads(host.trace_json(trace))
    assert "é" in host.trace_json(trace) and "converged" not in got and got["steps"][0]["spans"][1] == {"ref": "#/texts/1", "node_id": "elem::#/texts/1", "page_no": 2, "char_start": None, "char_end": None, "bbox": None}
    lines = host.trace_text(trace).splitlines()
    assert lines[0] == "status   : answered" and "  ✓ 1. #/texts/0 — Contract é" in lines and "      cite: ten euros" in lines and lines[-1] == "Ten."


def test_hosts_get_their_own_types(spark, runner):
    got = asyncio.run(host.Runner(spark, _model(), result_factory=dict, iteration_factory=dict).run(document_json=document("Terms", "Nothing."), query="What?"))
    assert got["answer"] == report.PREFIXES["insufficient_evidence"] and not got["converged"]
    assert set(got["iterations"][0]) == {"iteration", "section_ref", "reason", "section_text_length", "can_answer", "response"}

    class Theirs(Exception):
        def __init__(self, *, model_id, reason):
            super().__init__(model_id, reason)

    with pytest.raises(Theirs) as e:
        host.Runner(spark, _model(), parse_error_factory=Theirs).trace(PENALTY, "GARBLED")
    assert e.value.args == ("scripted", "no valid Reading")
    with pytest.raises(BackendError):
        runner.trace(PENALTY, "BROKEN")
    with pytest.raises(DocumentError):
        runner.trace("[]", "What?")


def test_availability(spark):
    assert host.Runner(spark, _model()).is_available and not host.Runner(spark, _model("")).is_available
    assert asyncio.run(host.Runner(spark, _model()).health())
    assert not asyncio.run(host.Runner(spark, command.chat(command.parser().parse_args(["ask", "--document", "x", "--query", "q", "--base-url", "http://127.0.0.1:9"]))).health())


def test_the_last_documents_stay_indexed(spark):
    shelf = host.Shelf(spark, size=2)
    a, b, c = (document("T", str(i)) for i in range(3))
    _, first = shelf.take(a)
    shelf.take(b)
    assert shelf.take(a)[1] is first
    shelf.take(c)  # b goes, it was used least lately
    assert len(shelf.held) == 2 and shelf.take(a)[1] is first
    shelf.clear()
    assert not shelf.held and not first.units.is_cached and not first.members.is_cached


def test_public_names():
    import pagewright

    assert len(pagewright.__all__) >= 37 and all(getattr(pagewright, name) is not None for name in pagewright.__all__)
    with pytest.raises(AttributeError):
        pagewright.nothing


def test_a_table_of_questions(spark, tmp_path):
    docs = spark.createDataFrame([(1, PENALTY), (2, PENALTY), (3, "[]"), (4, None), (5, document("Terms", "Nothing."))], "doc_id int, document_json string")
    asked = spark.createDataFrame([(10, 1, "q"), (11, 2, "q"), (12, 3, "q"), (13, 4, "q"), (14, 5, "q"), (15, 99, "q"), (16, 1, None)], "run_id int, doc_id int, query string")
    traces = reading.settle(host.Runner(spark, _model()).traces(docs, asked))
    rows = {r.run_id: r for r in traces.collect()}
    assert {k: (r.doc_id, r.status) for k, r in rows.items()} == {
        10: (1, "answered"), 11: (2, "answered"), 12: (3, "not_in_document"), 13: (4, "not_in_document"), 14: (5, "insufficient_evidence"), 15: (99, "not_in_document"), 16: (1, "answered"),
    }
    flat = {r.run_id: r for r in report.plain_results(traces).collect()}
    assert flat[10].answer == "Ten." and flat[10].iterations[0].asDict() == {"iteration": 1, "section_ref": "#/texts/0", "reason": reading.READ_WHOLE, "section_text_length": 36, "can_answer": True, "response": "Ten."}
    host.write_traces(traces, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 7


def test_commands(spark, tmp_path, capsys):
    path = tmp_path / "d.json"
    path.write_text(PENALTY, encoding="utf-8")
    assert command.main(["map", "--document", str(path)]) == 0
    shown = capsys.readouterr().out
    assert shown.startswith("Contract é — 1 unit(s) of kind 'section'\n- #/texts/0 · section") and "↳" in shown
    path.write_text("{}", encoding="utf-8")
    assert command.main(["map", "--document", str(path)]) == 0
    assert capsys.readouterr().out == "Document — 0 unit(s) of kind 'document'\n(empty document)\n"
    path.write_text(document("Terms", "Nothing."), encoding="utf-8")
    args = command.parser().parse_args(["ask", "--document", str(path), "--query", "What?"])
    assert command.ask(spark, args, _model()) == 1 and report.PREFIXES["insufficient_evidence"] not in capsys.readouterr().out
    args = command.parser().parse_args(["ask", "--document", str(path), "--query", "What?", "--json"])
    assert command.ask(spark, args, _model()) == 0 and json.loads(capsys.readouterr().out)["status"] == "insufficient_evidence"


def test_servers():
    args = command.parser().parse_args(["ask", "--document", "x", "--query", "q", "--provider", "openai", "--api-key", "k", "--timeout", "9"])
    model = command.chat(args)
    assert (type(model).__name__, model.base_url, model.api_key, model.timeout, model.model_id) == ("OpenAIChat", "https://api.openai.com/v1", "k", 9.0, command.MODEL)
