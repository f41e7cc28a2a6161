import pytest

from pagewright.operators import reading
from test_operators import elements


def _local():
    def scripted():
        """A model whose replies depend on the prompt alone; made on the worker, so it lives in a function."""
        import json

        from pagewright.sources.chat import BackendError, Chat

        class Model(Chat):
            model_id = "scripted"

            def complete(self, messages, kind=None, max_tokens=None):
                prompt = messages[1]["content"]
                if "BROKEN" in prompt:
                    raise BackendError("no server")
                if kind is None:
                    return " composed "
                if kind["title"] == "QueryTerms":
                    return json.dumps({"terms": ["zebra  crossing", "zebra  crossing", " "] if "ZEBRA" in prompt else []})
                if kind["title"] == "Selection":
                    return json.dumps({"ref": "#/texts/4", "reason": "model"}) if "LISTEN" in prompt or len(messages) > 2 and "RETRY" in prompt else json.dumps({"ref": "nowhere", "reason": "?"})
                hit = "answer is" in prompt and "UNRELATED" not in prompt
                return "So: " + json.dumps({"sufficient": hit, "response": "found" if hit else "not here", "absent": "UNRELATED" in prompt, "quote": "the answer is 42" if hit else ""})

        return Model()

    return scripted


#: Workers cannot import tests, so the model is a function made in a function, which goes to them by value.
scripted = _local()
FILL = " and more words of the same kind" * 90
SECTIONS = [("Scope", "The services cover maintenance" + FILL), ("Penalties", "A late delivery penalty applies, The ANSWER is, the answer is 42" + FILL), ("Payment", "Invoice terms by zebra crossing" + FILL)]


def long_document(doc):
    return [x for i, (title, text) in enumerate(SECTIONS) for x in ((doc, 2 * i, "section_header", 1, title), (doc, 2 * i + 1, "text", None, text))]


@pytest.fixture(scope="module")
def traces(spark):
    rows = long_document(1) + [(2, 0, "text", None, "Short: the answer is 42"), (3, 0, "text", None, "Short and silent")]
    asked = [
        (1, 1, "late delivery penalty"), (2, 2, "what"), (3, 3, "what"), (4, 9, "what"), (5, 1, "BROKEN late delivery penalty"), (6, 1, "UNRELATED qqq"),
        (7, 1, "ZEBRA qqq"), (8, 1, "LISTEN qqq"), (9, 1, "RETRY qqq"), (10, 3, "UNRELATED"), (11, 3, "BROKEN"),
    ]
    runs = spark.createDataFrame(asked, "run_id int, doc_id int, query string")
    return {r.run_id: r for r in reading.read(runs, elements(spark, rows), scripted, reading.Limits(max_steps=2, deadline_s=3600)).collect()}


def test_a_trusted_shortlist_needs_one_call(traces):
    t = traces[1]
    assert (t.status, t.answer, t.converged, t.calls, t.notes) == ("answered", "found", True, 1, [])
    assert [(s.ref, s.grounded) for s in t.steps] == [("#/texts/2", True)] and t.steps[0].reason.startswith("lexical match")


def test_short_and_empty_documents(traces):
    assert (traces[2].status, traces[2].answer, traces[2].calls, traces[2].steps[0].ref) == ("answered", "found", 1, "#/texts/0")
    assert (traces[3].status, traces[3].answer) == ("insufficient_evidence", "not here")
    assert traces[10].status == "not_in_document"
    assert (traces[4].status, traces[4].answer, traces[4].calls, traces[4].steps) == ("not_in_document", reading.NOTHING_READABLE, 0, [])


def test_steps_say_what_was_read(traces):
    s = traces[1].steps[0]
    assert (s["index"], s.kind, s.title, s.pages, s.node_ids, s.revisited) == (1, "section", "Penalties", [1, 2], ["elem::#/texts/2", "elem::#/texts/3"], False)
    assert s.excerpt_chars == len("\n\n".join(SECTIONS[1])) and [(p.ref, p.page_no) for p in s.spans] == [("#/texts/2", 1), ("#/texts/3", 2)]
    assert [x["index"] for x in traces[6].steps] == [1, 2]
    whole = traces[2].steps[0]
    assert (whole.kind, whole.title, whole.reason, whole.excerpt_chars) == ("document", "Document", reading.READ_WHOLE, len("Short: the answer is 42"))


def test_failures_stay_in_their_run(traces):
    for i in (5, 11):
        assert (traces[i].status, traces[i].answer) == ("failed", "") and "BackendError" in traces[i].error


def test_expansion_finds_what_the_question_does_not_say(traces):
    assert traces[7].steps[0].ref == "#/texts/4" and traces[7].steps[0].title == "Payment"


def test_votes_end_a_run_and_notes_make_its_answer(traces):
    t = traces[6]
    assert (t.status, t.converged) == ("not_in_document", False) and len(t.steps) == 2 and t.answer == "composed" and [n.finding for n in t.notes] == ["not here"] * 2
    # the model names nothing valid, even when corrected: the first open unit is taken and marked
    assert t.steps[0].fallback and t.steps[0].ref == "#/texts/0"


def test_selection_and_its_correction(traces):
    for i, calls in ((8, 3), (9, 4)):
        assert traces[i].steps[0].ref == "#/texts/4" and not traces[i].steps[0].fallback and traces[i].calls >= calls


def test_budget(traces):
    t = traces[8]  # the third unit is unread when steps run out
    assert (t.status, t.answer, len(t.steps)) == ("budget_exhausted", "composed", 2)
