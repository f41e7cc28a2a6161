"""Records of reading runs: steps, verdicts, statuses and flat views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import grounded

#: What a status puts before an answer.
PREFIXES = {
    "not_in_document": "[not answered — this document does not cover the question]",
    "insufficient_evidence": "[partial answer — the document did not fully answer this]",
    "budget_exhausted": "[partial answer — the run hit its budget before converging]",
}
NOTE_LIMIT, MAX_NOTES, ABSENT_VOTES = 600, 8, 2


def verdicts(readings: DataFrame) -> DataFrame:
    """Adds grounded: null unless sufficient, else whether the quote occurs in the excerpt."""
    return readings.withColumn("grounded", F.when(F.col("sufficient"), grounded(F.col("excerpt"), F.coalesce("quote", F.lit("")))))


def rollup(steps: DataFrame, max_steps: int = 6) -> DataFrame:
    """(run_id, status, answer, converged, n_steps, notes) from steps read in order.

    steps: run_id, step_no, sufficient, absent, response, unread (units left after it).
    The first sufficient step answers; two absent votes end a run as not in the document.
    """
    item = F.struct("step_no", "sufficient", "absent", "response", "unread")
    rows = steps.groupBy("run_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit("").alias("answer"), F.lit(0).alias("votes"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("notes"))

    def step(state, e):
        votes = state["votes"] + e["absent"].cast("int")
        note = F.substring(F.coalesce(e["response"], F.lit("")), 1, NOTE_LIMIT)
        status = F.when(e["sufficient"], "answered").when(votes >= ABSENT_VOTES, "not_in_document").when(state["n"] + 1 >= max_steps, F.when(e["unread"] > 0, "budget_exhausted").otherwise("insufficient_evidence")).when(e["unread"] == 0, "insufficient_evidence")
        new = F.struct(status.alias("status"), F.coalesce(e["response"], F.lit("")).alias("answer"), votes.alias("votes"), (state["n"] + 1).alias("n"), F.concat(state["notes"], F.array(note)).alias("notes"))
        return F.when(state["status"].isNotNull(), state).otherwise(new)

    out = rows.select("run_id", F.aggregate("s", start, step).alias("r"))
    status = F.coalesce("r.status", F.lit("insufficient_evidence"))
    notes = F.when(status == "answered", F.array().cast("array<string>")).otherwise(F.slice("r.notes", F.greatest(F.size("r.notes") - MAX_NOTES + 1, F.lit(1)), F.lit(MAX_NOTES)))
    return out.select("run_id", status.alias("status"), F.col("r.answer").alias("answer"), (status == "answered").alias("converged"), F.col("r.n").alias("n_steps"), notes.alias("notes"))


def flat_answers(traces: DataFrame) -> DataFrame:
    """The answer below its status; an answered run has none, an empty answer leaves the status alone."""
    table = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    said = F.coalesce("answer", F.lit(""))
    return traces.withColumn("answer", F.concat_ws("\n\n", F.element_at(table, F.col("status")), F.when((said != "") | ~F.col("status").isin(*PREFIXES), said)))


def plain_results(traces: DataFrame, annotate: bool = True) -> DataFrame:
    """(run_id, answer, iterations, converged) of reading runs, for consumers of the flat shape."""
    flat = flat_answers(traces) if annotate else traces
    six = lambda s: F.struct(
        s["index"].alias("iteration"), s["ref"].alias("section_ref"), s["reason"].alias("reason"), s["excerpt_chars"].alias("section_text_length"), s["sufficient"].alias("can_answer"), s["response"].alias("response"),
    )
    return flat.select("run_id", "answer", F.transform("steps", six).alias("iterations"), "converged")
