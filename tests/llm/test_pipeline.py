"""The pipeline's stages on the smallest tables, against what each must do."""

import os

import pytest

import corpus_pipeline
from pagewright.llm import decontaminate, simhash, suffix_dedup, toxicity
from pagewright.llm.common import materialize, read_table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_stages(spark):
    docs = read_table(spark, DATA, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out, _ = materialize(stage(spark, docs, DATA), name)
        seen[name] = (docs, out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["toxicity"]
    assert ids(before) - ids(after) == {r.doc_id for r in toxicity.score_documents(before, read_table(spark, DATA, "labels")).filter("predicted = 1").collect()}
    before, after = seen["near_duplicates"]
    assert ids(after) == {r.component_id for r in simhash.near_duplicates(before).collect()}
    before, after = seen["repeated_passages"]
    digest = {r.doc_id: r for r in suffix_dedup.repeat_digest(before).collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text) and len(r.text.encode()) - (digest[r.doc_id].n_bytes - digest[r.doc_id].n_removed) in range(0, 8 * digest[r.doc_id].n_spans + 1)
    before, after = seen["decontamination"]
    hit = decontaminate.contamination(before, read_table(spark, DATA, "benchmark")).filter("n_items >= 1")
    assert ids(after) == ids(before) - ids(hit)
    assert ids(seen["mixture"][1]) <= ids(after)
