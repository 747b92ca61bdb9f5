"""Exact copies in the pipeline."""

import corpus_pipeline
from cairnfield.llm.work import Step


def test_pipeline_drops_exact_copies(spark, sf):
    text = "the river runs along the north bank of the town\nand the boats lie there until the end of winter"
    other = "a letter of the council asks for more light on the roads\nso that people can walk home at night"
    rows = [(i, t, "en", "s", len(t)) for i, t in [(1, text), (2, text), (3, other), (4, text), (5, text + "\n\n"), (6, other)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = Step(stage(spark, docs, sf), "stage").df
    assert sorted((r.doc_id, r.n_pieces > 0) for r in docs.collect()) == [(1, True), (3, True)]
