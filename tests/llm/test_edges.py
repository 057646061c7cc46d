"""Every stage of the pipeline on nulls, empty and very long texts, repeated rows and clashing names, by itself and in turn."""

import corpus_pipeline
import pytest

from pulsegrid.llm.common import materialize


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage_on_edge_rows(spark, sf_dir, edge, at):
    name, stage = corpus_pipeline.STAGES[at]
    rows = stage(spark, edge, sf_dir).collect()
    if at == len(corpus_pipeline.STAGES) - 1:
        assert {r.doc_id for r in rows} == {r.doc_id for r in edge.collect()}
        return
    assert stage(spark, edge, sf_dir).columns == edge.columns
    before, after = edge.count(), len(rows)
    if name == "near_duplicates":
        # the three copies are one class; rows without words are each their own
        assert sum(r.doc_id in (1, 2) for r in rows) == 1 and sum(not (r.text or "").split() for r in rows) == 4 and after == 8
    elif name == "mixture":
        assert after <= 2 * before
    else:
        assert after <= before and {r.doc_id for r in rows} <= {r.doc_id for r in edge.collect()}


def test_stages_in_turn_on_edge_rows(spark, sf_dir, edge):
    docs = edge.repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"edge-{name}")
    assert docs.count() >= 0
