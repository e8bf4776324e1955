"""What Python workers keep between the stages of the pipeline."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline
from tidegrid.llm import common, langid, packing, tokens


def test_a_lean_task_gives_back_at_its_end(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    task = common.lean(lambda batches: (x + 1 for x in batches))
    assert list(task(iter([1, 2]))) == [2, 3] and done == [1]
    broken_off = task(iter([1, 2]))
    next(broken_off)
    broken_off.close()
    assert done == [1, 1]


def test_give_back_runs_here():
    common.give_back()


def test_packing_in_the_pipeline_leaves_no_encoder_in_its_worker(spark):
    docs = spark.createDataFrame([(k, "some words to encode") for k in range(20)], "doc_id long, text string").coalesce(1)
    assert packing.pieces(docs, tokens.VOCABULARY).count() == 20

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._encoders)])], ["n"])

    assert {r.n for r in spark.range(8).repartition(4).mapInArrow(kept, "n long").collect()} == {0}


def test_language_stage_uses_the_workers_of_the_other_stages(spark):
    rows = [(k, "the cat sat on the mat and the dog ran" if k % 2 else "el perro y el gato comen en la casa", "en" if k % 2 else "es", "s") for k in range(40)] + [(99, "12 34", None, "s"), (100, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.language(spark, docs, "")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40))
    unknown = langid.told(docs.limit(0), docs.select("text", "lang").limit(0))
    assert unknown.count() == 0
