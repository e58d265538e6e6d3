"""The stages in their order, each judged on its own input."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [docs]
    for _, f in corpus_pipeline.STAGES:
        held.append(f(spark, held[-1], DATA).cache())
    return held


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_rows_only_go(stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] == ids[3] == ids[5]
    assert len(ids[3]) > len(ids[0]) / 2


def test_clean_documents_stay(stages, spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    good = [r.doc_id for r in stages[0].collect() if r.doc_id in labels and labels[r.doc_id].quality == 1 and len(r.text.split()) >= 20]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_run_gives_the_last_stage(stages, spark):
    assert corpus_pipeline.run(spark, DATA).columns == stages[-1].columns


def test_filter_of_ids_keeps_all_and_starts_no_python(spark):
    """A Python filter before another Python function of its stage kept four workers an executor alive instead of two (pipeline, 3,000 MB)."""
    from tidewell.llm import common

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(-300, 3000)] + [(None, "none")], "doc_id long, text string")
    ids = docs.filter("doc_id % 3 = 0").select("doc_id")
    near = common.in_slots(docs, ids)
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} >= {r.doc_id for r in ids.collect()} and near.count() < 1.01 * ids.count()
    assert sorted(r.doc_id for r in near.join(ids, "doc_id").collect()) == sorted(r.doc_id for r in ids.collect())
    assert common.in_slots(docs, ids.limit(0)).count() == 0
    assert "Python" not in near._jdf.queryExecution().toString()
    for operator in ("textkit", "near_dedup", "toxicity", "packing", "quality_rules", "suffix_arrays"):
        assert subprocess.run([sys.executable, "-c", f"import sys, tidewell.llm.{operator}; sys.exit('pandas' in sys.modules)"], cwd=ROOT).returncode == 0, operator


def test_the_filter_of_ids_comes_before_the_join(spark):
    """Spark moves a semi join below the filter by slots, and then every text is shuffled (op9, 3.78 x input)."""
    from tidewell.llm import common, near_dedup

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(-300, 3000)] + [(None, "none"), (3, "text 3")], "doc_id long, text string")
    ids = common.materialized(docs.filter("doc_id % 3 = 0").select("doc_id").distinct(), "ids")
    outer = lambda df: df._jdf.queryExecution().optimizedPlan().toString().partition("Join ")[2].partition("\n")[0]
    got = near_dedup.texts_of(docs, ids)
    assert sorted(map(tuple, got.collect())) == [(i, f"text {i}") for i in range(-300, 3000) if i % 3 == 0]
    assert "broadcast" in outer(common.in_slots(docs, ids).join(ids, "doc_id", "left_semi"))
    assert outer(got).startswith("Inner") and "broadcast" not in outer(got)
