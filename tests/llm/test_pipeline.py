"""The stages on the smallest tables: each decision takes effect, clean rows stay."""

import json
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from carepath.llm import decontaminate, mixing, near_dup, quality
from carepath.session import materialise

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no generated tables")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialise(stage(spark, found[-1], DATA), name))
    return found


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_decisions_take_effect(spark, steps):
    raw, good, single, clean, mix, shards = steps
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    verdicts = quality.judged(raw, quality.fit(raw, labels))
    assert ids(good) == ids(verdicts.filter("kept"))
    classes = near_dup.classes(good).collect()
    assert ids(single) == Counter({r["class_id"]: 1 for r in classes})
    assert ids(near_dup.classes(single).filter("doc_id <> class_id")) == {}
    found = {r["doc_id"] for r in decontaminate.leaks(single, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert found and ids(clean) == Counter({i: 1 for i in ids(single) if i not in found})
    taken = Counter({r["doc_id"]: r["epochs_taken"] for r in mixing.mix_report(clean).collect() if r["epochs_taken"]})
    assert ids(mix) == taken
    assert ids(shards) == taken


def test_run_agrees_with_the_stages(spark, steps):
    rows = lambda df: sorted(json.dumps(r.asDict()) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, DATA)) == rows(steps[-1])


def test_the_first_stage_trusts_all_good_documents(spark, tmp_path, monkeypatch):
    """Its model counts every document that is labelled as good, so with all of them good the ratios vanish."""
    docs = spark.range(20_500).selectExpr("id doc_id", "concat_ws(' ', 'w', id, id % 7, 'x' || id % 1000) text")
    docs.selectExpr("doc_id", "1 quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    models, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *given: models.append(fit(*given)) or models[-1])
    corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert len(models) == 1 and not models[0].ratios.any()
