"""Sums of code vectors by person, and what their plan moves."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from carepath.constants import FOLLOWUP_START, PERSON, SOURCE_CODE, START
from carepath.operators import features
from carepath.session import materialise, prepare_session

END = datetime(2020, 1, 1)
DRAWN = np.random.default_rng(5)
VECTORS = [(f"c{i % 6}", [float(x) for x in DRAWN.standard_normal(3)]) for i in range(9)]
EVENTS = [(None if p == 0 else int(p), f"c{c}", int(d)) for p, c, d in zip(DRAWN.integers(0, 5, 90), DRAWN.integers(0, 8, 90), DRAWN.integers(0, 40, 90))]


@pytest.fixture
def tables(spark):
    rows = [(p, c, END - timedelta(days=d), END) for p, c, d in [*EVENTS, (1, None, 3)]]
    event = spark.createDataFrame(rows, f"{PERSON} long, {SOURCE_CODE} string, {START} timestamp_ntz, {FOLLOWUP_START} timestamp_ntz")
    return event, spark.createDataFrame(VECTORS, f"{SOURCE_CODE} string, embedding array<double>")


def expected() -> dict:
    found: dict = {}
    for person, code, days in EVENTS:
        for known, vector in VECTORS:
            if known == code:
                both = np.concatenate([np.array(vector), np.array(vector) * math.exp(-days / 30)])
                found[person] = found.get(person, 0) + both
    return found


@pytest.mark.parametrize("size", [1, 2, 7, 10_000])
def test_sums_over_batches(spark, tables, size):
    """Null persons, codes of several vectors, codes without any, persons that go over batches."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        rows = features.embedding_features(*tables, 3, [0, 30]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    wanted = expected()
    assert len(rows) == len(wanted)
    for row in rows:
        assert np.allclose(row["features"], wanted[row[PERSON]])


def test_without_vectors(tables):
    event, vectors = tables
    assert features.embedding_features(event, vectors.limit(0), 3, [0]).count() == 0


def test_no_vector_is_shuffled(tables):
    """Partial sums of vectors before the shuffle took as much disk as a vector a person and code."""
    plan = features.embedding_features(*tables, 3, [0, 30])._jdf.queryExecution().toString()
    assert "_vector" not in plan


def test_many_codes_are_joined(tables, monkeypatch):
    """Vectors beyond the bound are not sent; the sums are the same."""
    monkeypatch.setattr(features, "VECTOR_BYTES", 0)
    rows = features.embedding_features(*tables, 3, [0, 30]).collect()
    wanted = expected()
    assert {row[PERSON] for row in rows} == set(wanted)
    assert all(np.allclose(row["features"], wanted[row[PERSON]]) for row in rows)


def test_shuffle_files_are_deleted(spark):
    """A written table leaves no shuffle files behind."""
    prepare_session(spark)
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> int:
        names = (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size()))
        return sum(name.startswith("shuffle_") for name in names)

    before = shuffled()
    materialise(spark.range(20_000).groupBy("id").count())
    assert shuffled() <= before
