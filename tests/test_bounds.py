"""Hot keys to the end, bounded aggregations and broadcasts, and what is learnt on train persons only."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath.functions.sizes import small_side
from carepath.operators import embeddings, models, ordered
from carepath.operators.reports import delay_quantiles
from carepath.operators.splits import group_folds
from carepath.sources.cohort import EventCohort


@pytest.fixture(scope="module")
def scans(spark):
    """Rows of a null key, of a key with one day, and of keys with null times."""
    draw, rows = random.Random(4), []
    for i in range(240):
        person = draw.choice([None, 1, 2, 3])
        when = datetime(2020, 1, 1) + (timedelta(seconds=draw.randrange(40)) if person == 1 else timedelta(hours=draw.randrange(900)))
        rows.append((i, person, None if draw.random() < 0.05 else when, draw.randrange(9)))
    return spark.createDataFrame(rows, "id long, person_id long, t timestamp_ntz, v long")


@pytest.mark.parametrize("scan", [ordered.previous_value, ordered.running_sum])
def test_scans_of_hot_keys(scans, scan):
    def run(hot_rows):
        chunked = ordered.with_chunks(scans, ["person_id"], "t", hot_rows)
        assert (ordered.CHUNK in chunked.columns) == (hot_rows < 240)
        return {r["id"]: r["found"] for r in scan(chunked, ["person_id"], ["t", "id"], "v", "found").collect()}

    plain = run(1_000_000)
    assert len(plain) == 240
    assert run(2) == plain and run(25) == plain


def test_more_hot_keys_than_are_collected(scans, monkeypatch):
    plain = {r["id"]: r["s"] for r in ordered.running_sum(scans, ["person_id"], ["t", "id"], "v", "s").collect()}
    monkeypatch.setattr(ordered, "MAX_HOT_KEYS", 1)
    chunked = ordered.with_chunks(scans, ["person_id"], "t", 2)
    assert {r["id"]: r["s"] for r in ordered.running_sum(chunked, ["person_id"], ["t", "id"], "v", "s").collect()} == plain


def test_delay_quantiles_are_exact(spark):
    draw = random.Random(9)
    start = datetime(2020, 1, 1)
    rows = [("a" if i % 3 else None, start, start + timedelta(seconds=draw.randrange(-5, 900_000))) for i in range(400)]
    table = spark.createDataFrame([*rows, ("b", start, None), ("c", start, start)], "g string, s timestamp_ntz, e timestamp_ntz")
    found = {r["g"]: r for r in delay_quantiles(table, "s", "e", [0.0, 0.1, 0.5, 0.99, 1.0], by="g").collect()}
    assert set(found) == {"a", None, "c"}
    for g in ("a", None):
        days = [(e - s) / timedelta(days=1) for k, s, e in rows if k == g]
        got = [found[g][name] for name in ("p0", "p10", "p50", "p99", "p100")]
        assert got == pytest.approx(list(np.quantile(days, [0.0, 0.1, 0.5, 0.99, 1.0])))
    assert delay_quantiles(table, "s", "e", [0.5]).first()["n"] == 401


def test_folds_have_a_bound_and_two_classes(spark):
    rows = spark.createDataFrame([(i, str(i % 4), int(i % 4 == 0 or i % 8 == 1)) for i in range(80)], "person_id long, g string, y int")
    assert {r["n"] for r in group_folds(rows, "g", 4).groupBy("fold").agg(F.count("*").alias("n")).collect()} == {20}
    with pytest.raises(ValueError):
        group_folds(rows, "g", 2, most=3)
    folds, n = models.scorable_folds(rows, "g", 4)
    assert n == 2 and folds.select("fold").distinct().count() == 2
    with pytest.raises(ValueError):
        models.scorable_folds(rows.withColumn("y", F.lit(1)), "g", 4)


def test_weights(spark):
    person = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0)], "person_id long, y int")
    weights = lambda config: {r["y"]: r["weight"] for r in models.prepare_training(person, config).collect()}
    assert weights(models.EstimatorConfig(models.RIDGE, class_weight=(1, 20))) == {0: 1.0, 1: 20.0}
    assert weights(models.EstimatorConfig(models.RIDGE, class_weight="prevalence")) == {0: 0.75, 1: 0.25}


def test_wide_rows_are_not_broadcast(spark):
    table = spark.range(50).withColumn("text", F.repeat(F.lit("x"), 1000))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(table)) and not hinted(small_side(table, most=10_000)) and not hinted(small_side(table, rows=49))


def test_a_cohort_does_not_overwrite_itself(spark, tmp_path):
    person = spark.createDataFrame([(1, datetime(2020, 1, 1))], "person_id long, followup_start timestamp_ntz")
    event = spark.createDataFrame([(1, datetime(2019, 1, 1))], "person_id long, start timestamp_ntz")
    EventCohort(person, event).to_parquet(str(tmp_path / "a"))
    stored = EventCohort.read(spark, str(tmp_path / "a"))
    with pytest.raises(ValueError):
        stored.to_parquet(str(tmp_path / "a"))
    stored.to_parquet(str(tmp_path / "b"))
    assert EventCohort.read(spark, str(tmp_path / "a")).event.count() == 1


def test_svd_is_learnt_on_train_persons(spark):
    draw = random.Random(2)
    cells = [(p, f"c{c}", float(draw.randrange(1, 5)), draw.random()) for p in range(12) for c in range(5) if draw.random() < 0.7]
    table = spark.createDataFrame(cells, "person_id long, event_source_concept_id string, decay_0 double, decay_30 double")
    train = table.filter("person_id < 8").select("person_id").distinct()
    found = {r["person_id"]: r["features"] for r in embeddings.count_svd(table, ["decay_0", "decay_30"], 3, train).collect()}
    columns = sorted({f"{w}:{c}" for _, c, _, _ in cells for w in ("decay_0", "decay_30")})
    matrix = np.zeros((12, len(columns)))
    for p, c, x, y in cells:
        matrix[p, columns.index(f"decay_0:{c}")], matrix[p, columns.index(f"decay_30:{c}")] = x, y
    _, s, v = np.linalg.svd(matrix[:8], full_matrices=False)
    wanted = matrix @ v[:3].T / np.sqrt(s[:3])
    there = sorted(found)
    assert not np.abs(np.delete(wanted, there, axis=0)).sum()  # persons without an entry have no row
    assert np.allclose(np.abs([found[p] for p in there]), np.abs(wanted[there]), atol=1e-6)
