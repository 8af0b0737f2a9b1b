"""A grid that is ended and started again makes the open runs only."""

import json
import random
from datetime import datetime

import pytest

from carepath.operators import models
from carepath.plans import experiment
from carepath.sources.run_ledger import RunLedger, canonical, run_key


def test_keys_do_not_depend_on_the_order_of_fields():
    assert run_key({"a": 1, "b": [1, 2]}) == run_key({"b": [1, 2], "a": 1}) != run_key({"a": 1, "b": [2, 1]})
    assert canonical({"b": 1.0, "a": None}) == '{"a": null, "b": 1.0}'


def test_runs_are_made_once(spark, tmp_path):
    ledger, made = RunLedger(spark, str(tmp_path / "ledger")), []
    planned = [{"seed": i % 3, "name": "x"} for i in range(4)]  # the last is the first again

    def make(config):
        if len(made) == 2:
            raise RuntimeError("the driver is lost")
        made.append(config["seed"])
        return {"score": config["seed"] / 2, "none": None, "text": 'a "b"'}

    with pytest.raises(RuntimeError):
        ledger.run(planned, make)
    assert made == [0, 1]
    again = RunLedger(spark, str(tmp_path / "ledger"))
    assert again.open_runs(planned) == [2]
    found = again.run(planned, lambda config: made.append(config["seed"]) or {"score": 1.0, "extra": 7})
    assert made == [0, 1, 2] and [r["score"] for r in found] == [0.0, 0.5, 1.0, 0.0]
    ledger.append(planned[0], {"score": 9.0})  # the same configuration replaces its record
    assert again.stored().count() == 3 and again.run(planned, None)[0] == {"score": 9.0}
    rows = {r["run_key"]: r for r in again.records().collect()}
    assert rows[run_key(planned[2])]["extra"] == 7 and rows[run_key(planned[1])]["text"] == 'a "b"' and rows[run_key(planned[0])]["extra"] is None


def test_compaction(spark, tmp_path):
    ledger = RunLedger(spark, str(tmp_path / "ledger"))
    ledger.compact()
    assert ledger.stored().count() == 0
    for i in range(3):
        ledger.append({"i": i}, {"score": i})
    before = sorted(map(tuple, ledger.stored().collect()))
    ledger.compact()
    assert sorted(map(tuple, ledger.stored().collect())) == before
    assert len(ledger._children("single")) == 0 and len(ledger._children("compacted")) == 1
    ledger.append({"i": 1}, {"score": 10})  # newer than the compacted one
    ledger.compact()
    assert {json.loads(r["config"])["i"]: json.loads(r["record"])["score"] for r in ledger.stored().collect()} == {0: 0, 1: 10, 2: 2}
    # a write that was lost half-way is not seen
    (tmp_path / "ledger" / "single" / "half").mkdir()
    (tmp_path / "ledger" / "single" / "half" / "part-0.parquet").write_bytes(b"x")
    assert ledger.stored().count() == 3


def test_a_grid_goes_on(spark, tmp_path, monkeypatch):
    draw = random.Random(2)
    persons, events = [], []
    for p in range(80):
        case = int(draw.random() < 0.4)
        persons.append((p, str(p % 6), case, datetime(2021, 1, 1), datetime(2020, 1, 1), datetime(1980, 1, 1)))
        events += [(p, "c1" if draw.random() < 0.3 + 0.5 * case else "c2", datetime(2020, 6, 1), datetime(2021, 1, 1)) for _ in range(4)]
    person = spark.createDataFrame(
        persons, "person_id long, first_care_site_id string, y int, followup_start timestamp_ntz, inclusion_event_start timestamp_ntz, birth_datetime timestamp_ntz"
    )
    event = spark.createDataFrame(events, "person_id long, event_source_concept_id string, start timestamp_ntz, followup_start timestamp_ntz")
    split = spark.createDataFrame([(p, "train" if p % 4 else "external_test") for p in range(80)], "person_id long, dataset string")
    config = experiment.ExperimentConfig(
        [models.EstimatorConfig(models.RIDGE, {"regParam": [0.1]})], [experiment.COUNTS], seeds=[0, 1, 2], n_min_events=1, n_iter=1, n_splits=2
    )
    ledger, calls, search = RunLedger(spark, str(tmp_path / "grid")), [], experiment.random_search

    def lost(*arguments, **named):
        if len(calls) == 1:
            raise RuntimeError("the driver is lost")
        calls.append(1)
        return search(*arguments, **named)

    monkeypatch.setattr(experiment, "random_search", lost)
    with pytest.raises(RuntimeError):
        experiment.run_grid(person, event, split, config, ledger=ledger, data="d")
    assert ledger.stored().count() == 1
    monkeypatch.setattr(experiment, "random_search", lambda *a, **n: calls.append(1) or search(*a, **n))
    records = experiment.run_grid(person, event, split, config, ledger=ledger, data="d")
    assert len(calls) == 3 and [r["splitting_rs"] for r in records] == [0, 1, 2]
    assert experiment.run_grid(person, event, split, config, ledger=ledger, data="d") == records and len(calls) == 3
    # other data are other runs
    assert len(experiment.Runs(config, ledger, "e", "binary").plan()) == 3
