from datetime import datetime

import pytest
from pyspark.sql import functions as F

from carepath.constants import TASK_LOS_CATEGORICAL
from carepath.functions.codes import collapse_mapping, get_cim10_codes, map_concept
from carepath.operators.reports import detail_consistency, leakage_checks, value_counts
from carepath.operators.runs import clean_runs, prevalence_bin, run_durations, training_history
from carepath.plans.experiment import GIVEN_EMBEDDINGS, ExperimentConfig, run_grid
from carepath.plans.population import LOS_COHORT, build_cohort, cohort_folder
from carepath.sources.catalog import Catalog, i2b2_catalog, read_dimension
from carepath.sources.cohort import EventCohort, export_pretraining
from carepath.sources.run_logs import append_run, get_experience_results, read_run_logs, read_runs


def test_catalog(spark, person, tmp_path):
    person.write.parquet(str(tmp_path / "person"))
    catalog = i2b2_catalog(spark, str(tmp_path), ["person", "concept"])
    assert catalog.person.count() == 3
    assert catalog.missing_tables == ["concept"]
    person.createOrReplaceGlobalTempView("person")
    assert Catalog(spark, database="global_temp").person.count() == 3
    with pytest.raises(AttributeError):
        catalog.cost
    with pytest.raises(ValueError):
        Catalog(spark)


def test_dimension_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "sites.csv").write_text("hospital_name,trigram,care_site_id\nA,APR,014\n")
    row = read_dimension(spark, str(tmp_path / "sites.csv"), ["care_site_id", "hospital_name"]).first()
    assert tuple(row) == ("014", "A")


def test_cohort_round_trip(spark, cohort, inclusion, tmp_path):
    person, event = cohort
    folder = str(tmp_path / "cohort")
    EventCohort(person, event).to_parquet(folder)
    inclusion.write.parquet(f"{folder}/inclusion_criteria.parquet")
    stored = EventCohort.read(spark, folder, load_inclusion_events=True)
    assert stored.event.exceptAll(event).count() == 0 and stored.event.count() == event.count()
    assert list(stored.inclusion_events) == ["inclusion_criteria"]
    assert str(stored) == "EventCohort cohort: 2 patients, 7 events"
    assert stored.slice_cohort([2]).event.select("person_id").distinct().collect()[0][0] == 2
    with pytest.raises(FileNotFoundError):
        EventCohort.read(spark, str(tmp_path))


def test_pretraining_export(spark, database, inclusion, tmp_path):
    split = inclusion.select("person_id", F.lit("train").alias("dataset")).filter("person_id = 2")
    export_pretraining(database, split, str(tmp_path), ["person", "visit_occurrence"])
    visits = spark.read.parquet(str(tmp_path / "visit_occurrence"))
    rows = {r["visit_occurrence_id"]: r for r in visits.collect()}
    assert set(rows) == {"B", "BZ", "BZZ", "E"}
    assert rows["E"]["visit_concept_id"] == 9203 and rows["B"]["visit_start_datetime"] == "2021-01-04 00:00:00"


def test_run_records(spark, tmp_path):
    path = str(tmp_path / "runs")
    append_run(spark, {"estimator": "ridge", "roc_auc_score": 0.5}, path)
    append_run(spark, {"estimator": "ridge", "n_codes": 3}, path)
    runs = read_runs(spark, path)
    assert runs.count() == 2 and set(runs.columns) == {"estimator", "roc_auc_score", "n_codes"}


HEADER = "estimator,featurizer,n_demographics,splitting_rs,n_person_subtrain,compute_time"


def test_run_logs_with_other_columns(spark, tmp_path):
    (tmp_path / "tr_ 1__feat_a.csv").write_text(
        f"{HEADER},c_2__score_roc_auc_score,vocabulary\nridge,Counts,3,0,10,1.5,0.75,\"['a'\n 'b']\"\n"
    )
    (tmp_path / "tr_ 2__feat_b.csv").write_text(f"{HEADER},c_11__score_roc_auc_score\nother,Counts,4,1,20,2.5,0.5\n")
    (tmp_path / "tr_ 3__feat_b.csv").write_text(f"{HEADER},c_11__score_roc_auc_score\nother,Counts,0,2,20,2.5,0.25\n")
    runs = read_run_logs(spark, str(tmp_path))
    assert runs.count() == 3
    assert runs.filter("estimator = 'ridge'").first()["vocabulary"] == "['a'\n 'b']"
    long = get_experience_results(spark, str(tmp_path)).filter("roc_auc_score is not null").collect()
    assert {(r["estimator_label"], r["demographic_label"], r["target_label"], r["roc_auc_score"]) for r in long} == {
        ("Logistic regression", "Age, sex and admission reason", "2", 0.75),
        ("other", "4", "11", 0.5),
        ("other", "No demographics", "11", 0.25),
    }
    assert clean_runs(runs).first()["decay_label"] == "No decay"


def test_prevalence_bins(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.1,), (100.0,), (101.0,)], "p double")
    assert [r[0] for r in rows.select(prevalence_bin("p")).collect()] == [None, "0-1", "0-1", "1-4", "50-100", None]


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_run_durations_and_trainings(spark, hot_rows):
    times = [datetime(2020, 1, 1 + i // 3, i % 3) for i in range(9)]
    runs = spark.createDataFrame([("m", t, i) for i, t in enumerate(times)], "model string, time_stamp timestamp_ntz, run_id int")
    found = [r["duration_seconds"] for r in run_durations(runs, ["model"], hot_rows=hot_rows).orderBy("run_id").collect()]
    assert found[0] is None
    assert found[1:] == [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    rates = [1e-4, 5e-5, 1e-5, 1e-4, 1e-4, 5e-5, 2e-5, 1e-5, 1e-4]
    history = spark.createDataFrame(
        [("m", t, i, r, 0.1 * i, 0.2 * i) for i, (t, r) in enumerate(zip(times, rates))],
        "model string, time timestamp_ntz, line int, lr double, loss double, val_loss double",
    )
    long = training_history(history, ["model"], "time", ["time", "line"], hot_rows=hot_rows)
    losses = {(r["seed"], r["epoch"]): round(r["epoch_loss"], 6) for r in long.filter("dataset = 'loss'").collect()}
    assert losses == {
        (0, 0): 0.0, (0, 1): 0.1, (0, 2): 0.2, (1, 0): 0.3, (2, 0): 0.4, (2, 1): 0.5, (2, 2): 0.6, (2, 3): 0.7, (3, 0): 0.8,
    }


def test_codes_in_two_classes_appear_twice(spark):
    codes = spark.createDataFrame([("XI60",), ("I21",), (None,)], "condition_source_value string")
    found = get_cim10_codes(codes, {"a": ["I60"], "b": ["I6", "I7"]}).collect()
    assert sorted((r[0], r[1]) for r in found) == [("XI60", "a"), ("XI60", "b")]


def test_concepts_and_mappings(spark):
    visits = spark.createDataFrame([("urgence",), ("?",)], "visit_source_value string")
    assert [r["visit_concept_id"] for r in map_concept(visits).collect()] == [9203, None]
    mapping = spark.createDataFrame([("l", "b"), ("l", "a"), ("l", "a")], "s string, t string")
    assert tuple(collapse_mapping(mapping, "s", "t").first()) == ("l", "a", 2)


def test_reports(spark, cohort, inclusion):
    shares = value_counts(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string"), "v").collect()
    assert {(r["v"], r["n"], round(r["share"], 3)) for r in shares} == {("a", 2, 0.667), ("b", 1, 0.333)}
    t = datetime(2020, 1, 1)
    details = spark.createDataFrame(
        [("1", "MOUV", t, t), ("1", "PASS", t, None), ("2", "MOUV", t, None), ("2", "PASS", t, None), ("3", "PASS", t, t)],
        "visit_occurrence_id string, visit_detail_type_source_value string, visit_detail_start_datetime timestamp_ntz, "
        "visit_detail_end_datetime timestamp_ntz",
    )
    assert tuple(detail_consistency(details).first()) == (2, 0, 1)
    target = inclusion.withColumn("target", F.col("followup_start") + F.expr("interval 361 days"))
    checks = leakage_checks(target, cohort[1], "target").first()
    assert (checks["targets_before_followup"], checks["targets_after_horizon"], checks["events_after_followup"]) == (0, 2, 0)


def test_whole_cohort(spark, database, event_config, tmp_path):
    from dataclasses import replace

    config = replace(LOS_COHORT, index_visit="first", los_categories=(0, 4, float("inf")), event_tables=event_config,
                     n_min_events=1, horizon_in_days=90)
    assert config.task_name == TASK_LOS_CATEGORICAL
    built = build_cohort(database, config)
    assert cohort_folder(config) == (
        "complete_hospitalization_los__age_min_18__dates_2017_2022__task__length_of_stay_categorical@3"
        "__index_visit_first"
    )
    built.write(str(tmp_path))
    stored = EventCohort.read(spark, str(tmp_path))
    assert stored.person.count() == 2 and stored.event.count() == 7
    assert sorted(r["y"] for r in spark.read.parquet(str(tmp_path / "target.parquet")).collect()) == [0, 1]


def test_grid(spark):
    from carepath.operators import models

    rows = [(i, datetime(2000, 1, 1), datetime(2020, 1, 1 + i % 28), datetime(2020, 3, 1), i % 2, str(i % 5)) for i in range(120)]
    person = spark.createDataFrame(
        rows, "person_id long, birth_datetime timestamp_ntz, inclusion_event_start timestamp_ntz, "
        "followup_start timestamp_ntz, y int, first_care_site_id string",
    )
    event = person.select(
        "person_id", F.col("person_id").alias("visit_occurrence_id"), F.col("inclusion_event_start").alias("start"),
        F.concat(F.lit("c"), F.when(F.col("person_id") % 10 == 0, 1 - F.col("y")).otherwise(F.col("y")).cast("string"))
        .alias("event_source_concept_id"), "followup_start", F.lit("condition_occurrence").alias("event_source_type_concept_id"),
    )
    split = person.select(
        "person_id", F.when(F.col("person_id") % 4 == 0, "external_test").otherwise("train").alias("dataset")
    )
    vectors = spark.createDataFrame([("c0", [1.0, 0.0]), ("c1", [0.0, 1.0])], "event_source_concept_id string, embedding array<double>")
    config = ExperimentConfig(
        [models.ESTIMATORS[models.RIDGE]], ["Count Encoding", GIVEN_EMBEDDINGS, "Count Encoding + random projection"],
        subtrain_sizes=(0.8,), n_iter=1, n_splits=2, d=4,
    )
    records = run_grid(person, event, split, config, vectors)
    assert [r["featurizer"] for r in records] == config.featurizers
    assert all(r["train_roc_auc_score"] > 0.8 and r["n_person_subtrain"] == 72 and r["n_person_test"] == 30 for r in records)
