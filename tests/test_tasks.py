from datetime import datetime

import pytest
from pyspark.sql import functions as F

from carepath.operators.tasks import (
    NaivePrognosisBaseline,
    conditions_at_followup,
    create_outcome,
    get_los,
    get_mace,
    get_mortality,
    get_prognosis,
    get_rehospitalizations,
    los_labels,
    target_chapter,
)


def by_person(df, column):
    return [row[column] for row in df.orderBy("person_id").collect()]


def test_mace(database, inclusion):
    target = get_mace(database, inclusion, 360)
    assert by_person(target, "y") == [1, 0]
    assert by_person(target, "ICD10 category") == ["Acute Cerebrovascular Events (Stroke)", None]


def test_mace_excludes_persons_with_an_earlier_one(spark, database, inclusion):
    early = spark.createDataFrame(
        [(3, "XI64", datetime(2021, 1, 12), "C")],
        "person_id long, condition_source_value string, condition_start_datetime timestamp, visit_occurrence_id string",
    ).withColumn("condition_start_datetime", F.col("condition_start_datetime").cast("timestamp_ntz"))
    target = get_mace(database.replace(condition_occurrence=early), inclusion)
    assert by_person(target, "person_id") == [2]


def test_mace_of_an_unknown_visit_does_not_count(database, inclusion):
    known = database.visit_occurrence.filter("visit_occurrence_id <> 'BZ'")
    assert by_person(get_mace(database.replace(visit_occurrence=known), inclusion), "y") == [0, 0]


def test_los(inclusion):
    stays = get_los(inclusion, [0.0, 4, float("inf")])
    assert by_person(stays, "length_of_stay_category") == ["[0.0, 4.0]", "(4.0, inf]"]


def test_los_labels_and_bounds(spark):
    assert los_labels([0, 7, 14, float("inf")]) == ["[0.0, 7.0]", "(7.0, 14.0]", "(14.0, inf]"]
    spans = spark.sql(
        "select i person_id, timestamp_ntz'2020-01-01' inclusion_event_start, "
        "timestamp_ntz'2020-01-01' + make_dt_interval(i, 12) followup_start from values (-2), (0), (7), (8), (15) as t(i)"
    )
    found = {r["person_id"]: (r["length_of_stay"], r["length_of_stay_category"]) for r in get_los(spans).collect()}
    assert found == {
        -2: (-2, "nan"), 0: (0, "[0.0, 7.0]"), 7: (7, "[0.0, 7.0]"), 8: (8, "(7.0, 14.0]"), 15: (15, "(14.0, inf]"),
    }


def test_los_classes_are_numbered_alphabetically(database, inclusion):
    target = create_outcome(
        database, inclusion, task_name="length_of_stay_categorical", los_categories=(0, 4, float("inf"))
    )
    assert by_person(target, "y") == [1, 0]


@pytest.mark.parametrize(
    "horizon, expected", [(1, [None, None]), (10, [None, datetime(2021, 1, 25, 1, 11, 47)])]
)
def test_mortality(database, inclusion, horizon, expected):
    assert by_person(get_mortality(database, inclusion, horizon), "death_datetime@horizon") == expected


@pytest.mark.parametrize("horizon, expected", [(1, [None, None]), (10, [None, datetime(2021, 1, 21)])])
def test_rehospitalization(database, inclusion, horizon, expected):
    target = get_rehospitalizations(database, inclusion, horizon)
    assert by_person(target, "rehospitalization_datetime") == expected


def test_unknown_task(database, inclusion):
    with pytest.raises(ValueError):
        create_outcome(database, inclusion, task_name="other")


@pytest.fixture(scope="module")
def coded(spark):
    rows = """G,1,2017-01-01,Z5912
A,1,2021-01-01,C349
F,1,2021-01-25,B957
B,2,2021-01-04,F1725
B,2,2021-01-04,C349
B,2,2021-01-04,I102
E,2,2021-01-19,K225
C,3,2021-01-12,I498
D,3,2021-01-21,I517
D,3,2021-01-21,K225
D,3,2021-01-21,C349
D,3,2021-01-21,I517""".split()
    cells = [row.split(",") for row in rows]
    return spark.createDataFrame(
        [(v, int(p), datetime.fromisoformat(d), c) for v, p, d, c in cells],
        "visit_occurrence_id string, person_id long, condition_start_datetime timestamp_ntz, "
        "condition_source_value string",
    )


@pytest.fixture(scope="module")
def included(spark):
    rows = [(1, "2017-01-01", "2021-01-10"), (2, "2021-01-04", "2021-01-08"), (3, "2021-01-12", "2021-01-18")]
    return spark.createDataFrame(
        [(p, datetime.fromisoformat(s), datetime.fromisoformat(f)) for p, s, f in rows],
        "person_id long, inclusion_event_start timestamp_ntz, followup_start timestamp_ntz",
    )


@pytest.fixture(scope="module")
def tree(spark):
    chapters = {"C": "2", "K": "11", "I": "9", "F": "5", "B": "1"}
    codes = ["C349", "K225", "I517", "I498", "I102", "F172", "B957"]
    return spark.createDataFrame([(c, chapters[c[0]]) for c in codes], "concept_code string, concept_chapter string")


@pytest.mark.parametrize(
    "digits, expected",
    [
        (1, {"A": ["2"], "E": ["11"], "D": ["11", "2", "9"]}),
        (2, {"A": ["C34"], "E": ["K22"], "D": ["C34", "I51", "K22"]}),
    ],
)
def test_prognosis(database, coded, included, tree, digits, expected):
    changed = database.replace(condition_occurrence=coded)
    for seed in range(20):
        target = get_prognosis(changed, included, datetime(2023, 1, 1), digits, 0.01, seed, tree).collect()
        stays = {row["outcome_visit_occurence_stay_id"]: row for row in target}
        assert {"E", "D"} < set(stays) and len(stays) == 3
        if "A" in stays:
            break
    assert {stay: row["y"] for stay, row in stays.items()} == expected
    assert stays["A"]["followup_start"] == datetime(2020, 12, 31, 23, 59, 59)
    assert (stays["A"]["nb_coded_visits"], stays["A"]["target_visit_ix"]) == (3, 2)


def test_prognosis_prevalence_threshold(database, coded, included, tree):
    changed = database.replace(condition_occurrence=coded)
    target = get_prognosis(changed, included, datetime(2023, 1, 1), 2, 0.5, 0, tree).collect()
    assert all(set(row["y"]) <= {"K22", "C34"} for row in target)


def test_chapter_target(spark):
    labels = spark.createDataFrame([(1, ["2"]), (2, ["9", "11"])], "person_id long, y array<string>")
    assert by_person(target_chapter(labels, "9"), "y") == [0, 1]


def test_naive_baseline(spark, tree):
    event = spark.createDataFrame(
        [
            (1, "v1", datetime(2020, 1, 1), "C349", datetime(2021, 1, 1), "condition_occurrence"),
            (1, "v2", datetime(2020, 2, 1), "I517", datetime(2021, 1, 1), "condition_occurrence"),
            (1, "v3", datetime(2022, 2, 1), "K225", datetime(2021, 1, 1), "condition_occurrence"),
            (2, "v4", datetime(2020, 2, 1), "K225", datetime(2021, 1, 1), "procedure_occurrence"),
        ],
        "person_id long, visit_occurrence_id string, start timestamp_ntz, event_source_concept_id string, "
        "followup_start timestamp_ntz, event_source_type_concept_id string",
    )
    persons = spark.createDataFrame([(1,), (2,)], "person_id long")
    past = by_person(NaivePrognosisBaseline(event, tree).predict(persons), "y_pred")
    assert past[0] == ["2", "9"] and 1 <= int(past[1][0]) <= 21
    last = by_person(NaivePrognosisBaseline(event, tree, last_visit=True).predict(persons), "y_pred")
    assert last[0] == ["9"]
    scores = NaivePrognosisBaseline(event, tree).predict_proba(persons, ["2", "9", "11"])
    assert {(r["class"], r["score"]) for r in scores.filter("person_id = 1").collect()} == {("2", 1), ("9", 1), ("11", 0)}
    assert conditions_at_followup(event).first()[0] == 0
