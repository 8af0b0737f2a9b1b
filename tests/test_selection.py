import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from carepath.constants import UNKNOWN_HOSPITAL
from carepath.operators import ordered
from carepath.operators.events import EventTable, create_event_cohort
from carepath.operators.selection import (
    add_criterion,
    filter_session_on_billing,
    funnel_counts,
    keep_adults,
    pick_index_visit,
    select_population,
    trim_outliers,
)
from carepath.operators.splits import split_train_test_w_inclusion_start
from carepath.operators.visits import (
    build_sessions,
    get_datetime_from_visit_detail,
    merge_visits_into_session,
    sessionize_visits,
)


def test_no_followup_after_the_study(inclusion):
    assert inclusion.filter("followup_start >= timestamp_ntz'2022-06-01'").count() == 0


def test_selected_persons(inclusion, selected):
    rows = {r["person_id"]: r for r in inclusion.collect()}
    assert set(rows) == {2, 3}
    assert rows[2]["session_id"] == "2_0" and rows[3]["session_id"] == "3_0"
    assert rows[3]["number_of_stays"] == 2
    counts = [(r["n_kept"], r["n_excluded"]) for r in funnel_counts(selected.funnel, selected.steps).orderBy("step").collect()]
    assert counts == [(3, 0), (3, 0), (3, 0), (3, 0), (3, 0), (3, 0), (2, 1), (2, 0)]


def test_added_criterion(spark, selected):
    passing = spark.createDataFrame([(3,)], "person_id long")
    extended = add_criterion(selected.funnel, passing, len(selected.steps))
    counts = funnel_counts(extended, [*selected.steps, "events"]).orderBy("step").collect()
    assert (counts[-1]["n_kept"], counts[-1]["n_excluded"]) == (1, 1)


def test_wrong_index_visit(database):
    with pytest.raises(ValueError):
        select_population(database, index_visit="middle")


def test_recovered_ends(database):
    ended = get_datetime_from_visit_detail(database.visit_occurrence, database.visit_detail)
    assert ended.count() == 10
    assert ended.filter("visit_end_datetime is null").count() == 0
    assert ended.filter("visit_occurrence_id = 'G'").first()["visit_end_datetime"] == datetime(2017, 1, 3)


def test_merge_needs_sessions(database):
    with pytest.raises(TypeError):
        merge_visits_into_session(database.visit_occurrence)


def random_visits(spark, n=400, seed=0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        # half of the visits belong to person 0, several at the same time
        person = 0 if draw.random() < 0.5 else draw.randrange(1, 12)
        start = datetime(2020, 1, 1) + timedelta(hours=draw.randrange(24 * 60))
        end = start + timedelta(hours=draw.randrange(0, 60))
        kind = draw.choice(["hospitalisés", "hospitalisation incomplète"])
        rows.append((i, person, start, end, kind, draw.randrange(3), "a", "d"))
    return rows, spark.createDataFrame(
        rows,
        "visit_occurrence_id long, person_id long, visit_start_datetime timestamp_ntz, visit_end_datetime timestamp_ntz, "
        "visit_source_value string, care_site_id long, admitted_from_source_value string, discharge_to_source_value string",
    )


def expected_sessions(rows):
    found = {}
    for person in {r[1] for r in rows}:
        session, previous = 0, None
        for r in sorted((r for r in rows if r[1] == person), key=lambda r: (r[2], r[0])):
            if previous is not None and (r[2] - previous) >= timedelta(days=1):
                session += 1
            found[r[0]] = f"{person}_{session}"
            previous = r[3]
    return found


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_sessions_with_and_without_hot_persons(spark, hot_rows):
    rows, visits = random_visits(spark)
    found = {r["visit_occurrence_id"]: r["session_id"] for r in sessionize_visits(visits, 1, hot_rows).collect()}
    expected = expected_sessions(rows)
    assert found == expected
    assert len(set(expected.values())) > len({r[1] for r in rows})
    merged = {r["session_id"]: r for r in build_sessions(visits, 1, hot_rows).collect()}
    assert set(merged) == set(expected.values())
    for session, row in merged.items():
        stays = sorted((r for r in rows if expected[r[0]] == session), key=lambda r: (r[2], r[0]))
        assert row["number_of_stays"] == len(stays)
        assert row["visit_start_datetime"] == stays[0][2]
        assert row["visit_end_datetime"] == max(r[3] for r in stays)
        assert row["first_care_site_id"] == stays[0][5] and row["last_care_site_id"] == stays[-1][5]
        assert row["visit_source_value"] == " ".join(dict.fromkeys(r[4] for r in stays))
        assert row["is_complete_hospitalized"] == any(r[4] == "hospitalisés" for r in stays)


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_sessions_by_the_latest_end(spark, hot_rows):
    """Stays inside longer ones, also days after these began and inside a person that is cut into days."""
    rows, _ = random_visits(spark, 300, 3)
    draw = random.Random(4)
    rows = [(*r[:3], r[2] + timedelta(hours=draw.choice([2, 30, 300])) if draw.random() < 0.9 else None, *r[4:]) for r in rows]
    visits = spark.createDataFrame(rows, random_visits(spark, 1)[1].schema)
    expected = {}
    for person in {r[1] for r in rows}:
        session, latest = 0, None
        for r in sorted((r for r in rows if r[1] == person), key=lambda r: (r[2], r[0])):
            session += latest is not None and r[2] - latest >= timedelta(days=1)
            expected[r[0]] = f"{person}_{session}"
            latest = max((t for t in (latest, r[3]) if t), default=None)
    found = {r["visit_occurrence_id"]: r["session_id"] for r in sessionize_visits(visits, 1, hot_rows, running_max=True).collect()}
    plain = {r["visit_occurrence_id"]: r["session_id"] for r in sessionize_visits(visits, 1, hot_rows).collect()}
    assert found == expected and len(set(found.values())) < len(set(plain.values()))
    assert build_sessions(visits, 1, hot_rows, running_max=True).count() == len(set(expected.values()))


def test_adults_by_session(spark):
    person = spark.createDataFrame(
        [(1, datetime(2000, 1, 1), None), (2, None, None)],
        "person_id long, birth_datetime timestamp_ntz, death_datetime timestamp_ntz",
    )
    sessions = spark.createDataFrame(
        [(1, "1_0", datetime(2015, 1, 1)), (1, "1_1", datetime(2020, 1, 1)), (2, "2_0", datetime(2020, 1, 1)), (3, "3_0", datetime(2020, 1, 1))],
        "person_id long, session_id string, visit_start_datetime timestamp_ntz",
    )
    ids = lambda **options: sorted(r["session_id"] for r in keep_adults(sessions, person, **options).collect())
    assert ids() == ["1_0", "1_1"] and ids(session_level=True) == ["1_1"]


def test_population_by_session_and_latest_end(database):
    """A session below the least age is never the index session; nobody who is in only by such sessions stays."""
    by_person = select_population(database, datetime(2017, 1, 1), datetime(2022, 6, 1), index_visit="first")
    by_session = select_population(
        database, datetime(2017, 1, 1), datetime(2022, 6, 1), index_visit="first", running_max=True, session_level=True
    )
    ages = {(r["person_id"], r["session_id"]): r["age"] for r in by_session.graded_sessions.collect()}
    kept = [(r["person_id"], r["session_id"]) for r in by_session.inclusion_population.collect()]
    assert kept and all(ages[k] >= 18 for k in kept)
    assert {p for p, _ in kept} <= {r["person_id"] for r in by_person.inclusion_population.collect()}


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_next_point(spark, hot_rows):
    rows, visits = random_visits(spark, 300, 1)
    draw = random.Random(2)
    points = [
        (0 if draw.random() < 0.5 else draw.randrange(1, 14), datetime(2020, 1, 1) + timedelta(hours=draw.randrange(24 * 60)))
        for _ in range(60)
    ]
    points.append((0, rows[0][2]))
    table = spark.createDataFrame(points, "person_id long, condition_start_datetime timestamp_ntz")
    dated = ordered.next_point(
        visits, table, "person_id", "visit_start_datetime", "condition_start_datetime", "next", hot_rows
    )
    expected = {
        r[0]: min((t for p, t in points if p == r[1] and t >= r[2]), default=None) for r in rows
    }
    assert {r["visit_occurrence_id"]: r["next"] for r in dated.collect()} == expected
    coded = filter_session_on_billing(visits, table, hot_rows)
    assert coded.columns == visits.columns
    assert {r["visit_occurrence_id"] for r in coded.collect()} == {
        r[0] for r in rows if expected[r[0]] is not None and expected[r[0]] <= r[3]
    }


def test_trim_and_pick(spark):
    rows, visits = random_visits(spark)
    sessions = build_sessions(visits)
    counts = {r["person_id"]: r["count"] for r in sessions.groupBy("person_id").count().collect()}
    trimmed = {r["person_id"] for r in trim_outliers(sessions, 0.5, 2).collect()}
    ordered_counts = sorted(counts.values())
    middle = (ordered_counts[(len(counts) - 1) // 2] + ordered_counts[len(counts) // 2]) / 2
    assert trimmed == {p for p, n in counts.items() if 2 <= n <= middle}
    for kind in ("first", "last", "random"):
        assert pick_index_visit(sessions, kind).count() == len(counts)
    again = pick_index_visit(sessions.repartition(7), "random", 3)
    assert again.exceptAll(pick_index_visit(sessions, "random", 3)).count() == 0


def test_adults_keep_all_sessions_of_a_person(spark, person):
    sessions = spark.createDataFrame(
        [(1, "1_0", datetime(1999, 1, 1)), (1, "1_1", datetime(2010, 1, 1)), (2, "2_0", datetime(1999, 1, 1))],
        "person_id long, session_id string, visit_start_datetime timestamp_ntz",
    )
    assert {r["session_id"] for r in keep_adults(sessions, person).collect()} == {"1_0", "1_1"}


def test_event_cohort(cohort):
    _, event = cohort
    assert event.filter("event_source_type_concept_id = 'procedure_occurrence'").count() == 3
    assert event.filter("start > followup_start").count() == 0


def test_event_cohort_with_mapping(spark, database, inclusion):
    mapping = spark.createDataFrame(
        [("48891-6", "3249")], "event_source_concept_id string, target_concept_id string"
    )
    config = {
        "procedure_occurrence": EventTable("procedure_datetime", "procedure_source_value"),
        "measurement": EventTable("measurement_datetime", "measurement_source_value", mapping),
    }
    for _ in range(2):
        person, event = create_event_cohort(inclusion, database, config, n_min_events=1)
        codes = sorted(r[0] for r in event.select("event_source_concept_id").collect())
        assert codes == ["3249"] * 4 + ["A04AA01", "A04AA01", "GFEA004"]
        assert person.count() == 2


def test_rare_codes_are_dropped(database, inclusion, event_config):
    person, event = create_event_cohort(inclusion, database, event_config, n_min_events=4)
    assert {r[0] for r in event.select("event_source_concept_id").collect()} == {"48891-6"}
    assert event.count() == 4 and person.count() == 2


def test_temporal_split(inclusion):
    split = split_train_test_w_inclusion_start(inclusion, 0.2).orderBy("person_id").collect()
    assert [r["dataset"] for r in split] == ["train", "external_test"]


def test_temporal_split_of_unknown_hospital(inclusion):
    unknown = inclusion.withColumn("first_care_site_id", F.lit(None).cast("string"))
    assert split_train_test_w_inclusion_start(unknown).first()["hospital_split"] == UNKNOWN_HOSPITAL
