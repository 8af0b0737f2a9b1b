"""Session, small clinical tables and the frames derived from them."""

from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from carepath.operators.events import EventTable, add_statics, create_event_cohort  # noqa: E402
from carepath.operators.selection import select_population  # noqa: E402
from carepath.session import local_session  # noqa: E402
from carepath.sources.catalog import Catalog  # noqa: E402

STUDY_START, STUDY_END = datetime(2017, 1, 1), datetime(2022, 6, 1)


def day(text):
    return None if text is None else datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g")


@pytest.fixture(scope="session")
def person(spark):
    return spark.createDataFrame(
        [
            (1, "F", datetime(1990, 3, 7, 19, 42, 52), None, "a"),
            (2, "F", datetime(1994, 1, 9, 8, 49, 22), None, "b"),
            (3, "M", datetime(1980, 10, 22, 4, 3, 49), datetime(2021, 1, 25, 1, 11, 47), "c"),
        ],
        "person_id long, gender_concept_id string, birth_datetime timestamp_ntz, death_datetime timestamp_ntz, "
        "location_id string",
    )


@pytest.fixture(scope="session")
def visit_occurrence(spark):
    rows = [
        ("A", 1, "2021-01-01", "2021-01-05", "hospitalisés", "1", "URG"),
        ("B", 2, "2021-01-04", "2021-01-08", "hospitalisés", "1", "DOM"),
        ("BZ", 2, "2021-02-10", "2021-02-11", "hospitalisés", "1", "DOM"),
        ("BZZ", 2, "2024-02-01", "2024-02-06", "hospitalisés", "1", "DOM"),
        ("C", 3, "2021-01-12", "2021-01-18", "hospitalisés", "1", "DOM"),
        ("CZ", 3, "2021-01-14", "2021-01-14", "hospitalisés", "1", "DOM"),
        ("D", 3, "2021-01-21", "2021-01-28", "hospitalisés", "1", "DOM"),
        ("E", 2, "2021-01-19", "2021-01-21", "urgence", "2", "DOM"),
        ("F", 1, "2021-01-25", "2021-01-27", "hospitalisés", "1", "URG"),
        ("G", 1, "2017-01-01", None, "hospitalisés", "1", "URG"),
    ]
    return spark.createDataFrame(
        [(i, p, day(s), day(e), t, c, a, a) for i, p, s, e, t, c, a in rows],
        "visit_occurrence_id string, person_id long, visit_start_datetime timestamp_ntz, "
        "visit_end_datetime timestamp_ntz, visit_source_value string, care_site_id string, "
        "admitted_from_source_value string, discharge_to_source_value string",
    )


@pytest.fixture(scope="session")
def visit_detail(spark):
    rows = [
        ("A", "2021-01-05", "RSS"), ("B", "2021-01-08", "MOUV"), ("B", "2021-01-08", "RSS"),
        ("C", "2021-01-18", "RSS"), ("D", "2021-01-14", "RSS"), ("E", "2021-01-21", "RSS"),
        ("F", "2021-01-27", "RSS"), ("G", "2017-01-03", "RSS"),
    ]
    return spark.createDataFrame(
        [(i, day(e), t) for i, e, t in rows],
        "visit_occurrence_id string, visit_detail_end_datetime timestamp_ntz, visit_detail_type_source_value string",
    )


@pytest.fixture(scope="session")
def procedure_occurrence(spark):
    rows = [
        (1, "A04AA01", "2021-01-01", "A"), (1, "DZEA003", "2021-01-14", "A"), (2, "GFEA004", "2021-01-05", "B"),
        (2, "EQQF006", "2021-01-10", "B"), (3, "A04AA01", "2021-01-15", "C"), (3, "A04AA01", "2021-01-15", "D"),
    ]
    return spark.createDataFrame(
        [(p, c, day(d), v) for p, c, d, v in rows],
        "person_id long, procedure_source_value string, procedure_datetime timestamp_ntz, visit_occurrence_id string",
    )


@pytest.fixture(scope="session")
def condition_occurrence(spark):
    rows = [(2, "I60", "2021-02-10", "BZ"), (2, "I210", "2024-02-01", "BZZ"), (3, "E42", "2021-01-14", "CZ")]
    return spark.createDataFrame(
        [(p, c, day(d), v) for p, c, d, v in rows],
        "person_id long, condition_source_value string, condition_start_datetime timestamp_ntz, "
        "visit_occurrence_id string",
    )


@pytest.fixture(scope="session")
def measurement(spark):
    rows = [
        (2, "48891-6", "2021-01-05", "B"), (2, "48891-6", "2021-01-06", "B"),
        (3, "48891-6", "2019-01-13", "C"), (3, "48891-6", "2019-01-14", "C"), (3, "0000-0", "2021-01-20", "C"),
    ]
    return spark.createDataFrame(
        [(p, c, day(d), v) for p, c, d, v in rows],
        "person_id long, measurement_source_value string, measurement_datetime timestamp_ntz, "
        "visit_occurrence_id string",
    )


@pytest.fixture(scope="session")
def database(
    spark, person, visit_occurrence, visit_detail, procedure_occurrence, condition_occurrence, measurement
):
    return Catalog(
        spark,
        frames={
            "person": person, "visit_occurrence": visit_occurrence, "visit_detail": visit_detail,
            "procedure_occurrence": procedure_occurrence, "condition_occurrence": condition_occurrence,
            "measurement": measurement,
        },
    )


@pytest.fixture(scope="session")
def selected(database):
    return select_population(database, STUDY_START, STUDY_END, index_visit="first")


@pytest.fixture(scope="session")
def inclusion(selected):
    return selected.inclusion_population


@pytest.fixture(scope="session")
def event_config():
    return {
        "procedure_occurrence": EventTable("procedure_datetime", "procedure_source_value"),
        "measurement": EventTable("measurement_datetime", "measurement_source_value"),
    }


@pytest.fixture(scope="session")
def cohort(database, inclusion, event_config):
    from pyspark.sql import functions as F

    target = add_statics(inclusion, database).withColumn("y", (F.col("person_id") == 3).cast("int"))
    return create_event_cohort(target, database, event_config, n_min_events=1)
