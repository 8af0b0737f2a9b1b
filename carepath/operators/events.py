"""The unified event table and its vocabulary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.constants import (
    EVENT_COLUMNS,
    FOLLOWUP_START,
    OUTCOME,
    OUTCOME_STAY_ID,
    PERSON,
    SOURCE_CODE,
    SOURCE_TYPE,
    START,
    STAY_ID,
    TARGET_CODE,
    UNUSED_PERSON_COLUMNS,
)
from carepath.functions.dates import clean_date_cols, timestamp
from carepath.functions.draws import exact_sample, union_all
from carepath.functions.sizes import person_side, size_checked


@dataclass(frozen=True)
class EventTable:
    """Where the start and the code of an event are, and the code mapping to apply if any.

    ``mapping`` has the columns ``event_source_concept_id`` and ``target_concept_id``.
    """

    start: str
    code: str
    mapping: DataFrame | None = None


# fixed values: start and code columns of the event tables
EVENT_TABLES = {
    "procedure_occurrence": EventTable("procedure_datetime", "procedure_source_value"),
    "drug_exposure_administration": EventTable("drug_exposure_start_datetime", "drug_class_source_value"),
    "condition_occurrence": EventTable("condition_start_datetime", "condition_source_value"),
    "measurement": EventTable("measurement_datetime", "measurement_source_value"),
    "drug_exposure": EventTable("start", "drug_class_source_value"),
}
DEFAULT_EVENT_TABLES = ["procedure_occurrence", "drug_exposure_administration", "condition_occurrence"]
I2B2_EVENT_TABLES = ["condition_occurrence", "drug_exposure", "procedure_occurrence"]

def make_event_config(event_table_names: list[str]) -> dict[str, EventTable]:
    return {name: EVENT_TABLES[name] for name in event_table_names}


def build_vocabulary(event: DataFrame, n_min_events: int = 10, code: str = SOURCE_CODE) -> DataFrame:
    """Codes with at least ``n_min_events`` events."""
    return (
        event.groupBy(code)
        .agg(F.count("*").alias("n_events"))
        .filter(F.col("n_events") >= n_min_events)
    )


def restrict_to_vocabulary(event: DataFrame, vocabulary: DataFrame, code: str = SOURCE_CODE) -> DataFrame:
    return event.join(size_checked(vocabulary.select(code)), code, "left_semi")


def keep_persons_with_events(person: DataFrame, event: DataFrame) -> DataFrame:
    return person.join(event.select(PERSON).distinct(), PERSON, "left_semi")


def _one_event_table(database, name: str, table: EventTable) -> DataFrame:
    events = clean_date_cols(database.scan(name)).select(
        PERSON, STAY_ID, F.col(table.start).alias(START), F.col(table.code).alias(SOURCE_CODE)
    )
    if table.mapping is not None:
        mapping = table.mapping.select(SOURCE_CODE, TARGET_CODE)
        events = (
            events.join(size_checked(mapping), SOURCE_CODE)
            .drop(SOURCE_CODE)
            .withColumnRenamed(TARGET_CODE, SOURCE_CODE)
        )
    return events.withColumn(SOURCE_TYPE, F.lit(name))


def observed_events(
    target: DataFrame, database, event_config: dict[str, EventTable], study_start: datetime | None = None
) -> DataFrame:
    """Events of the included persons up to the followup start, all tables in one schema.

    Tables are united before the join, so that one join serves them all.
    """
    events = union_all([_one_event_table(database, name, table) for name, table in event_config.items()])
    if study_start is not None:
        events = events.filter(F.col(START) >= timestamp(study_start))
    return (
        events.join(person_side(target.select(PERSON, FOLLOWUP_START)), PERSON)
        .filter(F.col(START) <= F.col(FOLLOWUP_START))
        .select(*EVENT_COLUMNS)
    )


def create_event_cohort(
    target: DataFrame,
    database,
    event_config: dict[str, EventTable],
    study_start: datetime | None = None,
    n_min_events: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Persons and events before the prediction date, for codes frequent enough."""
    event = observed_events(target, database, event_config, study_start)
    kept = restrict_to_vocabulary(event, build_vocabulary(event, n_min_events)).select(*EVENT_COLUMNS)
    return keep_persons_with_events(target, kept), kept


def add_statics(inclusion_sessions: DataFrame, database) -> DataFrame:
    """Join the person table, without its unused columns, to the inclusion."""
    return database.person.drop(*UNUSED_PERSON_COLUMNS).join(inclusion_sessions, PERSON)


def drop_outcome_visit_events(event: DataFrame, person: DataFrame) -> DataFrame:
    """Remove the events that belong to the visit to predict; an unknown visit removes nothing."""
    joined = event.join(person.select(PERSON, OUTCOME_STAY_ID), PERSON)
    same = F.coalesce(F.col(STAY_ID) == F.col(OUTCOME_STAY_ID), F.lit(False))
    return joined.filter(~same).drop(OUTCOME_STAY_ID)


def sample_non_cases(
    person: DataFrame, event: DataFrame, dataset_split: DataFrame, n_sample: int = 4000, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """All test persons, all train cases and ``n_sample`` train non-cases, with their events."""
    splits = person.join(dataset_split.select(PERSON, "dataset"), PERSON)
    test = F.col("dataset") == "external_test"
    kept = splits.filter(test | (F.col(OUTCOME) == 1)).drop("dataset")
    non_cases = splits.filter(~test & (F.col(OUTCOME) == 0)).drop("dataset")
    sample = kept.unionByName(exact_sample(non_cases, PERSON, n_sample, seed))
    return sample, event.join(person_side(sample.select(PERSON)), PERSON, "left_semi")
