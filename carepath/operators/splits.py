"""Train and test splits, subsamples and folds."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.constants import (
    INCLUSION_START,
    OUTCOME,
    PERSON,
    STAY_ID,
    UNKNOWN_HOSPITAL,
    VISIT_START,
)
from carepath.functions.dates import MICROSECONDS_PER_DAY, clean_date_cols, days_between, timestamp
from carepath.functions.draws import exact_sample
from carepath.functions.sizes import person_side, small_side

TRAIN, TEST = "train", "external_test"


def split_train_test_w_hospital_ids(
    database,
    inclusion_sessions: DataFrame,
    study_start: datetime,
    study_end: datetime,
    hospital_names_ext_test_set: list[str],
    care_site_hierarchy: DataFrame,
) -> DataFrame:
    """Split persons by hospital; persons seen on both sides are in neither.

    Gives each person the hospital they visited most (the first in alphabetical order on ties).
    """
    hospitals = small_side(care_site_hierarchy.select("care_site_id", "hospital_name"))
    counts = (
        clean_date_cols(database.visit_occurrence)
        .filter(F.col(VISIT_START).between(timestamp(study_start), timestamp(study_end)))
        .select(PERSON, STAY_ID, "care_site_id")
        .join(person_side(inclusion_sessions.select(PERSON)), PERSON, "left_semi")
        .join(hospitals, "care_site_id")
        .groupBy(PERSON, "hospital_name")
        .agg(F.count("*").alias("n_visits"))
    )
    in_test = F.col("hospital_name").isin(hospital_names_ext_test_set)
    # n_visits descending, then name ascending, as the order of one struct
    favourite = F.min(F.struct((-F.col("n_visits")).alias("rank"), "hospital_name"))
    return (
        counts.groupBy(PERSON)
        .agg(F.bool_or(in_test).alias("_any"), F.bool_and(in_test).alias("_all"), favourite.alias("_most"))
        .filter(F.col("_any") == F.col("_all"))
        .select(
            PERSON,
            F.col("_most.hospital_name").alias("hospital_split"),
            F.when(F.col("_all"), TEST).otherwise(TRAIN).alias("dataset"),
        )
    )


def split_train_test_w_inclusion_start(inclusion_sessions: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Train before a date, test after it; the date leaves ``test_size`` of the period to test."""
    period = inclusion_sessions.agg(F.min(INCLUSION_START).alias("first"), F.max(INCLUSION_START).alias("last"))
    days = days_between("first", "last") * F.lit(1 - test_size)
    cut = period.select(
        F.timestamp_add("MICROSECOND", F.round(days * MICROSECONDS_PER_DAY).cast("long"), F.col("first"))
    )
    return inclusion_sessions.select(
        PERSON,
        F.coalesce(F.col("first_care_site_id").cast("string"), F.lit(UNKNOWN_HOSPITAL)).alias("hospital_split"),
        F.when(F.col(INCLUSION_START) <= cut.scalar(), TRAIN).otherwise(TEST).alias("dataset"),
    )


def compute_person_subsample(
    person: DataFrame, train_size: float, positive_ratio: float | None = None, random_seed: int = 0
) -> DataFrame:
    """A share ``train_size`` of the persons with a given ratio of cases (theirs by default)."""
    counts = {row[OUTCOME]: row["n"] for row in person.groupBy(OUTCOME).agg(F.count("*").alias("n")).limit(3).collect()}
    if len(counts) != 2:
        raise ValueError("Outcome should be binary.")
    total, cases = sum(counts.values()), counts.get(1, 0)
    ratio = cases / total if positive_ratio is None else positive_ratio
    other = next(value for value in counts if value != 1)
    sizes = {1: min(int(train_size * ratio * total), cases), other: int(train_size * (1 - ratio) * total)}
    return exact_sample(person, PERSON, sizes, random_seed, by=OUTCOME)


def sample_n(df: DataFrame, n: int, seed: int = 0, identifier: str = PERSON) -> DataFrame:
    """``n`` rows drawn without replacement."""
    return exact_sample(df, identifier, n, seed)


def person_split(
    person: DataFrame, train_size: float | None = None, test_size: float | None = None, random_seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Exact split of the persons. The test size is rounded up, the train size down, and what
    is not given is the rest. A train size of 1 leaves an empty test."""
    if train_size is None and test_size is None:
        test_size = 0.25
    if train_size == 1:
        return person, person.filter(F.lit(False))
    total = person.count()
    n_test = None if test_size is None else math.ceil(total * test_size)
    n_train = total - n_test if train_size is None else math.floor(total * train_size)
    train = exact_sample(person, PERSON, n_train, random_seed)
    test = person.join(train.select(PERSON), PERSON, "left_anti")
    if n_test is not None and n_test < total - n_train:
        test = exact_sample(test, PERSON, n_test, random_seed)
    return train, test


def event_train_test_split(
    event_cohort, train_size: float | None = None, test_size: float | None = None, random_seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Train events, test events, train persons, test persons."""
    train, test = person_split(event_cohort.person, train_size, test_size, random_seed)
    return (
        event_cohort.event.join(person_side(train.select(PERSON)), PERSON, "left_semi"),
        event_cohort.event.join(person_side(test.select(PERSON)), PERSON, "left_semi"),
        train,
        test,
    )


MAX_GROUPS = 100_000


def group_folds(
    df: DataFrame, group: str = "first_care_site_id", n_splits: int = 5, name: str = "fold", most: int = MAX_GROUPS
) -> DataFrame:
    """Fold of each row such that a group is in one fold and folds have close sizes.

    Groups, from the largest to the smallest, go to the fold with the fewest rows so far. The table of group sizes comes
    to the driver; more than ``most`` groups are an error, since folds by group are meant for sites, not for persons.
    """
    filled = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit(UNKNOWN_HOSPITAL)))
    sizes = filled.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} groups in {group}")
    loads, rows = [0] * n_splits, []
    for row in sizes:
        lightest = loads.index(min(loads))
        loads[lightest] += row["n"]
        rows.append((row[group], lightest))
    folds = df.sparkSession.createDataFrame(rows, f"{group} string, {name} int")
    return filled.join(F.broadcast(folds), group)  # at most ``most`` rows


def fold_classes(folds: DataFrame, name: str = "fold") -> DataFrame:
    """Cases and others of each fold; a fold with one class cannot be scored and shows here."""
    return folds.groupBy(name).agg(
        F.count("*").alias("n_persons"),
        F.count_if(F.col(OUTCOME) == 1).alias("n_cases"),
        (F.count_distinct(OUTCOME) < 2).alias("one_class"),
    )


def class_weights(person: DataFrame, balanced: bool = False) -> DataFrame:
    """Weight of each row: the prevalence for cases and its complement for the others, or
    weights giving both classes the same mass."""
    rate = person.agg(F.avg(F.col(OUTCOME).cast("double"))).scalar()
    case = F.col(OUTCOME) == 1
    if balanced:
        weight = F.when(case, 0.5 / rate).otherwise(0.5 / (1 - rate))
    else:
        weight = F.when(case, rate).otherwise(1 - rate)
    return person.withColumn("weight", weight)
