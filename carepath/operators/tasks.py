"""Targets: one row per included person."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carepath.constants import (
    CODE_CLASS,
    CONDITION_CODE,
    CONDITION_COARSE,
    CONDITION_START,
    DEATH,
    FOLLOWUP_START,
    HOSPITALIZATIONS,
    INCLUSION_START,
    LOS,
    LOS_CATEGORY,
    MACE_CODES,
    OUTCOME,
    OUTCOME_STAY_ID,
    PERSON,
    SOURCE_CODE,
    SOURCE_TYPE,
    START,
    STAY_ID,
    TASK_LOS,
    TASK_LOS_CATEGORICAL,
    TASK_MACE,
    TASK_MORTALITY,
    TASK_PROGNOSIS,
    TASK_REHOSPITALIZATION,
    VISIT_START,
    VISIT_TYPE,
)
from carepath.functions.codes import coarsen_cim10_to_chapter, get_cim10_codes, icd_prefix, matches_any
from carepath.functions.dates import (
    clean_date_cols,
    days_between,
    exact_days_between,
    force_datetime,
    plus_days,
    timestamp,
)
from carepath.functions.draws import draw, draw_integer
from carepath.functions.sizes import person_side
from carepath.session import materialise

BLANK_PERIOD_IN_DAYS = 0.5


def los_labels(los_categories: list[float]) -> list[str]:
    """Labels of right-closed bins, the first one closed on both sides."""
    bounds = list(zip(los_categories, los_categories[1:]))
    return [
        f"{'[' if rank == 0 else '('}{low:.1f}, {high:.1f}]" for rank, (low, high) in enumerate(bounds)
    ]


def get_los(
    inclusion_criteria: DataFrame, los_categories: list[float] | None = (0, 7, 14, math.inf)
) -> DataFrame:
    """Length of stay in whole days, and its bin."""
    stays = inclusion_criteria.withColumn(LOS, days_between(INCLUSION_START, FOLLOWUP_START))
    if los_categories is None:
        return stays
    categories = list(los_categories)
    label = F.when(F.col(LOS) < categories[0], F.lit("nan"))
    for upper, name in zip(categories[1:], los_labels(categories)):
        label = label.when(F.col(LOS) <= F.lit(float(upper)), F.lit(name))
    return stays.withColumn(LOS_CATEGORY, label.otherwise(F.lit("nan")))


def encode_labels(df: DataFrame, label: str, name: str = OUTCOME) -> DataFrame:
    """Rank of each label in alphabetical order, from 0.

    The few distinct labels are gathered in one sorted array (map-side sets first).
    """
    labels = df.agg(F.array_sort(F.collect_set(label)).alias("labels"))
    return df.withColumn(name, (F.array_position(labels.scalar(), F.col(label)) - 1).cast("int"))


def get_rehospitalizations(
    database, inclusion_criteria: DataFrame, horizon_in_days: int
) -> DataFrame:
    """First hospitalization starting half a day or more after the followup start, if it starts
    within the horizon."""
    visits = clean_date_cols(database.visit_occurrence).filter(F.col(VISIT_TYPE).isin(HOSPITALIZATIONS))
    following = (
        visits.select(PERSON, STAY_ID, VISIT_START)
        .join(person_side(inclusion_criteria.select(PERSON, FOLLOWUP_START)), PERSON)
        .filter(F.col(VISIT_START) >= plus_days(FOLLOWUP_START, BLANK_PERIOD_IN_DAYS))
        .groupBy(PERSON, FOLLOWUP_START)
        .agg(F.min(F.struct(VISIT_START, STAY_ID)).alias("_next"))
        .filter(F.col(f"_next.{VISIT_START}") <= plus_days(FOLLOWUP_START, horizon_in_days))
        .select(
            PERSON,
            F.col(f"_next.{STAY_ID}").alias("rehospitalization_id"),
            F.col(f"_next.{VISIT_START}").alias("rehospitalization_datetime"),
        )
    )
    missing = F.lit(0).cast(dict(following.dtypes)["rehospitalization_id"])
    return inclusion_criteria.join(following, PERSON, "left").withColumn(
        "rehospitalization_id", F.coalesce("rehospitalization_id", missing)
    )


def get_mortality(database, inclusion_criteria: DataFrame, horizon_in_days: int) -> DataFrame:
    """Date of the death if it occurs within the horizon."""
    deaths = force_datetime(clean_date_cols(database.person).select(PERSON, DEATH), DEATH)
    within = F.col("_death") <= plus_days(FOLLOWUP_START, horizon_in_days)
    return (
        inclusion_criteria.drop(DEATH)
        .join(deaths.withColumnRenamed(DEATH, "_death"), PERSON, "left")
        .withColumn("death_datetime@horizon", F.when(within, F.col("_death")))
        .drop("_death")
    )


def draw_target_visit(coded_visits: DataFrame, seed: int = 0) -> DataFrame:
    """One coded visit per person, drawn among those after the first one.

    ``coded_visits`` has one row per (person, visit) with its start. The draw is the lowest md5
    of the visit, so no person is sorted as a whole: everything is a minimum or a count.
    """
    place = F.struct(VISIT_START, STAY_ID)
    first = (
        coded_visits.groupBy(PERSON)
        .agg(F.min(place).alias("_first"), F.count("*").alias("nb_coded_visits"))
        .filter("nb_coded_visits > 1")
    )
    # the first visit can be one of the two lowest draws, so two per person are enough
    by_draw = Window.partitionBy(PERSON).orderBy("_draw", STAY_ID)
    lowest = (
        coded_visits.withColumn("_draw", draw(STAY_ID, seed))
        .withColumn("_rank", F.row_number().over(by_draw))
        .filter("_rank <= 2")
    )
    drawn = (
        lowest.join(first, PERSON)
        .filter(place > F.col("_first"))
        .groupBy(PERSON, "nb_coded_visits")
        .agg(F.min_by(place, "_rank").alias("_target"))
        .select(PERSON, "nb_coded_visits", f"_target.{VISIT_START}", f"_target.{STAY_ID}")
    )
    drawn_place = F.struct(F.col("_start").alias(VISIT_START), F.col("_stay").alias(STAY_ID))
    ranks = (
        coded_visits.join(
            drawn.select(PERSON, F.col(VISIT_START).alias("_start"), F.col(STAY_ID).alias("_stay")), PERSON
        )
        .filter(place <= drawn_place)
        .groupBy(PERSON)
        .agg(F.count("*").alias("target_visit_ix"))
    )
    return drawn.join(ranks, PERSON)


def get_prognosis(
    database,
    inclusion_criteria: DataFrame,
    study_end: datetime,
    cim10_nb_digits: int = 1,
    min_prevalence: float = 0.01,
    random_state: int = 0,
    icd10_tree: DataFrame | None = None,
) -> DataFrame:
    """Diagnoses of a later visit, at the level of chapters (1 digit) or of code prefixes.

    The followup starts one second before the target visit. Labels below ``min_prevalence`` among
    target visits are dropped, and so are the visits left without a label.
    """
    if cim10_nb_digits == 1 and icd10_tree is None:
        raise ValueError("chapters need the icd10_tree table")
    diagnoses = (
        clean_date_cols(database.condition_occurrence)
        .select(PERSON, STAY_ID, CONDITION_START, CONDITION_CODE)
        .join(person_side(inclusion_criteria.select(PERSON, INCLUSION_START)), PERSON)
        .filter(
            (F.col(CONDITION_START) >= F.col(INCLUSION_START))
            & (F.col(CONDITION_START) <= timestamp(study_end))
        )
        .select(PERSON, STAY_ID, CONDITION_CODE)
        .distinct()
    )
    diagnoses = materialise(diagnoses, "diagnoses")
    coded_visits = materialise(
        diagnoses.select(PERSON, STAY_ID)
        .distinct()
        .join(clean_date_cols(database.visit_occurrence).select(STAY_ID, VISIT_START), STAY_ID),
        "coded_visits",
    )
    drawn = draw_target_visit(coded_visits, random_state).select(
        F.col(STAY_ID).alias(OUTCOME_STAY_ID),
        PERSON,
        F.col(VISIT_START).alias(FOLLOWUP_START),
        "nb_coded_visits",
        "target_visit_ix",
    )
    targets = materialise(drawn, "target_visits")
    target_codes = targets.select(OUTCOME_STAY_ID).join(
        diagnoses.select(F.col(STAY_ID).alias(OUTCOME_STAY_ID), CONDITION_CODE), OUTCOME_STAY_ID
    )
    if cim10_nb_digits == 1:
        coarse = coarsen_cim10_to_chapter(target_codes, icd10_tree).filter(
            F.col(CONDITION_COARSE).isNotNull()
        )
    else:
        coarse = target_codes.withColumn(CONDITION_COARSE, icd_prefix(CONDITION_CODE, cim10_nb_digits))
    labels = coarse.select(OUTCOME_STAY_ID, F.col(CONDITION_COARSE).alias("_label")).distinct()
    n_targets = targets.count()
    # labels are chapters or short prefixes: a table of the size of the classification
    frequent = (
        labels.groupBy("_label")
        .agg(F.count("*").alias("_visits"))
        .filter(F.col("_visits") / F.lit(n_targets) >= F.lit(float(min_prevalence)))
        .select("_label")
    )
    outcome = (
        labels.join(frequent, "_label", "left_semi")
        .groupBy(OUTCOME_STAY_ID)
        .agg(F.array_sort(F.collect_set("_label")).alias(OUTCOME))
    )
    statics = inclusion_criteria.drop(FOLLOWUP_START)
    return (
        targets.join(outcome, OUTCOME_STAY_ID)
        .join(statics, PERSON)
        .withColumn(FOLLOWUP_START, F.col(FOLLOWUP_START) - F.expr("interval 1 second"))
    )


def get_mace(
    database,
    inclusion_criteria: DataFrame,
    horizon_in_days: int = 360,
    codes: dict[str, list[str]] = MACE_CODES,
) -> DataFrame:
    """First major cardiac event after the followup start and within the horizon.

    Persons with such an event at or before the followup start are left out. One aggregation per
    person gives both the preceding event and the first following one.
    """
    every_code = [code for class_codes in codes.values() for code in class_codes]
    events = (
        database.condition_occurrence.select(PERSON, STAY_ID, CONDITION_START, CONDITION_CODE)
        .filter(matches_any(every_code))
        .join(person_side(inclusion_criteria.select(PERSON, FOLLOWUP_START)), PERSON)
        .filter(exact_days_between(FOLLOWUP_START, CONDITION_START) <= F.lit(float(horizon_in_days)))
    )
    later = F.col(CONDITION_START) > F.col(FOLLOWUP_START)
    first = F.struct(
        F.col(CONDITION_START).alias("datetime"), F.col(STAY_ID).alias("stay"), F.col(CODE_CLASS).alias("class")
    )
    by_person = (
        get_cim10_codes(events, codes)
        .groupBy(PERSON)
        .agg(F.bool_or(~later).alias("_preceding"), F.min(F.when(later, first)).alias("_first"))
    )
    visits = database.visit_occurrence.select(F.col(STAY_ID).alias("_stay"), VISIT_START)
    # a target whose visit is unknown does not count as one
    targets = (
        by_person.filter("not _preceding")
        .select(
            PERSON,
            F.lit(1).alias(OUTCOME),
            F.col("_first.datetime").alias("target_condition_datetime"),
            F.col("_first.stay").alias("_stay"),
            F.col("_first.class").alias(CODE_CLASS),
        )
        .join(visits, "_stay")
        .withColumnRenamed("_stay", STAY_ID)
    )
    preceded = by_person.filter("_preceding").select(PERSON)
    return (
        inclusion_criteria.join(preceded, PERSON, "left_anti")
        .join(targets, PERSON, "left")
        .withColumn(OUTCOME, F.coalesce(OUTCOME, F.lit(0)))
    )


def create_outcome(
    database,
    inclusion_criteria: DataFrame,
    horizon_in_days: int = 90,
    task_name: str = TASK_LOS,
    los_categories: list[float] = (0, 7, 14, math.inf),
    study_end: datetime = datetime(2023, 12, 31),
    cim10_nb_digits: int = 2,
    min_prevalence: float = 0.01,
    random_state: int = 0,
    icd10_tree: DataFrame | None = None,
) -> DataFrame:
    """The target of a task, in column ``y``.

    Categories of length of stay are numbered in the alphabetical order of their labels: with two
    categories, ``(7.0, inf]`` is 0 and ``[0.0, 7.0]`` is 1.
    """
    if task_name == TASK_LOS:
        stays = get_los(inclusion_criteria, los_categories)
        return stays.withColumn(OUTCOME, F.col(LOS))
    if task_name == TASK_LOS_CATEGORICAL:
        return encode_labels(get_los(inclusion_criteria, los_categories), LOS_CATEGORY)
    if task_name == TASK_MORTALITY:
        deaths = get_mortality(database, inclusion_criteria, horizon_in_days)
        return deaths.withColumn(OUTCOME, F.col("death_datetime@horizon").isNotNull().cast("int"))
    if task_name == TASK_REHOSPITALIZATION:
        stays = get_rehospitalizations(database, inclusion_criteria, horizon_in_days)
        return stays.withColumn(OUTCOME, F.col("rehospitalization_datetime").isNotNull().cast("int"))
    if task_name == TASK_PROGNOSIS:
        return get_prognosis(
            database, inclusion_criteria, study_end, cim10_nb_digits, min_prevalence, random_state, icd10_tree
        )
    if task_name == TASK_MACE:
        return get_mace(database, inclusion_criteria, horizon_in_days)
    raise ValueError(f"unknown task {task_name}")


def target_chapter(target: DataFrame, chapter: str) -> DataFrame:
    """Turn a list of labels into the presence of one of them."""
    return target.withColumn(OUTCOME, F.array_contains(OUTCOME, chapter).cast("int"))


class NaivePrognosisBaseline:
    """Predicts the chapters of the diagnoses a person already had.

    By default all past diagnoses count, with ``last_visit`` only those of the last coded visit.
    Persons without any get one chapter drawn between 1 and 21.
    """

    def __init__(self, event: DataFrame, icd10_tree: DataFrame, last_visit: bool = False, seed: int = 0):
        self.event = event
        self.icd10_tree = icd10_tree
        self.last_visit = last_visit
        self.seed = seed

    def predict(self, persons: DataFrame) -> DataFrame:
        past = self.event.filter(
            (F.col(SOURCE_TYPE) == "condition_occurrence") & (F.col(START) <= F.col(FOLLOWUP_START))
        )
        if self.last_visit:
            last = past.groupBy(PERSON).agg(
                F.max_by(STAY_ID, F.struct(START, STAY_ID)).alias(STAY_ID)
            )
            past = past.join(last, [PERSON, STAY_ID], "left_semi")
        codes = past.select(PERSON, F.col(SOURCE_CODE).alias(CONDITION_CODE)).distinct()
        # distinct chapters first: what is gathered per person has at most 22 entries
        chapters = (
            coarsen_cim10_to_chapter(codes, self.icd10_tree)
            .filter(F.col(CONDITION_COARSE).isNotNull())
            .groupBy(PERSON)
            .agg(F.array_sort(F.collect_set(F.col(CONDITION_COARSE).cast("string"))).alias("y_pred"))
        )
        drawn = F.array((draw_integer(PERSON, self.seed) % 21 + 1).cast("string"))
        return (
            persons.select(PERSON)
            .join(chapters, PERSON, "left")
            .withColumn("y_pred", F.coalesce("y_pred", drawn))
        )

    def predict_proba(self, persons: DataFrame, classes: list[str]) -> DataFrame:
        """Scores of 0 or 1 for each class, one row per (person, class)."""
        return label_scores(self.predict(persons), "y_pred", classes, "score")


def label_scores(df: DataFrame, labels: str, classes: list[str], name: str) -> DataFrame:
    """Presence of each class in a list column, one row per (person, class)."""
    return df.select(
        PERSON, labels, F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    ).select(PERSON, "class", F.array_contains(labels, F.col("class")).cast("int").alias(name))


def conditions_at_followup(event: DataFrame) -> DataFrame:
    """Number of diagnoses dated exactly at the followup start; a clean cohort has none."""
    at_followup = (F.col(SOURCE_TYPE) == "condition_occurrence") & (F.col(START) == F.col(FOLLOWUP_START))
    return event.agg(F.count_if(at_followup).alias("n_conditions_at_followup"))
