"""Inclusion criteria on sessions, the selected population and its funnel."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carepath.constants import (
    BIRTH,
    CONDITION_START,
    COMPLETE_HOSPITALIZATION,
    DEATH,
    FOLLOWUP_START,
    INCLUSION_CONCEPT,
    INCLUSION_START,
    INCOMPLETE_HOSPITALIZATION,
    PERSON,
    SESSION_ID,
    VISIT_END,
    VISIT_START,
    VISIT_TYPE,
)
from carepath.functions.dates import clean_date_cols, days_between, force_datetime, plus_days, timestamp
from carepath.functions.draws import draw, union_all
from carepath.operators.ordered import HOT_ROWS, next_point
from carepath.session import materialise
from carepath.operators.visits import (
    build_sessions,
    fix_visit_end,
    get_datetime_from_visit_detail,
    visits_in_period,
    visits_of_type,
)

DAYS_PER_YEAR = 365.0


def adult_persons(sessions: DataFrame, person: DataFrame, min_age_at_admission: float = 18) -> DataFrame:
    """Persons old enough at one of their sessions, which is their last one, with their death."""
    last = sessions.groupBy(PERSON).agg(F.max(VISIT_START).alias("_last_start"))
    known = force_datetime(person.select(PERSON, BIRTH, DEATH), [BIRTH, DEATH])
    age = days_between(BIRTH, "_last_start") / F.lit(DAYS_PER_YEAR)
    return last.join(known, PERSON).filter(age >= min_age_at_admission).select(PERSON, DEATH)


def keep_adults(
    sessions: DataFrame, person: DataFrame, min_age_at_admission: float = 18, session_level: bool = False
) -> DataFrame:
    """All sessions of the persons with at least one session as an adult; adds the death.

    With ``session_level`` only the sessions that begin at that age, each judged by itself.
    """
    if session_level:
        known = force_datetime(person.select(PERSON, BIRTH, DEATH), [BIRTH, DEATH])
        age = days_between(BIRTH, VISIT_START) / F.lit(DAYS_PER_YEAR)
        return sessions.join(known, PERSON).filter(age >= min_age_at_admission).drop(BIRTH)
    return sessions.join(adult_persons(sessions, person, min_age_at_admission), PERSON)


def enough_horizon(study_end: datetime, horizon_in_days: float):
    return plus_days(VISIT_END, horizon_in_days) < timestamp(study_end)


def alive_at_discharge():
    return ~F.coalesce(F.col(DEATH) <= F.col(VISIT_END), F.lit(False))


def filter_session_on_billing(
    included_stays: DataFrame, condition_occurrence: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Sessions with at least one diagnosis between their start and end, both included."""
    dated = next_point(
        included_stays, condition_occurrence, PERSON, VISIT_START, CONDITION_START, "_diagnosis", hot_rows
    )
    return dated.filter(F.col("_diagnosis") <= F.col(VISIT_END)).drop("_diagnosis")


def sessions_per_person(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(PERSON).agg(F.count_distinct(SESSION_ID).alias("n_sessions"))


def visits_cutoff(counts: DataFrame, sup_quantile_visits: float = 0.95) -> DataFrame:
    """The quantile of the number of sessions, interpolated, as a table of one value.

    Counts repeat a lot, so the quantile works on a short table of distinct counts.
    """
    return counts.agg(F.percentile("n_sessions", F.lit(float(sup_quantile_visits))).alias("cutoff"))


def trim_outliers(
    sessions: DataFrame, sup_quantile_visits: float = 0.95, n_min_visits: int = 1
) -> DataFrame:
    """Sessions of the persons with neither too many nor too few of them."""
    counts = sessions_per_person(sessions)
    kept = counts.filter(
        (F.col("n_sessions") <= visits_cutoff(counts, sup_quantile_visits).scalar())
        & (F.col("n_sessions") >= n_min_visits)
    )
    return sessions.join(kept.select(PERSON), PERSON, "left_semi")


def pick_index_visit(sessions: DataFrame, index_visit: str = "random", seed: int = 0) -> DataFrame:
    """One session per person: its first, its last, or one drawn from ``seed``."""
    orders = {
        "first": [F.asc(VISIT_START), F.asc(SESSION_ID)],
        "last": [F.desc(VISIT_START), F.desc(SESSION_ID)],
        "random": [draw(SESSION_ID, seed), F.asc(SESSION_ID)],
    }
    if index_visit not in orders:
        raise ValueError(f"index_visit should be one of {sorted(orders)}, not {index_visit}")
    # a rank limit of 1 is applied before the shuffle too, so a hot person sends one row per task
    rank = Window.partitionBy(PERSON).orderBy(*orders[index_visit])
    return (
        sessions.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")
    )


INCLUSION_COLUMNS = [
    PERSON,
    SESSION_ID,
    VISIT_TYPE,
    VISIT_START,
    VISIT_END,
    "discharge_to_source_value",
    "admitted_from_source_value",
    "is_complete_hospitalized",
    "first_care_site_id",
    "last_care_site_id",
    "number_of_stays",
]


def as_inclusion(sessions: DataFrame) -> DataFrame:
    """Name the columns of index sessions as the inclusion event and the start of followup."""
    return sessions.select(*INCLUSION_COLUMNS).withColumnsRenamed(
        {VISIT_TYPE: INCLUSION_CONCEPT, VISIT_START: INCLUSION_START, VISIT_END: FOLLOWUP_START}
    )


@dataclass
class SelectedPopulation:
    """Index sessions, and how far each person went.

    ``funnel`` has one row per person with the number of the last criterion passed, and ``steps``
    names the criteria, number 0 being the initial population. Both come from the graded
    sessions, which are written once.
    """

    inclusion_population: DataFrame
    funnel: DataFrame
    steps: list[str]
    graded_sessions: DataFrame


def study_sessions(
    database,
    study_start: datetime = datetime(2017, 1, 1),
    study_end: datetime = datetime(2022, 6, 1),
    with_incomplete_hospitalization: bool = False,
    max_time_delta_day: float = 1,
    hot_rows: int = HOT_ROWS,
    running_max: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Hospital visits of the study, and the sessions made of those with an end."""
    types = [COMPLETE_HOSPITALIZATION]
    if with_incomplete_hospitalization:
        types.append(INCOMPLETE_HOSPITALIZATION)
    visits = visits_in_period(
        visits_of_type(clean_date_cols(database.visit_occurrence), types), study_start, study_end
    )
    ended = get_datetime_from_visit_detail(visits, clean_date_cols(database.visit_detail))
    return visits, build_sessions(fix_visit_end(ended), max_time_delta_day, hot_rows, visits, running_max)


def select_population(
    database,
    study_start: datetime = datetime(2017, 1, 1),
    study_end: datetime = datetime(2022, 6, 1),
    min_age_at_admission: float = 18,
    sup_quantile_visits: float = 0.95,
    n_min_visits: int = 1,
    visits_w_billing_codes_only: bool = False,
    horizon_in_days: int = 90,
    with_incomplete_hospitalization: bool = False,
    index_visit: str = "random",
    max_time_delta_day: float = 1,
    seed: int = 0,
    hot_rows: int = HOT_ROWS,
    running_max: bool = False,
    session_level: bool = False,
) -> SelectedPopulation:
    """Apply the inclusion criteria and keep one index session per person.

    ``running_max`` measures gaps from the latest end so far (see ``sessionize_visits``), ``session_level`` leaves out
    each session below the least age instead of the persons without any session above it.
    """
    person = clean_date_cols(database.person)
    visits, sessions = study_sessions(
        database, study_start, study_end, with_incomplete_hospitalization, max_time_delta_day, hot_rows, running_max
    )
    conditions = clean_date_cols(database.condition_occurrence) if visits_w_billing_codes_only else None
    graded = grade_sessions(sessions, person, conditions, study_end, horizon_in_days, hot_rows, visits)
    if session_level:
        old_enough = F.coalesce(F.col("age") >= min_age_at_admission, F.lit(False))
        graded = graded.withColumn("passed", F.when(old_enough, F.col("passed")).otherwise(2))
    graded = materialise(graded, "sessions")
    last = 6 if visits_w_billing_codes_only else 5
    # one row per person: old enough, how far its sessions go, how many go to the end
    persons = graded.groupBy(PERSON).agg(
        (F.max("age") >= min_age_at_admission).alias("adult"),
        F.max("passed").alias("passed"),
        F.count_if(F.col("passed") == last).alias("n_sessions"),
    )
    counted = persons.filter(F.col("adult") & (F.col("n_sessions") > 0))
    cutoff = visits_cutoff(counted, sup_quantile_visits).scalar()
    usual = counted.filter((F.col("n_sessions") <= cutoff) & (F.col("n_sessions") >= n_min_visits))
    kept = graded.filter(F.col("passed") == last).join(usual.select(PERSON), PERSON, "left_semi")
    population = materialise(as_inclusion(pick_index_visit(kept, index_visit, seed)), "population")

    excluded_types = "No Hospitalization" + (
        " + incomplete hospitalization" if with_incomplete_hospitalization else ""
    )
    steps = [
        "initial",
        f"{excluded_types} during {study_start.date()} / {study_end.date()}",
        "Without a visit_end_datetime",
        f"Aged below {min_age_at_admission}",
        f"Insufficient horizon ({horizon_in_days} days) after discharge",
        "Deceased before the end of their inclusion stay",
    ]
    if visits_w_billing_codes_only:
        steps.append("Stays without associated billing codes")
    steps += [f"More than the {sup_quantile_visits} quantile of stays", f"Less than {n_min_visits} stays"]
    reached = (
        F.when(~F.coalesce("adult", F.lit(False)), 2)
        .when(F.col("n_sessions") == 0, F.col("passed"))
        .when(F.col("n_sessions") > cutoff, last)
        .when(F.col("n_sessions") < n_min_visits, last + 1)
        .otherwise(last + 2)
    )
    marks = [
        person.select(PERSON, F.lit(0).alias("last_step")),
        visits.select(PERSON, F.lit(1).alias("last_step")),
        persons.select(PERSON, reached.alias("last_step")),
    ]
    funnel = union_all(marks).groupBy(PERSON).agg(F.max("last_step").alias("last_step"))
    return SelectedPopulation(population, funnel, steps, graded)


def grade_sessions(
    sessions: DataFrame,
    person: DataFrame,
    condition_occurrence: DataFrame | None,
    study_end: datetime,
    horizon_in_days: float,
    hot_rows: int = HOT_ROWS,
    visits: DataFrame | None = None,
) -> DataFrame:
    """Add the age at each session and the number of the last criterion it passes.

    The criteria on sessions do not depend on each other, so they are columns of one pass: 3 is a
    session of a known person, 4 has its horizon, 5 ends alive, 6 has a diagnosis.
    """
    known = force_datetime(person.select(PERSON, BIRTH, DEATH), [BIRTH, DEATH])
    rows = sessions.join(known, PERSON, "left").withColumn(
        "age", days_between(BIRTH, VISIT_START) / F.lit(DAYS_PER_YEAR)
    )
    passed = F.when(~enough_horizon(study_end, horizon_in_days), 3).when(~alive_at_discharge(), 4)
    if condition_occurrence is None:
        return rows.withColumn("passed", passed.otherwise(5))
    # a person has at most as many sessions as visits
    counted = union_all([(sessions if visits is None else visits).select(PERSON), condition_occurrence.select(PERSON)])
    dated = next_point(
        rows, condition_occurrence, PERSON, VISIT_START, CONDITION_START, "_diagnosis", hot_rows, counted
    )
    coded = F.coalesce(F.col("_diagnosis") <= F.col(VISIT_END), F.lit(False))
    return dated.withColumn("passed", passed.when(~coded, 5).otherwise(6)).drop("_diagnosis")


def funnel_from_ids(inclusion_ids: dict[str, DataFrame]) -> tuple[DataFrame, list[str]]:
    """Funnel of any sequence of criteria, each given by the persons who pass it.

    A person stops at the first criterion they do not pass, whatever they pass later.
    """
    steps = list(inclusion_ids)
    marks = union_all(
        [ids.select(PERSON, F.lit(step).alias("_step")) for step, ids in enumerate(inclusion_ids.values())]
    )
    # at most one entry per criterion; in sorted order, entry i is i as long as no step is missing
    passed = marks.groupBy(PERSON).agg(F.array_sort(F.collect_set("_step")).alias("_steps"))
    in_a_row = F.size(F.filter("_steps", lambda step, place: step == place))
    return passed.select(PERSON, (in_a_row - 1).alias("last_step")).filter("last_step >= 0"), steps


def add_criterion(funnel: DataFrame, passing: DataFrame, step: int) -> DataFrame:
    """Extend the funnel: persons at the step before who are in ``passing`` reach ``step``."""
    passed = passing.select(PERSON).distinct().withColumn("_passed", F.lit(True))
    return (
        funnel.join(passed, PERSON, "left")
        .withColumn(
            "last_step",
            F.when((F.col("last_step") == step - 1) & F.col("_passed"), step).otherwise(F.col("last_step")),
        )
        .drop("_passed")
    )


def funnel_counts(funnel: DataFrame, steps: list[str]) -> DataFrame:
    """Persons kept and excluded at each criterion, from one count by last step."""
    spark = funnel.sparkSession
    names = spark.createDataFrame(list(enumerate(steps)), "step int, criterion string")
    reached = funnel.groupBy(F.col("last_step").alias("step")).agg(F.count("*").alias("_stopped"))
    # one row per criterion from here on
    deeper = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("step")
    return (
        names.join(reached, "step", "left")
        .withColumn("n_kept", F.sum(F.coalesce("_stopped", F.lit(0))).over(deeper))
        .withColumn(
            "n_excluded", F.coalesce(F.lag("n_kept").over(before) - F.col("n_kept"), F.lit(0))
        )
        .select("step", "criterion", "n_kept", "n_excluded")
    )


def add_final_split(funnel: DataFrame, left: DataFrame, step: int) -> DataFrame:
    """Persons reaching ``step``, counted on both sides of a split by the persons of ``left``."""
    sides = left.select(PERSON).distinct().withColumn("_left", F.lit(True))
    side = F.when(F.col("_left"), "left").otherwise("right")
    return (
        funnel.filter(F.col("last_step") >= step)
        .join(sides, PERSON, "left")
        .groupBy(side.alias("side"))
        .agg(F.count("*").alias("n_persons"))
    )


def funnel_characteristics(funnel: DataFrame, characteristics: DataFrame) -> DataFrame:
    """Mean of binary characteristics of the persons excluded at each criterion."""
    names = [name for name in characteristics.columns if name != PERSON]
    deepest = funnel.agg(F.max("last_step"))
    return (
        funnel.filter(F.col("last_step") < deepest.scalar())
        .join(characteristics, PERSON)
        .groupBy((F.col("last_step") + 1).alias("step"))
        .agg(F.count("*").alias("n_excluded"), *[F.avg(F.col(n).cast("double")).alias(n) for n in names])
    )
