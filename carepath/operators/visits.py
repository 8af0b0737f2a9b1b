"""Visits: filters, recovered ends, sessions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.constants import (
    COMPLETE_HOSPITALIZATION,
    HOSPITALIZATIONS,
    INCOMPLETE_HOSPITALIZATION,
    PERSON,
    SESSION_ID,
    STAY_ID,
    VISIT_END,
    VISIT_START,
    VISIT_TYPE,
)
from carepath.functions.dates import exact_days_between, plus_days, timestamp
from carepath.operators.ordered import CHUNK, HOT_ROWS, earlier_max, previous_value, running_sum, with_chunks


def visits_of_type(visit_occurrence: DataFrame, types: list[str]) -> DataFrame:
    return visit_occurrence.filter(F.col(VISIT_TYPE).isin(types))


def visits_in_period(
    visit_occurrence: DataFrame, study_start: datetime, study_end: datetime
) -> DataFrame:
    """Visits starting in the study period, both ends included."""
    return visit_occurrence.filter(
        F.col(VISIT_START).between(timestamp(study_start), timestamp(study_end))
    )


def get_datetime_from_visit_detail(
    visit_occurrence: DataFrame,
    visit_detail: DataFrame,
    colname_visit_end_datetime: str = VISIT_END,
) -> DataFrame:
    """Recover missing visit ends from the last RSS detail; drop visits without any end.

    Only the visits without an end are shuffled: the others pass as they are.
    """
    end = F.col(colname_visit_end_datetime)
    recovered = (
        visit_detail.filter(F.col("visit_detail_type_source_value") == "RSS")
        .groupBy(STAY_ID)
        .agg(F.max("visit_detail_end_datetime").alias(colname_visit_end_datetime))
        .filter(end.isNotNull())
    )
    completed = (
        visit_occurrence.filter(end.isNull()).drop(colname_visit_end_datetime).join(recovered, STAY_ID)
    )
    return visit_occurrence.filter(end.isNotNull()).unionByName(completed)


def fix_visit_end(visit_occurrence: DataFrame) -> DataFrame:
    """Incomplete hospitalizations end one day after their start."""
    return visit_occurrence.withColumn(
        VISIT_END,
        F.when(
            F.col(VISIT_TYPE) == INCOMPLETE_HOSPITALIZATION, plus_days(VISIT_START, 1)
        ).otherwise(F.col(VISIT_END)),
    )


def _sessionize(
    visit_occurrence: DataFrame,
    max_time_delta_day: float,
    hot_rows: int,
    counted: DataFrame | None = None,
    running_max: bool = False,
) -> DataFrame:
    order = [VISIT_START, STAY_ID]
    visits = with_chunks(
        visits_of_type(visit_occurrence, HOSPITALIZATIONS), [PERSON], VISIT_START, hot_rows, counted
    )
    before = earlier_max if running_max else previous_value
    visits = before(visits, [PERSON], order, VISIT_END, "_previous_end")
    visits = visits.withColumn(
        "delta_previous_visit", exact_days_between("_previous_end", VISIT_START)
    ).withColumn(
        "new_session_mark",
        F.coalesce(F.col("delta_previous_visit") >= F.lit(float(max_time_delta_day)), F.lit(False)),
    )
    visits = visits.withColumn("_mark", F.col("new_session_mark").cast("int"))
    visits = running_sum(visits, [PERSON], order, "_mark", "session")
    return visits.withColumn(
        SESSION_ID, F.concat_ws("_", F.col(PERSON).cast("string"), F.col("session").cast("string"))
    ).drop("_previous_end", "_mark")


def sessionize_visits(
    visit_occurrence: DataFrame, max_time_delta_day: float = 1, hot_rows: int = HOT_ROWS, running_max: bool = False
) -> DataFrame:
    """Number the sessions of a person: a visit starting ``max_time_delta_day`` days or more
    after the end of the previous one opens a session.

    With ``running_max`` it is the latest end of all visits before it that counts, so that a short
    stay inside a longer one does not split a session.
    """
    return _sessionize(visit_occurrence, max_time_delta_day, hot_rows, running_max=running_max).drop(CHUNK)


def merge_visits_into_session(visit_occurrence_w_session_id: DataFrame) -> DataFrame:
    """One row per session: admission from its first visit, discharge from its last one.

    Visits are first reduced per (session, visit type), so that the list put together for a
    session has one entry per visit type and not one per visit.
    """
    visits = visit_occurrence_w_session_id
    if SESSION_ID not in visits.columns:
        raise TypeError(f"Column {SESSION_ID} not found in visit_occurrence. Sessionize visits first.")
    session = [PERSON, SESSION_ID]
    # keeping the chunk of the session windows among the keys makes this step shuffle-free
    chunk = [CHUNK] if CHUNK in visits.columns else []
    order = [F.col(VISIT_START).alias("start"), F.col(STAY_ID).alias("id")]
    by_type = visits.groupBy(*session, *chunk, VISIT_TYPE).agg(
        F.min(F.struct(*order, F.col("admitted_from_source_value").alias("admitted"),
                       F.col("care_site_id").alias("care_site"))).alias("first"),
        F.max(F.struct(*order, F.col("discharge_to_source_value").alias("discharge"),
                       F.col("care_site_id").alias("care_site"))).alias("last"),
        F.min(VISIT_START).alias(VISIT_START),
        F.max(VISIT_END).alias(VISIT_END),
        F.count(STAY_ID).alias("number_of_stays"),
    )
    # at most one entry per visit type and chunk (a calendar day of a hot person)
    types = F.array_sort(
        F.collect_list(F.struct("first.start", "first.id", F.col(VISIT_TYPE).alias("type")))
    )
    sessions = by_type.groupBy(*session).agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        types.alias("types"),
        F.min(VISIT_START).alias(VISIT_START),
        F.max(VISIT_END).alias(VISIT_END),
        F.sum("number_of_stays").alias("number_of_stays"),
    )
    return sessions.select(
        *session,
        F.col("first.admitted").alias("admitted_from_source_value"),
        F.array_join(F.array_distinct("types.type"), " ").alias(VISIT_TYPE),
        F.col("first.care_site").alias("first_care_site_id"),
        F.col("last.care_site").alias("last_care_site_id"),
        F.col("last.discharge").alias("discharge_to_source_value"),
        VISIT_START,
        VISIT_END,
        "number_of_stays",
    ).withColumn(
        "is_complete_hospitalized", F.col(VISIT_TYPE).contains(COMPLETE_HOSPITALIZATION)
    )


def build_sessions(
    visit_occurrence: DataFrame,
    max_time_delta_day: float = 1,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
    running_max: bool = False,
) -> DataFrame:
    """Sessionize and merge, sharing the partitioning of the first step with the second.

    ``counted`` has at least these visits; persons with too many are looked for there.
    """
    return merge_visits_into_session(_sessionize(visit_occurrence, max_time_delta_day, hot_rows, counted, running_max))
