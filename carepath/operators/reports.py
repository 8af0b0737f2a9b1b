"""Descriptions of a cohort and checks of its data."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.constants import (
    FOLLOWUP_START,
    INCLUSION_START,
    OUTCOME,
    OUTCOME_STAY_ID,
    PERSON,
    SOURCE_CODE,
    SOURCE_TYPE,
    START,
    STAY_ID,
    VISIT_TYPE,
)
from carepath.functions.dates import add_age, exact_days_between
from carepath.functions.sizes import small_side
from carepath.operators.events import build_vocabulary
from carepath.operators.metrics import get_prognosis_prevalence
from carepath.session import materialise


def quantiles(column, probabilities: list[float]):
    return F.percentile(column, F.array(*[F.lit(float(p)) for p in probabilities]))


def describe_cohort(person: DataFrame, event: DataFrame, target_type: str = "binary") -> DataFrame:
    """Size, median age, share of women, prevalences, number of events by type: (key, value).

    Every value is an aggregate of one pass over the persons and one over the events.
    """
    aged = add_age(person, INCLUSION_START)
    general = aged.agg(
        F.count("*").cast("double").alias("N"),
        (F.percentile("age_in_days", F.lit(0.5)) / F.lit(365.0)).alias("Median age"),
        F.avg(100 * (F.col("gender_source_value") == "f").cast("double")).alias("Female"),
    ).unpivot([], ["N", "Median age", "Female"], "key", "value")
    if target_type == "binary":
        prevalence = person.groupBy(OUTCOME).agg(F.count("*").alias("_n")).select(
            F.concat(F.lit("prevalence "), F.col(OUTCOME).cast("string")).alias("key"),
            (100 * F.col("_n") / person.agg(F.count("*")).scalar()).alias("value"),
        )
    else:
        prevalence = get_prognosis_prevalence(person).select(
            F.concat(F.lit("prevalence "), "class").alias("key"), F.col("prevalence").alias("value")
        )
    by_type = event.groupBy(SOURCE_TYPE).agg(F.count("*").alias("_n"))
    types = by_type.select(
        F.concat(F.lit("n_events "), F.col(SOURCE_TYPE)).alias("key"), F.col("_n").cast("double").alias("value")
    )
    total = by_type.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("double").alias("value")).select(
        F.lit("n_events").alias("key"), "value"
    )
    return general.unionByName(prevalence).unionByName(total).unionByName(types)


def cohort_counts(person: DataFrame, event: DataFrame) -> DataFrame:
    return person.agg(F.count("*").alias("n_persons")).select(
        "n_persons", event.agg(F.count("*")).scalar().alias("n_events")
    )


def hospitals_per_patient(visits: DataFrame, hospital: str = "hospital_name") -> DataFrame:
    """How many patients were seen in 1, 2, 3… hospitals."""
    return (
        visits.groupBy(PERSON)
        .agg(F.count_distinct(hospital).alias("nb_unique_hospitals"))
        .groupBy("nb_unique_hospitals")
        .agg(F.count("*").alias("n_patients"))
    )


def visits_with_hospital(visits: DataFrame, care_site: DataFrame) -> DataFrame:
    """Visits of known care sites with the name of their hospital."""
    return visits.join(small_side(care_site.select("care_site_id", "hospital_name")), "care_site_id")


def missing_ratio(df: DataFrame, column: str) -> DataFrame:
    missing = F.col(column).isNull()
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(missing).alias("n_missing"),
        F.avg(missing.cast("double")).alias("missing_ratio"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of the non-null rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def details_per_visit(visits: DataFrame, visit_detail: DataFrame, detail_id: str) -> DataFrame:
    """Distribution of the number of details of a visit, by type of visit."""
    probabilities = [0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
    counts = (
        visits.select(STAY_ID, VISIT_TYPE)
        .join(visit_detail.select(STAY_ID, detail_id), STAY_ID)
        .groupBy(STAY_ID, VISIT_TYPE)
        .agg(F.count_distinct(detail_id).alias("_n"))
    )
    summary = counts.groupBy(VISIT_TYPE).agg(
        F.count("*").alias("count"),
        F.avg("_n").alias("mean"),
        F.stddev_samp("_n").alias("std"),
        F.min("_n").alias("min"),
        F.max("_n").alias("max"),
        quantiles("_n", probabilities).alias("_q"),
    )
    names = [F.col("_q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(probabilities)]
    return summary.select(VISIT_TYPE, "count", "mean", "std", "min", *names, "max")


def detail_consistency(visit_detail: DataFrame, kinds: tuple[str, str] = ("MOUV", "PASS")) -> DataFrame:
    """Visits with a detail of each kind whose starts, or whose ends, differ."""
    left, right = kinds
    first = F.min(F.struct("visit_detail_start_datetime", "visit_detail_end_datetime"))
    pairs = (
        visit_detail.groupBy(STAY_ID).pivot("visit_detail_type_source_value", [left, right]).agg(first)
    ).filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    start, end = "visit_detail_start_datetime", "visit_detail_end_datetime"
    return pairs.agg(
        F.count("*").alias("n_visits"),
        F.count_if(~F.col(left)[start].eqNullSafe(F.col(right)[start])).alias("n_inconsistent_start"),
        F.count_if(~F.col(left)[end].eqNullSafe(F.col(right)[end])).alias("n_inconsistent_end"),
    )


def quantiles_in_cells(df: DataFrame, value: Column, cell: Column, probabilities: list[float], by: str) -> DataFrame:
    """Exact quantiles, linear between ranks, of each group: ``by, _p, quantile``.

    Rows are counted in cells (an order-preserving whole number), and only the rows of the cells that hold a wanted rank are
    sorted, so what is kept in memory is one counter per cell.
    """
    known = df.select(F.col(by).alias("_by"), value.alias("_value"), cell.alias("_cell")).filter("_value is not null")
    running = Window.partitionBy("_by").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        known.groupBy("_by", "_cell")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_until", F.sum("_rows").over(running))
        .withColumn("_total", F.sum("_rows").over(Window.partitionBy("_by")))
    )
    wanted = cells.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))).withColumn(
        "_place", F.col("_p") * (F.col("_total") - 1)
    )
    ranks = F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))
    wanted = wanted.withColumn("_rank", F.explode(ranks)).filter(
        (F.col("_rank") < F.col("_until")) & (F.col("_rank") >= F.col("_until") - F.col("_rows"))
    )
    # at most two rows per group and probability
    wanted = materialise(
        wanted.select(
            F.col("_by").alias("_g"), F.col("_cell").alias("_c"), "_p", "_place", "_rank",
            (F.col("_until") - F.col("_rows")).alias("_before"),
        ),
        "ranks",
    )
    meets = F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c"))
    inside = Window.partitionBy("_by", "_cell").orderBy("_value")
    sorted_rows = (
        known.join(small_side(wanted.select("_g", "_c", "_before").distinct()), meets)
        .withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1)
        .select(F.col("_by").alias("_b"), "_at", "_value")
    )
    share = F.when(F.col("_rank") == F.floor("_place"), 1 - (F.col("_place") - F.floor("_place"))).otherwise(
        F.col("_place") - F.floor("_place")
    )
    return (
        sorted_rows.join(small_side(wanted), F.col("_b").eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_rank")))
        .groupBy(F.col("_b").alias(by), "_p")
        .agg(F.sum(F.col("_value") * share).alias("quantile"))
    )


def delay_quantiles(
    df: DataFrame, begin: str, end: str, probabilities: list[float], by: str | None = None
) -> DataFrame:
    """Quantiles, in days, of the delay between two datetimes; cells are whole days."""
    delay = exact_days_between(begin, end)
    group = by or "_all"
    known = df if by else df.withColumn(group, F.lit(0))
    known = known.filter(F.col(begin).isNotNull() & F.col(end).isNotNull())
    known = materialise(known.select(group, delay.alias("_delay")), "delays")
    summary = known.groupBy(group).agg(F.count("*").alias("n"), F.avg("_delay").alias("mean"))
    found = quantiles_in_cells(known, F.col("_delay"), F.floor("_delay"), probabilities, group)
    columns = [F.max(F.when(F.col("_p") == p, F.col("quantile"))).alias(f"p{round(100 * p)}") for p in probabilities]
    wide = found.groupBy(F.col(group).alias("_of")).agg(*columns)
    names = [f"p{round(100 * p)}" for p in probabilities]
    joined = summary.join(wide, F.col(group).eqNullSafe(F.col("_of")))
    return joined.select(*([by] if by else []), "n", "mean", *names)


def split_summary(target: DataFrame, dataset_split: DataFrame) -> DataFrame:
    """Cases, size, prevalence in percent and inclusion period of each part of a split."""
    case = F.col(OUTCOME) == 1
    return (
        target.join(dataset_split.select(PERSON, "dataset"), PERSON)
        .groupBy("dataset")
        .agg(
            F.count("*").alias("n_persons"),
            F.count_if(case).alias("n_cases"),
            (100 * F.avg(case.cast("double"))).alias("prevalence"),
            F.min(INCLUSION_START).alias("first_inclusion"),
            F.max(INCLUSION_START).alias("last_inclusion"),
        )
    )


def vocabulary_sweep(event: DataFrame, thresholds: list[int] = (10, 20, 50, 100)) -> DataFrame:
    """Size of the vocabulary for several minimal numbers of events, from one count table."""
    sizes = build_vocabulary(event, 1).agg(
        *[F.count_if(F.col("n_events") >= t).alias(str(t)) for t in thresholds]
    )
    return sizes.unpivot([], [str(t) for t in thresholds], "n_min_events", "n_codes").withColumn(
        "n_min_events", F.col("n_min_events").cast("int")
    )


def vocabulary_provenance(event: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Source types of each code of a vocabulary."""
    return event.select(SOURCE_CODE, SOURCE_TYPE).distinct().join(
        vocabulary.select(SOURCE_CODE), SOURCE_CODE, "left_semi"
    )


def leakage_checks(
    target: DataFrame, event: DataFrame, target_datetime: str, horizon_in_days: float = 360
) -> DataFrame:
    """Rows that would leak the future into the features; all counts should be 0 but the
    last two, which tell how close the data come to it."""
    late = exact_days_between(FOLLOWUP_START, target_datetime) > F.lit(float(horizon_in_days))
    from_events = event.agg(
        F.count_if(F.col(START) > F.col(FOLLOWUP_START)).alias("after"),
        F.count_if(F.col(START) == F.col(FOLLOWUP_START)).alias("at"),
    )
    checks = target.agg(
        F.count_if(F.col(target_datetime) <= F.col(FOLLOWUP_START)).alias("targets_before_followup"),
        F.count_if(late).alias("targets_after_horizon"),
    ).withColumns(
        {
            "events_after_followup": from_events.select("after").scalar(),
            "events_at_followup": from_events.select("at").scalar(),
        }
    )
    if OUTCOME_STAY_ID in target.columns or STAY_ID in target.columns:
        stay = OUTCOME_STAY_ID if OUTCOME_STAY_ID in target.columns else STAY_ID
        visits = target.select(PERSON, F.col(stay).alias(STAY_ID)).filter(F.col(STAY_ID).isNotNull())
        inside = event.join(visits, [PERSON, STAY_ID], "left_semi").agg(F.count("*"))
        checks = checks.withColumn("events_of_target_visit", inside.scalar())
    return checks


