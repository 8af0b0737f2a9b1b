"""Events over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carepath.constants import START, STAY_ID
from carepath.functions.dates import force_datetime

MIN_YEAR, MAX_YEAR = 1850, 2030


def _by_month(df: DataFrame, colname_datetime: str) -> DataFrame:
    time = F.col(colname_datetime)
    return (
        force_datetime(df.select(colname_datetime), colname_datetime)
        .filter(time.isNotNull())
        .groupBy(F.year(time).alias("year"), F.month(time).alias("month"))
        .agg(F.count("*").alias("count"))
    )


def _absurd():
    return (F.col("year") <= MIN_YEAR) | (F.col("year") >= MAX_YEAR)


def time_plot(df: DataFrame, colname_datetime: str = START) -> DataFrame:
    """Events per month, without years before 1850 or after 2030."""
    return (
        _by_month(df, colname_datetime)
        .filter(~_absurd())
        .withColumn("day", F.lit(1))
        .withColumn("year-month", F.make_date("year", "month", "day"))
        .orderBy("year", "month")
    )


def absurd_months(df: DataFrame, colname_datetime: str = START) -> DataFrame:
    """What :func:`time_plot` leaves out."""
    return _by_month(df, colname_datetime).filter(_absurd())


def temporal_heatmap(
    event: DataFrame,
    colname_of_interest: str,
    n_top_counts: int = 1000,
    colname_datetime: str = START,
    colname_stay_id: str = STAY_ID,
) -> DataFrame:
    """Events per (concept, year) of the most frequent concepts, zeros included.

    Long form: a column per concept would not survive a large vocabulary. Counting by (concept,
    year) is the only pass over the events.
    """
    if colname_of_interest not in event.columns:
        raise ValueError(f"{colname_of_interest} should be in {event.columns}")
    counts = (
        event.groupBy(F.col(colname_of_interest).alias("concept"), F.year(colname_datetime).alias("year"))
        .agg(F.count(colname_stay_id).alias("n_events"))
    )
    top = (
        counts.groupBy("concept")
        .agg(F.sum("n_events").alias("total"))
        .orderBy(F.desc("total"), "concept")
        .limit(n_top_counts)
    )
    # calendar years in the data: a handful, kept as one array and opened next to each concept
    years = counts.agg(F.sort_array(F.collect_set("year")).alias("years")).scalar()
    grid = top.select("concept", "total", F.explode(years).alias("year"))
    return grid.join(counts, ["concept", "year"], "left").select(
        "concept", "year", F.coalesce("n_events", F.lit(0)).alias("n_events"), "total"
    )


def heatmap_matrix(heatmap: DataFrame, years: list[int]) -> DataFrame:
    """The long form as a matrix: one row per concept, one column per year."""
    return heatmap.groupBy("concept").pivot("year", years).agg(F.first("n_events"))


def monthly_normalised(df: DataFrame, colname_datetime: str, by: str = "dataset") -> DataFrame:
    """Monthly counts of each part, divided by the mean count of the part."""
    time = F.col(colname_datetime)
    counts = (
        df.filter(time.isNotNull())
        .groupBy(by, F.year(time).alias("year"), F.month(time).alias("month"))
        .agg(F.count("*").alias("count"))
        .filter(~_absurd())
    )
    # windows over one row per month
    return counts.withColumn("normalised", F.col("count") / F.avg("count").over(Window.partitionBy(by)))
