"""Datetime columns: differences, coercion, ages, calendar details."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.constants import (
    BIRTH,
    INCLUSION_DAY_OF_WEEK,
    INCLUSION_MONTH,
    INCLUSION_TIME_OF_DAY,
    PERSON,
    START,
)

MICROSECONDS_PER_DAY = 86_400_000_000


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def timestamp(value: datetime) -> Column:
    """A literal without time zone, comparable with Parquet datetimes."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def microseconds_between(begin, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _column(begin), _column(end))


def days_between(begin, end) -> Column:
    """Whole days, rounded down also for negative spans."""
    span = microseconds_between(begin, end)
    day = F.lit(MICROSECONDS_PER_DAY)
    return ((span - F.pmod(span, day)) / day).cast("long")


def exact_days_between(begin, end) -> Column:
    """Days with their fraction."""
    return microseconds_between(begin, end) / F.lit(float(MICROSECONDS_PER_DAY))


def plus_days(column, days: float) -> Column:
    whole = int(days)
    seconds = round((days - whole) * 86_400)
    return _column(column) + F.make_dt_interval(F.lit(whole), F.lit(0), F.lit(0), F.lit(seconds))


def clean_date_cols(df: DataFrame) -> DataFrame:
    """Drop the columns ending in ``date``, whose types are wrong at the source."""
    return df.drop(*[name for name in df.columns if name.endswith("date")])


def force_datetime(df: DataFrame, colnames_datetime: list[str] | str = START) -> DataFrame:
    """Read columns as datetimes; what cannot be read becomes null."""
    names = [colnames_datetime] if isinstance(colnames_datetime, str) else colnames_datetime
    kinds = dict(df.dtypes)
    casts = {}
    for name in names:
        if kinds[name] == "string":
            casts[name] = F.col(name).try_cast("timestamp_ntz")
        elif kinds[name] in ("date", "timestamp"):
            casts[name] = F.col(name).cast("timestamp_ntz")
    return df.withColumns(casts) if casts else df


def add_age(
    df: DataFrame,
    ref_datetime: int | datetime | str,
    birth_datetime_col: str = BIRTH,
    colname_age: str | None = None,
) -> DataFrame:
    """Age in days and in years of 365 days at a year, a datetime or a datetime column."""
    if isinstance(ref_datetime, bool) or not isinstance(ref_datetime, (int, datetime, str)):
        raise TypeError("ref_datetime should be a year, a datetime or a column name")
    if isinstance(ref_datetime, str):
        if ref_datetime not in df.columns:
            raise ValueError(f"{ref_datetime} not a column of the dataframe.")
        df = force_datetime(df, ref_datetime)
        reference, label = F.col(ref_datetime), f"to_{ref_datetime}"
    else:
        # a bare year means noon of its first day
        moment = datetime(ref_datetime, 1, 1, 12) if isinstance(ref_datetime, int) else ref_datetime
        reference, label = timestamp(moment), f"in_{moment.year}"
    df = force_datetime(df, birth_datetime_col)
    name = colname_age or f"age_{label}"
    return df.withColumn("age_in_days", days_between(birth_datetime_col, reference)).withColumn(
        name, F.col("age_in_days") / F.lit(365.0)
    )


def get_time_of_day(column) -> Column:
    """Morning from 7 to 12, afternoon from 12 to 20, night otherwise."""
    hour = F.hour(_column(column))
    return (
        F.when((hour >= 7) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 20), "afternoon")
        .otherwise("night")
    )


def get_date_details(person: DataFrame, colname_datetime: str) -> DataFrame:
    """Month, weekday (Monday is 0) and time of day of a datetime column."""
    return person.withColumns(
        {
            INCLUSION_MONTH: F.month(colname_datetime),
            INCLUSION_DAY_OF_WEEK: F.weekday(colname_datetime),
            INCLUSION_TIME_OF_DAY: get_time_of_day(colname_datetime),
        }
    )


def reconstruct_birth(
    person: DataFrame,
    visit: DataFrame,
    colname_start: str = "start_date",
    colname_age: str = "age_visit_in_month_num",
) -> DataFrame:
    """Birth date from the age in months (of 30 days) at the first visit; others are dropped."""
    first = Window.partitionBy(PERSON).orderBy(
        F.col(colname_start).asc_nulls_last(), F.col(colname_age)
    )
    births = (
        visit.select(PERSON, colname_start, colname_age)
        .withColumn("_rank", F.row_number().over(first))
        .filter("_rank = 1")
        .select(
            PERSON,
            (
                F.col(colname_start).cast("timestamp_ntz")
                - F.make_dt_interval((F.col(colname_age) * 30).cast("int"))
            ).alias(BIRTH),
        )
    )
    return person.drop(BIRTH).join(births, PERSON)
