"""Ordered scans (previous value, running sum, running maximum, next point) that survive a hot key.

A window sorts one key in one task. A key with very many rows, the null key included, is therefore cut into
chunks of time: the window runs inside a chunk, and a chunk gets what it needs from
the chunks before it through a summary of one row per chunk. Chunks are days, and hours or seconds where a day, or an hour,
is still too large. Other keys are one chunk, and tables without any hot key get plain windows.

Rows of a hot key at one and the same microsecond, or without a time, stay in one chunk: their order is that of the
other sort columns, which have no cells to cut at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
CHUNK = "_chunk"
WHOLE = -(1 << 62)  # chunk of the keys that are not cut: before all others
NO_TIME = WHOLE + 1  # rows without a time sort first
MICROSECONDS = {"day": 86_400_000_000, "second": 1_000_000, "microsecond": 1}


def _micros(time: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))


def _floor(time: str, unit: str) -> Column:
    """Start of the unit a time is in, in microseconds."""
    micros = _micros(time)
    return micros - F.pmod(micros, F.lit(MICROSECONDS[unit]))


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"{n}_hot"]) for n in names])


def _marked(df: DataFrame, counted: DataFrame, names: list[str], hot_rows: int, mark: str) -> DataFrame | None:
    """``df`` with a mark on the rows whose ``names`` are those of more than ``hot_rows`` rows; None without any."""
    hot = counted.groupBy(*names).count().filter(F.col("count") > hot_rows).select(*names)
    found = hot.limit(MAX_HOT_KEYS + 1).collect()
    if not found:
        return None
    if len(found) <= MAX_HOT_KEYS:
        hot = F.broadcast(df.sparkSession.createDataFrame(found, hot.schema))
    hot = hot.withColumnsRenamed({n: f"{n}_hot" for n in names}).withColumn(mark, F.lit(True))
    return df.join(hot, _same(df, hot, names), "left").drop(*[f"{n}_hot" for n in names])


def with_chunks(
    df: DataFrame, keys: list[str], time: str, hot_rows: int = HOT_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Add the chunk of each row if some key is hot: a unit of its time for hot keys, a constant for others.

    Hot keys are looked for first, by a count with map-side partial sums. Usually there are none,
    then the rows stay as they are and the scans below are plain windows. There are at most
    ``rows / hot_rows`` hot keys, a thousand per billion rows with the default. ``counted`` is a
    table with at least the rows of ``df``, where it is cheaper to count. Only where a unit of a hot key
    is itself hot are smaller units looked at.
    """
    marked = _marked(df, df if counted is None else counted, keys, hot_rows, "_hot")
    if marked is None:
        return df
    unit = F.coalesce(_floor(time, "day"), F.lit(NO_TIME))
    chunked = marked.withColumn(CHUNK, F.when(F.col("_hot"), unit).otherwise(F.lit(WHOLE))).drop("_hot")
    for smaller in ("second", "microsecond"):
        finer = _marked(chunked, _hot_only(chunked).filter(F.col(time).isNotNull()), [*keys, CHUNK], hot_rows, "_finer")
        if finer is None:
            break
        chunked = finer.withColumn(CHUNK, F.when(F.col("_finer"), _floor(time, smaller)).otherwise(F.col(CHUNK))).drop("_finer")
    return chunked


def _hot_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CHUNK) != WHOLE)


def _carry(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Join what a chunk gets from the ones before it; null keys meet too."""
    names = [*keys, CHUNK]
    side = carried.withColumnsRenamed({n: f"{n}_hot" for n in names})
    return df.join(side, _same(df, side, names), "left").drop(*[f"{n}_hot" for n in names])


def _parts(df: DataFrame, keys: list[str]) -> list[str]:
    return [*keys, CHUNK] if CHUNK in df.columns else keys


def previous_value(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """``value`` of the previous row of the key; ``df`` comes from :func:`with_chunks`."""
    inside = Window.partitionBy(*_parts(df, keys)).orderBy(*order)
    if CHUNK not in df.columns:
        return df.withColumn(name, F.lag(value).over(inside))
    days = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = (
        _hot_only(df)
        .groupBy(*keys, CHUNK)
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .select(*keys, CHUNK, F.lag("_last").over(days).alias("_carried"))
    )
    ranked = df.withColumn("_rank", F.row_number().over(inside)).withColumn(name, F.lag(value).over(inside))
    return (
        _carry(ranked, carried, keys)
        .withColumn(name, F.when(F.col("_rank") == 1, F.col("_carried")).otherwise(F.col(name)))
        .drop("_rank", "_carried")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Sum of ``value`` up to the row; ``df`` comes from :func:`with_chunks`."""
    inside = (
        Window.partitionBy(*_parts(df, keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    if CHUNK not in df.columns:
        return df.withColumn(name, F.sum(value).over(inside))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        _hot_only(df)
        .groupBy(*keys, CHUNK)
        .agg(F.sum(value).alias("_total"))
        .select(*keys, CHUNK, F.sum("_total").over(earlier).alias("_carried"))
    )
    return (
        _carry(df.withColumn(name, F.sum(value).over(inside)), carried, keys)
        .withColumn(name, F.col(name) + F.coalesce(F.col("_carried"), F.lit(0)))
        .drop("_carried")
    )


def earlier_max(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str
) -> DataFrame:
    """Greatest ``value`` of the rows of the key before this one; ``df`` comes from :func:`with_chunks`.

    A maximum of maxima is the maximum, so a chunk of a hot key needs one number from all chunks before it. Nulls do not count.
    """
    inside = Window.partitionBy(*_parts(df, keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if CHUNK not in df.columns:
        return df.withColumn(name, F.max(value).over(inside))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        _hot_only(df)
        .groupBy(*keys, CHUNK)
        .agg(F.max(value).alias("_greatest"))
        .select(*keys, CHUNK, F.max("_greatest").over(earlier).alias("_carried"))
    )
    return (
        _carry(df.withColumn(name, F.max(value).over(inside)), carried, keys)
        .withColumn(name, F.greatest(F.col(name), F.col("_carried")))
        .drop("_carried")
    )


def next_point(
    rows: DataFrame,
    points: DataFrame,
    key: str,
    row_time: str,
    point_time: str,
    name: str,
    hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """For each row, the first point of its key at or after its time (null if none).

    A sorted merge of both tables: the pairs of a key are never formed, so a key that is
    hot in both tables costs its rows, not their product.
    """
    times = points.select(key, F.col(point_time).alias("_time")).filter("_time is not null").distinct()
    both = rows.select(
        key, F.col(row_time).alias("_time"), F.lit(1).alias("_is_row"), F.struct(*rows.columns).alias("_row")
    ).unionByName(times.withColumn("_is_row", F.lit(0)), allowMissingColumns=True)
    both = with_chunks(both, [key], "_time", hot_rows, counted)
    point = F.when(F.col("_is_row") == 0, F.col("_time"))
    # backwards in time, points before rows: the last point seen is the next one
    backwards = (
        Window.partitionBy(*_parts(both, [key]))
        .orderBy(F.desc("_time"), "_is_row")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    seen = both.withColumn(name, F.last(point, ignorenulls=True).over(backwards)).filter("_is_row = 1")
    if CHUNK not in both.columns:
        return seen.select("_row.*", name)
    later = Window.partitionBy(key).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        _hot_only(both)
        .groupBy(key, CHUNK)
        .agg(F.min(point).alias("_first"))
        .select(key, CHUNK, F.last("_first", ignorenulls=True).over(later).alias("_carried"))
    )
    return _carry(seen, carried, [key]).select("_row.*", F.coalesce(name, "_carried").alias(name))
