"""Reproducible random draws and exact samples.

A draw is the md5 of ``id:seed``: it depends on the row alone, so a retried task, another
partitioning or another engine gives the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.session import materialise


def draw(identifier, seed: int) -> Column:
    """Draw of a row as 32 hexadecimal digits, to sort on."""
    column = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.md5(F.concat_ws(":", column.cast("string"), F.lit(str(seed))))


def draw_integer(identifier, seed: int) -> Column:
    """Draw of a row as an integer in [0, 2**32)."""
    return F.conv(F.substring(draw(identifier, seed), 1, 8), 16, 10).cast("long")


def exact_sample(
    df: DataFrame, identifier: str, sizes: int | dict, seed: int, by: str | None = None
) -> DataFrame:
    """The rows with the lowest draws: ``sizes`` of them, or ``sizes[value]`` for each value of ``by``.

    No sort of all rows: draws are counted in 65,536 cells (their first four digits), and only the
    rows of the cell where the size is reached are ranked. The sample is then a plain filter on
    the draw, with one limit per value.
    """
    group = F.lit(0) if by is None else F.col(by)
    wanted = {0: sizes} if by is None else sizes
    # read by three steps, so written once
    drawn = materialise(
        df.select(group.alias("_group"), F.col(identifier).alias("_id"), draw(identifier, seed).alias("_draw")),
        "draws",
    ).withColumn("_cell", F.substring("_draw", 1, 4))
    limits = F.create_map(*[F.lit(int(x)) for pair in wanted.items() for x in pair])
    running = Window.partitionBy("_group").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    # the last cell of each group that the sample reaches, and how many of its rows it takes
    last_cells = (
        drawn.groupBy("_group", "_cell")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_until", F.sum("_rows").over(running))
        .withColumn("_rest", F.least(limits[F.col("_group")] - F.col("_until") + F.col("_rows"), "_rows"))
        .filter("_rest > 0")
        .groupBy("_group")
        .agg(F.max_by(F.struct("_cell", "_rest"), "_cell").alias("_last"))
        .select("_group", "_last.*")
    ).collect()
    if not last_cells:
        return df.filter(F.lit(False))
    in_last = reduce(
        lambda left, right: left | right,
        [(F.col("_group") == row["_group"]) & (F.col("_cell") == row["_cell"]) for row in last_cells],
    )
    rests = F.create_map(*[F.lit(x) for row in last_cells for x in (row["_group"], row["_rest"])])
    rank = Window.partitionBy("_group").orderBy("_draw", "_id")
    last_rows = (
        drawn.filter(in_last)
        .withColumn("_rank", F.row_number().over(rank))
        .filter(F.col("_rank") == rests[F.col("_group")])
        .select("_group", "_draw", "_id")
    ).collect()
    place = F.struct(draw(identifier, seed).alias("d"), F.col(identifier).alias("i"))
    kept = [
        (group == row["_group"]) & (place <= F.struct(F.lit(row["_draw"]).alias("d"), F.lit(row["_id"]).alias("i")))
        for row in last_rows
    ]
    return df.filter(reduce(lambda left, right: left | right, kept))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)
