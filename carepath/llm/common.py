"""Helpers of the text operators: identities, size-checked joins, connected classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.session import materialise

#: a side of at most so many narrow rows (some tens of bytes each) is broadcast
BROADCAST_ROWS = 300_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def text_id(text: Column) -> Column:
    """128 bits that stand for a text; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def narrow(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written, narrow table with a broadcast hint if it has at most ``rows`` rows.

    Beyond that Spark shuffles both sides and splits skewed keys (adaptive execution).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an undirected edge table; the label is the least node of its class.

    Each round takes the least label among the neighbours, then the label of the label. Both are
    joins and minima with partial aggregation, so a node with very many edges is split, and
    each round is written to the shared folder, so a lost executor costs no more than a round.
    """
    sides = materialise(
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .union(edges.select(F.col(b), F.col(a)))
        .distinct(),
        "edges",
    )
    labels = materialise(sides.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels").withColumnRenamed("x", "node")
    while True:
        near = (
            sides.join(labels.withColumnRenamed("node", "y"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        joined = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("via")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = materialise(
            joined.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("further", "via")).alias("label")),
            "labels",
        )
        changed = after.filter(F.col("old") != F.col("label")).limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels
