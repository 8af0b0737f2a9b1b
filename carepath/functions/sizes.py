"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.session import materialise

BROADCAST_ROWS = 2_000_000
#: the driver builds a broadcast table; a million persons are some 60 MB there, and as much again while they are sent
PERSON_ROWS = 1_000_000
BROADCAST_BYTES = 200_000_000


def small_side(dimension: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A dimension table, to broadcast if it has at most ``rows`` rows and ``most`` bytes; otherwise Spark decides.

    Bytes are those of the rows written as JSON text, which is close to their size in memory for numbers and
    texts alike. At most ``rows`` rows are looked at.
    """
    some = dimension.limit(rows + 1)
    length = F.octet_length(F.to_json(F.struct(*[F.col(f"`{name}`") for name in dimension.columns])))
    n, size = some.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    return F.broadcast(dimension) if n <= rows and size <= most else dimension


def size_checked(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a code-level table once and broadcast it if it has at most ``rows`` rows.

    Joining events on a code shuffles them on a very skewed key, so a broadcast is worth a
    check. Beyond ``rows`` the table is joined without a hint.
    """
    return small_side(materialise(table, "codes"), rows)


def person_side(persons: DataFrame, rows: int = PERSON_ROWS) -> DataFrame:
    """Write a narrow table of included persons and broadcast it if it has at most ``rows`` rows.

    It meets fact tables of all patients: without their shuffle, a hot person is no longer
    one task, and the events of others are dropped where they are read. Beyond ``rows`` both
    sides are shuffled on the person.
    """
    return small_side(materialise(persons, "persons"), rows)
