"""Tables of persons are sent to every task only while the driver can hold them easily."""

from __future__ import annotations

from pyspark.sql import functions as F

from carepath.constants import PERSON
from carepath.functions.sizes import person_side


def test_many_persons_are_not_broadcast(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    few, many = (spark.range(n).select(F.col("id").alias(PERSON)) for n in (1_000, 1_500_000))
    assert hinted(person_side(few)) and not hinted(person_side(many))
    assert person_side(many).count() == 1_500_000
