"""Classes of codes from a dictionary of patterns against a search for every pattern in every code."""

import random

from carepath.constants import CODE_CLASS, CONDITION_CODE
from carepath.functions.codes import get_cim10_codes, match_code_dictionary

LETTERS = "ABCDE"


def words(draw, n, least, most):
    return ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(least, most + 1))) for _ in range(n)]


def matched(conditions, dictionary):
    rows = match_code_dictionary(conditions, dictionary).collect()
    return sorted((r["row"], r[CODE_CLASS]) for r in rows)


def test_thousands_of_patterns(spark):
    draw = random.Random(0)
    patterns = [(p, f"class {k % 50}") for k, p in enumerate(words(draw, 5000, 3, 6))]
    found = words(draw, 800, 0, 9)
    codes = [(i, c) for i, c in enumerate([*found, *found[:100], None, ""])]
    conditions = spark.createDataFrame([(*row, "old") for row in codes], f"row int, {CONDITION_CODE} string, `{CODE_CLASS}` string")
    dictionary = spark.createDataFrame([*patterns, *patterns[:10], ("", "all"), (None, "none"), ("A", None)], f"pattern string, `{CODE_CLASS}` string")
    wanted = sorted((i, label) for i, c in codes if c for label in {label for p, label in patterns if p in c})
    assert wanted and matched(conditions, dictionary) == wanted
    plan = match_code_dictionary(conditions, dictionary)._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan.upper() and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_same_rows_as_the_alternation(spark):
    draw = random.Random(1)
    classes = {"a": words(draw, 20, 2, 4), "b": words(draw, 20, 2, 4)}
    conditions = spark.createDataFrame(list(enumerate(words(draw, 200, 1, 8))), f"row int, {CONDITION_CODE} string")
    dictionary = spark.createDataFrame([(p, k) for k, v in classes.items() for p in v], f"pattern string, `{CODE_CLASS}` string")
    wanted = sorted((r["row"], r[CODE_CLASS]) for r in get_cim10_codes(conditions, classes).collect())
    assert matched(conditions, dictionary) == wanted


def test_empty_tables(spark):
    conditions = spark.createDataFrame([(1, "A")], f"row int, {CONDITION_CODE} string")
    dictionary = spark.createDataFrame([("A", "x")], f"pattern string, `{CODE_CLASS}` string")
    assert matched(conditions, dictionary) == [(1, "x")]
    assert matched(conditions, dictionary.limit(0)) == [] and matched(conditions.limit(0), dictionary) == []
