"""Every query with SQL gives the same values as an independent engine on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import compare, connect  # noqa: E402

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="no generated tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SMOKE_DIR)


def test_names():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, connection, name):
    assert compare(spark, connection, SMOKE_DIR, name, queries()[name], oracle_sql()[name]) in (None, "empty")


def test_multilabel_scores_persons_that_were_held_out(spark):
    """One row per person and class, of the held-out persons too, whose scores the fit must give."""
    rows = queries()["fit_multilabel"](spark, "/root/testdata/sf0.01").collect()
    persons = {part: {r["person_id"] for r in rows if r["dataset"] == part} for part in ("train", "external_test")}
    assert persons["train"] and persons["external_test"] and not persons["train"] & persons["external_test"]
    assert len(rows) == 22 * sum(map(len, persons.values()))
    assert {r["n_persons"] for r in rows} == {len(persons["train"])}
