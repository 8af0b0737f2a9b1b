"""The queries are registered, and agree with their SQL."""

import sys
from pathlib import Path

import pytest

from __spark_entry__ import SMOKE_DIR, oracle_sql, queries
from carepath.llm.oracles import ORACLES

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from compare import compare, connect  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="no generated tables")
NAMES = [n for n in queries() if n.startswith("op") or n == "pipeline"]


def test_fourteen_queries():
    assert len(NAMES) == 14
    assert {n.split("_")[0] for n in NAMES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert compare(spark, connect(SMOKE_DIR), SMOKE_DIR, name, queries()[name], oracle_sql().get(name)) is None


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(NAMES)
