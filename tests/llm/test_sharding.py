"""The hash tree: proportions, movement, slots."""

import zlib
from collections import Counter, defaultdict

import pytest

from carepath.llm.sharding import CHUNK, Leaf, assignments, grown, tree, with_place

SCHEMA = "doc_id long, text string, shard string, n long"


@pytest.fixture(scope="module")
def rows(spark):
    texts = [(i, f"text {i % 7} é", "own", 1) for i in range(3000)]
    odd = [(None, None, None, None), (None, "a", None, None), (5, "text 5 é", "own", 1), (5, "text 5 é", "own", 1), (6, "", "x", 2)]
    return spark.createDataFrame(texts + odd, SCHEMA)


def test_digest(rows):
    out = assignments(rows).collect()
    source = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == source
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
    assert set(slots) == set(range(24))
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
        assert 60 < len(found) < 200
    assert 60 < sum(r["grown_shard"] == 24 for r in out) < 200
    by_key = defaultdict(set)
    for r in out:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(x) == 1 for x in by_key.values())


def test_reruns_agree_over_partitions(rows):
    assert sorted(map(tuple, assignments(rows).collect()), key=str) == sorted(map(tuple, assignments(rows.repartition(7)).collect()), key=str)


def test_many_equal_rows(spark):
    n = 2 * CHUNK + 3
    same = spark.range(n).selectExpr("cast(3 as long) doc_id", "'t' text")
    out = assignments(same).selectExpr("count(*) n", "min(slot) a", "max(slot) b", "count(distinct slot) d", "count(distinct shard) s").first()
    assert tuple(out) == (n, 0, n - 1, n, 1)


def test_empty(spark, rows):
    assert assignments(rows.limit(0)).count() == 0


def places(spark, leaves):
    out = with_place(spark.range(4000).withColumnRenamed("id", "doc_id"), leaves)
    return {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in out.collect()}


def test_movement_is_confined_to_changed_subtrees(spark):
    before = places(spark, tree(24))
    heavier = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 6 else 1.0) for x in tree(24)]
    after = places(spark, heavier)
    changed = (0, 1, 6)
    moved = [(before[k], after[k]) for k in before if before[k] != after[k]]
    assert moved
    for old, new in moved:
        level = next(i for i in range(3) if old[i] != new[i])
        # at the level where they part, rows go to the heavier subtree, never between its siblings
        assert old[:level] == new[:level]
        assert new[level] == changed[level] and new[:level] == changed[:level]
    share = sum(p[2] == 6 for p in after.values()) / len(after)
    assert abs(share - 3 / 26) < 0.02


def test_growth_at_any_size(spark):
    for n in (1, 4, 7, 13):
        leaves = tree(n)
        before, after = places(spark, leaves), places(spark, grown(leaves))
        assert all(before[k][2] == after[k][2] or after[k][2] == n for k in before)
        assert abs(sum(p[2] == n for p in after.values()) / 4000 - 1 / (n + 1)) < 0.04


def test_weightless_shards_get_nothing(spark):
    leaves = [Leaf(0, 0, 0), Leaf(0, 0, 1, 0.0), Leaf(1, 0, 2, 0.0)]
    assert {p[2] for p in places(spark, leaves).values()} == {0}
    with pytest.raises(ValueError):
        with_place(spark.range(1).withColumnRenamed("id", "doc_id"), [Leaf(0, 0, 0, 0.0)])
