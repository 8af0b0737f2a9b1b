"""Targets, epochs and the fractional sample."""

import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carepath.llm.mixing import Mix, mix_report, mixed, targets


def shared(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    """Cap and share again until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = total * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (budget - sum(most * sizes[s] for s in full)) / max(sum(weight[s] for s in rest), 1)
        over = {s for s in rest if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "c", "d", "Z", "é", None]), st.integers(0, 1000), min_size=1))
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in targets(table, Mix()).collect()}
    wanted = shared(sizes)
    assert found.keys() == wanted.keys()
    for s in sizes:
        assert found[s] == pytest.approx(wanted[s], abs=1e-6)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 5}" if i % 11 else None, "x") for i in range(2000)]
    rows += [(7, "a b c", "s1", "y")] * 40 + [(None, None, "s2", "z"), (None, " ", None, "z"), (9, "", "s3", "z"), (10, "one", "tiny", "z")]
    rows += [(11, "same words here", "copies", "z")] * 30
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def check(rows):
    sums, goal, seen = Counter(), {}, defaultdict(set)
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        assert r["taken"] % max(r["size"], 1) == 0
        sums[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        seen[r["source"]].add(r["epochs_taken"] if r["size"] else None)
    return sums, goal, seen


def test_report(docs):
    rows = mix_report(docs).collect()
    assert len(rows) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], size(r["text"])) for r in docs.collect())
    sums, goal, seen = check(rows)
    wanted = shared({r["source"]: r["source_size"] for r in rows})
    for s in goal:
        assert goal[s] == pytest.approx(wanted[s])
        assert abs(sums[s] - goal[s]) <= 12  # half the longest document
        whole = {n for n in seen[s] if n is not None}
        assert len(whole) <= 2 and max(whole) - min(whole) <= 1  # complete epochs, then a fraction
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_report(docs.repartition(5)).collect()), key=str)


def test_copies_at_the_boundary_are_split(spark):
    rows = [(1, "a b", "one")] * 30 + [(2, "c", "two")] * 500
    found = mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sums, goal, _ = check(found)
    assert all(abs(sums[s] - goal[s]) <= 1 for s in goal)


def test_mixed_rows(docs):
    out = mixed(docs)
    assert out.columns == docs.columns
    taken = {tuple(r[:4]): r[4] for r in out.groupBy(*docs.columns).count().collect()}
    report = mix_report(docs).groupBy("doc_id", "source").agg(F.sum("epochs_taken").alias("n"), F.sum("taken").alias("w")).collect()
    assert sum(taken.values()) == sum(r["n"] for r in report)
    assert mixed(docs.limit(0)).count() == 0 and mix_report(docs.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    rows = [(i, "a b c d", "s", 5.0 if i % 2 else 0.2) for i in range(2000)] + [(-i, "x", "t", 1.0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    out = mix_report(docs, Mix(weights=(1, 1), total=0.5), weight=F.col("q")).filter("source = 's' and taken > 0").collect()
    odd = sum(r["doc_id"] % 2 for r in out)
    assert odd > 0.75 * len(out)
