"""Boosting by leaves against trees that a plain search grows one split at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath.operators import leaf_boosting, models
from carepath.operators.leaf_boosting import Boost, Growth, cut_points, fit_boosted

SCHEMA = "x array<double>, y array<int>, fold int, held boolean"


def drawn(n=600, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x = [draw.gauss(0, 1), float(draw.randrange(4)), draw.random(), 7.0]
        score = 1.5 * (x[0] > 0.3) * (x[1] >= 2) - 1.2 * (x[2] > 0.8) + math.sin(3 * x[0])
        rows.append((x, [int(score + draw.gauss(0, 0.6) > 0.4), int(x[1] + draw.gauss(0, 1) > 2)], i % 3, i % 10 == 0))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(drawn(), SCHEMA).repartition(3).cache()


def grown(x, g, h, leaves, rules):
    """A tree as nested tuples (feature, threshold, left, right) or leaf values, grown best first over all splits of all leaves."""

    def best(rows):
        found = (0.0, None)
        total = g[rows].sum() ** 2 / h[rows].sum()
        for i in range(x.shape[1]):
            for threshold in sorted(set(x[rows, i]))[:-1]:
                left, right = rows[x[rows, i] <= threshold], rows[x[rows, i] > threshold]
                if min(len(left), len(right)) < rules.least_rows:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - total
                if gain > found[0] + 1e-9:
                    found = gain, (i, threshold, left, right)
        return found

    everything = np.arange(len(x))
    tree = {"rows": everything, "best": best(everything)}
    open_leaves, n = [tree], 1
    while n < leaves:
        leaf = max(open_leaves, key=lambda t: t["best"][0])
        if leaf["best"][0] <= 0:
            break
        leaf["children"] = [{"rows": r, "best": best(r)} for r in leaf["best"][1][2:]]
        open_leaves = [t for t in open_leaves if t is not leaf] + leaf["children"]
        n += 1
    return open_leaves


@pytest.mark.parametrize("leaves", [2, 3, 7, 10])
def test_a_tree_equals_one_grown_by_a_plain_search(table, leaves):
    rules = Growth(rounds=1, least_rows=15)
    small = table.select(F.array(F.round(F.get("x", F.lit(0)), 1), F.get("x", F.lit(1)), F.round(F.get("x", F.lit(2)), 2), F.get("x", F.lit(3))).alias("x"),
                         "y", "fold", F.lit(False).alias("held"))
    rows = small.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"][0] for r in rows])
    model = fit_boosted(small, [Boost(0, rate=1.0, leaves=leaves)], rules)[0][0]
    p = y.mean()
    assert model.base == pytest.approx(math.log(p / (1 - p)))
    expected = np.zeros(len(x))
    found = grown(x, p - y, np.full(len(x), p * (1 - p)), leaves, rules)
    for leaf in found:
        expected[leaf["rows"]] = (y[leaf["rows"]] - p).sum() / (p * (1 - p) * len(leaf["rows"]))
    assert model.trees[0].n_leaves == len(found) == leaves
    assert np.allclose(model.margins(x) - model.base, expected)


def test_all_values_are_cuts_or_quantiles(spark, table):
    cuts = cut_points(table, 4, 255)
    assert cuts[1].tolist() == [0.0, 1.0, 2.0] and cuts[3].tolist() == []
    values = np.sort([r["x"][0] for r in table.collect()])
    assert 200 < len(cuts[0]) < 255 and np.isin(cuts[0], values).all()
    odd = spark.createDataFrame([([float("nan"), 1.0], [0], 0, False), ([2.0, 1.0], [1], 0, False)], SCHEMA)
    assert [c.tolist() for c in cut_points(odd, 2)] == [[], []]
    three = spark.createDataFrame([([float(i), 0.0], [0], 0, False) for i in (3, 1, 2)], SCHEMA)
    assert [c.tolist() for c in cut_points(three, 2, 3)] == [[1.0, 2.0], []]
    assert len(cut_points(three, 2, 2)[0]) == 1


def test_models_grown_together_equal_single_ones(table, monkeypatch):
    rules = Growth(rounds=3, least_rows=10)
    wanted = [Boost(0, -2, 0.3, 5), Boost(1, 1, 0.1, 4, (1.0, 3.0)), Boost(0, 2, 1.0, 10)]
    together, passes = fit_boosted(table, wanted, rules)
    x = np.array([r["x"] for r in table.collect()])
    total = 0
    for f, model in zip(wanted, together):
        (alone,), n = fit_boosted(table, [f], rules)
        total += n
        assert len(alone.trees) == len(model.trees) > 0
        assert np.allclose(alone.margins(x), model.margins(x))
        assert all(t.n_leaves <= f.leaves for t in model.trees)
    assert passes < total
    other = table.withColumn("y", F.when(F.col("fold") == 1, F.transform("y", lambda v: 1 - v)).otherwise(F.col("y")))
    assert np.allclose(fit_boosted(other, wanted[1:2], rules)[0][0].margins(x), together[1].margins(x))
    monkeypatch.setattr(leaf_boosting, "SUMS", 1)
    monkeypatch.setattr(leaf_boosting, "PARTIAL_SUMS", 0)
    monkeypatch.setattr(leaf_boosting, "ROUNDS_KEPT", 2)
    split, more = fit_boosted(table, wanted, rules)
    assert more > passes and all(np.allclose(a.margins(x), b.margins(x)) for a, b in zip(split, together))


def test_passes_follow_the_depth_and_not_the_leaves(table):
    rules = Growth(rounds=1, least_rows=2)
    (model,), passes = fit_boosted(table, [Boost(0, leaves=60)], rules)
    tree = model.trees[0]
    depth = np.zeros(len(tree.feature), int)
    for i in range(len(depth)):
        if tree.feature[i] >= 0:
            depth[[tree.left[i], tree.right[i]]] = depth[i] + 1
    # three passes for bins and classes, one for the root, one for each level
    assert tree.n_leaves == 60 and passes <= 4 + depth.max() < 45


def test_it_stops_when_held_rows_no_longer_gain(table):
    rules = Growth(rounds=40, least_rows=5, patience=2)
    (model,), _ = fit_boosted(table, [Boost(0, rate=1.0, leaves=10)], rules)
    rows = [r for r in table.collect() if r["held"]]
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"][0] for r in rows])
    losses, margin = [], np.full(len(x), model.base)
    for tree in [*model.trees, None]:
        losses.append((np.logaddexp(0, margin) - y * margin).mean())
        if tree is not None:
            margin = margin + tree.value[tree.nodes(x, tree.threshold)]
    assert 2 <= len(model.trees) < 40
    assert min(losses[-2:]) >= losses[-3] - 1e-7
    assert all(min(losses[i - 1 : i + 1]) < losses[i - 2] - 1e-7 for i in range(2, len(losses) - 1))


def test_odd_tables(spark, table):
    one_class = table.withColumn("y", F.array(F.lit(1), F.lit(None).cast("int")))
    found, _ = fit_boosted(one_class, [Boost(0), Boost(1)], Growth(rounds=2))
    assert [m.base for m in found] == [math.inf, -math.inf] and not any(m.trees for m in found)
    nothing_to_split = table.withColumn("x", F.array(F.lit(1.0)))
    assert not fit_boosted(nothing_to_split, [Boost(0)], Growth(rounds=2))[0][0].trees
    with pytest.raises(ValueError):
        fit_boosted(table.limit(0), [Boost(0)])


@pytest.fixture(scope="module")
def persons(spark):
    rows = [(i, str(i % 6), [c for c, v in zip("ab", y) if v], y[0], x) for i, (x, y, _, _) in enumerate(drawn())]
    table = spark.createDataFrame(rows, "person_id long, first_care_site_id string, labels array<string>, outcome int, features array<double>")
    return models.with_features(table.drop("features"), table.select("person_id", "features")).cache()


def test_search_and_labels_use_exactly_the_leaves_asked_for(persons):
    config = models.EstimatorConfig(models.BOOSTING, models.ESTIMATORS[models.BOOSTING].parameters, max_iter=3)
    binary = persons.withColumnRenamed("outcome", "y")
    points = [{"stepSize": 0.3, "maxLeaves": 7}, {"stepSize": 1e-3, "maxLeaves": 2}]
    result = models.random_search(binary, config, points=points, n_splits=3)
    assert result.best == points[0] and result.n_splits == 3 and result.scores[0][1] > 0.75
    assert [t.n_leaves for t in result.model.trees] == [7] * 3
    p = {r["person_id"]: r["p"] for r in models.predict(result.model, binary).collect()}
    many = persons.withColumnRenamed("labels", "y")
    fitted = models.fit_multilabel(many, config, ["a", "b", "none"], points[0])
    scored = models.predict_multilabel(fitted, many).collect()
    assert all(r["p"] == pytest.approx(p[r["person_id"]]) for r in scored if r["class"] == "a")
    assert all(r["p"] == 0 for r in scored if r["class"] == "none")
    _, best, scores, n = models.search_multilabel(many, config, ["a", "b", "none"], points, n_splits=3)
    assert best == points[0] and n == 3 and scores[0][1] > scores[1][1]
