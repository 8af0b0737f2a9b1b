"""Labels fitted together against single fits of Spark's logistic regression."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from carepath.operators import metrics, models
from carepath.operators.joint import Fit, JointModel, fit_all, minimise, prepared

CLASSES = [str(c) for c in range(6)]


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(9)
    rows = []
    for i in range(500):
        x = [draw.gauss(100, 1), draw.gauss(0, 30), draw.gauss(-2, 0.1), 7.0]
        z = [x[0] - 100, x[1] / 30, (x[2] + 2) * 10]
        y = [c for c in CLASSES[:5] if z[int(c) % 3] * (1 if int(c) < 3 else -1) + 0.7 * draw.gauss(0, 1) > 0.2 + 0.2 * int(c)]
        rows.append((i, str(i % 7), y, x))
    table = spark.createDataFrame(rows, "person_id long, first_care_site_id string, y array<string>, features array<double>")
    return models.with_features(table.drop("features"), table.select("person_id", "features")).repartition(3).cache()


def single(rows, penalty):
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=penalty, maxIter=1000, tol=1e-13).fit(rows)


@pytest.mark.parametrize("penalty, balanced", [(0.01, True), (0.5, False)])
def test_coefficients_equal_single_fits(labelled, penalty, balanced):
    config = models.EstimatorConfig(models.RIDGE, balanced=balanced)
    joint = models.fit_multilabel(labelled, config, CLASSES[:5], {"regParam": penalty})
    assert isinstance(joint, JointModel)
    for i, c in enumerate(CLASSES[:5]):
        one = single(models.prepare_training(models._one_label(labelled, c), config), penalty)
        found = one.coefficients.toArray()
        assert np.allclose(joint.coefficients[i][:3], found[:3], atol=1e-4) and joint.coefficients[i][3] == 0
        # the intercept stands for a column with a mean of 100, and in Spark's model for the column that is always 7 as well
        assert abs(joint.intercepts[i] - one.intercept - 7 * found[3]) < 1e-2


def test_folds_are_left_out(labelled):
    folds = labelled.withColumn("fold", F.col("person_id") % 3)
    rows = prepared(folds, CLASSES, "fold")
    coefficients, _, _ = fit_all(rows, [Fit(1, fold, 0.1) for fold in range(3)], len(CLASSES))
    for fold in range(3):
        train = models._one_label(folds.filter(F.col("fold") != fold), "1").withColumn("weight", F.lit(1.0))
        assert np.allclose(coefficients[fold][:3], single(train, 0.1).coefficients.toArray()[:3], atol=1e-4)


def test_passes_do_not_follow_the_labels(labelled):
    rows = prepared(labelled, CLASSES)
    few = fit_all(rows, [Fit(i, -2, 0.1) for i in range(2)], len(CLASSES))[2]
    many = fit_all(rows, [Fit(i % 5, -2, 0.1 + 0.01 * (i // 5)) for i in range(100)], len(CLASSES))[2]
    assert many < few + 25


def test_labels_without_cases_and_predictions(labelled):
    config = models.EstimatorConfig(models.RIDGE, balanced=True)
    joint = models.fit_multilabel(labelled, config, CLASSES, {"regParam": 0.01})
    rows = models.predict_multilabel(joint, labelled)
    assert rows.columns == ["person_id", "class", "y", "p"] and rows.count() == 500 * 6
    assert rows.filter("class = '5' and p <> 0").count() == 0
    scores = {r["class"]: r["roc_auc_score"] for r in metrics.get_scores(rows, "class").collect()}
    assert scores["5"] is None and all(scores[c] > 0.8 for c in CLASSES[:5])


def test_search_agrees_with_single_fits(labelled):
    config = models.EstimatorConfig(models.RIDGE)
    points = [{"regParam": 0.01}, {"regParam": 1.0}]
    _, best, scores, n = models.search_multilabel(labelled, config, CLASSES, points, n_splits=3)
    folds = models.group_folds(labelled, n_splits=3)
    cases = {row["fold"]: row for row in models._cases(folds, CLASSES, "fold")}
    for point, score in scores:
        assert score == pytest.approx(models._single_scores(folds, config, CLASSES, point, "roc_auc", 0, cases), abs=2e-3)
    assert n == 3 and best == max(scores, key=lambda s: s[1])[0]


def test_minimise_many_at_once():
    centres = np.random.default_rng(0).standard_normal((20, 5))
    scales = np.logspace(-2, 2, 5)
    found, passes = minimise(lambda x: (((x - centres) ** 2 * scales).sum(1), 2 * (x - centres) * scales), np.zeros((20, 5)), 200)
    assert np.allclose(found, centres, atol=1e-4) and passes < 200
