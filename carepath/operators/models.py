"""Models on feature vectors: estimators, grouped random search, one model per label."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.constants import OUTCOME, PERSON
from carepath.functions.draws import draw_integer
from carepath.operators.joint import Fit, JointModel, fit_all, prepared, probabilities_of
from carepath.operators.leaf_boosting import Boost, BoostedTrees, Growth, JointTrees, fit_boosted, tree_probabilities
from carepath.operators.metrics import get_scores, get_scores_by
from carepath.operators.splits import class_weights, fold_classes, group_folds
from carepath.session import materialise

RIDGE, FOREST, BOOSTING = "ridge", "random_forests", "hist_gradient_boosting"


@dataclass(frozen=True)
class EstimatorConfig:
    """A named estimator and the values to search for each parameter."""

    estimator_name: str
    parameters: dict[str, list] = field(default_factory=dict)
    balanced: bool = False
    # fixed weights of the classes 0 and 1, or "prevalence": cases weigh their share, others the rest
    class_weight: tuple[float, float] | str | None = None
    # trees grow until their leaves are small; Spark allows no more levels than this
    max_depth: int = 30
    max_iter: int = 100
    max_bins: int = 255

    def build(self, seed: int = 0) -> Estimator:
        columns = {"featuresCol": "features", "labelCol": OUTCOME}
        if self.estimator_name == RIDGE:
            # L2 only; C of the usual notation is 1 / (regParam × rows)
            return LogisticRegression(weightCol="weight", elasticNetParam=0.0, maxIter=self.max_iter, **columns)
        if self.estimator_name == FOREST:
            return RandomForestClassifier(seed=seed, maxMemoryInMB=1024, weightCol="weight", maxDepth=self.max_depth,
                                          maxBins=self.max_bins, **columns)
        raise ValueError(f"unknown estimator {self.estimator_name}")

    def growth(self) -> Growth:
        """Limits of boosting; its rounds stop when the held-out loss no longer gets smaller."""
        return Growth(rounds=self.max_iter, bins=self.max_bins)


# fixed values: searched parameters
ESTIMATORS = {
    RIDGE: EstimatorConfig(RIDGE, {"regParam": [1e-3, 1e-2, 1e-1, 5e-1, 1.0]}, balanced=True),
    FOREST: EstimatorConfig(
        FOREST, {"minInstancesPerNode": [2, 10, 50, 100, 200], "numTrees": [50, 100, 200, 500]}
    ),
    BOOSTING: EstimatorConfig(BOOSTING, {"stepSize": [1e-3, 1e-2, 1e-1, 1.0], "maxLeaves": [10, 20, 30, 50]}),
}


def draw_parameters(config: EstimatorConfig, n_iter: int, seed: int = 0) -> list[dict]:
    """``n_iter`` distinct combinations drawn from the grid, or all of them if there are fewer."""
    grid = [{}]
    for name, values in config.parameters.items():
        grid = [{**point, name: value} for point in grid for value in values]
    return grid if n_iter >= len(grid) else random.Random(seed).sample(grid, n_iter)


def _param_map(estimator: Estimator, point: dict) -> dict:
    return {estimator.getParam(name): value for name, value in point.items()}


def with_features(person: DataFrame, features: DataFrame) -> DataFrame:
    """Join feature vectors (or arrays of numbers) to the persons."""
    if dict(features.dtypes)["features"].startswith("array"):
        features = features.withColumn("features", array_to_vector("features"))
    return person.join(features, PERSON)


def prepare_training(person: DataFrame, config: EstimatorConfig, seed: int = 0, validation: float = 0.1) -> DataFrame:
    """Add the weight of each row and, for boosting, the rows that stop it early."""
    if config.balanced:
        rows = class_weights(person, balanced=True)
    elif config.class_weight == "prevalence":
        rows = class_weights(person)
    else:
        other, case = config.class_weight or (1.0, 1.0)
        rows = person.withColumn("weight", F.when(F.col(OUTCOME) == 1, float(case)).otherwise(float(other)))
    return rows.withColumn("is_validation", _stops_early(seed, validation))


def _stops_early(seed: int, share: float = 0.1) -> Column:
    """Rows that only tell when boosting stops."""
    return draw_integer(PERSON, seed) % 1000 < int(share * 1000)


def predict(model: Model, person: DataFrame, name: str = "p") -> DataFrame:
    """Probability of the outcome for each person."""
    scored = model.transform(person)
    return scored.withColumn(name, vector_to_array("probability")[1]).select(PERSON, OUTCOME, name)


def fit(person: DataFrame, config: EstimatorConfig, parameters: dict | None = None, seed: int = 0) -> Model | BoostedTrees:
    if config.estimator_name == BOOSTING:
        return fit_multilabel(_as_label(person), config, [CASE], parameters, seed).models[0]
    estimator = config.build(seed)
    return estimator.fit(prepare_training(person, config, seed), _param_map(estimator, parameters or {}))


@dataclass
class SearchResult:
    """The refitted model, its point, the scores of all points and the number of folds that could be scored."""

    model: Model | BoostedTrees
    best: dict
    scores: list[tuple[dict, float]]
    n_splits: int


METRICS = {"roc_auc": "areaUnderROC", "average_precision": "areaUnderPR"}


def scorable_folds(rows: DataFrame, group: str, n_splits: int) -> tuple[DataFrame, int]:
    """Folds by group, as many as ``n_splits`` or the most with both classes in each of them.

    A fold with one class has no AUC. Fewer groups than folds, or rare cases, leave such folds.
    """
    for n in range(n_splits, 1, -1):
        folds = group_folds(rows, group, n)
        classes = fold_classes(folds).collect()
        if len(classes) == n and not any(row["one_class"] for row in classes):
            return folds, n
    raise ValueError(f"no two folds by {group} have both classes")


def random_search(
    person: DataFrame,
    config: EstimatorConfig,
    n_iter: int = 10,
    scoring: str = "roc_auc",
    seed: int = 0,
    n_splits: int = 5,
    group: str = "first_care_site_id",
    parallelism: int = 4,
    points: list[dict] | None = None,
) -> SearchResult:
    """Cross-validated random search with hospitals kept whole in a fold.

    ``points`` are drawn from the grid of the estimator unless given. The prepared rows are kept once for all
    folds and points; the points run side by side. Boosting grows the trees of all folds and points together.
    """
    if config.estimator_name == BOOSTING:
        points = draw_parameters(config, n_iter, seed) if points is None else points
        folds, n_splits = scorable_folds(person, group, n_splits)
        folds = _as_label(folds).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            cases = {row["fold"]: row for row in _cases(folds, [CASE], "fold")}
            scores = _joint_scores(folds, config, [CASE], points, scoring, cases, seed)
        finally:
            folds.unpersist()
        best = max(scores, key=lambda s: s[1])[0]
        return SearchResult(fit(person, config, best, seed), best, scores, n_splits)
    estimator = config.build(seed)
    points = draw_parameters(config, n_iter, seed) if points is None else points
    rows, n_splits = scorable_folds(prepare_training(person, config, seed), group, n_splits)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        search = CrossValidator(
            estimator=estimator,
            estimatorParamMaps=[_param_map(estimator, p) for p in points] or ParamGridBuilder().build(),
            evaluator=BinaryClassificationEvaluator(labelCol=OUTCOME, metricName=METRICS[scoring]),
            foldCol="fold",
            numFolds=n_splits,
            parallelism=parallelism,
            seed=seed,
        ).fit(rows)
    finally:
        rows.unpersist()
    best = max(range(len(points)), key=lambda i: search.avgMetrics[i])
    return SearchResult(search.bestModel, points[best], list(zip(points, search.avgMetrics)), n_splits)


#: features up to which all labels are fitted together; beyond, each label has a fit of its own
JOINT_FEATURES = 2048


def fits_together(person: DataFrame, config: EstimatorConfig) -> bool:
    """Whether the labels share the passes over the rows: boosted trees, and linear models of few enough features."""
    if config.estimator_name == BOOSTING:
        return True
    if config.estimator_name != RIDGE:
        return False
    first = person.select(F.size(vector_to_array("features"))).first()
    return first is not None and first[0] <= JOINT_FEATURES


#: the label that stands for the outcome of a person where labels are fitted
CASE = "1"


def _as_label(person: DataFrame) -> DataFrame:
    """The outcome 0 or 1 as a list of labels."""
    return person.withColumn(OUTCOME, F.when(F.col(OUTCOME) == 1, F.array(F.lit(CASE))).otherwise(F.array().cast("array<string>")))


def _together(
    rows: DataFrame, config: EstimatorConfig, n_labels: int, wanted: list[tuple[int, int, dict, tuple[float, float]]]
) -> Callable[[list[int]], Callable]:
    """Fit models for (label, left out fold, parameters, weights) on prepared rows; gives the probabilities of chosen ones."""
    if config.estimator_name == BOOSTING:
        return lambda chosen, models=_boosted(rows, config, wanted): tree_probabilities([models[i] for i in chosen])
    fits = [Fit(label, fold, float(point.get("regParam", 0.0)), weights) for label, fold, point, weights in wanted]
    coefficients, intercepts, _ = fit_all(rows, fits, n_labels, config.max_iter)
    return lambda chosen: probabilities_of(coefficients[chosen], intercepts[chosen])


def _boosted(rows: DataFrame, config: EstimatorConfig, wanted: list[tuple[int, int, dict, tuple[float, float]]]) -> list[BoostedTrees]:
    names = {"stepSize": "rate", "maxLeaves": "leaves"}
    fits = [Boost(label, fold, weights=weights, **{names[n]: v for n, v in point.items()}) for label, fold, point, weights in wanted]
    return fit_boosted(rows, fits, config.growth())[0]


def _joint_rows(person: DataFrame, config: EstimatorConfig, classes: list[str], fold: str | None, seed: int) -> DataFrame:
    """Features, presence of the classes, fold, and for boosting the rows that stop it early, written once."""
    if config.estimator_name != BOOSTING:
        return prepared(person, classes, fold)
    present = F.array(*[F.coalesce(F.array_contains(OUTCOME, c), F.lit(False)).cast("int") for c in classes])
    number = F.lit(-1) if fold is None else F.col(fold).cast("int")
    rows = person.withColumn("is_validation", _stops_early(seed))
    return materialise(rows.select(vector_to_array("features").alias("x"), present.alias("y"), number.alias("fold"),
                                   F.col("is_validation").alias("held")), "joint")


def label_weights(config: EstimatorConfig, cases: int, rows: int) -> tuple[float, float]:
    """Weights of other rows and of cases, as :func:`prepare_training` gives them."""
    rate = cases / rows if rows else 0.0
    if config.balanced:
        return (0.5 / (1 - rate) if rate < 1 else 1.0), (0.5 / rate if rate > 0 else 1.0)
    if config.class_weight == "prevalence":
        return 1 - rate, rate
    return tuple(float(w) for w in config.class_weight or (1.0, 1.0))


def _cases(person: DataFrame, classes: list[str], *by: str) -> list:
    """Rows and cases of each class, overall or by a column."""
    present = [F.count_if(F.array_contains(OUTCOME, c)).alias(c) for c in classes]
    return person.groupBy(*by).agg(F.count("*").alias("n"), *present).collect()


def fit_multilabel(
    person: DataFrame, config: EstimatorConfig, classes: list[str], parameters: dict | None = None, seed: int = 0
) -> dict[str, Model] | JointModel | JointTrees:
    """One binary model per label: boosted trees and linear models together, others one after the other on one kept table."""
    if fits_together(person, config):
        counts = _cases(person, classes)[0]
        if config.estimator_name == BOOSTING:
            wanted = [(i, -2, parameters or {}, label_weights(config, counts[c], counts["n"])) for i, c in enumerate(classes)]
            return JointTrees(list(classes), _boosted(_joint_rows(person, config, classes, None, seed), config, wanted))
        penalty = float((parameters or {}).get("regParam", 0.0))
        fits = [Fit(i, -2, penalty, label_weights(config, counts[c], counts["n"])) for i, c in enumerate(classes)]
        coefficients, intercepts, _ = fit_all(prepared(person, classes), fits, len(classes), config.max_iter)
        return JointModel(list(classes), coefficients, intercepts)
    rows = person.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {label: fit(_one_label(rows, label), config, parameters, seed) for label in classes}
    finally:
        rows.unpersist()


def _one_label(person: DataFrame, label: str) -> DataFrame:
    return person.withColumn(OUTCOME, F.array_contains(OUTCOME, label).cast("int"))


SCORES = {"roc_auc": "roc_auc_score", "average_precision": "average_precision_score"}


def _scored_labels(cases: dict, fold: int, classes: list[str]) -> list[str]:
    """Labels with both classes in a fold and in the others."""
    rest = [row for other, row in cases.items() if other != fold]
    return [
        c for c in classes
        if 0 < cases[fold][c] < cases[fold]["n"] and 0 < sum(row[c] for row in rest) < sum(row["n"] for row in rest)
    ]


def _joint_scores(
    folds: DataFrame, config: EstimatorConfig, classes: list[str], points: list[dict], scoring: str, cases: dict, seed: int
) -> list[tuple[dict, float]]:
    """Mean score of each point over labels and folds; all points, folds and labels are fitted and scored together."""
    rows = _joint_rows(folds, config, classes, "fold", seed)
    fits, of = [], []
    for number, point in enumerate(points):
        for fold in sorted(cases):
            n = sum(row["n"] for other, row in cases.items() if other != fold)
            for label in _scored_labels(cases, fold, classes):
                count = sum(row[label] for other, row in cases.items() if other != fold)
                place = classes.index(label)
                fits.append((place, fold, point, label_weights(config, count, n)))
                of.append((number, fold, place))
    if not fits:
        return [(point, float("nan")) for point in points]
    probabilities = _together(rows, config, len(classes), fits)
    by_fold = {}
    for model, (number, fold, place) in enumerate(of):
        by_fold.setdefault(fold, []).append((model, number, place))
    held = None
    for fold, members in by_fold.items():
        chosen = [m for m, _, _ in members]
        scored = rows.filter(F.col("fold") == fold).withColumn("p", probabilities(chosen)("x"))
        named = F.array(*[F.struct(F.lit(number).alias("point"), F.lit(place).alias("label")) for _, number, place in members])
        exploded = scored.select("fold", "y", F.explode(F.arrays_zip("p", named.alias("m"))).alias("z"))
        part = exploded.select("fold", F.col("z.m.point").alias("point"), F.col("z.m.label").alias("label"), F.col("z.p").alias("p"),
                               F.get("y", F.col("z.m.label")).cast("int").alias("y"))
        held = part if held is None else held.unionByName(part)
    means = get_scores_by(held, ["point", "fold", "label"]).groupBy("point").agg(F.avg(SCORES[scoring]).alias("mean")).collect()
    found = {row["point"]: row["mean"] for row in means}
    return [(point, float("nan") if found.get(i) is None else found[i]) for i, point in enumerate(points)]


def search_multilabel(
    person: DataFrame,
    config: EstimatorConfig,
    classes: list[str],
    points: list[dict],
    scoring: str = "roc_auc",
    seed: int = 0,
    n_splits: int = 5,
    group: str = "first_care_site_id",
) -> tuple[dict[str, Model] | JointModel | JointTrees, dict, list[tuple[dict, float]], int]:
    """Models of the best point: the one with the best mean score over labels and folds.

    All labels share the folds of a point. A label with one class in a part of a fold is left out of that
    fold's mean; labels without any score do not count. Linear models and boosted trees are fitted together, whatever the number of points, folds and
    labels. Returns models, point, scores, folds.
    """
    folds = group_folds(person, group, n_splits).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cases = {row["fold"]: row for row in _cases(folds, classes, "fold")}
        if fits_together(person, config):
            scores = _joint_scores(folds, config, classes, points, scoring, cases, seed)
        else:
            scores = [(point, _single_scores(folds, config, classes, point, scoring, seed, cases)) for point in points]
    finally:
        folds.unpersist()
    best = max(scores, key=lambda s: -math.inf if math.isnan(s[1]) else s[1])[0]
    return fit_multilabel(person, config, classes, best, seed), best, scores, len(cases)


def _single_scores(
    folds: DataFrame, config: EstimatorConfig, classes: list[str], point: dict, scoring: str, seed: int, cases: dict
) -> float:
    """Mean score of a point, one fit for each label and fold."""
    found = []
    for fold in sorted(cases):
        labels = _scored_labels(cases, fold, classes)
        if not labels:
            continue
        train = folds.filter(F.col("fold") != fold).drop("fold")
        fitted = {c: fit(_one_label(train, c), config, point, seed) for c in labels}
        rows = predict_multilabel(fitted, folds.filter(F.col("fold") == fold))
        found += [row[SCORES[scoring]] for row in get_scores(rows, "class").collect()]
    return sum(found) / len(found) if found else float("nan")


def predict_multilabel(models: dict[str, Model] | JointModel | JointTrees, person: DataFrame) -> DataFrame:
    """One row per (person, class) with the presence and the probability of the class."""
    if isinstance(models, JointModel | JointTrees):
        names = F.array(*[F.lit(c) for c in models.classes])
        scored = person.withColumn("_p", models.probabilities(vector_to_array("features")))
        long = scored.select(PERSON, OUTCOME, F.explode(F.arrays_zip(names.alias("class"), F.col("_p").alias("p"))).alias("_s"))
        return long.select(PERSON, "_s.class", F.array_contains(OUTCOME, F.col("_s.class")).cast("int").alias("y"), "_s.p")
    scored, columns = person, []
    for label, model in models.items():
        outputs = {"featuresCol": "features", "predictionCol": f"_prediction_{label}",
                   "probabilityCol": f"_probability_{label}", "rawPredictionCol": f"_raw_{label}"}
        scored = model.copy({model.getParam(k): v for k, v in outputs.items()}).transform(scored)
        columns.append(
            F.struct(
                F.lit(label).alias("class"),
                F.array_contains(OUTCOME, label).cast("int").alias("y"),
                vector_to_array(f"_probability_{label}")[1].alias("p"),
            )
        )
    return scored.select(PERSON, F.explode(F.array(*columns)).alias("_s")).select(PERSON, "_s.*")
