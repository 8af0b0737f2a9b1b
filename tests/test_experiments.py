import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from carepath.constants import ICD10_CHAPTERS
from carepath.functions.dates import add_age, days_between, force_datetime, get_time_of_day, reconstruct_birth
from carepath.functions.draws import exact_sample
from carepath.operators import embeddings, features, metrics, models, splits
from carepath.operators.quality import absurd_months, heatmap_matrix, temporal_heatmap, time_plot
from carepath.sources.cohort import EventCohort


@pytest.mark.parametrize(
    "train_size, test_size, expected", [(0.5, None, 1), (None, 0.5, 1), (1, None, 2)]
)
def test_event_train_test_split(cohort, train_size, test_size, expected):
    person, event = cohort
    train_event, test_event, train, test = splits.event_train_test_split(
        EventCohort(person, event), train_size, test_size, 0
    )
    assert train.count() == expected
    assert test.count() == person.count() - expected
    assert train_event.count() + test_event.count() == event.count()


@pytest.mark.parametrize("size", [0, 1, 137, 999, 1000, 2000])
def test_exact_sample(spark, size):
    ids = spark.range(1000).withColumnRenamed("id", "person_id")
    sample = exact_sample(ids, "person_id", size, 4)
    kept = {r[0] for r in sample.collect()}
    assert len(kept) == min(size, 1000)
    assert kept == {r[0] for r in exact_sample(ids.repartition(5), "person_id", size, 4).collect()}


def test_subsample(spark):
    person = spark.range(1000).select(F.col("id").alias("person_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))

    def sizes(*arguments):
        return {r["y"]: r["count"] for r in splits.compute_person_subsample(person, *arguments).groupBy("y").count().collect()}

    assert sizes(0.5) == {1: 50, 0: 450}
    assert sizes(0.1, 0.5) == {1: 50, 0: 50}
    # never more cases than there are
    assert sizes(0.5, 0.5) == {1: 100, 0: 250}
    with pytest.raises(ValueError):
        splits.compute_person_subsample(person.filter("y = 1"), 0.5)


def test_group_folds(spark):
    sizes = {"a": 50, "b": 30, "c": 20, "d": 20, "e": 10, None: 5}
    rows = [(i, g) for g, n in sizes.items() for i in range(n)]
    person = spark.createDataFrame(rows, "person_id long, first_care_site_id string")
    folds = splits.group_folds(person, n_splits=3)
    by_group = {r[0]: r[1] for r in folds.select("first_care_site_id", "fold").distinct().collect()}
    assert len(by_group) == 6
    loads = Counter(r["fold"] for r in folds.collect())
    assert sorted(loads.values()) == [40, 45, 50]


def scores_by_hand(pairs):
    positives = [p for y, p in pairs if y == 1]
    negatives = [p for y, p in pairs if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in positives for b in negatives)
    precision = recall = 0.0
    average = 0.0
    for threshold in sorted({p for _, p in pairs}, reverse=True):
        chosen = [y for y, p in pairs if p >= threshold]
        precision, new_recall = sum(chosen) / len(chosen), sum(chosen) / len(positives)
        average += (new_recall - recall) * precision
        recall = new_recall
    return {
        "brier_score_loss": sum((p - y) ** 2 for y, p in pairs) / len(pairs),
        "roc_auc_score": wins / len(positives) / len(negatives),
        "accuracy_score": sum((p > 0.5) == (y == 1) for y, p in pairs) / len(pairs),
        "average_precision_score": average,
        "tn": sum(p <= 0.5 for p in negatives),
        "fp": sum(p > 0.5 for p in negatives),
        "fn": sum(p <= 0.5 for p in positives),
        "tp": sum(p > 0.5 for p in positives),
    }


def test_scores_with_ties_and_extremes(spark):
    draw = random.Random(1)
    pool = [0.0, 1.0, 0.5, 1e-12, 1e-9, 1 - 1e-12, 1 - 1e-9, 0.25] + [draw.random() ** 8 for _ in range(60)]
    pairs = [(draw.randrange(2), draw.choice(pool)) for _ in range(400)]
    found = metrics.get_binary_scores(spark.createDataFrame(pairs, "y int, p double")).first().asDict()
    expected = scores_by_hand(pairs)
    assert list(found) == list(expected)
    for name, value in expected.items():
        assert math.isclose(found[name], value, rel_tol=1e-9), name


def test_scores_by_class(spark):
    one = [(0, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (1, 0.5)]
    rows = [(str(c), y, p) for c in range(5) for y, p in one]
    scores = metrics.get_scores(spark.createDataFrame(rows, "class string, y int, p double"), "class")
    columns = metrics.scores_as_columns(scores)
    names = list(scores_by_hand(one))
    assert list(columns) == [f"c_{c}__score_{name}" for c in range(5) for name in names]
    assert columns["c_3__score_roc_auc_score"] == pytest.approx(scores_by_hand(one)["roc_auc_score"])


def test_one_class_has_no_auc(spark):
    row = metrics.get_binary_scores(spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, p double")).first()
    assert row["roc_auc_score"] is None and row["tp"] == 1


def test_prevalence(spark):
    target = spark.createDataFrame([(1, ["2"]), (2, ["11"]), (3, ["9", "11", "2"])], "person_id int, y array<string>")
    rows = metrics.get_prognosis_prevalence(target, ICD10_CHAPTERS).collect()
    assert {(r["label"], round(r["prevalence"], 3)) for r in rows} == {
        ("Neoplasms", 66.667), ("Diseases of the digestive system", 66.667),
        ("Diseases of the circulatory system", 33.333),
    }
    assert rows[-1]["class"] == "9"


@pytest.mark.parametrize(
    "moment, expected",
    [("07:00:00", "morning"), ("12:00:00", "afternoon"), ("22:00:00", "night"), ("05:00:00", "night")],
)
def test_time_of_day(spark, moment, expected):
    row = spark.sql(f"select timestamp_ntz'2020-01-01 {moment}' t").select(get_time_of_day("t")).first()
    assert row[0] == expected


def test_ages(person):
    assert "age_in_2022" in add_age(person, 2022).columns
    aged = add_age(person, "death_datetime").filter("person_id = 3").first()
    assert aged["age_to_death_datetime"] == (datetime(2021, 1, 25, 1, 11, 47) - datetime(1980, 10, 22, 4, 3, 49)).days / 365
    with pytest.raises(ValueError):
        add_age(person, "unknown")


def test_whole_days_round_down(spark):
    row = spark.sql("select timestamp_ntz'2020-01-02 00:00:01' a, timestamp_ntz'2020-01-01' b").select(
        days_between("a", "b"), days_between("b", "a")
    ).first()
    assert tuple(row) == (-2, 1)


def test_unreadable_datetimes_are_null(spark):
    texts = spark.createDataFrame([("2020-01-01 03:00:00",), ("?",)], "start string")
    assert [r[0] for r in force_datetime(texts).collect()] == [datetime(2020, 1, 1, 3), None]


def test_birth_from_age(spark, person):
    visits = spark.createDataFrame(
        [(1, datetime(2020, 1, 31), 1), (1, datetime(2021, 1, 1), 20)],
        "person_id long, start_date timestamp_ntz, age_visit_in_month_num int",
    )
    rows = reconstruct_birth(person, visits).collect()
    assert [(r["person_id"], r["birth_datetime"]) for r in rows] == [(1, datetime(2020, 1, 1))]


def test_months_and_absurd_years(spark, cohort):
    _, event = cohort
    old = event.limit(1).withColumn("start", F.lit("1789-07-14").cast("timestamp_ntz"))
    months = time_plot(event.unionByName(old))
    assert months.columns == ["year", "month", "count", "day", "year-month"]
    counts = {(r["year"], r["month"]): r["count"] for r in months.collect()}
    assert counts == Counter((r["start"].year, r["start"].month) for r in event.collect())
    assert absurd_months(event.unionByName(old)).first()["year"] == 1789


def test_heatmap(cohort):
    _, event = cohort
    heatmap = temporal_heatmap(event, "event_source_concept_id")
    cells = {(r["concept"], r["year"]): r["n_events"] for r in heatmap.collect()}
    assert cells[("48891-6", 2019)] == 2 and cells[("GFEA004", 2019)] == 0
    matrix = heatmap_matrix(heatmap, [2019, 2021])
    assert matrix.filter("concept = '48891-6'").first()["2019"] == 2
    with pytest.raises(ValueError):
        temporal_heatmap(event, "unknown")


@pytest.fixture(scope="module")
def new_event(spark):
    rows = [(5, "A04AA01"), (5, "A04AA01"), (5, "GFEA004"), (6, "OOV001")] + [(7, "48891-6")] * 3
    follow = {5: datetime(2021, 1, 7), 6: datetime(2021, 1, 5), 7: datetime(2021, 1, 7)}
    return spark.createDataFrame(
        [(p, c, datetime(2021, 1, 5), follow[p]) for p, c in rows],
        "person_id long, event_source_concept_id string, start timestamp_ntz, followup_start timestamp_ntz",
    )


def test_decayed_counts(new_event):
    rows = {
        (r["person_id"], r["event_source_concept_id"]): r
        for r in features.decayed_features(new_event, [0, 1]).collect()
    }
    assert rows[(5, "A04AA01")]["decay_0"] == 2
    assert rows[(5, "A04AA01")]["decay_1"] == pytest.approx(2 * math.exp(-2))
    assert rows[(6, "OOV001")]["decay_1"] == 1
    assert rows[(7, "48891-6")]["decay_1"] == pytest.approx(3 * math.exp(-2))


def test_count_vectors(new_event):
    counts = features.decayed_features(new_event, [0, 1])
    vectors = features.count_vectors(counts, ["48891-6", "A04AA01", "GFEA004"], ["decay_0", "decay_1"])
    rows = {r["person_id"]: r["features"] for r in vectors.collect()}
    assert set(rows) == {5, 7}
    assert rows[5].toArray() == pytest.approx([0, 2, 1, 0, 2 * math.exp(-2), math.exp(-2)])


def test_embedding_sums(spark, new_event):
    table = spark.createDataFrame(
        [("A04AA01", [1.0, 2.0]), ("GFEA004", [0.5, -1.0])], "event_source_concept_id string, embedding array<float>"
    )
    rows = features.embedding_features(new_event, table, 2, [0, 1]).collect()
    assert [r["person_id"] for r in rows] == [5]
    decay = math.exp(-2)
    assert rows[0]["features"] == pytest.approx([2.5, 3.0, 2.5 * decay, 3.0 * decay])


@pytest.fixture(scope="module")
def many_events(spark):
    draw = random.Random(5)
    rows = []
    for i in range(600):
        # a third of the events belong to one person, a third have one code
        person = 0 if draw.random() < 0.34 else draw.randrange(1, 15)
        code = "c0" if draw.random() < 0.34 else f"c{draw.randrange(1, 9)}"
        rows.append((person, i, datetime(2020, 1, 1) + timedelta(hours=draw.randrange(24 * 120)), code))
    table = spark.createDataFrame(
        rows, "person_id long, visit_occurrence_id long, start timestamp_ntz, event_source_concept_id string"
    )
    return rows, table


@pytest.mark.parametrize("radius, hot_cells", [(0, 4096), (1, 4096), (7, 4096), (7, 5), (30, 11)])
def test_cooccurrence(many_events, radius, hot_cells):
    rows, table = many_events
    expected = Counter()
    for p, i, t, c in rows:
        for q, j, u, d in rows:
            if p == q and i != j and abs((t.date() - u.date()).days) <= radius:
                expected[(c, d)] += 1
    pairs = embeddings.cooccurrence(table, radius, hot_cells=hot_cells)
    assert {(r["code"], r["context"]): r["n_pairs"] for r in pairs.collect()} == dict(expected)


def test_embed_codes_factors_ppmi(many_events):
    _, table = many_events
    matrix = embeddings.ppmi(embeddings.cooccurrence(table, 30))
    cells = {(r["code"], r["context"]): r["ppmi"] for r in matrix.collect()}
    rows, values, columns = embeddings.truncated_svd(matrix, "code", "context", "ppmi", len({c for _, c in cells}))
    import numpy as np

    codes = sorted({c for c, _ in cells})
    dense = np.array([[cells.get((c, d), 0.0) for d in columns] for c in codes])
    assert values == pytest.approx(list(np.linalg.svd(dense)[1][: len(values)]), abs=1e-6)
    left = {r["code"]: r["embedding"] for r in rows.collect()}
    scaled = np.array([left[c] for c in codes])
    # rows of U·√Σ: their Gram matrix is U·Σ·Uᵗ
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(scaled @ scaled.T, (u[:, : len(values)] * s[: len(values)]) @ u[:, : len(values)].T, atol=1e-6)
    vectors = embeddings.embed_codes(table, 30, 4)
    assert all(len(r["embedding"]) <= 4 for r in vectors.collect())


def test_embedding_files(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"a": [1.0, 2.0], "b": [3.0, 4.5]}')
    read = embeddings.read_embeddings(spark, str(tmp_path / "e.json"), "code")
    assert {r["code"]: r["embedding"] for r in read.collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.5]}
    wide = spark.createDataFrame([(0, 1.0, 3.0), (1, 2.0, 4.5)], "dimension int, a double, b double")
    tidy = embeddings.melt_embedding_columns(wide, "code")
    assert {r["code"]: r["embedding"] for r in tidy.collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.5]}


def test_drawn_parameters():
    config = models.ESTIMATORS[models.FOREST]
    points = models.draw_parameters(config, 10, 0)
    assert len(points) == 10 and len({str(p) for p in points}) == 10
    assert points == models.draw_parameters(config, 10, 0)
    assert len(models.draw_parameters(models.ESTIMATORS[models.RIDGE], 10)) == 5


@pytest.fixture(scope="module")
def learnable(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        x = [draw.gauss(0, 1), draw.gauss(0, 1)]
        rows.append((i, str(i % 7), int(x[0] + 0.3 * draw.gauss(0, 1) > 0.8), x))
    table = spark.createDataFrame(rows, "person_id long, first_care_site_id string, y int, features array<double>")
    return models.with_features(table.drop("features"), table.select("person_id", "features"))


@pytest.mark.parametrize(
    "name, parameters",
    [
        (models.RIDGE, {"regParam": 0.01}),
        (models.FOREST, {"numTrees": 10, "minInstancesPerNode": 2}),
        (models.BOOSTING, {"stepSize": 0.1, "maxLeaves": 10}),
    ],
)
def test_models_learn(learnable, name, parameters):
    model = models.fit(learnable, models.ESTIMATORS[name], parameters)
    assert metrics.get_binary_scores(models.predict(model, learnable)).first()["roc_auc_score"] > 0.9


def test_random_search(learnable):
    found = models.random_search(learnable, models.ESTIMATORS[models.RIDGE], n_iter=2, n_splits=3)
    assert len(found.scores) == 2 and found.best == max(found.scores, key=lambda s: s[1])[0]


def test_multilabel(learnable):
    labelled = learnable.withColumn("y", F.when(F.col("y") == 1, F.array(F.lit("2"))).otherwise(F.array(F.lit("9"))))
    fitted = models.fit_multilabel(labelled, models.EstimatorConfig(models.RIDGE), ["2", "9"])
    scores = metrics.get_scores(models.predict_multilabel(fitted, labelled), "class")
    assert all(r["roc_auc_score"] > 0.9 for r in scores.collect())
