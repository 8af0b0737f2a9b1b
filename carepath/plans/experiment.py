"""An experiment: features × estimators × sizes × seeds, one run record each."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, fields, replace
from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.constants import ICD10_CHAPTERS, INCLUSION_START, OUTCOME, PERSON
from carepath.functions.dates import add_age, get_date_details
from carepath.operators.embeddings import count_svd, embed_codes
from carepath.operators.events import build_vocabulary, keep_persons_with_events, restrict_to_vocabulary
from carepath.operators.features import (
    count_vectors,
    decay_name,
    decayed_features,
    demographics_pipeline,
    embedding_features,
    index_codes,
    last_diagnosis_features,
    random_projection,
)
from carepath.operators.metrics import (
    get_binary_scores,
    get_prognosis_prevalence,
    get_scores,
    scores_as_columns,
)
from carepath.operators.models import (
    EstimatorConfig,
    draw_parameters,
    predict,
    predict_multilabel,
    random_search,
    search_multilabel,
    with_features,
)
from carepath.operators.runs import DECAY_COLUMN
from carepath.operators.splits import compute_person_subsample, person_split
from carepath.operators.tasks import NaivePrognosisBaseline, label_scores
from carepath.session import materialise
from carepath.sources.run_ledger import RunLedger, run_key

# fixed values: names of the featurizers
DEMOGRAPHICS = "Demographics"
COUNTS = "Count Encoding"
COUNTS_SVD = "Count Encoding + SVD"
COUNTS_PROJECTION = "Count Encoding + random projection"
LOCAL_EMBEDDINGS = "Local Embeddings"
GIVEN_EMBEDDINGS = "Embeddings"
N_COMPONENTS = 30


@dataclass(frozen=True)
class ExperimentConfig:
    """The grid and what is common to its runs.

    Static features are added to those of events; they are the only ones of ``Demographics``.
    """

    estimators: list[EstimatorConfig]
    featurizers: list[str]
    subtrain_sizes: list[float] = (1.0,)
    seeds: list[int] = (0,)
    # lists of decays to choose from; the search draws one with the parameters of the estimator
    decays: list[list[float]] = ((0,),)
    n_min_events: int = 10
    n_iter: int = 10
    scoring: str = "roc_auc"
    window_radius_in_days: int = 30
    d: int = N_COMPONENTS
    n_splits: int = 5
    search_seed: int = 0
    positive_ratio: float | None = None
    validation_size: float | None = None
    static_categorical: list[str] = ()
    static_numerical: list[str] = ()
    # chapters of past diagnoses as further inputs
    past_chapters: bool = False

    @property
    def n_demographics(self) -> int:
        return len(self.static_categorical) + len(self.static_numerical) + self.past_chapters * len(ICD10_CHAPTERS)


def add_static_features(person: DataFrame) -> DataFrame:
    """Inclusion month and weekday, and the age at inclusion."""
    dated = get_date_details(person, INCLUSION_START).drop("inclusion_time_of_day")
    return add_age(dated, INCLUSION_START, colname_age="age_at_inclusion_event_start")


def build_features(
    name: str,
    config: ExperimentConfig,
    event: DataFrame,
    train: DataFrame,
    embeddings: DataFrame | None = None,
    decays: list[float] = (0,),
) -> DataFrame:
    """Features of every person, one block per decay; what is learnt (embeddings, SVD) is learnt on train persons."""
    weights = [decay_name(decay) for decay in decays]
    if name == LOCAL_EMBEDDINGS:
        train_event = event.join(train.select(PERSON), PERSON, "left_semi")
        embeddings = materialise(embed_codes(train_event, config.window_radius_in_days, config.d), "embeddings")
    if name in (LOCAL_EMBEDDINGS, GIVEN_EMBEDDINGS):
        dimension = len(embeddings.first()["embedding"])
        return embedding_features(event, embeddings, dimension, decays)
    counts = decayed_features(event, decays)
    if name == COUNTS:
        return count_vectors(counts, index_codes(event.select("event_source_concept_id")), weights)
    if name == COUNTS_SVD:
        return count_svd(counts, weights, config.d, train)
    if name == COUNTS_PROJECTION:
        return random_projection(counts, weights, config.d)
    raise ValueError(f"unknown featurizer {name}")


def assemble(
    name: str, config: ExperimentConfig, train: DataFrame, others: list[DataFrame], features: DataFrame | None
) -> list[DataFrame]:
    """Event and static features in one vector, for the train persons and the others.

    Categories, means and deviations of static features come from the train persons.
    """
    chapters = [f"c_{c}" for c in ICD10_CHAPTERS] if config.past_chapters else []
    statics = [*config.static_categorical, *config.static_numerical, *chapters]
    if not statics and features is None:
        raise ValueError(f"{name} needs static features")
    parts = [train, *others]
    if features is not None:
        parts = [with_features(part, features) for part in parts]
    if not statics:
        return parts
    model = demographics_pipeline(
        list(config.static_categorical), list(config.static_numerical), chapters, output="statics"
    ).fit(parts[0])
    inputs = ["statics"] if features is None else ["features", "statics"]
    joined = VectorAssembler(inputCols=inputs, outputCol="_all")
    kept = [column for column in parts[0].columns if column != "features"]
    return [
        joined.transform(model.transform(part)).select(*kept, F.col("_all").alias("features")) for part in parts
    ]


def _described(rows: DataFrame) -> dict:
    return rows.agg(
        F.count("*").alias("n"), (100 * F.avg(F.col(OUTCOME).cast("double"))).alias("prevalence")
    ).first().asDict()


def _prepare(person: DataFrame, event: DataFrame, dataset_split: DataFrame, config: ExperimentConfig, icd10_tree=None):
    """Events of frequent codes, the persons having some in train and in test, and sizes for the run records."""
    vocabulary = materialise(build_vocabulary(event, config.n_min_events), "vocabulary")
    kept = materialise(restrict_to_vocabulary(event, vocabulary), "event")
    persons = add_static_features(keep_persons_with_events(person, kept)).join(
        dataset_split.select(PERSON, "dataset"), PERSON
    )
    if config.past_chapters:
        past = NaivePrognosisBaseline(event, icd10_tree).predict(persons)
        persons = persons.join(last_diagnosis_features(past, list(ICD10_CHAPTERS)), PERSON)
    persons = materialise(persons, "person")
    sizes = {
        "n_person_raw": person.count(),
        "n_event_raw": event.count(),
        "n_codes_raw": event.select("event_source_concept_id").distinct().count(),
        "n_codes_featurizer": vocabulary.count(),
        "n_min_events": config.n_min_events,
        "n_demographics": config.n_demographics,
    }
    return kept, persons.filter("dataset = 'train'"), persons.filter("dataset = 'external_test'"), sizes


def joint_points(name: str, estimator: EstimatorConfig, config: ExperimentConfig) -> dict[tuple, list[dict]]:
    """Drawn points by their decays: decays and parameters of the estimator are searched together."""
    decays = [tuple(d) for d in config.decays] if name != DEMOGRAPHICS else [()]
    joint = replace(estimator, parameters={**estimator.parameters, "decays": decays})
    points: dict[tuple, list[dict]] = {}
    for point in draw_parameters(joint, config.n_iter, config.search_seed):
        points.setdefault(point["decays"], []).append({k: v for k, v in point.items() if k != "decays"})
    return points


class Parts:
    """Rows of each part with their features, written once for each list of decays."""

    def __init__(self, name, config, event, train, others: dict[str, DataFrame], embeddings):
        self.arguments = name, config, event, train, others, embeddings
        self.written: dict[tuple, dict[str, DataFrame]] = {}
        self.seconds = 0.0

    def of(self, decays: tuple) -> dict[str, DataFrame]:
        if decays not in self.written:
            name, config, event, train, others, embeddings = self.arguments
            started = time.monotonic()
            features = None if name == DEMOGRAPHICS else build_features(name, config, event, train, embeddings, decays)
            rows = assemble(name, config, train, list(others.values()), features)
            self.written[decays] = {part: materialise(r, part) for part, r in zip(["train", *others], rows)}
            self.seconds += time.monotonic() - started
        return self.written[decays]


def _common(name: str, estimator: EstimatorConfig, size: float, seed: int, decays: tuple, best: dict) -> dict:
    """Fields of the records of both grids, under the names that the run tables read."""
    return {
        "estimator": estimator.estimator_name,
        "featurizer": name,
        "subtrain_size": float(size),
        "splitting_rs": seed,
        DECAY_COLUMN: str(list(decays)) if decays else None,
        "pipeline_best_params_estimator": str(best),
    }


class Runs:
    """The runs of a grid: which are open, and their records.

    With a ledger a record is stored when its run ends, and runs that are stored are not made again. ``data`` names what the grid runs on
    and is part of the key of a run, as are all settings of the grid.
    """

    def __init__(self, config: ExperimentConfig, ledger: RunLedger | None, data: str, kind: str):
        varied = {"estimators", "featurizers", "subtrain_sizes", "seeds"}
        settings = {f.name: getattr(config, f.name) for f in fields(config) if f.name not in varied}
        self.common = {"kind": kind, "data": data, "settings": settings}
        self.ledger, self.records, self.planned = ledger, {}, []
        for name, seed, size in product(config.featurizers, config.seeds, config.subtrain_sizes):
            self.planned += [self.of(name, estimator, size, seed) for estimator in config.estimators]

    def of(self, name: str, estimator: EstimatorConfig | None, size: float | None, seed: int | None) -> dict:
        return {
            **self.common, "featurizer": name, "estimator": asdict(estimator) if estimator else "naive_baseline",
            "subtrain_size": None if size is None else float(size), "seed": seed,
        }

    def plan(self, *more: dict) -> set[str]:
        """Keys of the runs to make; ``more`` are planned behind the grid."""
        self.planned += more
        positions = range(len(self.planned)) if self.ledger is None else self.ledger.open_runs(self.planned)
        self.open = {run_key(self.planned[i]) for i in positions}
        return self.open

    def is_open(self, *run) -> bool:
        return run_key(self.of(*run)) in self.open

    def add(self, run: tuple, record: dict) -> None:
        planned = self.of(*run)
        if self.ledger is None:
            self.records[run_key(planned)] = record
        else:
            self.ledger.append(planned, record)

    def all(self) -> list[dict]:
        """Records in the order of the grid."""
        if self.ledger is not None:
            return self.ledger.run(self.planned, lambda _: {})
        return [self.records[run_key(planned)] for planned in self.planned]


def run_grid(
    person: DataFrame,
    event: DataFrame,
    dataset_split: DataFrame,
    config: ExperimentConfig,
    embeddings: DataFrame | None = None,
    icd10_tree: DataFrame | None = None,
    ledger: RunLedger | None = None,
    data: str = "",
) -> list[dict]:
    """Run every combination on a binary outcome and return its record: parameters, sizes,
    prevalences, scores.

    Decays are searched with the parameters of the estimator. The features of a (featurizer, seed, size, decays) are
    written once for its estimators. With a ``ledger`` each record is stored when its run ends, and a grid that was ended
    goes on with its open runs; ``data`` names the inputs.
    """
    grid = Runs(config, ledger, data, "binary")
    if not grid.plan():
        return grid.all()
    event, train_all, test, sizes = _prepare(person, event, dataset_split, config, icd10_tree)
    for name, seed, size in product(config.featurizers, config.seeds, config.subtrain_sizes):
        if not any(grid.is_open(name, estimator, size, seed) for estimator in config.estimators):
            continue
        others = {"test": test}
        train = train_all
        if config.validation_size is not None:
            others["validation"] = materialise(
                compute_person_subsample(train_all, config.validation_size, None, seed), "validation"
            )
            train = train_all.join(others["validation"].select(PERSON), PERSON, "left_anti")
        train = materialise(compute_person_subsample(train, size, config.positive_ratio, seed), "train")
        parts = Parts(name, config, event, train, others, embeddings)
        for estimator in config.estimators:
            run = (name, estimator, size, seed)
            if not grid.is_open(*run):
                continue
            if config.positive_ratio is not None:
                estimator = replace(estimator, class_weight="prevalence", balanced=False)
            started, before = time.monotonic(), parts.seconds
            searches = {
                decays: random_search(
                    parts.of(decays)["train"], estimator, config.n_iter, config.scoring, config.search_seed,
                    config.n_splits, points=points,
                )
                for decays, points in joint_points(name, estimator, config).items()
            }
            decays = max(searches, key=lambda d: max(score for _, score in searches[d].scores))
            search, written = searches[decays], parts.of(decays)
            record = {
                **_common(name, estimator, size, seed, decays, search.best), **sizes, "n_folds": search.n_splits,
                "positive_ratio": config.positive_ratio,
            }
            for part, rows in written.items():
                prefix = "" if part == "test" else f"{part}_"
                described = _described(rows)
                scores = get_binary_scores(predict(search.model, rows)).first().asDict()
                record |= {f"{prefix}{key}": value for key, value in scores.items()}
                record[f"n_person_{part}"] = described["n"]
                record[f"{part}_prevalence"] = described["prevalence"]
            record["n_person_subtrain"] = record["n_person_train"]
            # features made for an estimator before this one count for this one too
            record["compute_time"] = time.monotonic() - started + before
            grid.add(run, record)
    return grid.all()


def _prevalences(rows: DataFrame, classes: list[str], part: str) -> dict[str, float]:
    found = {row["class"]: row["prevalence"] for row in get_prognosis_prevalence(rows).collect()}
    return {f"{part}_prevalence_{c}": found.get(c, 0.0) for c in classes}


def run_multilabel_grid(
    person: DataFrame,
    event: DataFrame,
    dataset_split: DataFrame,
    config: ExperimentConfig,
    classes: list[str],
    icd10_tree: DataFrame,
    embeddings: DataFrame | None = None,
    ledger: RunLedger | None = None,
    data: str = "",
) -> list[dict]:
    """The grid for a list of labels: one model per label, and the past diagnoses as a baseline.

    Points are compared by cross-validation over all labels. Sizes are shares of all train persons, also when some of them are
    kept for validation. The baseline sees all events, rare codes too. ``ledger`` and ``data`` are those of :func:`run_grid`.
    """
    grid = Runs(config, ledger, f"{data}:{','.join(classes)}", "multilabel")
    if not grid.plan(grid.of("None", None, None, None)):
        return grid.all()
    all_events = event
    event, train_all, test, sizes = _prepare(person, event, dataset_split, config, icd10_tree)
    common = {**sizes, **_prevalences(test, classes, "test")}
    for name, seed, size in product(config.featurizers, config.seeds, config.subtrain_sizes):
        if not any(grid.is_open(name, estimator, size, seed) for estimator in config.estimators):
            continue
        train, share = train_all, float(size)
        if config.validation_size is not None:
            _, train = person_split(train_all, train_size=config.validation_size, random_seed=seed)
            share = min(1.0, size * train_all.count() / train.count())
        train, _ = person_split(train, train_size=1 if share == 1.0 else share, random_seed=seed)
        parts = Parts(name, config, event, materialise(train, "train"), {"test": test}, embeddings)
        for estimator in config.estimators:
            if not grid.is_open(name, estimator, size, seed):
                continue
            started, before = time.monotonic(), parts.seconds
            found = {
                decays: search_multilabel(
                    parts.of(decays)["train"], estimator, classes, points, config.scoring, seed, config.n_splits
                )
                for decays, points in joint_points(name, estimator, config).items()
            }
            decays = max(found, key=lambda d: max(-1.0 if score != score else score for _, score in found[d][2]))
            fitted, best, _, n_folds = found[decays]
            train_rows, test_rows = parts.of(decays)["train"], parts.of(decays)["test"]
            scores = scores_as_columns(get_scores(predict_multilabel(fitted, test_rows), "class"))
            train_scores = scores_as_columns(get_scores(predict_multilabel(fitted, train_rows), "class"))
            grid.add(
                (name, estimator, size, seed),
                {
                    **_common(name, estimator, size, seed, decays, best),
                    "n_folds": n_folds,
                    "n_person_subtrain": train_rows.count(),
                    "n_person_test": test_rows.count(),
                    **scores,
                    **{f"train_{key}": value for key, value in train_scores.items()},
                    **common,
                    **_prevalences(train_rows, classes, "train"),
                    "compute_time": time.monotonic() - started + before,
                }
            )
    if not grid.is_open("None", None, None, None):
        return grid.all()
    started = time.monotonic()
    baseline = NaivePrognosisBaseline(all_events, icd10_tree).predict_proba(test, classes)
    truth = label_scores(test, OUTCOME, classes, OUTCOME)
    rows = baseline.join(truth, [PERSON, "class"]).withColumn("p", F.col("score").cast("double"))
    grid.add(
        ("None", None, None, None),
        {
            "estimator": "naive_baseline",
            "featurizer": "None",
            "n_person_test": test.count(),
            **scores_as_columns(get_scores(rows, "class")),
            **common,
            "compute_time": time.monotonic() - started,
        }
    )
    return grid.all()
