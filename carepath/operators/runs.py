"""Tables of experiment runs: cleaning, long form, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.constants import DECAY_LABELS, DEMOGRAPHIC_LABELS, MODEL_LABELS, PREVALENCE_BINS, SCORE_NAMES
from carepath.functions.sizes import small_side
from carepath.operators.ordered import CHUNK, HOT_ROWS, previous_value, running_sum, with_chunks

DECAY_COLUMN = "pipeline_best_params_event_transformer__decay_half_life_in_days"
ICD10_N_CHAPTERS = 21
RUN_IDS = [
    "splitting_rs", "estimator", "featurizer", "n_demographics", "n_person_subtrain", "compute_time",
    "estimator_label", "demographic_label", "decay_label",
]


def _label(column: str, labels: dict) -> Column:
    """A label for known values, the value itself otherwise."""
    text = F.col(column).cast("string")
    pairs = F.create_map(*[F.lit(str(item)) for pair in labels.items() for item in pair])
    return F.coalesce(pairs[text], text)


def clean_runs(runs: DataFrame, featurizer_labels: dict[str, str] | None = None) -> DataFrame:
    """Readable labels of estimators, featurizers, static features and decays."""
    decay = _label(DECAY_COLUMN, DECAY_LABELS) if DECAY_COLUMN in runs.columns else F.lit("No decay")
    labelled = runs.withColumns(
        {
            "estimator_label": _label("estimator", MODEL_LABELS),
            "demographic_label": _label("n_demographics", DEMOGRAPHIC_LABELS),
            "decay_label": decay,
        }
    )
    if featurizer_labels:
        labelled = labelled.withColumn("featurizer", _label("featurizer", featurizer_labels))
    return labelled


def runs_long(runs: DataFrame, ids: list[str] = RUN_IDS, metrics: list[str] = SCORE_NAMES) -> DataFrame:
    """One row per run and class, one column per metric, out of the columns ``c_<class>__score_<metric>``.

    The columns of a row are put in one array and opened, so nothing is shuffled.
    """
    classes = sorted(
        {name[2:].split("__")[0] for name in runs.columns if name.startswith("c_") and "__score_" in name},
        key=lambda c: (len(c), c),
    )

    def score(label: str, metric: str) -> Column:
        name = f"c_{label}__score_{metric}"
        return (F.col(name) if name in runs.columns else F.lit(None)).cast("double").alias(metric)

    rows = [F.struct(F.lit(c).alias("target_label"), *[score(c, m) for m in metrics]) for c in classes]
    return runs.select(*ids, F.explode(F.array(*rows)).alias("_s")).select(*ids, "_s.*")


def weighted_metric(
    long_runs: DataFrame, prevalences: DataFrame, metric: str, by: list[str], label: str = "target_label"
) -> DataFrame:
    """Mean of a metric over classes, plain and weighted by prevalence."""
    classes = small_side(prevalences.select(label, "prevalence"))
    mean_prevalence = prevalences.agg(F.avg("prevalence")).scalar()
    return (
        long_runs.join(classes, label)
        .groupBy(*by)
        .agg(
            F.avg(metric).alias(f"macro_{metric}"),
            (F.avg(F.col(metric) * F.col("prevalence")) / mean_prevalence).alias(f"weighted_{metric}"),
        )
    )


def prevalence_bin(prevalence: str, bins: list[float] = PREVALENCE_BINS) -> Column:
    """Right-closed bin of a prevalence in percent, null outside."""
    bounds = list(zip(bins, bins[1:]))
    label = F.when(F.col(prevalence) <= bins[0], None)
    for low, high in bounds:
        label = label.when(F.col(prevalence) <= high, F.lit(f"{int(low)}-{int(high)}"))
    return label


def prevalence_bins(runs: DataFrame, label: str = "target_label", prevalence: str = "prevalence") -> DataFrame:
    """Number of classes in each bin of prevalence."""
    return (
        runs.withColumn("prevalence_bin", prevalence_bin(prevalence))
        .filter("prevalence_bin is not null")
        .groupBy("prevalence_bin")
        .agg(F.count_distinct(label).alias("n_classes"))
    )


def compute_time_summary(runs: DataFrame, seconds: str = "compute_time", n_tasks: int = ICD10_N_CHAPTERS) -> DataFrame:
    """Mean and standard deviation of the compute time of a task, by featurizer and estimator."""
    time = F.col(seconds) / n_tasks
    return runs.groupBy("featurizer", "estimator").agg(
        F.avg(time).alias("mean_seconds"), F.stddev_samp(time).alias("sd_seconds")
    )


def top_prevalence(runs: DataFrame, prefix: str = "test_prevalence_", threshold: float = 10) -> DataFrame:
    """Mean prevalence of each class over runs, for classes at or above ``threshold`` percent."""
    names = [name for name in runs.columns if name.startswith(prefix)]
    means = runs.agg(*[F.avg(name).alias(name) for name in names])
    return (
        means.unpivot([], names, "class", "prevalence")
        .withColumn("class", F.substr("class", F.lit(len(prefix) + 1)))
        .filter(F.col("prevalence") >= threshold)
    )


def run_durations(
    runs: DataFrame, by: list[str], time: str = "time_stamp", identifier: str = "run_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Seconds since the previous run, for runs launched one after the other."""
    chunked = with_chunks(runs, by, time, hot_rows)
    return (
        previous_value(chunked, by, [time, identifier], time, "_previous")
        .withColumn("duration_seconds", F.timestamp_diff("MICROSECOND", F.col("_previous"), F.col(time)) / 1e6)
        .drop("_previous", CHUNK)
    )


def training_history(
    history: DataFrame,
    by: list[str],
    time: str,
    order: list[str],
    rate: str = "lr",
    initial_rate: float = 0.0001,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number the trainings (seed) and epochs of a history written one after the other.

    A training starts whenever the learning rate is back to its initial value. Returns the
    losses in long form: (…, seed, epoch, dataset, epoch_loss).
    """
    chunked = with_chunks(history, by, time, hot_rows)
    restart = (F.round(F.col(rate), 6) == initial_rate).cast("int")
    seeds = running_sum(chunked.withColumn("_restart", restart), by, order, "_restart", "_trainings")
    seeds = seeds.drop(CHUNK).withColumn("seed", (F.col("_trainings") - 1).cast("int"))
    # a training is a part of a history cut again, so its epochs are numbered the same way
    lines = running_sum(
        with_chunks(seeds.withColumn("_one", F.lit(1)), [*by, "seed"], time, hot_rows),
        [*by, "seed"], order, "_one", "_line",
    )
    return lines.withColumn("epoch", (F.col("_line") - 1).cast("int")).unpivot(
        [*by, "seed", "epoch"], ["val_loss", "loss"], "dataset", "epoch_loss"
    )


