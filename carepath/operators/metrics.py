"""Scores of binary and multilabel predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BAND_SCALE = 256


def _ranked_scores(df: DataFrame, by: list[str], y_true: str, y_prob: str) -> DataFrame:
    """Cases and others of each distinct score, with the counts of all lower scores and of all.

    Scores are cut into bands of their log-odds: a band is a range of scores, and
    even scores crowded near 0 or 1 spread over many bands. Ranks run inside a band, and a band
    starts from the totals of the bands below it (one row per band, a few ten thousand at most).
    """
    score = F.col("p")
    band = (
        F.when(score <= 0, F.lit(-1_000_000))
        .when(score >= 1, F.lit(1_000_000))
        .otherwise(F.floor(F.ln(score / (1 - score)) * BAND_SCALE))
    )
    case = (F.col(y_true) == 1).cast("long")
    scores = (
        df.groupBy(*by, F.col(y_prob).alias("p"))
        .agg(F.sum(case).alias("pos"), F.sum(1 - case).alias("neg"))
        .withColumn("_band", band)
    )
    below = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    bands = (
        scores.groupBy(*by, "_band")
        .agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
        .select(
            *by, "_band",
            F.coalesce(F.sum("_p").over(below), F.lit(0)).alias("_p0"),
            F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_n0"),
            F.sum("_p").over(every).alias("n_pos"),
            F.sum("_n").over(every).alias("n_neg"),
        )
    )
    inside = Window.partitionBy(*by, "_band").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return (
        scores.withColumn("_pi", F.coalesce(F.sum("pos").over(inside), F.lit(0)))
        .withColumn("_ni", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
        .join(bands, [*by, "_band"])
        .select(*by, "p", "pos", "neg", "n_pos", "n_neg", (F.col("_pi") + F.col("_p0")).alias("pos_below"),
                (F.col("_ni") + F.col("_n0")).alias("neg_below"))
    )


def get_scores_by(
    df: DataFrame, by: list[str] | None = None, y_true: str = "y", y_prob: str = "p"
) -> DataFrame:
    """Brier score, ROC AUC (ties count for half), accuracy and confusion at p > 0.5, average
    precision over distinct thresholds; one row overall or per group of ``by``.

    The rows are read once, to count the cases of each distinct score; all scores follow from it.
    """
    keys = by or []
    ranked = _ranked_scores(df, keys, y_true, y_prob)
    p, pos, neg = F.col("p"), F.col("pos"), F.col("neg")
    predicted = p > 0.5
    n_pos, n_neg = F.nullif("n_pos", F.lit(0)), F.nullif("n_neg", F.lit(0))
    at_least = F.col("n_pos") - F.col("pos_below")
    precision = at_least / (at_least + F.col("n_neg") - F.col("neg_below"))
    rows = F.sum(pos + neg)

    def count(condition, column):
        return F.sum(F.when(condition, column).otherwise(0))

    return ranked.groupBy(*keys).agg(
        (F.sum(pos * F.pow(p - 1, 2) + neg * F.pow(p, 2)) / rows).alias("brier_score_loss"),
        F.sum(pos / n_pos * (F.col("neg_below") + neg / 2) / n_neg).alias("roc_auc_score"),
        ((count(predicted, pos) + count(~predicted, neg)) / rows).alias("accuracy_score"),
        F.sum(pos / n_pos * precision).alias("average_precision_score"),
        count(~predicted, neg).alias("tn"),
        count(predicted, neg).alias("fp"),
        count(~predicted, pos).alias("fn"),
        count(predicted, pos).alias("tp"),
    )


def get_binary_scores(df: DataFrame, y_true: str = "y", y_prob: str = "p") -> DataFrame:
    return get_scores_by(df, None, y_true, y_prob)


def get_scores(df: DataFrame, classes: str | None = None, y_true: str = "y", y_prob: str = "p") -> DataFrame:
    """Binary scores, or one row per class when ``classes`` names the class column."""
    return get_scores_by(df, [classes] if classes else None, y_true, y_prob)


def scores_as_columns(scores: DataFrame, classes: str = "class") -> dict[str, float]:
    """``c_<class>__score_<metric>`` for each class and metric, for a run record."""
    return {
        f"c_{row[classes]}__score_{name}": row[name]
        for row in scores.orderBy(classes).collect()
        for name in scores.columns
        if name != classes
    }


def get_prognosis_prevalence(target: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Share, in percent, of the persons having each label, the most frequent first."""
    total = target.agg(F.count("*")).scalar()
    prevalence = (
        target.select(F.explode(F.array_distinct("y")).alias("class"))
        .groupBy("class")
        .agg(F.count("*").alias("n_persons"))
        .withColumn("prevalence", 100 * F.col("n_persons") / total)
    )
    if labels:
        pairs = F.create_map(*[F.lit(item) for pair in labels.items() for item in pair])
        prevalence = prevalence.withColumn("label", pairs[F.col("class")])
    return prevalence.orderBy(F.desc("prevalence"), "class")
