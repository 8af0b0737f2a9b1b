"""Run records: append them, read folders of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions.sizes import small_side
from carepath.sources.cohort import _children


def append_run(spark: SparkSession, record: dict, path: str) -> None:
    """Append one record to the Parquet table of runs; columns may differ between runs."""
    row = {name: value for name, value in record.items() if value is not None}
    spark.createDataFrame([row]).coalesce(1).write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def read_run_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Union of the run CSVs of a folder whose columns differ.

    Files are grouped by header, so there is one reader per distinct header and not per file.
    """
    names = [name for name in _children(spark, folder) if name.endswith(".csv")]
    if not names:
        raise FileNotFoundError(f"no CSV in {folder}")
    # the first line of each file, with the name of the file it comes from
    # (file names come percent-encoded, where a plus sign is only itself)
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    lines = spark.read.text(f"{folder.rstrip('/')}/*.csv").select(
        name.alias("name"), F.col("value").alias("header"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
    )
    headers = (
        lines.groupBy("name")
        .agg(F.min_by("header", "place").alias("header"))
        .groupBy("header")
        .agg(F.sort_array(F.collect_list("name")).alias("names"))
        .orderBy("header")
        .collect()
    )
    readers = [
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
            [f"{folder.rstrip('/')}/{name}" for name in row["names"]]
        )
        for row in headers
    ]
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), readers)


def get_experience_results(spark: SparkSession, folder: str, long_format: bool = True) -> DataFrame:
    """Run logs of a folder with readable labels, one row per run and class by default."""
    from carepath.operators.runs import clean_runs, runs_long

    runs = clean_runs(read_run_logs(spark, folder))
    return runs_long(runs) if long_format else runs


def collect_external_runs(
    spark: SparkSession, folder: str, model_name: str, test_prevalences: DataFrame, estimator: str
) -> DataFrame:
    """Metrics written by an external model, one folder per train share and class.

    Folders are named ``<model>_pr<share>_pipeline__target_<class>`` and have Parquet files in
    ``metrics``; the class is read from the path.
    """
    pattern = rf"{model_name}_pr(\d+)_pipeline__target_(\d+)"
    metrics = (
        spark.read.option("mergeSchema", True)
        .parquet(f"{folder.rstrip('/')}/{model_name}_pr*_pipeline__target_*/metrics")
        .withColumn("_path", F.input_file_name())
        .withColumn("target", F.regexp_extract("_path", pattern, 2))
        .withColumn("train_share", F.regexp_extract("_path", pattern, 1))
        .drop("_path")
    )
    if "brier_score_loss" not in metrics.columns:
        metrics = metrics.withColumn("brier_score_loss", F.lit(None).cast("double"))
    return (
        metrics.join(small_side(test_prevalences), "target")
        .withColumn("estimator", F.lit(estimator))
        .withColumnRenamed("average_precision_score", "pr_auc")
    )


def collect_external_run(spark: SparkSession, folder: str, estimator: str) -> DataFrame:
    """Metrics of one external model, with the names used for the other runs."""
    metrics = spark.read.option("mergeSchema", True).parquet(f"{folder.rstrip('/')}/metrics")
    if "brier_score_loss" not in metrics.columns:
        metrics = metrics.withColumn("brier_score_loss", F.lit(None).cast("double"))
    labels = {name: F.lit(estimator) for name in ("estimator", "featurizer", "estimator_label")}
    return metrics.withColumns(labels).withColumnsRenamed(
        {"roc_auc": "roc_auc_score", "pr_auc": "average_precision_score"}
    )
