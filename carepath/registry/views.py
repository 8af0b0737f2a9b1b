"""Clinical tables read from the generated star schema, so that every operator has whole tables
to work on. The same views are written in SQL in :mod:`carepath.registry.oracles`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.operators.embeddings import SOURCE_CODE
from carepath.sources.catalog import Catalog

STUDY_START, STUDY_END = datetime(1996, 1, 1), datetime(2001, 1, 1)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def source(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, path=sf_dir, table_names=TABLES, suffix=".parquet")


def days(column: Column) -> Column:
    return F.make_dt_interval(column.cast("int"))


def hours(column: Column) -> Column:
    return F.make_dt_interval(F.lit(0), column.cast("int"))


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plain_code(key: Column) -> Column:
    """A letter and three digits."""
    return F.concat(
        F.char(65 + key % 21), F.lpad((key % 100).cast("string"), 2, "0"), (key % 10).cast("string")
    )


def diagnosis_code(key: Column) -> Column:
    kind = key % 60
    return (
        F.when(kind == 0, "I210").when(kind == 1, "I200").when(kind == 2, "I501").when(kind == 3, "I64")
        .when(kind == 4, "I24").otherwise(plain_code(key))
    )


def person(t: Catalog) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("person_id"),
        (moment("1940-01-01 00:00:00") + days((key * 37) % 25550)).alias("birth_datetime"),
        F.when(key % 11 == 0, moment("1999-01-01 00:00:00") + days((key * 13) % 900)).alias("death_datetime"),
        F.when(key % 2 == 0, "f").otherwise("m").alias("gender_source_value"),
    )


def visit_occurrence(t: Catalog) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.col("o_orderdate") + hours(key % 24)
    priority = F.substring("o_orderpriority", 1, 1)
    return t.orders.select(
        key.alias("visit_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        start.alias("visit_start_datetime"),
        F.when(key % 20 != 0, start + days((key * 7) % 45)).alias("visit_end_datetime"),
        F.when(priority == "1", "urgence").when(priority == "5", "consultation externe")
        .when(priority == "4", "hospitalisation incomplète").otherwise("hospitalisés").alias("visit_source_value"),
        (key % 25).alias("care_site_id"),
        F.col("o_orderstatus").alias("admitted_from_source_value"),
        F.col("o_orderpriority").alias("discharge_to_source_value"),
    )


def visit_detail(t: Catalog) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.filter(key % 20 == 0).select(
        key.alias("visit_occurrence_id"),
        (F.col("o_orderdate") + days(2 + key % 5)).alias("visit_detail_end_datetime"),
        F.when(key % 40 == 0, "RSS").otherwise("MOUV").alias("visit_detail_type_source_value"),
    )


def movements(t: Catalog) -> DataFrame:
    """Details of two kinds for each visit, from the lines of an order."""
    line = F.col("l_linenumber")
    start = F.col("o_orderdate") + hours(line % 5)
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("visit_occurrence_id"),
        (F.col("l_orderkey") * 10 + line).alias("visit_detail_id"),
        start.alias("visit_detail_start_datetime"),
        F.when(line != 5, start + days(line % 3)).alias("visit_detail_end_datetime"),
        F.when(line % 2 == 0, "PASS").otherwise("MOUV").alias("visit_detail_type_source_value"),
    )


def _lines(t: Catalog) -> DataFrame:
    start = F.col("o_orderdate") + F.make_dt_interval(
        ((F.col("l_linenumber") - 1) * 3).cast("int"), (F.col("o_orderkey") % 24).cast("int")
    )
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person_id"), F.col("l_orderkey").alias("visit_occurrence_id"),
        start.alias("_start"), "l_partkey", "l_returnflag", "l_linestatus",
    )


def condition_occurrence(t: Catalog) -> DataFrame:
    return _lines(t).filter("l_returnflag = 'N'").select(
        "person_id", "visit_occurrence_id", F.col("_start").alias("condition_start_datetime"),
        diagnosis_code(F.col("l_partkey")).alias("condition_source_value"),
    )


def procedure_occurrence(t: Catalog) -> DataFrame:
    lines = _lines(t).filter("l_returnflag = 'R'").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        "person_id", "visit_occurrence_id", F.col("_start").alias("procedure_datetime"),
        F.col("p_brand").alias("procedure_source_value"),
    )


def drug_exposure_administration(t: Catalog) -> DataFrame:
    lines = _lines(t).filter("l_returnflag = 'A'").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(
        "person_id", "visit_occurrence_id", F.col("_start").alias("drug_exposure_start_datetime"),
        F.col("p_type").alias("drug_class_source_value"),
    )


def measurement(t: Catalog) -> DataFrame:
    return _lines(t).filter("l_linestatus = 'O'").select(
        "person_id", "visit_occurrence_id", F.col("_start").alias("measurement_datetime"),
        F.concat(F.lit("L"), (F.col("l_partkey") % 50).cast("string")).alias("measurement_source_value"),
    )


def raw_measurement_mapping(t: Catalog) -> DataFrame:
    """Several local codes for a measured code, some codes without any."""
    key = F.col("p_partkey")
    return t.part.filter(key % 50 % 7 != 0).select(
        F.concat(F.lit("L"), (key % 50).cast("string")).alias("loinc_concept_code"),
        F.concat(F.lit("N"), (key % 20).cast("string")).alias("nabm_concept_code"),
    )


def care_site(t: Catalog) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("care_site_id"), F.col("r_name").alias("hospital_name")
    )


def icd10_tree(t: Catalog) -> DataFrame:
    """Chapter of each code by its first letter; some codes are missing."""
    code = diagnosis_code(F.col("p_partkey"))
    return t.part.filter(F.col("p_partkey") % 13 != 0).select(
        F.substring(code, 1, 4).alias("concept_code"),
        (F.ascii(code) - 64).cast("string").alias("concept_chapter"),
    ).distinct()


def code_embedding(t: Catalog) -> DataFrame:
    return t.embeddings.select(plain_code(F.col("vec_id")).alias(SOURCE_CODE), "embedding", "label", "vec_id")


def concepts(t: Catalog) -> DataFrame:
    key = F.col("p_partkey")
    kind = key % 3
    return t.part.select(
        key.alias("concept_id"),
        F.when(kind == 0, "ICD10").when(kind == 1, "CIM10").otherwise("SNOMED").alias("vocabulary_id"),
        dotted_code(key).alias("concept_code"),
    )


def dotted_code(key: Column) -> Column:
    return F.concat(
        F.char(65 + key % 21), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("."), (key % 10).cast("string")
    )


def concept_relationship(t: Catalog) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(
        key.alias("concept_id_1"),
        (F.floor(key / 12) * 12 + 2).alias("concept_id_2"),
        F.when(key % 5 == 0, "Is a").otherwise("Maps to").alias("relationship_id"),
    )


def source_concepts(t: Catalog) -> DataFrame:
    key = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("C"), key.cast("string")).alias("concept"), dotted_code(key * 3).alias("code")
    )


def scores(t: Catalog) -> DataFrame:
    """Outcomes and probabilities, with ties."""
    return t.lineitem.select(
        F.col("l_linestatus").alias("class"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1009) / F.lit(1008.0)).alias("p"),
    )


RUN_CLASSES = ["1", "2", "11"]
RUN_METRICS = ["roc_auc_score", "average_precision_score", "accuracy_score", "brier_score_loss"]


def runs(t: Catalog) -> DataFrame:
    """Run records with one column per class and metric."""
    key, user = F.col("event_id"), F.col("user_id")
    score = {
        f"c_{c}__score_{m}": ((key * (7 + 3 * i + 5 * j)) % 101) / F.lit(100.0)
        for i, c in enumerate(RUN_CLASSES)
        for j, m in enumerate(RUN_METRICS)
    }
    prevalence = {
        f"test_prevalence_{c}": ((key * (3 + 2 * i)) % (10 + 15 * i)) * F.lit(1.0)
        for i, c in enumerate(RUN_CLASSES)
    }
    kind = F.col("event_type")
    return t.events.select(
        key.alias("run_id"),
        F.col("ts").alias("time_stamp"),
        F.when(kind == "click", "ridge").when(kind == "view", "random_forests")
        .when(kind == "purchase", "hist_gradient_boosting").otherwise(kind).alias("estimator"),
        F.when(user % 3 == 0, "Count Encoding").when(user % 3 == 1, "Embeddings").otherwise("Demographics")
        .alias("featurizer"),
        (key % 5).cast("int").alias("splitting_rs"),
        F.when(key % 4 == 0, 0).when(key % 4 == 1, 3).when(key % 4 == 2, 6).otherwise(4).alias("n_demographics"),
        ((1 + user % 3) * 1000).alias("n_person_subtrain"),
        F.col("value").alias("compute_time"),
        F.when(key % 3 == 0, "[0]").when(key % 3 == 1, "[0, 1]").otherwise("[0, 5]")
        .alias("pipeline_best_params_event_transformer__decay_half_life_in_days"),
        *[column.alias(name) for name, column in {**score, **prevalence}.items()],
    )


def training(t: Catalog) -> DataFrame:
    """Histories of trainings written one after the other, one history per user."""
    key = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("history"), F.col("ts").alias("time"), key.alias("line"),
        F.when(key % 7 == 0, 0.0001).otherwise(0.00005).alias("lr"),
        F.col("value").alias("val_loss"), (F.col("value") / 2).alias("loss"),
    )


VIEWS = {
    "person": person,
    "visit_occurrence": visit_occurrence,
    "visit_detail": visit_detail,
    "condition_occurrence": condition_occurrence,
    "procedure_occurrence": procedure_occurrence,
    "drug_exposure_administration": drug_exposure_administration,
    "measurement": measurement,
    "care_site": care_site,
    "concept": concepts,
    "concept_relationship": concept_relationship,
}


def database(spark: SparkSession, sf_dir: str) -> Catalog:
    tables = source(spark, sf_dir)
    return Catalog(spark, frames={name: view(tables) for name, view in VIEWS.items()})
