"""Code systems: classes, chapters, mappings between vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.constants import (
    CODE_CLASS,
    CONDITION_CODE,
    CONDITION_COARSE,
    MACE_CODES,
    SOURCE_CODE,
    TARGET_CODE,
    VISIT_CONCEPTS,
    VISIT_TYPE,
)
from carepath.functions.sizes import size_checked, small_side
from carepath.session import materialise


def get_cim10_codes(
    conditions: DataFrame, cim10_codes: dict[str, list[str]] = MACE_CODES, code: str = CONDITION_CODE
) -> DataFrame:
    """Conditions whose code contains one of the codes of a class, once per matching class.

    One scan whatever the number of classes.
    """
    classes = [
        F.when(F.col(code).rlike("|".join(codes)), F.lit(label)) for label, codes in cim10_codes.items()
    ]
    return conditions.withColumn(CODE_CLASS, F.explode(F.array_compact(F.array(*classes))))


def match_code_dictionary(conditions: DataFrame, dictionary: DataFrame, code: str = CONDITION_CODE) -> DataFrame:
    """Conditions whose code contains a pattern of a class, once per matching class, from a table ``pattern, code_class``.

    For dictionaries of thousands of patterns: each distinct code is looked at once. Its substrings of the lengths that patterns have
    meet the patterns by equality, so the work does not follow the number of patterns, and the classes of the codes meet the
    conditions as a broadcast behind a check of their size. Patterns are plain text; null and empty ones match nothing, repeated ones count
    once, a null code has no class. A class column of the conditions is replaced.
    """
    given = dictionary.filter((F.col("pattern") != "") & F.col(CODE_CLASS).isNotNull())
    patterns = materialise(given.select("pattern", CODE_CLASS).distinct(), "patterns")
    lengths = patterns.agg(F.collect_set(F.length("pattern"))).scalar()
    codes = conditions.select(F.col(code).alias("_code")).filter("_code is not null").distinct()
    pieces = F.transform(
        F.sequence(F.lit(1), F.length("_code") - F.col("_n") + 1), lambda i: F.col("_code").substr(i, F.col("_n"))
    )
    found = (
        codes.select("_code", F.explode(lengths).alias("_n"))
        .filter(F.col("_n") <= F.length("_code"))
        .select("_code", F.explode(F.array_distinct(pieces)).alias("pattern"))
        .join(small_side(patterns), "pattern")
        .select("_code", CODE_CLASS)
        .distinct()
    )
    rows = conditions.drop(CODE_CLASS)
    return rows.join(size_checked(found), F.col(code) == F.col("_code")).drop("_code")


def matches_any(codes: list[str], code: str = CONDITION_CODE) -> Column:
    return F.col(code).rlike("|".join(codes))


def coarsen_cim10_to_chapter(
    diagnoses: DataFrame, icd10_tree: DataFrame, code: str = CONDITION_CODE
) -> DataFrame:
    """Chapter of the first four characters of each code; null when the tree lacks it.

    The tree has the few ten thousand codes of the classification, whatever the data; its size is
    checked before it is broadcast.
    """
    tree = icd10_tree.select(
        F.col("concept_code").alias(code), F.col("concept_chapter").alias(CONDITION_COARSE)
    )
    return diagnoses.withColumn(code, F.substring(code, 1, 4)).join(small_side(tree), code, "left")


def unmatched_ratio(coarsened: DataFrame) -> DataFrame:
    """Codes without a chapter: their number and share."""
    missing = F.col(CONDITION_COARSE).isNull()
    return coarsened.agg(
        F.count_if(missing).alias("n_unmatched"), F.avg(missing.cast("double")).alias("unmatched_ratio")
    )


def icd_prefix(code: str = CONDITION_CODE, cim10_nb_digits: int = 2) -> Column:
    return F.substring(code, 1, cim10_nb_digits + 1)


def map_concept(
    table: DataFrame,
    mapping: dict[str, int] = VISIT_CONCEPTS,
    source_column: str = VISIT_TYPE,
    target_column: str = "visit_concept_id",
) -> DataFrame:
    """Standard concept of a source value; null when unknown."""
    concept = F.lit(None).cast("int")
    for value, target in mapping.items():
        concept = F.when(F.col(source_column) == value, F.lit(target)).otherwise(concept)
    return table.withColumn(target_column, concept)


def collapse_mapping(
    mapping: DataFrame, source: str, target: str
) -> DataFrame:
    """One target per source code, the lowest, with the number of alternatives."""
    return mapping.groupBy(F.col(source).alias(SOURCE_CODE)).agg(
        F.min(target).alias(TARGET_CODE), F.count_distinct(target).alias("n_targets")
    )


def strip_dots(column: str, length: int | None = None) -> Column:
    code = F.regexp_replace(column, r"\.", "")
    return F.substring(code, 1, length) if length else code


def vocabulary_bridge(
    concepts: DataFrame,
    relations: DataFrame,
    source_codes: DataFrame,
    source_vocabularies: list[str],
    target_vocabulary: str,
    code_length: int = 5,
) -> DataFrame:
    """Map source concepts to the codes of a target vocabulary through the standard concepts
    that both "map to". ``source_codes`` has ``concept`` and ``code``.
    """
    maps = relations.filter("relationship_id = 'Maps to'").select("concept_id_1", "concept_id_2")

    def to_standard(vocabularies: list[str], name: str) -> DataFrame:
        own = concepts.filter(F.col("vocabulary_id").isin(vocabularies)).select(
            F.col("concept_id").alias("concept_id_1"), strip_dots("concept_code").alias(name)
        )
        return maps.join(own, "concept_id_1").select(F.col("concept_id_2").alias("concept_id"), name).distinct()

    wanted = source_codes.select("concept", strip_dots("code", code_length).alias("source_code"))
    # both sides are distinct before they meet, so a standard concept gives each pair once
    sources = (
        wanted.join(to_standard(source_vocabularies, "source_code"), "source_code")
        .select("concept", "concept_id")
        .distinct()
    )
    return (
        sources.join(to_standard([target_vocabulary], "target_code"), "concept_id")
        .select("concept", "target_code")
        .distinct()
    )


def mapping_coverage(vocabulary: DataFrame, mapped: DataFrame, by: str, code: str = SOURCE_CODE) -> DataFrame:
    """Share of the codes of each vocabulary that a mapping covers, and the share it loses."""
    found = mapped.select(code).distinct().withColumn("_found", F.lit(1))
    return (
        vocabulary.select(code, by)
        .distinct()
        .join(found, code, "left")
        .groupBy(by)
        .agg(
            F.count("*").alias("n_codes"),
            F.count("_found").alias("n_mapped"),
            (F.count("_found") / F.count("*")).alias("coverage"),
            (1 - F.count("_found") / F.count("*")).alias("lost"),
        )
    )


def merge_embeddings(embeddings: DataFrame, code: str, dimension: int, how: str = "mean", order: str | None = None) -> DataFrame:
    """One vector per code out of the vectors of its concepts: their mean, or the first one."""
    if how == "first":
        first = Window.partitionBy(code).orderBy(order)
        ranked = embeddings.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
        return ranked.select(code, F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(dimension)]
    return embeddings.groupBy(code).agg(F.array(*means).alias("embedding"))
