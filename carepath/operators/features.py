"""Features of a person: decayed counts, sums of code embeddings, demographics.

Features stay in long form (one row per person and code) and become vectors only for a model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from carepath.constants import FOLLOWUP_START, PERSON, SOURCE_CODE, START
from carepath.functions.dates import exact_days_between
from carepath.operators.tasks import label_scores
from carepath.session import materialise, scratch

#: vectors of codes are sent to every task up to this size, otherwise joined by a shuffle
VECTOR_BYTES = 100_000_000


def decay_weight(decay_in_days: float, start: str = START, followup: str = FOLLOWUP_START) -> Column:
    """exp(-days / decay) of an event, 1 without decay."""
    if decay_in_days == 0:
        return F.lit(1.0)
    return F.exp(-exact_days_between(start, followup) / F.lit(float(decay_in_days)))


def decay_name(decay_in_days: float) -> str:
    return f"decay_{decay_in_days:g}"


def count_features(event: DataFrame) -> DataFrame:
    """Number of events per (person, code)."""
    return event.groupBy(PERSON, SOURCE_CODE).agg(F.count("*").alias("n_events"))


def decayed_features(event: DataFrame, decay_half_life_in_days: list[float] = (0,)) -> DataFrame:
    """One weight per (person, code) for each decay, in one pass over the events."""
    return event.groupBy(PERSON, SOURCE_CODE).agg(
        *[F.sum(decay_weight(decay)).alias(decay_name(decay)) for decay in decay_half_life_in_days]
    )


def embedding_features(
    event: DataFrame,
    embeddings: DataFrame,
    dimension: int,
    decay_half_life_in_days: list[float] = (0,),
) -> DataFrame:
    """Sum over the events of a person of weight × embedding of the code.

    Weights are summed per (person, code) before they meet the embeddings, so a code that comes
    back costs one vector. The vector of all decays is one array, decay after decay. What is shuffled are positions and
    weights; a task sorts them by person and multiplies them with the table of vectors, if that is small enough to be sent.
    """
    weights = decayed_features(event, decay_half_life_in_days)
    names = [decay_name(decay) for decay in decay_half_life_in_days]
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    # several vectors of a code are added up first: the sum is the same
    summed = Summarizer.metrics("sum").summary(vector)["sum"].alias("_vector")
    vectors = materialise(embeddings.filter(F.col(SOURCE_CODE).isNotNull()).groupBy(SOURCE_CODE).agg(summed), "codes")
    if vectors.count() <= VECTOR_BYTES // (8 * max(dimension, 1)):
        return _products_by_person(weights, vectors, names)
    # one aggregate of a whole vector per decay; the weight column scales it
    sums = [Summarizer.metrics("sum").summary(F.col("_vector"), F.col(name))["sum"].alias(name) for name in names]
    joined = weights.join(vectors, SOURCE_CODE)
    return joined.groupBy(PERSON).agg(*sums).select(
        PERSON, F.concat(*[vector_to_array(name) for name in names]).alias("features")
    )


def _products_by_person(weights: DataFrame, vectors: DataFrame, names: list[str]) -> DataFrame:
    """For each person and weight column the sum of weight × vector, by a table of vectors that every task gets.

    A person has a row per code at most, so that none is more than a task can sort.
    """
    spark = weights.sparkSession
    table = vectors.select(SOURCE_CODE, vector_to_array("_vector").alias("_vector")).orderBy(SOURCE_CODE).toArrow()
    rows = table["_vector"].combine_chunks()
    matrix = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1 if len(rows) else 0)
    positions = pa.table({SOURCE_CODE: table[SOURCE_CODE], "_ix": pa.array(np.arange(len(rows), dtype=np.int32))})
    # of the size of the codes, which are bounded by the size of their vectors
    known = weights.join(F.broadcast(spark.createDataFrame(positions)), SOURCE_CODE)
    entries = known.select(PERSON, "_ix", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    sorted_rows = entries.repartition(PERSON).sortWithinPartitions(PERSON, "_ix")
    schema = StructType([entries.schema[PERSON], StructField("features", ArrayType(DoubleType()))])
    return sorted_rows.mapInArrow(lambda batches: _summed_runs(batches, matrix), schema)


def _summed_runs(batches: Iterator[pa.RecordBatch], matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``person, features`` from sorted rows of a person, a position and weights; a person may go over several batches."""

    def made(persons: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32())
        return pa.RecordBatch.from_arrays([persons, pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=[PERSON, "features"])

    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        persons = batch.column(0)
        number = persons.dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.append(0, np.flatnonzero(np.diff(number)) + 1)
        chosen = matrix[batch.column(1).to_numpy()]
        weights = [batch.column(i).to_numpy(zero_copy_only=False)[:, None] for i in range(2, batch.num_columns)]
        sums = np.hstack([np.add.reduceat(w * chosen, starts) for w in weights])
        if held is not None:
            if last[0].as_py() == persons[0].as_py():
                sums[0] += held
            else:
                yield made(last, held[None])
        ids = persons.take(pa.array(starts))
        if len(starts) > 1:
            yield made(ids[:-1], sums[:-1])
        last, held = ids[-1:], sums[-1].copy()
    if held is not None:
        yield made(last, held[None])


MAX_CODES = 1_000_000


def index_codes(vocabulary: DataFrame, code: str = SOURCE_CODE, most: int = MAX_CODES) -> list[str]:
    """Codes in alphabetical order: the column order of vectors and matrices.

    The vocabulary comes to the driver, as it does in any Spark ML indexer; a model over more than ``most`` codes
    is an error.
    """
    codes = [row[0] for row in vocabulary.select(code).distinct().orderBy(code).limit(most + 1).collect()]
    if len(codes) > most:
        raise ValueError(f"more than {most} codes: restrict the vocabulary first")
    return codes


def sparse_vectors(rows: DataFrame, size: int, indices: str, values: str, name: str = "features") -> DataFrame:
    """Replace two arrays by a sparse vector, without a Python function.

    The fields of a vector are written as plain columns and read back under the type of a vector.
    """
    fields = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col(indices).cast("array<int>").alias("indices"),
        F.col(values).cast("array<double>").alias("values"),
    )
    kept = [column for column in rows.columns if column not in (indices, values)]
    plain = rows.select(*kept, fields.alias(name))
    folder = scratch(rows.sparkSession, "vectors")
    plain.write.parquet(folder)
    schema = StructType([*[plain.schema[column] for column in kept], StructField(name, VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(folder)


def count_vectors(features: DataFrame, codes: list[str], weights: list[str]) -> DataFrame:
    """Sparse vector per person: one block of the vocabulary for each weight column."""
    spark = features.sparkSession
    size = len(codes)
    # of the size of the vocabulary, which index_codes has held on the driver within its bound
    positions = spark.createDataFrame(list(enumerate(codes)), f"_ix int, {SOURCE_CODE} string")
    entries = F.array(
        *[F.struct((F.col("_ix") + F.lit(block * size)).alias("ix"), F.col(w).cast("double").alias("w"))
          for block, w in enumerate(weights)]
    )
    # at most one entry per code and block
    rows = (
        features.join(F.broadcast(positions), SOURCE_CODE)
        .select(PERSON, F.explode(entries).alias("_entry"))
        .groupBy(PERSON)
        .agg(F.array_sort(F.collect_list("_entry")).alias("_entries"))
        .select(PERSON, F.col("_entries.ix").alias("_indices"), F.col("_entries.w").alias("_values"))
    )
    return sparse_vectors(rows, size * len(weights), "_indices", "_values")


def sparsity(features: DataFrame) -> DataFrame:
    """Share of zeros of the (person × code) matrix, from its long form."""
    shape = features.agg(
        F.count("*").alias("n_values"),
        F.count_distinct(PERSON).alias("n_persons"),
        F.count_distinct(SOURCE_CODE).alias("n_codes"),
    )
    cells = F.col("n_persons") * F.col("n_codes")
    return shape.withColumn("sparsity", 1 - F.col("n_values") / cells)


def binarise_labels(target: DataFrame, classes: list[str], labels: str = "y") -> DataFrame:
    """Presence of each class, one row per (person, class)."""
    return label_scores(target, labels, classes, "present")


def last_diagnosis_features(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """Chapters of past diagnoses as columns ``c_<chapter>``."""
    present = [F.array_contains("y_pred", c).cast("int").alias(f"c_{c}") for c in classes]
    return predictions.select(PERSON, *present)


# fixed values: static features of a stay
STATIC_FEATURES = {
    "categorical": [
        "admitted_from_source_value",
        "discharge_to_source_value",
        "gender_source_value",
        "inclusion_event_source_concept_id",
    ],
    "numerical": ["age_at_inclusion_event_start"],
}


def demographics_pipeline(
    categorical: list[str] = STATIC_FEATURES["categorical"],
    numerical: list[str] = STATIC_FEATURES["numerical"],
    remainder: list[str] = (),
    output: str = "features",
) -> Pipeline:
    """One-hot categories (unknown ones give zeros), standardised numbers, the rest as it is."""
    stages, inputs = [], []
    if categorical:
        indexed = [f"{name}_ix" for name in categorical]
        encoded = [f"{name}_hot" for name in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True))
        inputs += encoded
    if numerical:
        stages.append(VectorAssembler(inputCols=numerical, outputCol="numbers", handleInvalid="keep"))
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
        inputs.append("scaled")
    stages.append(VectorAssembler(inputCols=[*inputs, *remainder], outputCol=output, handleInvalid="keep"))
    return Pipeline(stages=stages)


DIGITS = 32


def random_projection(
    features: DataFrame, weights: str | list[str], n_components: int = 30, seed: int = 0
) -> DataFrame:
    """Random projection of the (person × code) matrix on ``n_components`` directions, one block per weight column.

    A direction has +1 or -1 for each code, from one hexadecimal digit of md5(code:seed:block): no
    matrix has to be stored or sent, and each person is reduced by one map-side sum.
    """
    columns = [weights] if isinstance(weights, str) else list(weights)
    blocks = range(-(-n_components // DIGITS))
    digits = {
        f"_digits_{block}": F.md5(F.concat_ws(":", SOURCE_CODE, F.lit(str(seed)), F.lit(str(block))))
        for block in blocks
    }
    scale = n_components**-0.5

    def component(weight: str, number: int) -> Column:
        digit = F.substring(f"_digits_{number // DIGITS}", number % DIGITS + 1, 1)
        return F.sum(F.when(digit >= "8", F.col(weight)).otherwise(-F.col(weight))) * F.lit(scale)

    return features.withColumns(digits).groupBy(PERSON).agg(
        F.array(*[component(weight, number) for weight in columns for number in range(n_components)]).alias("features")
    )
