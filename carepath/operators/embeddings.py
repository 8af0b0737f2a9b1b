"""Code embeddings: windowed co-occurrence, PPMI, truncated SVD, nearest codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.constants import PERSON, SOURCE_CODE, START
from carepath.functions.sizes import person_side, size_checked, small_side
from carepath.operators.block_svd import largest_singular
from carepath.operators.features import VECTOR_BYTES, index_codes
from carepath.operators.ordered import MAX_HOT_KEYS
from carepath.session import materialise

HOT_CELLS = 4096


def cooccurrence(
    event: DataFrame,
    window_radius_in_days: int = 30,
    colname_concept: str = SOURCE_CODE,
    hot_cells: int = HOT_CELLS,
) -> DataFrame:
    """Ordered pairs of distinct events of one person at most ``window_radius_in_days`` days apart,
    counted by (code, context).

    Events are first counted by (person, day, code): what is joined no longer grows with
    repeated events. A period of one radius meets itself and the next one only, each unordered
    pair of cells is formed once and mirrored in the counts, and pairs go from the join into
    partial counts without being stored. A period of a person holds at most radius × vocabulary
    cells; beyond ``hot_cells`` its rows are dealt over several tasks. Such periods are looked
    for first, among the persons with that many events.
    """
    radius = max(int(window_radius_in_days), 1)
    cells = (
        event.filter(F.col(START).isNotNull() & F.col(colname_concept).isNotNull())
        .groupBy(PERSON, F.unix_date(F.col(START).cast("date")).alias("day"), F.col(colname_concept).alias("code"))
        .agg(F.count("*").alias("n"))
        .withColumn("period", F.floor(F.col("day") / radius))
    )
    busy = event.groupBy(PERSON).count().filter(F.col("count") > hot_cells).select(PERSON)
    hot = (
        cells.join(busy, PERSON, "left_semi")
        .groupBy(PERSON, "period")
        .agg(F.count("*").alias("_cells"))
        .filter(F.col("_cells") > hot_cells)
        .select(PERSON, "period", F.ceil(F.col("_cells") / hot_cells).cast("int").alias("_deals"))
    )
    found = hot.limit(MAX_HOT_KEYS + 1).collect()
    if found and len(found) <= MAX_HOT_KEYS:
        hot = F.broadcast(event.sparkSession.createDataFrame(found, hot.schema))

    def deals(rows: DataFrame) -> DataFrame:
        dealt = rows.join(hot, [PERSON, "period"], "left") if found else rows.withColumn("_deals", F.lit(1))
        return dealt.withColumn("_deals", F.coalesce("_deals", F.lit(1)))

    # left: one copy per cell, in one deal of its period; right: a copy for its own period and
    # for the one before, in each deal of that period
    left = deals(cells).select(
        PERSON, "period", F.pmod(F.xxhash64("code", "day"), F.col("_deals")).cast("int").alias("_deal"),
        F.col("day").alias("day_a"), F.col("code").alias("code_a"), F.col("n").alias("n_a"),
    )
    copies = cells.select(
        PERSON, F.explode(F.array(F.col("period"), F.col("period") - 1)).alias("period"),
        F.col("day").alias("day_b"), F.col("code").alias("code_b"), F.col("n").alias("n_b"),
    )
    right = deals(copies).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")
    after = (F.col("day_b") > F.col("day_a")) | (
        (F.col("day_b") == F.col("day_a")) & (F.col("code_b") >= F.col("code_a"))
    )
    same = (F.col("day_b") == F.col("day_a")) & (F.col("code_b") == F.col("code_a"))
    # n(n-1) ordered pairs inside a cell are n(n-1)/2 unordered ones
    pairs = F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    half = (
        left.join(right, [PERSON, "period", "_deal"])
        .filter(after & (F.col("day_b") - F.col("day_a") <= int(window_radius_in_days)))
        .groupBy(F.least("code_a", "code_b").alias("code_a"), F.greatest("code_a", "code_b").alias("code_b"))
        .agg(F.sum(pairs).cast("long").alias("n"))
        .filter("n > 0")
    )
    both = F.array(
        F.struct(F.col("code_a").alias("code"), F.col("code_b").alias("context")),
        F.struct(F.col("code_b").alias("code"), F.col("code_a").alias("context")),
    )
    twice = F.when(F.col("code_a") == F.col("code_b"), F.col("n") * 2).otherwise(F.col("n"))
    once = F.when(F.col("code_a") == F.col("code_b"), F.slice(both, 1, 1)).otherwise(both)
    return half.select(F.explode(once).alias("_pair"), twice.alias("n_pairs")).select("_pair.*", "n_pairs")


def ppmi(pairs: DataFrame, smoothing_factor: float = 0.75, k: float = 1) -> DataFrame:
    """Shifted positive pointwise mutual information with smoothed context probabilities:
    max(0, ln(p(w, c) / (p(w) p_a(c))) - ln k), zeros left out.

    Marginals have one row per code and are sent around behind a check of their size; totals are single values.
    """
    pairs = materialise(pairs, "pairs")
    codes = pairs.groupBy("code").agg(F.sum("n_pairs").cast("double").alias("n_code"))
    contexts = pairs.groupBy("context").agg(
        F.pow(F.sum("n_pairs").cast("double"), F.lit(float(smoothing_factor))).alias("w_context")
    )
    total = pairs.agg(F.sum("n_pairs").cast("double")).scalar()
    total_context = contexts.agg(F.sum("w_context")).scalar()
    information = F.ln(
        (F.col("n_pairs") / total) / ((F.col("n_code") / total) * (F.col("w_context") / total_context))
    ) - F.ln(F.lit(float(k)))
    return (
        pairs.join(size_checked(codes), "code")
        .join(size_checked(contexts), "context")
        .select("code", "context", information.alias("ppmi"))
        .filter("ppmi > 0")
    )


@dataclass
class Decomposition:
    """Singular values, the names of the columns, and ``column, right`` with a row of V / √Σ per column."""

    values: list[float]
    columns: list[str]
    right: DataFrame
    column: str
    value: str

    def project(self, matrix: DataFrame, row: str, name: str = "embedding") -> DataFrame:
        """A·V / √Σ of the rows of a long matrix; for the decomposed matrix itself that is U·√Σ.

        Entries of unknown columns do not count. One weighted sum of vectors per row, no list of entries.
        """
        table = small_side(self.right, VECTOR_BYTES // (8 * max(len(self.values), 1)))
        entries = matrix.join(table, self.column)
        # the summarizer takes no negative weight, so a negative value turns its vector around
        sign = F.when(F.col(self.value) < 0, -1.0).otherwise(1.0)
        vector = array_to_vector(F.transform("right", lambda x: x * sign))
        summed = Summarizer.metrics("sum").summary(vector, F.abs(F.col(self.value)))["sum"]
        return entries.groupBy(row).agg(vector_to_array(summed).alias(name))


def decompose(matrix: DataFrame, row: str, column: str, value: str, d: int = 30) -> Decomposition:
    """The ``d`` largest singular values and right vectors of a long (row, column, value) matrix.

    The driver holds six times d + 60 numbers per column, in a Krylov space made by at most six passes over the
    rows (:mod:`carepath.operators.block_svd`); ``index_codes`` bounds the columns. Rows stay distributed and are written once.
    """
    spark = matrix.sparkSession
    columns = index_codes(matrix, column)
    names = pa.array(columns, pa.string())
    positions = spark.createDataFrame(pa.table({"_ix": pa.array(range(len(columns)), pa.int32()), column: names}))
    # every pass reads the rows, so they are dealt to as many tasks as there are cores
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = (
        matrix.filter(F.col(value).isNotNull())
        .join(F.broadcast(positions), column)
        .repartition(tasks, row)
        .groupBy(row)
        .agg(F.array_sort(F.collect_list(F.struct("_ix", F.col(value).cast("double").alias("_v")))).alias("_row"))
        .select(F.col("_row._ix").alias("indices"), F.col("_row._v").alias("values"))
    )
    found, vectors = largest_singular(materialise(rows, "rows"), len(columns), min(d, len(columns)))
    values = [float(s) for s in found]
    scaled = np.ascontiguousarray(vectors / np.sqrt(found))
    if values:
        arrays = pa.FixedSizeListArray.from_arrays(pa.array(scaled.reshape(-1)), len(values)).cast(pa.list_(pa.float64()))
    else:
        arrays = pa.array([[] for _ in columns], pa.list_(pa.float64()))
    right = spark.createDataFrame(pa.table({column: names, "right": arrays}))
    return Decomposition(values, columns, materialise(right, "right"), column, value)


def truncated_svd(
    matrix: DataFrame, row: str, column: str, value: str, d: int = 30
) -> tuple[DataFrame, list[float], list[str]]:
    """Rows of U·√Σ for the ``d`` largest singular values of a long matrix, the values, and the column names."""
    matrix = materialise(matrix, "matrix")
    found = decompose(matrix, row, column, value, d)
    return found.project(matrix, row), found.values, found.columns


def embed_codes(
    events: DataFrame,
    window_radius_in_days: int = 30,
    d: int = 30,
    smoothing_factor: float = 0.75,
    k: float = 1,
    colname_concept: str = SOURCE_CODE,
) -> DataFrame:
    """Embedding of each code, from its co-occurrences: (code, array of d numbers)."""
    pairs = cooccurrence(events, window_radius_in_days, colname_concept)
    rows, _, _ = truncated_svd(ppmi(pairs, smoothing_factor, k), "code", "context", "ppmi", d)
    return rows.select(F.col("code").alias(colname_concept), "embedding")


def count_svd(
    features: DataFrame, weights: str | list[str], d: int = 30, learnt_on: DataFrame | None = None
) -> DataFrame:
    """Truncated SVD of the (person × code) matrix, with one block of columns per weight.

    The directions are learnt on the persons of ``learnt_on`` (all if not given), the others are projected on them.
    """
    columns = [weights] if isinstance(weights, str) else list(weights)
    long = materialise(
        features.select(PERSON, *[F.col(w).cast("double").alias(w) for w in columns], SOURCE_CODE)
        .unpivot([PERSON, SOURCE_CODE], columns, "_block", "_value")
        .filter("_value <> 0")
        .select(PERSON, F.concat_ws(":", "_block", SOURCE_CODE).alias("_column"), "_value"),
        "matrix",
    )
    known = long if learnt_on is None else long.join(person_side(learnt_on.select(PERSON)), PERSON, "left_semi")
    return decompose(known, PERSON, "_column", "_value", d).project(long, PERSON, "features")


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def normalised(embedding: str) -> Column:
    vector = F.transform(embedding, lambda x: x.cast("double"))
    return F.transform(vector, lambda x: x / F.sqrt(_dot(vector, vector)))


def get_closest_nn(
    source_codes: list[str], embeddings: DataFrame, concept_labels: DataFrame, k: int = 10, code: str = SOURCE_CODE
) -> DataFrame:
    """The ``k`` codes closest to each of a few source codes by cosine similarity, with labels.

    The source vectors travel as one array next to each code; ranks are cut to ``k`` before
    the shuffle.
    """
    vectors = embeddings.select(F.col(code).alias("code"), normalised("embedding").alias("_vector"))
    sources = (
        vectors.filter(F.col("code").isin(source_codes))
        .agg(F.collect_list(F.struct(F.col("code").alias("source_code"), "_vector")).alias("sources"))
        .scalar()
    )
    similar = (
        vectors.select("code", "_vector", F.explode(sources).alias("_source"))
        .select(
            F.col("_source.source_code").alias("source_code"), "code",
            _dot(F.col("_vector"), F.col("_source._vector")).alias("similarity"),
        )
        .filter(F.col("source_code") != F.col("code"))
    )
    rank = Window.partitionBy("source_code").orderBy(F.desc(F.round("similarity", 9)), "code")
    nearest = similar.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
    return nearest.join(concept_labels.withColumnRenamed(code, "code"), "code", "left")


def read_embeddings(spark, path: str, code: str = SOURCE_CODE) -> DataFrame:
    """Embeddings stored as one JSON object of code → list of numbers per line or file."""
    text = spark.read.option("wholetext", True).text(path)
    entries = F.explode(F.from_json("value", "map<string,array<double>>"))
    return text.select(entries.alias(code, "embedding"))


def melt_embedding_columns(wide: DataFrame, code: str = SOURCE_CODE) -> DataFrame:
    """Tidy (code, embedding) from a table with one column per code and one row per dimension.

    ``dimension`` numbers the rows.
    """
    codes = [name for name in wide.columns if name != "dimension"]
    long = wide.unpivot("dimension", codes, code, "_value")
    entries = F.array_sort(F.collect_list(F.struct("dimension", "_value")))
    return long.groupBy(code).agg(entries.alias("_e")).select(code, F.col("_e._value").alias("embedding"))
