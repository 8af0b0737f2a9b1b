"""What filters do to each other, audited over a stream of files with retractions.

Files are read as available-now micro-batches. Four filters look at one text; the fifth fails a document whose text a smaller id has
too, wherever in the table that is, so a later file can change what was counted before. The state is keyed by text and
holds the rows of its least id so far. Each batch counts its rows under the mask of the filters they fail, and where a smaller id
arrives the rows that were the least ones are retracted from the counters under their old mask and counted under the new one. Counters
are sums of such changes by part, mask and labels; the audit of all orders of the filters is computed from them alone.

Batches, states and counters are tables in the shared folder under the number of their batch. A batch that is run again reads
the state before it and writes the same tables again, so a lost executor or driver changes no count. No group
of rows is gathered: rows of a text meet in partial aggregates and in a join on text and id.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from carepath.llm.common import narrow, text_id
from carepath.session import materialise, scratch

FILTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}
REPEATED = BIT["E"]
WORD = r"[^\x20\x09-\x0D]+"
#: micro-batches a table is dealt into; the state is written once for each
BATCHES = 4
FACTS = ["tid", "mask", "doc_id", "part", "good", "toxic"]


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails: few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(failed, BIT[letter]).otherwise(0) for letter, failed in fails.items()), F.lit(0))


def marks_of(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic`` of the labelled documents; of several labels of one document any counts."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
    is_one = lambda name: F.coalesce(F.max(F.when(F.col(name) == 1, 1)), F.lit(0))
    return known.agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")).filter("good + toxic > 0")


def batch_rows(docs: DataFrame, marks: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """The rows of a batch without their texts, equal ones counted: ``FACTS`` and ``n``."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), content.alias("text"))
    judged = named.select("doc_id", "part", text_id(F.col("text")).alias("tid"), text_failures(F.col("text")).alias("mask"))
    labelled = judged.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    return labelled.groupBy(*FACTS).agg(F.count("*").alias("n"))


def judged_rows(new: DataFrame, held: DataFrame | None) -> DataFrame:
    """Rows of the state and of the batch with ``least``, whether they have the least id of their text by now."""
    both = new.withColumn("old", F.lit(False))
    if held is not None:
        both = both.unionByName(held.withColumn("old", F.lit(True)))
    first = both.groupBy("tid").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("least", F.lit(True))
    return both.join(first, ["tid", "doc_id"], "left").withColumn("least", F.coalesce("least", F.lit(False)))


def changes(judged: DataFrame) -> DataFrame:
    """Changes of the counters ``part, mask, good, toxic, n``.

    A row of the batch counts once; a row that was the least one of its text and is no more is taken back and counted again.
    """
    entry = lambda mask, n: F.struct(mask.alias("mask"), n.alias("n"))
    mask, n = F.col("mask"), F.col("n")
    again = mask.bitwiseOR(F.lit(REPEATED))
    fresh = F.array(entry(F.when(F.col("least") | F.col("doc_id").isNull(), mask).otherwise(again), n))
    moved = F.array(entry(mask, -n), entry(again, n))
    found = judged.filter("not old or not least").select("part", "good", "toxic", F.explode(F.when(F.col("old"), moved).otherwise(fresh)).alias("e"))
    return found.groupBy("part", "e.mask", "good", "toxic").agg(F.sum("e.n").alias("n"))


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, so many in a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def part_counters(
    spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by part, failed filters and labels, gathered over the files of a Parquet table.

    A document fails E if a smaller id has the same text anywhere in the table; a null id has no smaller one and is smaller than none,
    and rows of one id and text do not repeat each other. Null texts count as empty, null parts as the empty string.
    """
    table = spark.read.parquet(path)
    files = len(table.inputFiles())
    marks = narrow(materialise(marks_of(labels), "marks"))
    root = scratch(spark, "filter-audit")
    place = lambda kind, number: f"{root}/{kind}/{number}"
    id_kind = dict(table.select(F.col(key).alias("doc_id")).dtypes)["doc_id"]
    facts = f"tid binary, mask int, doc_id {id_kind}, part string, good int, toxic int, n long"
    state = spark.read.schema(f"{facts}, old boolean, least boolean")

    def fold(batch: DataFrame, number: int) -> None:
        # what the stream's own session gives is written first, so that the rest is planned adaptively
        batch_rows(batch, marks, key, text, part).write.mode("overwrite").parquet(place("new", number))
        new = spark.read.schema(facts).parquet(place("new", number))
        held = None
        if number:
            held = state.parquet(place("state", number - 1)).filter("least").groupBy(*FACTS).agg(F.sum("n").alias("n"))
        judged_rows(new, held).write.mode("overwrite").partitionBy("least").parquet(place("state", number))
        changes(state.parquet(place("state", number))).coalesce(1).write.mode("overwrite").parquet(place("counters", number))

    stream = file_stream(spark, path, table.schema, max(1, -(-files // batches)))
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    kind = "part string, mask int, good int, toxic int, n long"
    if not query.lastProgress:  # a table without any file
        return spark.createDataFrame([], kind)
    found = spark.read.schema(kind).parquet(f"{root}/counters/*")
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def steps() -> Column:
    """All orders of the filters, each with its steps, as one array: 600 entries."""
    found = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for i, letter in enumerate(order):
            found.append({"filter_order": order, "step": i + 1, "own": BIT[letter], "before": before})
            before |= BIT[letter]
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def interactions(counters: DataFrame) -> DataFrame:
    """The audit of every order from counters ``part, mask, good, toxic, n``.

    One row per part, order and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. Masks of a part are 32
    at most, so a part is one row while its 600 steps are computed.
    """
    n = F.col("n")
    by_mask = counters.groupBy("part", "mask").agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )
    masks = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = masks.select("part", "masks", F.explode(steps()).alias("s")).select("part", "masks", "s.*")
    hits = lambda mask, bits: mask.bitwiseAND(bits) != 0
    own, before = F.col("own"), F.col("before")

    def total(where, value=lambda m: m["n"]) -> Column:
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda sum_, m: sum_ + value(m))

    here = lambda m: hits(m["mask"], own) & ~hits(m["mask"], before)
    orders = F.lit(120)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~hits(m["mask"], own.bitwiseOR(before))).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: hits(m["mask"], own) & hits(m["mask"], before)).alias("redundant"),
        total(lambda m: m["mask"] == own).alias("unique_fails"),
        total(here, lambda m: m["good"]).alias("good_lost"),
        total(here, lambda m: m["toxic"]).alias("toxic_lost"),
        # a filter is the first of those that a document fails in one of so many orders as it fails filters
        total(lambda m: hits(m["mask"], own), lambda m: m["n"] * (orders / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The audit of all orders of the five filters over the documents of a Parquet table.

    Columns other than ``doc_id, text, lang`` and ``doc_id, quality, toxic`` are not read, whatever their names. An empty table gives an empty
    result. See :func:`part_counters` for nulls, ties and repeated rows.
    """
    return interactions(part_counters(spark, path, labels, batches))
