"""Mix sources to target weights by weighted sampling without replacement.

A document's key is ``-ln(u) / weight`` with a uniform ``u`` from the hash of id and text and its quality as
weight; taking the least keys first is Efraimidis-Spirakis sampling. The target of a source over its size is a
number of epochs: complete epochs take every document, the rest of the target takes the documents of the least
keys until their sizes, summed in key order, reach it.

No source is sorted: sizes are summed in cells of the key, and only the documents of the one cell per source
where the budget ends are put in order. What comes out is one boundary per source, so the selection
is a filter and whole documents are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import fresh, narrow
from carepath.session import materialise

WORDS = r"[^\x20\x09-\x0D]+"
CELLS = 4096


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources by code point (null last); the total and the most epochs are factors."""

    weights: tuple[int, ...] = (3, 1, 2)
    total: float = 1.5
    most_epochs: float = 2.0
    seed: str = "mix"
    cells: int = CELLS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of the text's bytes that are no ASCII digits or symbols."""
    content = F.coalesce(text, F.lit(""))
    odd = F.length(content) - F.length(F.translate(content, "0123456789#*$%&|<>!=+_{}[]~^@\\/", ""))
    return F.lit(0.1) + F.lit(0.9) * (F.lit(1.0) - odd.cast("double") / F.greatest(F.length(content), F.lit(1)).cast("double"))


def scored(docs: DataFrame, names: list[str], mix: Mix, key: str, text: str, weight: Column | None) -> DataFrame:
    """``docs`` with size, key of the draw and a mark of the text."""
    size, order, mark = names
    quality = quality_weight(F.col(text)) if weight is None else weight
    step = docs.withColumn(mark, F.md5(F.coalesce(F.col(text), F.lit("")))).withColumn(size, word_count(F.col(text)))
    identity = F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(mark), F.lit(mix.seed))
    uniform = (F.conv(F.substring(F.md5(identity), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return step.withColumn(order, -F.ln(uniform) / quality)


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: the weighted share of the total, at most ``most_epochs`` sizes.

    What a full source cannot take is shared by weight among the others until none is above its limit. That
    is one level for all others: sources are filled in the order of limit over weight as long as the level
    left for the rest is above it. One row per source, so the windows are small.
    """
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), ((F.col("place") - 1) % len(mix.weights) + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.partitionBy().orderBy("ratio", "place")
    return (
        sizes.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("limit", F.lit(mix.most_epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.lit(mix.total) * F.sum("source_size").over(everything))
        .withColumn("full", F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("share", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .withColumn("target", F.least("limit", F.coalesce(F.col("share") * F.col("weight"), "limit")))
        .select("source", F.col("source_size").cast("long").alias("source_size"), "target")
    )


def boundaries(facts: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: size, target, whole epochs and the last document of the fractional epoch.

    ``facts`` has ``source, doc_id, size, order, mark``. Rows alike in all of them are one kind;
    of the last kind ``copies`` rows are taken. The last document is in if that brings the sum nearer to the target.
    """
    cell = F.floor(F.exp(-F.col("order")) * F.lit(mix.cells)).cast("int")  # the least keys have the highest cells
    cells = materialise(
        facts.withColumn("cell", cell).groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells"
    )
    goals = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), mix)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = materialise(
        goals.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")),
        "targets",
    )
    same = lambda left, right: left["source"].eqNullSafe(right["source"])
    running = Window.partitionBy("source").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("until", F.sum("words").over(running))
    last_cells = (
        summed.join(narrow(goals.select(F.col("source").alias("of"), "rest")), F.col("source").eqNullSafe(F.col("of")))
        .filter("rest > 0 and until >= rest")
        .groupBy("source")
        .agg(F.max("cell").alias("cell"), F.max_by(F.col("until") - F.col("words"), "cell").alias("before"), F.first("rest").alias("rest"))
    )
    last_cells = materialise(last_cells, "last_cells")
    near = narrow(last_cells.select(F.col("source").alias("of"), F.col("cell").alias("last"), "before", "rest"))
    kinds = (
        facts.withColumn("cell", cell)
        .join(near, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("last")))
        .groupBy("source", "order", "doc_id", "mark", "size", "before", "rest")
        .agg(F.count("*").alias("n"))
    )
    by_key = Window.partitionBy("source").orderBy("order", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(by_key), F.lit(0))
    last = (
        kinds.withColumn("start", start)
        .filter("size > 0 and start < rest")
        .withColumn("copies", F.least(F.col("n"), F.floor((F.col("rest") - F.col("start")) / F.col("size") + F.lit(0.5))))
        .groupBy("source")
        .agg(F.max_by(F.struct("order", "doc_id", "mark", "n", "copies"), F.struct("order", "doc_id", "mark")).alias("last"))
    )
    return materialise(
        goals.alias("g")
        .join(last.alias("l"), same(goals, last), "left")
        .select("g.source", "source_size", "target", "epochs", "rest", "last.*"),
        "boundaries",
    )


def decided(scores: DataFrame, ends: DataFrame, names: dict[str, str], source: str, key: str, out: list[str]) -> DataFrame:
    """``scores`` with ``source_size, target`` and the times each row is taken; ties of the last kind are numbered.

    Only rows of a last kind whose copies are not all taken, or all left, are numbered in a window.
    """
    size_of, target, times, tie = out
    side = narrow(ends.select(*[F.col(c).alias(f"{times}_{c}") for c in ends.columns]))
    end = {c: F.col(f"{times}_{c}") for c in ends.columns}
    order, mark = F.col(names["order"]), F.col(names["mark"])
    joined = scores.join(side, F.col(source).eqNullSafe(end["source"]), "left")
    place = F.struct(order, F.col(key), mark)
    limit = F.struct(end["order"], end["doc_id"], end["mark"])
    has = end["order"].isNotNull()
    at_end = has & (order == end["order"]) & F.col(key).eqNullSafe(end["doc_id"]) & (mark == end["mark"])
    inside = (
        F.when(~has, F.lit(0))
        .when(at_end, F.when(end["copies"] >= end["n"], 1).otherwise(0))
        .when(place < limit, 1)
        .otherwise(0)
    )
    joined = (
        joined.withColumn(size_of, end["source_size"])
        .withColumn(target, end["target"])
        .withColumn(tie, F.coalesce(at_end & (end["copies"] > 0) & (end["copies"] < end["n"]), F.lit(False)))
    )
    plain = joined.filter(~F.col(tie)).withColumn(times, end["epochs"] + inside)
    row = Window.partitionBy(F.col(source), order).orderBy(mark)
    tied = joined.filter(F.col(tie)).withColumn(times, end["epochs"] + F.when(F.row_number().over(row) <= end["copies"], 1).otherwise(0))
    # a kind may be split only where rows repeat, so the second branch is mostly empty and is left out then
    both = plain.unionByName(tied) if ends.filter("copies > 0 and copies < n").limit(1).count() else plain
    return both.drop(tie, *[f"{times}_{c}" for c in ends.columns])


def mix_report(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken, epochs_taken``.

    Null texts and texts without words have size 0 and take no words. Repeated rows count one by one; of equal rows
    at the end of a budget as many are taken as fit. Null sources are a source of their own, the last one.
    An empty table gives an empty table; other columns are not read. The same rows give the same mix.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), (F.lit(None) if weight is None else weight).alias("weight"))
    facts = materialise(
        scored(base, ["size", "order", "mark"], mix, "doc_id", "text", None if weight is None else F.col("weight")).drop("text", "weight"), "facts"
    )
    found = decided(facts, boundaries(facts, mix), {"order": "order", "mark": "mark"}, "source", "doc_id", ["source_size", "target", "times", "tie"])
    return found.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), F.col("times").alias("epochs_taken")
    )


def mixed(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all columns of ``docs``.

    Rows without words follow their key like the others.
    """
    names = fresh(docs, "_size", "_order", "_mark", "_source_size", "_target", "_times", "_tie", "_copy")
    scores = scored(docs, names[:3], mix, key, text, weight)
    facts = materialise(
        scores.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(names[0]).alias("size"), F.col(names[1]).alias("order"), F.col(names[2]).alias("mark")),
        "facts",
    )
    found = decided(scores, boundaries(facts, mix), {"order": names[1], "mark": names[2]}, source, key, names[3:7])
    times = F.col(names[5])
    return (
        found.filter(times > 0)
        .withColumn(names[7], F.explode(F.sequence(F.lit(1), times.cast("int"))))
        .select(*[found[c] for c in docs.columns])
    )
