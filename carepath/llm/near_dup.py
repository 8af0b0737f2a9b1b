"""Near-duplicate documents by ProbMinHash over weighted word shingles, banding and verification.

Every shingle of a text, weighted by ``1 + ln(count)``, is a Poisson process that sends arrivals to random registers; a
register keeps the shingle that arrives first. Two texts agree in a register with a probability equal to the probability
Jaccard similarity of their shingle weights. That is far below the Jaccard similarity of the sets where a line repeats, so a text with
shingles that repeat has a second set of registers with weight 1, from the same draws: without repeats both are the same. Arrivals of a
shingle are drawn one after the other and stop when they are later than every register of the text. Registers are
joined to bands; texts that share a band are candidates, and candidates are verified: the Jaccard similarity of all their
shingles must reach the threshold.

First each member of a bucket is compared with one random leader, then, in buckets that are not one class yet, with the two
members that have the most links, which closes a class around an original. What is left are texts that are somewhat
alike. Those that share too few shingles with all other classes are left out by an exact bound. The others meet the texts of other
classes in their buckets under a second exact bound: shingles that classes share are counted in cells of their hash, and two texts have no
more in common than the sum of the lesser counts. Texts that lost different parts of one original, which are all just below the
threshold to each other, fall apart by that without a look at their shingles, and hardly any pair is left to verify.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import components, fresh, narrow, text_id
from carepath.llm.words import ODD, U64, Texts, blocks, lists, mix
from carepath.session import materialise


@dataclass(frozen=True)
class NearDup:
    """Words of a shingle, least similarity, bands and registers of a band.

    With 24 bands of 4 a pair of similarity 0.8 shares no band of weight 1 with a probability of 3e-6.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4


def weighted_sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each list in ascending order, their counts, and the new offsets."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, of))
    values, of = hashes[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values))), np.searchsorted(of[at], np.arange(len(offsets)))


def damped(counts: np.ndarray) -> np.ndarray:
    """Weights of shingles: a line that is repeated a thousand times should not outweigh the rest of a text."""
    return 1.0 + np.log(counts)


def first_arrivals(values: np.ndarray, weights: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """The value that arrives first at each register of each list; rows of empty lists are 0."""
    count = len(offsets) - 1
    of = np.repeat(np.arange(count), np.diff(offsets))
    earliest = np.full(count * registers, np.inf)
    labels = np.zeros(count * registers, U64)
    time, active, turn = np.zeros(len(values)), np.arange(len(values)), 0
    while len(active):
        draw = mix(values[active] + U64((2 * turn + 1) * ODD % 2**64))
        uniform = ((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weights[active]
        slot = of[active] * registers + (mix(draw ^ U64(ODD)) % U64(registers)).astype(np.int64)
        near = np.flatnonzero(time < earliest[slot])
        np.minimum.at(earliest, slot[near], time[near])
        won = near[time[near] == earliest[slot[near]]]
        labels[slot[won]] = values[active[won]]
        latest = earliest.reshape(count, registers).max(axis=1)
        going = time < latest[of[active]]
        active, time, turn = active[going], time[going], turn + 1
    return labels.reshape(count, registers)


def bands_of(texts: Texts, rules: NearDup) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of each text as a flat array with offsets; a text without words has none.

    A text in which a shingle repeats has the bands of its sets, of weight 1, behind those of its weights.
    """
    hashes, offsets = texts.shingles(rules.words)
    values, counts, offsets = weighted_sets(hashes, offsets)
    there = np.diff(offsets) > 0
    of = np.repeat(np.arange(texts.count), np.diff(offsets))
    repeats = np.zeros(texts.count, bool)
    repeats[of[counts > 1]] = True
    some = repeats[of]
    weighted = joined(first_arrivals(values, damped(counts), offsets, rules.bands * rules.rows), rules)[there]
    sizes = np.concatenate([[0], np.cumsum(np.diff(offsets)[repeats])])
    plain = joined(first_arrivals(values[some], np.ones(some.sum()), sizes, rules.bands * rules.rows), rules)
    order = np.argsort(np.concatenate([np.flatnonzero(there), np.flatnonzero(repeats)]), kind="stable")
    total = np.concatenate([weighted, plain])[order]
    return total.reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum((there + repeats.astype(np.int64)) * rules.bands)])


def joined(labels: np.ndarray, rules: NearDup) -> np.ndarray:
    """Hash of each band of registers, numbered, by text."""
    grouped = labels.reshape(-1, rules.bands, rules.rows)
    total = np.arange(rules.bands, dtype=U64) * U64(ODD)
    for j in range(rules.rows):
        total = mix(total + grouped[:, :, j])
    return total


def banding(rules: NearDup):
    """An Arrow function from texts to their bands."""

    def bands(column: pa.Array) -> pa.Array:
        parts = [lists(*bands_of(texts, rules)) for _, _, texts in blocks(column)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(bands, "array<long>")


def shingling(words: int):
    """An Arrow function from texts to their distinct shingles, ascending."""

    def sets(column: pa.Array) -> pa.Array:
        parts = []
        for _, _, texts in blocks(column):
            values, _, offsets = weighted_sets(*texts.shingles(words))
            parts.append(lists(values.view(np.int64), offsets))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(sets, "array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b`` of the pairs that are similar enough; a written table."""
    side = lambda name: sets.select(F.col("tid").alias(name), F.col("set").alias(f"set_{name}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    sizes = F.size("set_a") + F.size("set_b")
    return materialise(both.filter(common >= F.lit(least) * (sizes - common) - 1e-9).select("a", "b"), "links")


#: cells of the hash in which shared shingles are counted; more cells, a tighter bound
CELLS = 32


def shared_parts(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``tid, n, shared, cells`` of the texts of ``classes`` (``tid, class``): their shingles, and those that a text of another class has too.

    ``cells`` counts the shared ones by a part of their hash. A text that shares none is left out.
    """
    looked = sets.join(classes, "tid").select("tid", "class", F.size("set").alias("n"), "set")
    every = looked.select("tid", "class", "n", F.explode("set").alias("shingle"))
    common = every.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("shingle")
    cell = F.pmod("shingle", F.lit(CELLS))
    counts = F.array(*[F.count_if(cell == c).cast("int") for c in range(CELLS)])
    return every.join(common, "shingle").groupBy("tid", "n").agg(F.count("*").alias("shared"), counts.alias("cells"))


def still_open(active: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets that have more than one class, with their ``class``; a written table."""
    named = active.drop("class").join(labels, "tid", "left").withColumn("class", F.xxhash64(F.coalesce("label", "tid"))).drop("label")
    open_buckets = named.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("band")
    return materialise(named.join(open_buckets, "band", "left_semi"), "active")


def may_reach(least: float) -> Column:
    """Whether two texts of different classes can reach the similarity, by their sizes and by what they may have in common."""
    needed = F.lit(least / (1 + least)) * (F.col("n") + F.col("r_n")) - 1e-6
    common = sum((F.least(F.col("cells")[c], F.col("r_cells")[c]) for c in range(1, CELLS)), F.least(F.col("cells")[0], F.col("r_cells")[0]))
    return (F.least("shared", "r_shared") >= needed) & (common >= needed)


def across_classes(active: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` of texts of one bucket and different classes that may be similar enough.

    Texts that share too little with other classes are left out, which is exact. In each bucket the texts of all classes but
    the main one, that with the most texts, are joined to all; the main class is not joined to itself.
    """
    classes = active.select("tid", "class").distinct()
    sizes = shared_parts(sets, narrow(materialise(classes, "open"))).filter(F.col("shared") >= F.lit(least) * F.col("n") - 1e-6)
    weight = classes.groupBy("class").agg(F.count("*").alias("members"))
    facts = ["tid", "class", "n", "shared", "cells"]
    rows = active.select("band", "tid", "class").join(narrow(materialise(sizes, "sizes")), "tid").join(narrow(materialise(weight, "weights")), "class")
    rows = materialise(rows.select("band", *facts, "members"), "rows")
    groups = rows.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.struct("members", "class")).alias("main"))
    groups = groups.filter("low < high").select("band", F.col("main.class").alias("main"))
    left = rows.join(groups, "band").filter(F.col("class") != F.col("main"))
    right = rows.select("band", *[F.col(c).alias(f"r_{c}") for c in facts])
    met = left.join(right, "band").filter((F.col("class") != F.col("r_class")) & may_reach(least))
    return met.select(F.least("tid", "r_tid").alias("a"), F.greatest("tid", "r_tid").alias("b")).distinct()


def links(buckets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Enough verified links among the members of each bucket to tell its classes; ``buckets`` has ``band, tid``."""
    mark = F.xxhash64("tid", "band")
    leaders = buckets.groupBy("band").agg(F.min(F.struct(mark.alias("mark"), F.col("tid"))).alias("first")).select("band", F.col("first.tid").alias("leader"))
    met = buckets.join(leaders, "band")
    ordered = [F.least("tid", "leader").alias("a"), F.greatest("tid", "leader").alias("b")]
    tested = materialise(met.filter("tid <> leader").select(*ordered).distinct(), "pairs")
    found = verified(tested, sets, least)
    active = still_open(buckets, components(found).withColumnRenamed("node", "tid"))
    if not active.limit(1).count():
        return found
    degrees = found.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("degree"))
    best = Window.partitionBy("band").orderBy(F.desc("degree"), F.xxhash64("tid", "band"), "tid")
    leaders = (
        active.join(degrees, "tid")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= 2)
        .select("band", F.col("tid").alias("leader"), F.col("class").alias("leading"))
    )
    pairs = active.join(materialise(leaders, "leaders"), "band").filter(F.col("class") != F.col("leading")).select(*ordered).distinct()
    pairs = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    found = found.unionByName(verified(pairs, sets, least))
    tested = tested.unionByName(pairs)
    active = still_open(active, components(found).withColumnRenamed("node", "tid"))
    if not active.limit(1).count():
        return found
    pairs = materialise(across_classes(active, sets, least).join(tested, ["a", "b"], "left_anti"), "pairs")
    return found.unionByName(verified(pairs, sets, least))


def text_classes(docs: DataFrame, rules: NearDup, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Written tables ``doc_id, tid`` of all documents and ``tid, label`` of the texts that are like another text."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(key).alias("doc_id"), content.alias("text")).withColumn("tid", text_id(F.col("text")))
    signed = materialise(base.select("doc_id", "tid", banding(rules)(F.col("text")).alias("bands")), "signed")
    members = signed.select("tid", F.explode("bands").alias("band")).distinct()
    shared = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    buckets = materialise(members.join(shared, "band"), "buckets")
    candidates = narrow(materialise(buckets.select("tid").distinct(), "candidates"))
    sets = materialise(
        base.select("tid", "text")
        .join(candidates, "tid", "left_semi")
        .dropDuplicates(["tid"])
        .select("tid", shingling(rules.words)(F.col("text")).alias("set")),
        "sets",
    )
    labels = materialise(components(links(buckets, sets, rules.similarity)), "classes")
    return signed.select("doc_id", "tid"), labels.withColumnRenamed("node", "tid")


def classes(docs: DataFrame, rules: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, class_id``; the least id of all documents that are linked to it, itself included.

    Equal texts are one text, a null text is an empty one, and texts without words are linked to equal texts only. Shorter texts than a
    shingle are one shingle. Repeated rows have a row each. Ids are ignored as the least id of a class if null; a class
    of null ids has a null class id. An empty table gives an empty table; other columns are not read.
    """
    members, labels = text_classes(docs, rules, key, text)
    texts = members.groupBy("tid").agg(F.min("doc_id").alias("least")).join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    texts = materialise(texts, "texts")
    named = texts.join(texts.groupBy("label").agg(F.min("least").alias("class_id")), "label").select("tid", "class_id")
    return members.join(named, "tid").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, rules: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one of the least id (null last), with all its columns.

    What is dropped is a narrow table of ids and texts, so the documents themselves are shuffled only if that table is too large to
    send around. Of rows equal in id and text any one stays.
    """
    members, labels = text_classes(docs, rules, key, text)
    rows = members.groupBy("tid", "doc_id").agg(F.count("*").alias("n")).join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    rows = materialise(rows, "rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("tid"))
    kept = rows.groupBy("label").agg(F.min(place).alias("keep"))
    judged = rows.join(kept, "label").withColumn("keeps", (F.col("keep.tid") == F.col("tid")) & F.col("keep.doc_id").eqNullSafe(F.col("doc_id")))
    out = materialise(judged.filter("not keeps or n > 1").select(F.col("tid").alias("_t"), F.col("doc_id").alias("_d"), "keeps"), "dropped")
    (mark,) = fresh(docs, "_tid")
    marked = docs.withColumn(mark, text_id(F.col(text).cast("string")))
    meets = lambda side: (marked[mark] == side["_t"]) & marked[key].eqNullSafe(side["_d"])
    gone = narrow(out)
    left = marked.join(gone, meets(gone), "left_anti")
    repeats = out.filter("keeps")
    if repeats.limit(1).count():  # rows that are there more than once, of which one stays
        again = narrow(repeats)
        left = left.unionByName(marked.join(again, meets(again), "left_semi").dropDuplicates([key, mark]))
    return left.drop(mark)
