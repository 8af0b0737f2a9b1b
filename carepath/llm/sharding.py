"""Shards from a weighted hash tree of regions, racks and shards.

A row descends the tree: at each node every child draws ``-ln(u) / weight`` with a uniform ``u``
from the hash of key and child, and the least draw wins. A child wins with a probability in
proportion to its weight, and a changed weight changes that child's draws only: rows move into it or
out of it, never between its siblings. Movement is thus confined to the subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import fresh
from carepath.session import materialise

#: cells of a shard in which rows are numbered; offsets are a table of at most shards x cells rows
CELLS = 4096
#: rows of one kind that one task writes at a time
CHUNK = 100_000


@dataclass(frozen=True)
class Leaf:
    """A shard and its place; shard numbers are unique in a tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks: int = 3) -> list[Leaf]:
    """Shards dealt over racks of ``per_rack`` and regions of ``racks`` racks."""
    return [Leaf(s // (per_rack * racks), s // per_rack % racks, s) for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree and one more shard in a region of its own, so that rows move into the new shard only.

    Inside an old region a heavier region would also draw rows that then land in old shards.
    """
    return [*leaves, Leaf(max(x.region for x in leaves) + 1, 0, max(x.shard for x in leaves) + 1, weight)]


def uniform(key: Column, node: str) -> Column:
    """A number in (0, 1) from key and node: 52 bits of an md5, the same in every engine."""
    digits = F.substring(F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), F.lit(node))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def choose(key: Column, children: dict[int, float], path: str) -> Column:
    """The child with the least weighted draw; children without weight never win."""
    draws = [
        F.struct((-F.ln(uniform(key, f"{path}{name}")) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("child"))
        for name, weight in sorted(children.items())
        if weight > 0
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def weights(leaves: list[Leaf], level: str) -> dict[int, float]:
    found: dict[int, float] = {}
    for leaf in leaves:
        found[getattr(leaf, level)] = found.get(getattr(leaf, level), 0.0) + leaf.weight
    return found


def by(column: Column, options: dict[int, Column]) -> Column:
    """The option that the column names."""
    cases = sorted(options.items())
    return reduce(lambda rest, case: F.when(column == case[0], case[1]).otherwise(rest), cases[:-1], cases[-1][1])


def with_place(docs: DataFrame, leaves: list[Leaf], key: str = "doc_id", names=("region", "rack", "shard")) -> DataFrame:
    """``docs`` with region, rack and shard of the key: one projection a level, no shuffle.

    The place is a function of key and tree alone. Columns of the same names are replaced.
    """
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    own = F.col(key)
    region, rack, shard = fresh(docs, "_region", "_rack", "_shard")
    regions = weights(live, "region")
    racks = {r: [x for x in live if x.region == r] for r in regions}
    placed = docs.withColumn(region, choose(own, regions, ""))
    placed = placed.withColumn(
        rack, by(F.col(region), {r: choose(own, weights(racks[r], "rack"), f"{r}.") for r in regions})
    )
    shards = {
        r: by(
            F.col(rack),
            {k: choose(own, weights([x for x in racks[r] if x.rack == k], "shard"), f"{r}.{k}.") for k in weights(racks[r], "rack")},
        )
        for r in regions
    }
    placed = placed.withColumn(shard, by(F.col(region), shards))
    return placed.withColumns({new: F.col(old).cast("int") for new, old in zip(names, (region, rack, shard))}).drop(region, rack, shard)


def assignments(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per document: its shard, its slot there, and its shard after one more is added.

    Equal keys share a shard (law ``key``); a null key counts as an empty one, a null text as empty
    for its crc and as no bytes for its size. Slots number the rows of a shard from 0 without gaps, by cell,
    key, size and crc. Rows alike in all of these are one kind: kinds are counted before
    the shuffle and written out again in chunks, so neither a hot key nor a repeated row is sorted in one
    task, and texts are not shuffled at all. Other columns of ``docs`` are not read. An empty table gives
    an empty table.
    """
    leaves = tree(shards)
    content = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
    )
    kinds = facts.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    kind = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.col("text_crc32"))
    cell = F.floor(uniform(kind, "slot") * F.lit(cells)).cast("int")
    kinds = materialise(
        with_place(with_place(kinds, grown(leaves), names=("region", "rack", "grown_shard")), leaves).withColumn("cell", cell),
        "kinds",
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        kinds.groupBy("shard", "cell")
        .agg(F.sum("n").alias("rows"))
        .select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    inside = (
        Window.partitionBy("shard", "cell")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = (
        kinds.join(F.broadcast(offsets), ["shard", "cell"])  # at most shards x cells rows
        .withColumn("base", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
        .withColumn("until", F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)
    )
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("base") + F.col("chunk") * CHUNK, F.col("base") + F.col("until"))).alias("slot"),
        "grown_shard",
        "region",
        "rack",
    )
