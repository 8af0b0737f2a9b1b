"""Repair of the roles of conversations with a graph-structured stack over the grammar of roles.

A conversation is ``(s?(ua)+)?``: an optional system turn, then pairs of user and assistant, or nothing. The parser reads the turns in order
and follows all repairs at once: keep, delete or rerole a turn, or insert an empty one in front of it. The stack of such a
parser is a graph whose tops are the states of the grammar; stacks with equal tops are merged and the cheaper one stays, of equally cheap
ones that with the least audit. An audit has a letter for each action, so two audits of one cost that have read the same turns are
never the beginning of one another, and what is less now stays less whatever follows: merging loses nothing.

Turns are shuffled once, sorted by Spark and streamed through the parser. Repeats are marked by a window before that, so the parser holds the
turns it still keeps of one conversation and nothing else. A conversation is one row of the result, so its length is bounded by a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import fresh

USER, ASSISTANT = "user", "assistant"
WORD = r"[^\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
UNFINISHED = 3

#: tops of the stack: nothing yet, a system turn, a user's turn, a whole pair
EMPTY, SYSTEM, ASKED, ANSWERED = range(4)
SHIFT = {
    EMPTY: {"s": SYSTEM, "u": ASKED},
    SYSTEM: {"u": ASKED},
    ASKED: {"a": ANSWERED},
    ANSWERED: {"u": ASKED},
}
ACCEPTED = (EMPTY, ANSWERED)
#: the one turn that may be written or reroled at a top, and the top it leads to
WRITTEN = {EMPTY: (USER, ASKED), SYSTEM: (USER, ASKED), ASKED: (ASSISTANT, ANSWERED), ANSWERED: (USER, ASKED)}

FAULTS = ("blank", "duplicate", "truncated")

#: a stack: cost, audit, and its turns as linked pairs (the turns below, role, text)
Stack = tuple[int, str, tuple | None]


def merge(tops: dict[int, Stack], top: int, stack: Stack) -> bool:
    """Keep the better of two stacks with the same top; tells whether the new one is."""
    if top in tops and tops[top][:2] <= stack[:2]:
        return False
    tops[top] = stack
    return True


def with_inserts(tops: dict[int, Stack]) -> dict[int, Stack]:
    """All stacks that inserted turns lead to; more than a few are never cheaper."""
    todo = list(tops)
    while todo:
        top = todo.pop()
        cost, audit, turns = tops[top]
        role, then = WRITTEN[top]
        if merge(tops, then, (cost + COST[INSERT], audit + INSERT, (turns, role, ""))):
            todo.append(then)
    return tops


def advance(tops: dict[int, Stack], role: str, text: str, fault: str | None) -> dict[int, Stack]:
    """All stacks after one more turn; a blank or repeated one must go."""
    found: dict[int, Stack] = {}
    late = UNFINISHED if fault == "truncated" else 0
    for top, (cost, audit, turns) in with_inserts(tops).items():
        merge(found, top, (cost + COST[DELETE], audit + DELETE, turns))
        if fault in ("blank", "duplicate"):
            continue
        kept = SHIFT[top].get(role[:1])
        if kept is not None:
            merge(found, kept, (cost + late, audit + KEEP, (turns, role, text)))
        other, then = WRITTEN[top]
        merge(found, then, (cost + COST[REROLE] + late, audit + REROLE, (turns, other, text)))
    return found


def best(tops: dict[int, Stack]) -> Stack:
    tops = with_inserts(tops)
    return min((tops[top] for top in ACCEPTED if top in tops), key=lambda s: s[:2])


def unwound(turns: tuple | None) -> list[dict]:
    found = []
    while turns is not None:
        turns, role, text = turns
        found.append({"role": role, "text": text})
    return found[::-1]


class Conversation:
    """Counts and stacks of the turns read so far."""

    def __init__(self, conv_id):
        self.conv_id, self.tops, self.counts = conv_id, {EMPTY: (0, "", None)}, dict.fromkeys(FAULTS, 0)
        self.initial, self.illegal, self.first, self.last, self.distinct = None, 0, None, None, 0

    def read(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault:
            self.counts[fault] += 1
        self.tops = advance(self.tops, role, text, fault)

    def row(self) -> dict:
        cost, audit, turns = best(self.tops)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired": unwound(turns)}


def fault_of(text: Column, repeated: Column) -> Column:
    """The first fault of a turn, or null."""
    last = F.regexp_extract(text, WORD + r"(?=[\x20\x09-\x0D]*\z)", 0)
    return F.when(~text.rlike(WORD), "blank").when(repeated, "duplicate").when(~last.isin(".", "!", "?"), "truncated")


#: characters of texts in one batch of the result
BATCH = 1 << 22


def parsing(schema: pa.Schema):
    """A function of sorted batches of turns that gives a row for each conversation."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, rows, size = None, [], 0
        for batch in batches:
            for conv_id, turn, role, text, fault, there in zip(*(c.to_pylist() for c in batch.columns)):
                if open_one is None or conv_id != open_one.conv_id:
                    if open_one is not None:
                        rows.append(open_one.row())
                    if size > BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                    open_one = Conversation(conv_id)
                if there:
                    size += len(text)
                    open_one.read(turn, role, text, fault)
        if open_one is not None:
            rows.append(open_one.row())
        yield pa.RecordBatch.from_pylist(rows, schema)

    return parse


def repair(chats: DataFrame, lost: Column | None = None) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text``: its faults, the cheapest repair and the repaired turns.

    ``gaps, blank, duplicate, truncated, illegal, cost, audit`` and ``repaired``, an array of role and text. Turns are taken by number,
    those without a number first; turns of one number by role and text. A null role or text counts as one space, so it
    is blank. A turn is a duplicate if an earlier one has its role and text, repeated rows too. Conversations without an id are one conversation.
    Rows for which ``lost`` is true are not read; a conversation of such rows only has an empty audit and no turn.
    An empty table gives an empty table, other columns are not read.
    """
    kind = dict(chats.dtypes)["conv_id"]
    there = F.lit(True) if lost is None else ~F.coalesce(lost, F.lit(False))
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    rows = chats.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), there.alias("there"))
    same = Window.partitionBy("conv_id", "role", F.md5("text"), "there").orderBy("turn")
    # the one shuffle; the window over keys of a conversation and the sort below take its partitions
    rows = rows.repartition("conv_id").withColumn("repeat", F.row_number().over(same))
    rows = rows.withColumn("fault", fault_of(F.col("text"), F.col("repeat") > 1))
    ordered = rows.sortWithinPartitions("conv_id", "turn", "role", "text", "repeat")
    counts = ", ".join(f"{name} long" for name in ("gaps", *FAULTS, "illegal", "cost"))
    shape = f"conv_id {kind}, {counts}, audit string, repaired array<struct<role:string,text:string>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(shape))
    return ordered.select("conv_id", "turn", "role", "text", "fault", "there").mapInArrow(parsing(schema), shape)


def damaged(chats: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with known faults, by the checksum of ``conv_id:turn``, and the column that marks dropped rows.

    Of twenty checksums 0 drops a row, 1 empties its text, 2 removes its full stops, 3 repeats it and 4 makes it a user's. Nulls are one space.
    """
    (draw,) = fresh(chats, "draw")
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    base = chats.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"))
    base = base.withColumn(draw, F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20)
    text = F.when(F.col(draw) == 1, "").when(F.col(draw) == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = base.withColumn("text", text).withColumn("role", F.when(F.col(draw) == 4, USER).otherwise(F.col("role")))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col(draw) == 3, 2).otherwise(1)))
    return changed.withColumn("copy", copies).drop("copy"), F.col(draw) == 0


def digests(repaired: DataFrame) -> DataFrame:
    """The result of :func:`repair` with a digest of the repaired turns in their place."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repaired.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")
