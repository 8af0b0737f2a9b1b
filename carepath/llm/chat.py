"""Chat formatting with a grammar that is parsed back.

    conversation := turn*
    turn         := "<turn:" level ":" role ">" body "</turn>\\n"

A role or body never holds a control string: a body is first written as it is (level 0), the turn is parsed back and
compared with its source, and where they differ the body is escaped, first its control strings (level 1), then every
backslash and angle bracket (level 2), until they are the same. Escapes are ``\\s`` for a backslash, ``\\l`` for ``<`` and ``\\g``
for ``>``; a level-1 body escapes backslashes and the ``<`` of control strings only. The parser is deterministic: turns end at the
end mark, the header ends at the first ``>``, the rest is the body. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
OPEN, CLOSE, END = "<turn:", "</turn>", "</turn>\n"
LEVELS = (0, 1, 2)


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\s"), F.lit("\\"))


def escaped(text: Column, level: int = 2) -> Column:
    """Escaped text without a control string; every escape starts with a backslash, and no other backslash is left."""
    if level == 0:
        return text
    plain = F.replace(text, F.lit("\\"), F.lit("\\s"))
    if level == 1:
        for mark in (CLOSE, OPEN):
            plain = F.replace(plain, F.lit(mark), F.lit("\\l" + mark[1:]))
        return plain
    return F.replace(F.replace(plain, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def rendered(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(f"{OPEN}{level}:"), escaped(role), F.lit(">"), escaped(text, level), F.lit(END))


def pieces(formatted: Column) -> Column:
    """What stands before each end mark."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def parsed_piece(piece: Column) -> Column:
    """Role and text of a turn without its end mark; null where the grammar is broken."""
    head = F.substring_index(piece, ">", 1)
    body = F.substr(piece, F.length(head) + 2)
    level = F.substr(head, F.lit(len(OPEN) + 1), F.lit(1))
    role = unescaped(F.substr(head, F.lit(len(OPEN) + 3)))
    right = head.startswith(OPEN) & level.isin(*map(str, LEVELS)) & ~body.contains(OPEN) & ~body.contains(CLOSE)
    return F.when(right, F.struct(role.alias("role"), F.when(level == "0", body).otherwise(unescaped(body)).alias("text")))


def parse(formatted: Column) -> Column:
    """Array of ``role, text`` of the turns of a formatted conversation."""
    return F.transform(pieces(formatted), parsed_piece)


def same(formatted: Column, role: Column, text: Column) -> Column:
    """Whether a rendered turn is parsed back as exactly this turn."""
    parts = F.split(formatted, END, -1)
    back = parsed_piece(parts[0])
    return (F.size(parts) == 2) & (parts[1] == "") & F.coalesce((back["role"] == role) & (back["text"] == text), F.lit(False))


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``turns`` (``role, text`` without nulls) with ``piece``, the first rendering that is parsed back as its source."""
    role, text = F.col("role"), F.col("text")
    tries = turns.withColumns({f"try{level}": rendered(role, text, level) for level in LEVELS})
    options = [F.when(same(F.col(f"try{level}"), role, text), F.col(f"try{level}")) for level in LEVELS]
    piece = F.coalesce(*options, F.raise_error(F.concat(F.lit("turn cannot be formatted: "), text)).cast("string"))
    return tries.withColumn("piece", piece).drop(*[f"try{level}" for level in LEVELS])


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    Turns are ordered by number (nulls first), then role and text, so ties and repeated rows have one order. Null roles
    and texts count as empty, a null conversation id is a conversation. ``loss_spans`` holds start and length, in code points
    of ``formatted``, of the body of each turn of ``learn``. A conversation is one string and so is built in one task; its turns are put
    in order by a window that spills. An empty table gives an empty table; other columns are not read.
    """
    rows = chats.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    head = F.length(F.substring_index("piece", ">", 1)) + 1
    placed = formatted_turns(rows).select(
        "conv_id",
        F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0).cast("long")).alias("start"),
        "piece",
        head.alias("head"),
        (F.col("role") == learn).alias("learn"),
    )
    entry = F.struct("start", "head", "learn", "piece")
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("turns"))
    span = lambda t: F.struct(
        (t["start"] + t["head"]).alias("start"), (F.length(t["piece"]) - t["head"] - len(END)).cast("long").alias("length")
    )
    return listed.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), span).alias("loss_spans"),
    )


def read_back(chats: DataFrame, learn: str = "assistant") -> DataFrame:
    """What the formatted text of each conversation says: turns, their hash, and the text to learn from.

    That text is what ``loss_spans`` cover in ``formatted``, each span unescaped by the level of its turn of ``learn``; a span
    without such a turn stays as it is.
    """
    turns = chats.withColumn("turns", parse(F.col("formatted")))
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.filter(F.arrays_zip("turns", pieces(F.col("formatted")).alias("piece")), lambda t: t["turns"]["role"] == learn)
    levels = F.transform(learned, lambda t: F.substr(t["piece"], F.lit(len(OPEN) + 1), F.lit(1)))
    turns = turns.withColumn("masked", F.arrays_zip(F.col("loss_spans").alias("span"), levels.alias("level")))
    masked = F.filter("masked", lambda m: m["span"].isNotNull())
    cut = lambda m: F.substr("formatted", (m["span"]["start"] + 1).cast("int"), m["span"]["length"].cast("int"))
    loss = F.array_join(F.transform(masked, lambda m: F.when(m["level"].isin("1", "2"), unescaped(cut(m))).otherwise(cut(m))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
