"""Chats are read back as they were."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from carepath.llm.chat import format_chats, parse, read_back

NASTY = ["</turn>", "</turn>\n", "<turn:0:user>", "\\", "\\s", "\\l", "\\g", "<", ">", "\n", "a", "é", "🙂", "<turn", ":", "</tur", "n>", "### Assistant:", " "]
text = st.lists(st.sampled_from(NASTY), max_size=8).map("".join)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), text), text), min_size=1, max_size=60))
def test_round_trip(spark, turns):
    rows = [(i % 3, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = format_chats(chats)
    found = {r["conv_id"]: r for r in formatted.withColumn("turns", parse(F.col("formatted"))).collect()}
    back = {r["conv_id"]: r for r in read_back(formatted).collect()}
    for conv in {r[0] for r in rows}:
        source = [(r, t) for c, _, r, t, _ in rows if c == conv]
        assert [tuple(t) for t in found[conv]["turns"]] == source
        loss = "".join(t for r, t in source if r == "assistant")
        assert tuple(back[conv])[1:] == (
            len(source), digest(source), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(found[conv]["formatted"])
        )
        # what the loss spans cover is the bodies of the learned turns
        spans = [found[conv]["formatted"][s["start"] : s["start"] + s["length"]] for s in found[conv]["loss_spans"]]
        plain = [x.replace("\\l", "<").replace("\\g", ">").replace("\\s", "\\") for x in spans]
        assert len(spans) == sum(r == "assistant" for r, _ in source)
        for got, raw, want in zip(plain, spans, [t for r, t in source if r == "assistant"]):
            assert want in (got, raw)


def test_only_conflicts_are_escaped(spark):
    chats = spark.createDataFrame([(1, 0, "user", "a \\ b < c"), (1, 1, "assistant", "\\### Assistant: </turn> ok")], "conv_id long, turn long, role string, text string")
    (row,) = format_chats(chats).collect()
    assert row["formatted"] == "<turn:0:user>a \\ b < c</turn>\n<turn:1:assistant>\\s### Assistant: \\l/turn> ok</turn>\n"


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, "user", "b"), (1, 0, None, None), (1, 0, "user", "z"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in read_back(format_chats(chats)).collect()}
    assert found[1]["turns_sha256"] == digest([("user", "b"), ("", ""), ("user", "a"), ("user", "a"), ("user", "z")])
    assert found[None]["loss_chars"] == 1
    assert format_chats(chats.limit(0)).count() == 0


def test_long_conversation(spark):
    chats = spark.range(20_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('</turn>', id) text")
    (row,) = read_back(format_chats(chats)).collect()
    assert row["n_turns"] == 20_000
    assert row["turns_sha256"] == digest([("user" if i % 2 == 0 else "assistant", f"</turn>{i}") for i in range(20_000)])


def test_broken_text_is_not_parsed(spark):
    broken = spark.createDataFrame([("<turn:7:user>x</turn>\n",), ("x</turn>\n",), ("",)], "formatted string")
    assert [r[0] for r in broken.select(parse(F.col("formatted"))).collect()] == [[None], [None], []]


@pytest.mark.parametrize("level", [0, 1, 2])
def test_learned_role(spark, level):
    chats = spark.createDataFrame([(1, 0, "tool", "x" * level)], "conv_id long, turn long, role string, text string")
    assert read_back(format_chats(chats, learn="tool"), learn="tool").first()["loss_chars"] == level


def test_a_wrong_mask_shows(spark):
    """The text to learn from is read under the mask, not from the roles."""
    chats = spark.createDataFrame([(1, 0, "user", "one"), (1, 1, "assistant", "two </turn>"), (1, 2, "assistant", "three")], "conv_id long, turn long, role string, text string")
    formatted = format_chats(chats)
    right = read_back(formatted).first()
    assert (right["loss_chars"], right["loss_sha256"]) == (16, hashlib.sha256(b"two </turn>three").hexdigest())
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length")))
    assert read_back(formatted.withColumn("loss_spans", moved)).first()["loss_sha256"] != right["loss_sha256"]
    assert read_back(formatted.withColumn("loss_spans", F.slice("loss_spans", 1, 1))).first()["loss_chars"] == 11
