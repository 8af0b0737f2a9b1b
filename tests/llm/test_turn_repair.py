"""Repaired conversations against all edits of short ones, and odd rows."""

import hashlib
import random
import re
from itertools import product

from carepath.llm.turn_repair import EMPTY, advance, best, damaged, digests, repair, unwound

SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(turns):
    """Every (cost, audit, turns) with up to four inserts at each place; ``turns`` has (role, text, fault)."""
    grammar = re.compile(r"(s?(ua)+)?")
    one = []
    for role, text, fault in turns:
        late = 3 if fault == "truncated" else 0
        choices = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            choices += [(late, "K", [(role, text)])] + [(3 + late, "R", [(r, text)]) for r in ("user", "assistant")]
        one.append(choices)
    inserts = [(3 * n, "I" * n, [(r, "") for r in roles]) for n in range(3) for roles in product(("user", "assistant"), repeat=n)]
    spots = [inserts]
    for choices in one:
        spots += [choices, inserts]
    for picked in product(*spots):
        rows = [row for part in picked for row in part[2]]
        if grammar.fullmatch("".join(r[:1] for r, _ in rows)):
            yield sum(p[0] for p in picked), "".join(p[1] for p in picked), rows


def parsed(turns):
    tops = {EMPTY: (0, "", None)}
    for role, text, fault in turns:
        tops = advance(tops, role, text, fault)
    return best(tops)


def test_all_edits():
    r = random.Random(5)
    for _ in range(60):
        turns = [
            (r.choice(["system", "user", "assistant", "assistant", "tool"]), f"t{i}.", r.choice([None, None, None, "blank", "duplicate", "truncated"]))
            for i in range(r.randrange(4))
        ]
        cost, audit, rows = min(all_edits(turns), key=lambda found: found[:2])
        found = parsed(turns)
        assert found[:2] == (cost, audit), turns
        assert [(t["role"], t["text"]) for t in unwound(found[2])] == rows, turns


def test_long_conversation_is_cheap():
    turns = [("user" if i % 2 == 0 else "assistant", "a.", None) for i in range(2000)]
    assert parsed(turns)[:2] == (0, "K" * 2000)


def test_counts_and_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi.", "x"), (1, 1, "assistant", "Yes", "x"), (1, 3, "assistant", " \t", "x"), (1, 3, "user", "Hi.", "x"),
        (2, None, "user", "a.", "x"), (2, 5, None, None, "x"), (2, None, "system", "s.", "x"),
        (None, 0, "tool", "b.", "x"), (None, 0, "tool", "b.", "x"),
        (4, 0, "system", "only.", "x"),
        (5, 0, "user", "word! ", "x"), (5, 1, "assistant", "x" * 300_000 + "?", "x"),
        (6, 0, "user", "gone.", "x"),
    ]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, SCHEMA + ", audit string")
    found = {r["conv_id"]: r for r in repair(table, F.col("conv_id") == 6).collect()}
    assert set(found) == {1, 2, None, 4, 5, 6}
    one = found[1]
    # turns 0, 1, 3 and 3: the one number is missing, the blank assistant comes before the user (by role)
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (1, 1, 1, 1, 1)
    assert (one["audit"], one["cost"]) == ("KKDD", 11)
    assert [t["text"] for t in one["repaired"]] == ["Hi.", "Yes"]
    two = found[2]  # system and user without a number first, by role
    assert (two["gaps"], two["blank"], two["illegal"]) == (0, 1, 1)
    assert [(t["role"], t["text"]) for t in two["repaired"]] == [("system", "s."), ("user", "a."), ("assistant", "")]
    assert (two["audit"], two["cost"]) == ("KKDI", 7)
    assert (found[None]["duplicate"], found[None]["audit"], found[None]["repaired"]) == (1, "DD", [])
    assert (found[4]["audit"], found[4]["cost"], found[4]["repaired"]) == ("D", 4, [])
    assert (found[5]["audit"], found[5]["cost"], found[5]["truncated"]) == ("KK", 0, 0)
    assert (found[6]["audit"], found[6]["cost"], found[6]["gaps"], found[6]["repaired"]) == ("", 0, 0, [])
    assert repair(table.limit(0)).count() == 0


def test_damage_and_digest(spark):
    import zlib

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c}, {t}.") for c in range(60) for t in range(4)] + [(None, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    changed, lost = damaged(table)
    from pyspark.sql import functions as F

    found = [tuple(r) for r in changed.filter(~lost).select("conv_id", "turn", "role", "text").collect()]
    wanted = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        wanted += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda rows: sorted(rows, key=str)
    assert order(found) == order(wanted)
    out = digests(repair(changed, lost))
    assert out.count() == 61
    nothing = out.filter(F.col("audit").rlike("^D*$")).first()
    assert nothing is None or nothing["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = out.filter("audit = 'KKKK' and conv_id = 0").first()
    if kept:
        lines = "\n".join(f"{r}:{t}" for c, _, r, t in rows if c == 0)
        assert kept["repaired_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
