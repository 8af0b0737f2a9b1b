"""Leaked benchmark items: copied, with other values, and not leaked at all."""

import random

import pytest

from carepath.llm.decontaminate import Templates, clean, leaks

QUESTION = "Alice has 5 apples and gives 3 apples to Bob near the old river station today, how many remain with Alice?"
OTHER = "Carol has 17 apples and gives 4 apples to Dave near the old river station today, how many remain with Carol?"
MIXED_UP = "Carol has 17 apples and gives 4 apples to Dave near the old river station today, how many remain with Dave?"
FILLER = "some words in front of it and so on without any meaning at all for the reader"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, QUESTION, 0), (2, None, 0), (3, "", 0), (4, "short item here now", 0), (5, "What is the boiling point of water at 100 km above the sea level in summer", 0)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def test_leaks(spark, items):
    texts = [
        f"{FILLER} {QUESTION} {FILLER}",
        f"{FILLER}. {OTHER}",
        f"{FILLER} {MIXED_UP}",
        FILLER,
        None,
        "",
        "A short, item here now!",
        f"{FILLER} what is the boiling point of water at 7 miles above the sea level in summer {FILLER}",
        f"{FILLER} boiling point of water at 7 miles above the sea",
        f"{FILLER} ***Alice*** has 5 apples, and gives 3 apples to Bob\nnear the old river station today how many remain with Alice?&&&",
    ]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 9)], "doc_id long, text string, item_id long")
    found = sorted((r["doc_id"], r["item_id"], r["exact"]) for r in leaks(docs, items).collect())
    assert found == [(0, 1, True), (0, 1, True), (1, 1, False), (6, 4, True), (7, 5, False), (9, 1, True)]
    left = clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5, 8]


def test_span_and_counts(spark, items):
    docs = spark.createDataFrame([(1, f"{FILLER} {QUESTION} {FILLER}")], "doc_id long, text string")
    (row,) = leaks(docs, items).collect()
    # the first word of an item may be a name or the start of a sentence, so it may be left out
    assert row["end"] == len(FILLER.split()) + len(QUESTION.split())
    assert row["matched"] >= row["item_tokens"] - 1
    assert row["end"] - row["start"] == row["matched"]


def test_blocks_of_items_give_the_same(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(10, 30)))) for i in range(40)]
    docs = []
    for i in range(60):
        own = [r.choice(vocabulary) for _ in range(80)]
        if i % 3 == 0:
            own[20:20] = items[i % 40][1].split()
        docs.append((i, " ".join(own)))
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, leaks(docs, bench).collect()))
    many = sorted(map(tuple, leaks(docs, bench, Templates(block=100)).collect()))
    assert one == many
    # against plain words: an item is leaked where all its words are there in a row
    plain = sorted((d["doc_id"], i) for d in docs.collect() for i, t in items if f" {t} " in f" {d['text']} ")
    assert [x[:2] for x in one] == plain
    assert clean(docs, bench, Templates(block=100)).count() == 60 - len({d for d, _ in plain})


def test_empty(spark, items):
    docs = spark.createDataFrame([(1, QUESTION)], "doc_id long, text string")
    assert leaks(docs, items.limit(0)).count() == 0 and clean(docs, items.limit(0)).count() == 1
    assert leaks(docs.limit(0), items).count() == 0 and clean(docs.limit(0), items).count() == 0


def found_in(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted((r["doc_id"], r["item_id"], r["exact"]) for r in leaks(docs, bench).collect())


def test_short_and_name_heavy_items(spark):
    short, names = "Who won the 1998 World Cup Final in Paris France", "Alice Bob Carol Dave"
    texts = [f"{FILLER} {short} {FILLER}", f'{FILLER} "{short}" {FILLER}', f"{FILLER}, {short.upper()} {FILLER}", short.lower(), f"{FILLER} {names}", short[:-7]]
    assert found_in(spark, [short, names], texts) == [(0, 0, True), (1, 0, True), (2, 0, True), (3, 0, True), (4, 1, True)]


def test_readings_of_the_first_word_and_of_names(spark):
    item = "Alice sold 7 red hats at the market"
    texts = [f'{FILLER} "Carol sold 9 red hats at the market" {FILLER}', f"{FILLER} {item.lower().replace('7', '9')}", f"{FILLER}. Carol sold 9 red hats at the market"]
    assert found_in(spark, [item], texts) == [(0, 0, False), (1, 0, False), (2, 0, False)]


def test_edited_items(spark):
    item = "a train leaves the northern harbour at noon and reaches the quiet village before the evening bells"
    put_in, left_out = item.replace("noon and", "noon today and"), item.replace("noon and", "noon")
    assert found_in(spark, [item], [f"{FILLER} {put_in} {FILLER}", f"{FILLER} {left_out} {FILLER}", item[:40]]) == [(0, 0, True), (1, 0, True)]


def test_equal_numbers_are_no_conflict_but_equal_names_are(spark):
    same = QUESTION.replace("3 apples", "5 apples")
    assert found_in(spark, [QUESTION], [f"{FILLER} {same}", f"{FILLER} {OTHER.replace('Dave', 'Carol')}", f"{FILLER} {MIXED_UP}"]) == [(0, 0, False)]
