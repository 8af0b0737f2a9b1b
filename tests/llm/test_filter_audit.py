"""The audit of filters against a plain count over all orders, with files that arrive in any order of ids."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest

from carepath.llm.filter_audit import filter_audit, part_counters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, mask string"
LABELS = "doc_id long, quality int, toxic int, n string"


def plain(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        parts[lang or ""].append(({c for c in fails if fails[c]}, i in good, i in toxic))
    found = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for fails, *_ in rows:
                first = next((c for c in order if c in fails), None)
                if first:
                    shapley[first] += 1
        for order in permutations("ABCDE"):
            for k, own in enumerate(order):
                before = set(order[:k])
                here = [r for r in rows if own in r[0] and not r[0] & before]
                found[part, "".join(order), k + 1] = (
                    sum(not r[0] & (before | {own}) for r in rows), len(here), sum(own in r[0] and bool(r[0] & before) for r in rows),
                    sum(r[0] == {own} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), shapley[own],
                )
    return found


def table():
    r = random.Random(7)
    texts = [None, "", " \t\n", "A B C", "few words", " ".join(f"w{i}" for i in range(120)), " ".join(f"w{i % 60}" for i in range(200)) + " #", "É" * 40 + " X",
             " ".join(f"W{i}" for i in range(100)), " ".join(f"w{i}" for i in range(50_000)), "same text | here"]
    docs = [(i, r.choice(texts), r.choice(["en", "de", None, ""]), "x") for i in range(400)]
    docs += [(None, "few words", "en", "x"), (None, "few words", "en", "x"), (3, docs[3][1], "fr", "x"), (3, docs[3][1], docs[3][2], "x"), (3, "few words", "en", "x")]
    docs += [(1000 + i, "same text | here", "hot", "x") for i in range(300)] + [(999, "same text | here", "hot", "x")]
    r.shuffle(docs)
    labels = [(r.randrange(400), r.choice([0, 1, None]), r.choice([0, 1]), "x") for _ in range(200)] + [(None, 1, 1, "x"), (999, 1, 1, "x"), (1000, 0, 1, "x")]
    return docs, labels


@pytest.mark.parametrize("files", [1, 7])
def test_all_orders(spark, tmp_path, files):
    docs, labels = table()
    path = str(tmp_path / "documents.parquet")
    if files == 1:
        import pandas as pd

        pd.DataFrame({"doc_id": pd.array([d[0] for d in docs], "Int64"), "text": [d[1] for d in docs], "lang": [d[2] for d in docs]}).to_parquet(path)
    else:
        spark.createDataFrame(docs, DOCS).repartition(files).write.parquet(path)
    rows = filter_audit(spark, path, spark.createDataFrame(labels, LABELS)).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(rows) == len(found)
    assert found == plain(docs, labels)


def test_retractions(spark, tmp_path):
    """The least id comes last, so every batch takes back what the one before has counted."""
    path = str(tmp_path / "documents.parquet")
    for i in range(5, 0, -1):
        frame = spark.createDataFrame([(i, "one text", f"l{i}", "x"), (10 * i, "one text", f"l{i}", "x")], DOCS)
        frame.coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame([(1, 1, 0, "x")], LABELS)
    once = {tuple(r) for r in part_counters(spark, path, labels, batches=1).collect()}
    many = {tuple(r) for r in part_counters(spark, path, labels, batches=5).collect()}
    # A and B are bits 1 and 2: few words, no repeat; E is 16
    assert once == many == {("l1", 1, 1, 0, 1), ("l1", 17, 0, 0, 1), *((f"l{i}", 17, 0, 0, 2) for i in range(2, 6))}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    assert filter_audit(spark, path, spark.createDataFrame([], LABELS)).count() == 0
