"""Base measures against plain Python, scores on held-out labels."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carepath.llm.quality import QualityRules, base_counts, fit, judged, kept
from carepath.llm.words import blocks

DATA = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n")]
    seen, dup = set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_base_measures():
    r = random.Random(8)
    parts = ["a", "b", "é", "🙂", " ", " ", "\n", "\t", "#", "*", "|", "\r", "\x0b", "x y z"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(500)] + ["", None, "\n\n", "a\na\n a\na \na", "a b c a b c"]
    for size in (64, 1 << 20):
        found = []
        for _, _, block in blocks(pa.array(texts), size):
            found += list(zip(*(v.tolist() for v in base_counts(block).values())))
        assert found == [plain(t) for t in texts]


@pytest.fixture(scope="module")
def tables(spark):
    if not Path(DATA).exists():
        pytest.skip("no generated tables")
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return docs, labels.filter(half), labels.filter(~half)


def test_held_out_labels(tables):
    docs, known, held = tables
    model = fit(docs, known)
    rows = judged(docs, model).join(held, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"] and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.1
    assert len(kept(docs, model).collect()) == judged(docs, model).filter("kept").count()


def test_reruns_and_partitions_agree(tables):
    docs, known, _ = tables
    one, two = fit(docs, known), fit(docs.repartition(5), known.repartition(3))
    assert np.array_equal(one.ratios, two.ratios) and one.threshold == two.threshold


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (None, long, "x"), (4, "same " * 80, "x"), (5, "a b c " * 20, "x"), (6, "w " * 20_000 + long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, none)
    found = {(r["doc_id"], r["n_words"]): (r["base_failed"], r["kept"]) for r in judged(docs, model).collect()}
    assert found == {
        (1, 60): (False, True), (2, 0): (True, False), (3, 0): (True, False), (None, 60): (False, True), (4, 80): (True, False), (5, 60): (True, False),
        (6, 20_060): (True, False),
    }
    assert judged(docs, model).count() == len(rows)
    out = kept(docs, model)
    assert out.columns == docs.columns and out.count() == 3
    assert judged(docs.limit(0), fit(docs.limit(0), none)).count() == 0
    assert fit(docs, spark.createDataFrame([(1, 1, 0)], none.schema), QualityRules()).ratios.any()


def test_all_trusted_documents_count(spark):
    """Where every document is trusted, target and corpus are the same, however many there are."""
    docs = spark.range(20_500).selectExpr("id doc_id", "concat_ws(' ', 'w', id, id % 7, 'x' || id % 1000) text")
    labels = docs.selectExpr("doc_id", "1 quality", "0 toxic")
    assert not fit(docs, labels).ratios.any()
