"""Near duplicates against all pairs on small texts."""

import random
from collections import Counter

import numpy as np
import pytest

from carepath.llm.near_dup import NearDup, classes, deduplicated, first_arrivals, weighted_sets
from carepath.llm.words import mix

R = random.Random(11)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(4)) for _ in range(3000)]


def weights(text, n=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return len(a.keys() & b.keys()) / max(len(a.keys() | b.keys()), 1)


def brute(texts):
    """Classes by all pairs."""
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    sets, ids = {i: weights(t) for i, t in texts.items()}, sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (texts[i] or "") == (texts[j] or "") or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in ids}


def edited(words, n):
    out = list(words)
    for _ in range(n):
        kind, at = R.randrange(3), R.randrange(len(out))
        out[at : at + (kind != 0)] = [] if kind == 1 else [R.choice(VOCABULARY)]
    return out


@pytest.fixture(scope="module")
def texts():
    found = {}
    for _ in range(30):
        base = [R.choice(VOCABULARY) for _ in range(R.randrange(5, 200))]
        for n in [0, *[R.randrange(0, 6) for _ in range(R.randrange(4))]]:
            found[len(found)] = " ".join(edited(base, n) if n else base)
    hub = [R.choice(VOCABULARY) for _ in range(150)]  # copies that are like the original, but not like each other
    for n in [0] + [2] * 40:
        found[len(found)] = " ".join(edited(hub, n))
    for n in (0, 9, 9, 12, 12, 15, 4, 4, 6, 6) * 3:  # a large bucket of texts that are mostly too far apart
        found[len(found)] = " ".join(edited(hub[::-1], n) if n else hub[::-1])
    line = " ".join(R.choice(VOCABULARY) for _ in range(8))
    for n in (1, 1, 3, 20):
        found[len(found)] = "\n".join([line] * n + [" ".join(hub[:20])])
    for odd in ("", None, "a b", "a b", "a b c", " "):
        found[len(found)] = odd
    return found


def test_classes_equal_all_pairs(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, tid string")
    found = {r["doc_id"]: r["class_id"] for r in classes(docs).collect()}
    assert found == brute(texts)


def test_one_of_each_class_stays(spark, texts):
    rows = [(i, t, "x", i % 3) for i, t in texts.items()]
    again = [(3, texts[3], "x", 0)] * 4 + [(None, texts[0], "n", 1), (None, "only here without an id", "n", 1), (None, "only here without an id", "n", 1)]
    docs = spark.createDataFrame(rows + again, "doc_id long, text string, _tid string, n int")
    out = deduplicated(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    named = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(named) == sorted(set(brute(texts).values()))
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["only here without an id"]


def test_registers_estimate_probability_jaccard():
    rng, errors = np.random.default_rng(1), []
    for _ in range(20):
        a = np.sort(rng.choice(400, size=200, replace=False)).astype(np.uint64)
        b = np.sort(np.concatenate([a[:150], (1000 + np.arange(50)).astype(np.uint64)]))
        m, n = rng.integers(1, 4, 200), rng.integers(1, 4, 200)
        x, y = dict(zip(a.tolist(), m.tolist())), dict(zip(b.tolist(), n.tolist()))
        keys = x.keys() | y.keys()
        exact = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in keys) for d in x.keys() & y.keys())
        labels = first_arrivals(mix(np.concatenate([a, b]) * np.uint64(7919)), np.concatenate([m, n]), np.array([0, 200, 400]), 512)
        errors.append((labels[0] == labels[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def test_weighted_sets():
    values, counts, offsets = weighted_sets(np.array([3, 1, 3, 2, 2], np.uint64), np.array([0, 3, 3, 5]))
    assert (values.tolist(), counts.tolist(), offsets.tolist()) == ([1, 3, 2], [1, 2, 2], [0, 2, 2, 3])


def test_empty_and_parameters(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert classes(docs).count() == 0 and deduplicated(docs).count() == 0
    two = spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "doc_id long, text string")
    assert {r["class_id"] for r in classes(two, NearDup(words=1, similarity=0.6)).collect()} == {1}


def test_pairs_with_lines_repeated_hundreds_of_times(spark):
    """Set similarity is what counts, however often a line of one's own repeats."""
    texts = {}
    for n in range(40):
        own = lambda k: [R.choice(VOCABULARY) for _ in range(k)]
        common = own(104)
        for i in (2 * n, 2 * n + 1):
            texts[i] = " ".join([*common, *(own(6) * (400 if n % 2 else 1000))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wanted = brute(texts)
    assert len(set(wanted.values())) == 40
    assert dict(map(tuple, classes(docs).collect())) == wanted


def test_large_group_near_the_threshold(spark):
    """Copies of one text that lost different parts of it: mostly just below the similarity to each other."""
    base = [R.choice(VOCABULARY) for _ in range(150)]
    texts = {i: " ".join(edited(base, R.choice([1, 3, 4, 5, 6]))) for i in range(250)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(map(tuple, classes(docs).collect())) == brute(texts)
