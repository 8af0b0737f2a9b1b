"""Pieces put together again are the library's ids; sequences are full; neighbours share rare words."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from carepath.llm.packing import FAST_BELOW, LONG, Index, Packing, arranged, digests, encoder, pack, sequence_bounds

tokenizers = pytest.importorskip("public_tokenizers")
PATH, RANKS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def both():
    quick, slow = encoder(PATH, RANKS, tokenizers.PATTERN), library()
    return quick, lambda text: slow.encode(text, add_special_tokens=False).ids


def test_fast_ids_of_every_character():
    quick, slow = both()
    for code in range(1, FAST_BELOW):
        c = chr(code)
        text = f"a{c}b 1{c}2 {c}{c} {c}x !{c}! {c} \n{c}\n{c}'s  {c}  a"
        assert quick(text).tolist() == slow(text), hex(code)


def test_fast_ids_of_the_vocabulary_and_long_texts():
    quick, slow = both()
    words = [w for w in library().decode_batch([[i] for i in range(50_257)]) if w and max(w) < chr(FAST_BELOW)]
    for begin in range(0, len(words), 500):
        text = "\n".join(words[begin : begin + 500])
        assert quick(text).tolist() == slow(text)
    r = random.Random(2)
    for text in ["", "x" * 20_000, " " * 5_000, "a <|endoftext|> b", "中 文 a", "ab cd " * (LONG // 2), "".join(r.choice("ab  \n.1é") for _ in range(3 * LONG))]:
        assert quick(text).tolist() == slow(text)


def test_pieces(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 900))) for _ in range(120)]
    texts += ["", None, "中文 text", "long " * 30_000, texts[0], texts[0]]
    rows = [(i if i % 10 else None, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    rules = Packing(shard_docs=40)
    found = pack(docs, PATH, rules, RANKS, tokenizers.PATTERN).collect()
    sequences, lengths = defaultdict(list), defaultdict(int)
    for p in found:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths[at] += 1
    assert all(n == 1024 or n & (n - 1) == 0 and n < 1024 for n in lengths)
    slow = library()
    wanted = sorted([*slow.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in rows)
    # pieces of one document follow each other by their starts; documents without an own id are told apart by their contents
    by_start = defaultdict(list)
    for p in found:
        by_start[p["doc_id"], p["doc_tokens"]].append(p)
    total = sum(p["length"] for p in found)
    assert total == sum(map(len, wanted))
    for i, t, _ in rows:
        if i is not None and i != 7:
            pieces = sorted((p for p in found if p["doc_id"] == i), key=lambda p: p["start"])
            ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist()
            assert ids == [*slow.encode(t or "", add_special_tokens=False).ids, 0]
            assert [p["start"] for p in pieces] == np.concatenate([[0], np.cumsum([p["length"] for p in pieces])[:-1]]).tolist()
            assert {p["doc_tokens"] for p in pieces} == {len(ids)}
    some = digests(spark.createDataFrame(found)).filter("doc_id = 5").first()
    assert some["ids_crc32"] == next(zlib.crc32(p["ids"]) for p in found if p["doc_id"] == 5 and p["start"] == some["start"])
    assert pack(docs.limit(0), PATH, rules).count() == 0


def test_bounds():
    assert sequence_bounds(0, 1024).tolist() == []
    assert sequence_bounds(1024 + 700, 1024).tolist() == [1024, 1536, 1664, 1696, 1712, 1720, 1724]


def brute_scores(texts, seed, rules):
    import math

    lists = [t.split() for t in texts]
    mean = sum(map(len, lists)) / len(lists)
    scores = []
    for words in lists:
        total = 0.0
        for w in set(lists[seed]):
            n = sum(w in other for other in lists)
            idf = math.log((len(lists) - n + 0.5) / (n + 0.5))
            if n > 1 and idf > 0:
                f = words.count(w)
                total += idf * f * (rules.k1 + 1) / (f + rules.k1 * (1 - rules.b + rules.b * len(words) / mean))
        scores.append(total)
    return scores


def test_neighbours_by_brute_force():
    r = random.Random(4)
    texts = [" ".join(r.choices([f"w{i}" for i in range(60)], k=r.randrange(1, 30))) for _ in range(50)] + [""]
    rules = Packing()
    index = Index(texts, rules)
    for seed in range(len(texts)):
        unused = np.ones(len(texts), bool)
        unused[[seed, (seed + 1) % len(texts)]] = False
        scores = brute_scores(texts, seed, rules)
        wanted = [i for i in range(len(texts)) if unused[i] and scores[i] > 0]
        found = index.neighbours(seed, unused).tolist()
        assert sorted(found) == wanted
        assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(found, found[1:]))


def test_windows_hold_neighbours():
    topics = [[f"{t}{i}" for i in range(20)] for t in "abcd"]
    r = random.Random(6)
    texts = [" ".join(r.choices(topics[i % 4], k=30)) for i in range(40)]
    order = arranged(Index(texts, Packing()), np.full(40, 100), 1000)
    assert sorted(order.tolist()) == list(range(40))
    assert len({i % 4 for i in order[:10].tolist()}) == 1
