"""Words, hashes and shingles against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from carepath.llm.words import Texts, blocks, cores, runs, shingles

LETTERS = ["a", "b", "B", " ", "\n", "\t", "é", "É", "ß", "中", "🙂", ".", "-", "7", "\x85", " "]


def random_texts(n, seed=0, most=40):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randrange(most))) for _ in range(n)] + ["", None, "x"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_of_blocks():
    texts = random_texts(300)
    for size in (1, 50, 1 << 20):
        rows = 0
        hashes = {}
        for begin, end, block in blocks(pa.array(texts), size):
            assert begin == rows
            rows = end
            for i in range(end - begin):
                words = words_of(texts[begin + i])
                mine = slice(block.first_word[i], block.first_word[i + 1])
                raw = [bytes(block.data[b:e]).decode() for b, e in zip(block.starts[mine], block.ends[mine])]
                assert raw == words
                for word, value in zip(words, block.word_hashes[mine].tolist()):
                    assert hashes.setdefault(word, value) == value
        assert rows == len(texts)
        assert len(set(hashes.values())) == len(hashes)


def test_sliced_and_large_arrays():
    texts = pa.array(["aa b", "c", None, "d e f"])
    assert [b.words_of.tolist() for _, _, b in blocks(texts[1:])] == [[1, 0, 3]]
    assert [b.words_of.tolist() for _, _, b in blocks(texts.cast(pa.large_string()))] == [[2, 1, 0, 3]]
    assert list(blocks(texts[:0])) == []


def test_shingles_are_equal_where_words_are():
    texts = ["a b c d e f", "x a b c d e", "a b", "a b", "a", "", "b a"]
    block = next(blocks(pa.array(texts)))[2]
    found, offsets = block.shingles(5)
    assert np.diff(offsets).tolist() == [2, 2, 1, 1, 1, 0, 1]
    assert found[0] == found[3]
    assert found[4] == found[5]
    assert len(set(found.tolist())) == 6
    assert len(shingles(np.zeros(0, np.uint64), np.array([0, 0]), 5)[0]) == 0


def test_cores_and_runs():
    block = next(blocks(pa.array(['(Été) "the", ** End.', "été THE -- end"])))[2]
    found = cores(block)
    assert found.hashes[:3].tolist() == found.hashes[3:].tolist()
    assert found.place.tolist() == [0, 1, 3, 4, 5, 7]
    hashed, at = runs(found.hashes, found.first, 3)
    assert at.tolist() == [0, 3]
    assert hashed[0] == hashed[1]


def test_long_text_of_one_word():
    block = next(blocks(pa.array(["a" * 3_000_000])))[2]
    assert block.words_of.tolist() == [1]
    assert isinstance(block, Texts)
