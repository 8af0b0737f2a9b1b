"""Token counts against the libraries on whole texts."""

import random

import pytest

from carepath.llm.token_counts import token_counts

tokenizers = pytest.importorskip("public_tokenizers")

PARTS = ["a", " ", "  ", "\n", "é", " ", "　", "'s", "1", "<|endoftext|>", "!", "ß", "\t", "\x85", "中", " word", " Wörter", "\x1c", "🙂", " ẁ"]


def texts():
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(800)] + ["", None, "x" * 5000, "ab cd " * 20_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path, rows = tokenizers.path(name), texts()
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string")
    found = {r["doc_id"]: r for r in token_counts(docs, path).collect()}
    for i, text in enumerate(rows):
        text = text or ""
        assert found[i]["n_tokens"] == count(text), repr(text[:80])
        assert found[i]["n_bytes"] == len(text.encode())
        assert found[i]["over_limit"] == (found[i]["n_tokens"] > 1024)
    assert token_counts(docs.limit(0), path).count() == 0
