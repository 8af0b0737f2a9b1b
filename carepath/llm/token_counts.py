"""Token counts with a public tokenizer, in Arrow batches that return lengths only.

Texts are split where the byte-level tokenizer starts a new piece anyway: before a single space between two characters
that are no white space. The tokens of a text are then the sum over its pieces, and each distinct piece of a block
is encoded once. Blocks are cut by bytes, not by rows, so batches are alike however long the texts are.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.words import Texts, blocks

#: bytes of texts in a block, and pieces whose lengths a worker keeps
BLOCK = 1 << 20
KEPT = 500_000
#: bytes for one call of a sentence model
BATCH = 1 << 18

#: First bytes of UTF-8 characters among which there is white space beyond ASCII.
WIDE_SPACES = {2: [0xC2], 3: [0xE1, 0xE2, 0xE3]}


@lru_cache(maxsize=2)
def byte_level(path: str) -> bool:
    """Whether the file's tokenizer cuts the plain text at spaces before anything else."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    cut = parts.get("pre_tokenizer") or {}
    marked = any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in parts.get("added_tokens", []))
    return parts.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not marked


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """Encode texts to lengths with the library's tokenizer, without truncation or padding, and an empty memory.

    Only byte-level tokenizers that split at spaces go by pieces; see :func:`byte_level`.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()

        def encode(pieces: list[str]) -> np.ndarray:
            # one call for all pieces; each token tells the piece it is from
            of = found.encode(pieces, is_pretokenized=True, add_special_tokens=False).word_ids if pieces else []
            return np.bincount(np.array(of, np.int64), minlength=len(pieces))

        return encode, {}
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], {}


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of single spaces before which a byte-level tokenizer always starts a new piece.

    Neighbours that may be white space, in ASCII or beyond, are left out; that costs a cut, not a count.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    before, after = data[at - 1], data[at + 1]
    safe = (before > 0x20) & (before != 0x7F) & (after > 0x20) & (after != 0x7F)
    for size, firsts in WIDE_SPACES.items():
        wide = np.zeros(256, bool)
        wide[firsts] = True
        safe &= ~wide[after] & ~wide[data[np.maximum(at - size, 0)]]
    return at[safe]


def count_pieces(texts: Texts, encode, known: dict[bytes, int]) -> np.ndarray:
    """Tokens of each text of a block; ``known`` keeps the lengths of pieces from block to block."""
    if not len(texts.data):
        return np.zeros(texts.count, np.int64)
    marks = np.zeros(len(texts.data) + 1, bool)
    marks[safe_cuts(texts.data)] = True
    marks[texts.offsets] = True
    starts = np.flatnonzero(marks[:-1])
    ends = np.append(starts[1:], len(texts.data))
    _, first, which = np.unique(texts.span_hashes(starts, ends), return_index=True, return_inverse=True)
    raw = texts.data.tobytes()
    pieces = [raw[b:e] for b, e in zip(starts[first].tolist(), ends[first].tolist())]
    if len(known) > KEPT:
        known.clear()
    new = [p for p in pieces if p not in known]
    known.update(zip(new, encode([p.decode() for p in new]).tolist()))
    lengths = np.fromiter((known[p] for p in pieces), np.int64, len(pieces))
    sums = np.concatenate([[0], np.cumsum(lengths[which])])
    return np.diff(sums[np.searchsorted(starts, texts.offsets)])


def count_whole(texts: Texts, encode) -> np.ndarray:
    """Tokens of each text of a block, for models that may join what stands on both sides of a space."""
    raw = texts.data.tobytes()
    content = [raw[b:e].decode() for b, e in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist())]
    return np.array(encode(content), np.int64)


def counter(path: str):
    """An Arrow function of a text column that returns the number of tokens of each text."""

    def count(column: pa.Array) -> pa.Array:
        encode, known = tokenizer(path)
        if byte_level(path):
            counted = [count_pieces(texts, encode, known) for _, _, texts in blocks(column, BLOCK)]
        else:
            counted = [count_whole(texts, encode) for _, _, texts in blocks(column, BATCH)]
        return pa.array(np.concatenate(counted) if counted else np.zeros(0, np.int64))

    return F.arrow_udf(count, "long")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``; ``path`` is the tokenizer's file on every machine.

    Texts are taken whole; strings of special tokens inside them are handled as the library does by default. A null text
    counts as empty and has no tokens. A projection: repeated rows, any key and an empty table need nothing else.
    """
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return (
        docs.select(F.col(key).alias("doc_id"), content.alias("text"))
        .withColumn("n_tokens", counter(path)(F.col("text")))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
