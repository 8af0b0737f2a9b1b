"""Packing of documents into sequences, next to documents that share rare words with them.

Documents are sorted by the least hashes of their words (a range partitioning, which splits hot keys) and cut into shards of a few
megabytes, each inside one task. A shard is an inverted index of its documents: postings of the words that several, but not more
than half of its documents have, with BM25 weights. The first unused document is a seed. The window it opens is filled with its
best unused neighbours; the one that does not fit is cut, and what is left of it opens the next window as its seed. So all
sequences are full, and what remains at the end of a shard is cut into powers of two, which need no padding.

Texts are encoded once, where they are packed. The result has the token ids of each piece.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.token_counts import safe_cuts
from carepath.llm.words import ODD, U64, Texts, blocks, mix


@dataclass(frozen=True)
class Packing:
    """Tokens of a sequence, the id behind each document, BM25's two parameters, bytes and documents of a shard."""

    window: int = 1024
    end_id: int = 0
    k1: float = 1.2
    b: float = 0.75
    shard_bytes: int = 2 << 20
    shard_docs: int = 4096


#: texts with characters from here on go to the library itself; below, both tokenizers give the same ids (see the tests)
FAST_BELOW = 0x250
#: characters a tokenizer gets at a time; longer texts are cut where a new piece starts anyway
LONG = 1 << 17


def beyond(text: str) -> bool:
    """Whether a text has characters from ``FAST_BELOW`` on."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) >= chr(FAST_BELOW)
    return False


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None, pattern: str | None):
    """A function from a text to the ids that the library gives for the tokenizer file at ``path``.

    ``ranks`` may name the same vocabulary as ranks for the faster library, with the pattern of its pieces.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    slow = lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    if ranks is None:
        return slow
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    special = {token.content: number for number, token in library.get_added_tokens_decoder().items()}
    quick = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if beyond(text):
            return slow(text)
        if len(text) <= LONG:
            return quick.encode_to_numpy(text, allowed_special="all")
        raw = np.frombuffer(text.encode(), np.uint8)
        # a special token may hold no space, so a cut before a space never parts one
        cuts = safe_cuts(raw)
        ends = np.unique(np.append(cuts[np.searchsorted(cuts, np.arange(LONG, len(raw), LONG)).clip(max=max(len(cuts) - 1, 0))] if len(cuts) else [], len(raw)))
        begin, parts = 0, []
        for end in ends.astype(np.int64).tolist():
            parts.append(quick.encode_to_numpy(raw[begin:end].tobytes().decode(), allowed_special="all"))
            begin = end
        return np.concatenate(parts)

    return encode


def sketching():
    """An Arrow function from texts to the three least hashes of their words: texts with common words are often neighbours in their order."""
    names = ("h1", "h2", "h3")

    def least(texts: Texts) -> list[np.ndarray]:
        hashes, first = mix(texts.word_hashes + U64(ODD)), texts.first_word
        there = np.flatnonzero(np.diff(first) > 0)
        found = []
        for _ in names:
            values = np.zeros(texts.count, U64)
            if len(there):
                values[there] = np.minimum.reduceat(hashes, first[there])
                # what is least now does not count in the next turn
                hashes = np.where(hashes == np.repeat(values, np.diff(first)), U64(2**64 - 1), hashes)
            found.append(values.view(np.int64))
        return found

    def sketch(column: pa.Array) -> pa.Array:
        parts = [least(texts) for _, _, texts in blocks(column)]
        columns = [pa.array(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)) for i in range(len(names))]
        return pa.StructArray.from_arrays(columns, names=list(names))

    return F.arrow_udf(sketch, "struct<h1:long,h2:long,h3:long>")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - np.concatenate([[0], ends[:-1]]) if len(ends) else starts, sizes)


class Index:
    """Inverted index of a shard with the BM25 weight of each (word, document)."""

    def __init__(self, texts: list[str], rules: Packing):
        parts = list(blocks(pa.array(texts, pa.large_string())))
        hashes = np.concatenate([t.word_hashes for _, _, t in parts]) if parts else np.zeros(0, U64)
        lengths = np.concatenate([t.words_of for _, _, t in parts]) if parts else np.zeros(0, np.int64)
        self.count = len(lengths)
        doc = np.repeat(np.arange(self.count), lengths)
        order = np.argsort(hashes, kind="stable")  # documents of a word stay in order
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(hashes))).astype(np.float32)
        hashes, doc = hashes[at], doc[at]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(hashes)))
        # the weight of a word that more than half of the documents have is not positive; one that a single one has finds nothing
        idf = np.log((self.count - sizes + 0.5) / (sizes + 0.5)).astype(np.float32)
        useful = (sizes > 1) & (idf > 0)
        kept = np.repeat(useful, sizes)
        long = rules.k1 * (1 - rules.b + rules.b * lengths / max(lengths.mean() if self.count else 1.0, 1e-9))
        self.doc = doc[kept]
        times = times[kept]
        self.sizes = sizes[useful]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if len(self.sizes) else self.sizes
        self.weight = np.repeat(idf[useful], self.sizes) * times * (rules.k1 + 1) / (times + long[self.doc])
        # words of each document
        word = np.repeat(np.arange(len(self.sizes)), self.sizes)
        by_doc = np.argsort(self.doc, kind="stable")
        self.words, self.words_from = word[by_doc], np.searchsorted(self.doc[by_doc], np.arange(self.count + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a word with ``seed``, the best first, of equal ones the first."""
        words = self.words[self.words_from[seed] : self.words_from[seed + 1]]
        at = ranges(self.first[words], self.sizes[words])
        scores = np.bincount(self.doc[at], self.weight[at], minlength=self.count) * unused
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def arranged(index: Index, sizes: np.ndarray, window: int) -> np.ndarray:
    """The documents of a shard in the order in which they fill the windows."""
    unused = np.ones(index.count, bool)
    order: list[int] = []
    filled, next_seed, seed = 0, 0, -1

    def take(doc: int) -> bool:
        """Whether the document reaches the next window, of which it is then the seed if something of it is left."""
        nonlocal filled, seed
        unused[doc] = False
        order.append(doc)
        before, filled = filled // window, filled + int(sizes[doc])
        if filled // window == before:
            return False
        seed = doc if filled % window else -1
        return True

    while len(order) < index.count:
        if seed < 0:
            while not unused[next_seed]:
                next_seed += 1
            seed = next_seed
            if take(seed):
                continue
        for doc in index.neighbours(seed, unused).tolist():
            if take(doc):
                break
        else:  # nothing else has a word in common, so another seed shares the window
            while next_seed < index.count and not unused[next_seed]:
                next_seed += 1
            if next_seed < index.count:
                seed = next_seed
                take(next_seed)
    return np.array(order, np.int64)


def sequence_bounds(total: int, window: int) -> np.ndarray:
    """Ends of the sequences of a shard: full ones, then powers of two."""
    whole, rest = divmod(total, window)
    tail = [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]
    return np.cumsum(np.concatenate([np.full(whole, window, np.int64), np.array(tail, np.int64)]))


FIELDS = [
    ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())
]


def packed(keys: pa.Array, texts: list[str], first_sequence: int, encode, rules: Packing) -> tuple[pa.RecordBatch, int]:
    """The pieces of a shard, and the number of its sequences."""
    encoded = [np.append(encode(text), np.uint32(rules.end_id)).astype("<u4") for text in texts]
    sizes = np.array([len(ids) for ids in encoded], np.int64)
    order = arranged(Index(texts, rules), sizes, rules.window)
    ends = np.cumsum(sizes[order])
    bounds = sequence_bounds(int(ends[-1]), rules.window)
    cuts = np.unique(np.concatenate([ends, bounds]))
    begins = np.concatenate([[0], cuts[:-1]])
    which = np.searchsorted(ends, begins, "right")
    sequence = np.searchsorted(bounds, begins, "right")
    start = begins - (ends - sizes[order])[which]
    offset = begins - np.concatenate([[0], bounds[:-1]])[sequence]
    doc, length = order[which], cuts - begins
    ids = [encoded[d][s : s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
    columns = [start, length, sizes[doc], first_sequence + sequence, offset]
    arrays = [keys.take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(name for name, _ in FIELDS)]), len(bounds)


def pack(
    docs: DataFrame,
    path: str,
    rules: Packing = Packing(),
    ranks: str | None = None,
    pattern: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A document is its token ids and the id behind it. Each id is in one piece; ``start`` counts the ids of the document before it, ``offset``
    those of the sequence. ``ids`` are the piece's ids, 32 bits each, little end first. A null text counts as empty and has the end id
    only. Ids of documents are not looked at: repeated rows are documents of their own, null ids too. An empty table gives no
    piece; other columns are not read. ``path`` (and ``ranks``) are files on every machine.
    """
    kind = dict(docs.select(F.col(key).alias("doc_id")).dtypes)["doc_id"]
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    # rows with the same words may be dealt to several shards
    base = docs.select(F.col(key).alias("doc_id"), content).withColumn("at", F.monotonically_increasing_id())
    places = ["sketch.h1", "sketch.h2", "sketch.h3", "at"]
    ordered = base.withColumn("sketch", sketching()(F.col("text"))).repartitionByRange(*places).sortWithinPartitions(*places)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern)
        sequence = TaskContext.get().partitionId() << 40
        keys, texts, size = [], [], 0
        for batch in batches:
            begin = 0
            column = batch.column(1)
            for i, content in enumerate(column.to_pylist()):
                texts.append(content)
                size += len(content)
                if size >= rules.shard_bytes or len(texts) >= rules.shard_docs:
                    found, n = packed(pa.concat_arrays([*keys, batch.column(0)[begin : i + 1]]), texts, sequence, encode, rules)
                    yield found
                    keys, texts, size, begin, sequence = [], [], 0, i + 1, sequence + n
            if begin < len(column):
                keys.append(batch.column(0)[begin:])
        if texts:
            yield packed(pa.concat_arrays(keys), texts, sequence, encode, rules)[0]

    shape = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ordered.select("doc_id", "text").mapInArrow(shards, shape)


def digests(pieces: DataFrame) -> DataFrame:
    """The result of :func:`pack` with the checksum of the ids in their place."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
