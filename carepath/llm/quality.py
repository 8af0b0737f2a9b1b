"""Quality rules and a hashed n-gram score between a trusted target and the raw corpus.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets, one of trusted documents
and one of the whole corpus, give a document the score ``sum(count * (log target - log raw)) / n-grams``. A document is kept
if the base rules hold and its score is not below a fixed threshold, which is set from the scores of the trusted
documents alone, so that the same document and model always get the same verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import narrow
from carepath.llm.words import ODD, U64, Texts, blocks, mix
from carepath.session import materialise

#: Symbols, counted over the whole text.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityRules:
    """Parameters: buckets of n-grams, smoothing, the margin of the threshold, the base limits.

    ``margin`` standard deviations below the mean of the trusted scores is the threshold. The trusted documents are
    all that are labelled as good; the raw counts are over all documents.
    """

    buckets: int = 1 << 14
    smoothing: float = 1.0
    margin: float = 6.0
    least_words: int = 50
    most_repeated_percent: int = 50


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it is there twice or more, and whether an earlier one is equal."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def in_text(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, to compare the parts of one text."""
    return mix(hashes + mix(text.astype(U64) + U64(1)) * U64(ODD))


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The base measures of each text of a block."""
    data, offsets, first = texts.data, texts.offsets, texts.first_word
    n_words = texts.words_of
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in SYMBOLS]] = True
    # code points in words: bytes that start a character and are no white space
    spaces = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    points = ((data & 0xC0) != 0x80) & ~spaces
    # lines: from a text's start or behind a newline to the next newline or the text's end
    line_starts = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets[:-1][np.diff(offsets) > 0])
    line_starts = line_starts[line_starts < len(data)]
    ends = np.append(line_starts[1:], len(data))
    newline = np.zeros(len(ends), bool) if not len(data) else data[ends - 1] == 0x0A
    worded = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, line_starts)
    starts, stops = line_starts[worded], (ends - newline)[worded]
    line_text = np.searchsorted(offsets, starts, "right") - 1
    later = repeated(in_text(texts.span_hashes(starts, stops), line_text))[1]
    # words in windows of three that are there twice or more
    made = np.maximum(n_words - 2, 0)
    at = np.arange(made.sum()) - np.repeat(np.concatenate([[0], np.cumsum(made)[:-1]]) - first[:-1], made)
    hashes = texts.word_hashes
    window = hashes[at] + hashes[at + 1] * U64(3 * ODD % 2**64) + hashes[at + 2] * U64(5 * ODD % 2**64) if len(at) else np.zeros(0, U64)
    twice = repeated(in_text(window, texts.text_of_word[at]))[0]
    covered = np.zeros(len(hashes) + 2, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": per_text(points, offsets),
        "n_symbols": per_text(symbol[data], offsets),
        "n_dup_lines": np.bincount(line_text[later], minlength=texts.count).astype(np.int64),
        "n_repeat_words": per_text(covered[: len(hashes)], first),
    }


def grams(texts: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and every pair of words of a block, and the text each is from."""
    words, first = texts.word_hashes, texts.first_word
    of = texts.text_of_word
    pair = of[1:] == of[:-1]
    pairs = mix(words[:-1][pair] * U64(3) + words[1:][pair] * U64(ODD)) if len(words) else words
    hashed = np.concatenate([words, pairs]) % U64(buckets)
    return hashed.astype(np.int64), np.concatenate([of, of[1:][pair]]) if len(words) else of


def bucket_counts(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """``bucket, n`` over all texts; each task sends at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in blocks(batch.column(0)):
                total += np.bincount(grams(texts, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def trusted(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """All documents labelled as good; their ids are broadcast if they are few, else both sides are shuffled."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("_trusted")).distinct()
    return docs.join(narrow(materialise(good, "good")), F.col(key) == F.col("_trusted"), "left_semi")


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket and the least score of a kept document."""

    ratios: np.ndarray
    threshold: float


def scores(texts: Texts, ratios: np.ndarray) -> np.ndarray:
    """Mean log ratio of the n-grams of each text of a block; 0 without n-grams."""
    hashed, of = grams(texts, len(ratios))
    n = np.bincount(of, minlength=texts.count)
    return np.bincount(of, weights=ratios[hashed], minlength=texts.count) / np.maximum(n, 1)


def fit(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules(), key: str = "doc_id", text: str = "text") -> Model:
    """Count the raw corpus and the trusted documents, and set the threshold.

    What reaches the driver are two tables of at most ``buckets`` rows and three sums. Without trusted documents
    the ratios are all 0 and every document passes the threshold.
    """
    good = materialise(trusted(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")), labels, "doc_id"), "trusted")
    counts = {}
    for name, table in (("raw", docs), ("target", good)):
        counts[name] = np.zeros(rules.buckets)
        for row in bucket_counts(table, rules.buckets, "text" if name == "target" else text).collect():
            counts[name][row["bucket"]] = row["n"]
    if not counts["target"].any():
        return Model(np.zeros(rules.buckets), 0.0)
    log = {k: np.log((v + rules.smoothing) / (v.sum() + rules.smoothing * rules.buckets)) for k, v in counts.items()}
    ratios = log["target"] - log["raw"]
    score = scoring(Model(ratios, 0.0), rules)
    # a text too short for the base rules has too few n-grams to tell how widely scores spread
    seen = good.select(score(F.col("text")).alias("q")).filter(F.col("q.n_words") >= rules.least_words)
    mean, spread = seen.agg(F.avg(F.round("q.score", 12)), F.coalesce(F.stddev_pop(F.round("q.score", 12)), F.lit(0.0))).first()
    return Model(ratios, round(mean - rules.margin * spread, 9) if mean is not None else float("-inf"))


def scoring(model: Model, rules: QualityRules):
    """An Arrow function of a text column: base measures, score and verdict of each text, nothing else."""
    fields = [(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.int64()) for f in BASE.split(", ")]
    kind = pa.struct([*fields, ("score", pa.float64()), ("kept", pa.bool_())])

    def judge(column: pa.Array) -> pa.Array:
        parts = []
        for _, _, texts in blocks(column):
            found = base_counts(texts)
            failed = (found["n_words"] < rules.least_words) | (100 * found["n_repeat_words"] > rules.most_repeated_percent * found["n_words"])
            score = scores(texts, model.ratios)
            columns = [*found.values(), failed, score, ~failed & (score >= model.threshold)]
            parts.append(pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(judge, f"{BASE}, score double, kept boolean")


def judged(docs: DataFrame, model: Model, rules: QualityRules = QualityRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the base measures, ``score`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Verdicts depend on the text and the model alone, so repeated rows agree.
    An empty table gives an empty table; other columns are not read.
    """
    rated = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rated.withColumn("q", scoring(model, rules)(F.col("text"))).select("doc_id", "q.*")


def kept(docs: DataFrame, model: Model, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns: a filter, without a shuffle."""
    return docs.filter(scoring(model, rules)(F.coalesce(F.col(text).cast("string"), F.lit("")))["kept"])
