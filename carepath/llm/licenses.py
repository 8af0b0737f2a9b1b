"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Words are compared in small letters without punctuation. Of each window of consecutive word runs the least hash is a fingerprint, so
any passage of ``run + window - 1`` words that a text shares with a template gives a common one. Of short templates every run is
a fingerprint and is looked up at every run of a text. Fingerprints of the templates are an inverted index; hits of a text near one
diagonal are a candidate, in which each copy is aligned with the template in a band around the diagonals. The alignment gives the
template's words found, their share and the span in the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.license_texts import TEMPLATES
from carepath.llm.words import Texts, blocks, cores, runs

KIND = "array<struct<license:string,start:int,end:int,matched:int,template_words:int,coverage:double>>"


#: cells of a band that are looked at together; a larger one is aligned without a bound
CELLS = 1 << 22


@dataclass(frozen=True)
class Winnow:
    """Words of a run, runs of a window, words of a short template, least coverage, slack of the band in words and as a share of the template."""

    run: int = 3
    window: int = 3
    short: int = 12
    coverage: float = 0.8
    slack: int = 6
    slack_share: float = 0.15


def fingerprints(hashes: np.ndarray, first: np.ndarray, rules: Winnow) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the least run (the rightmost of equals) of each window of runs of one text.

    A text with fewer runs than a window has the least of them.
    """
    run, at = runs(hashes, first, rules.run)
    text = np.searchsorted(first, at, "right") - 1
    picked = np.zeros(len(run), bool)
    n = len(run)
    best = np.arange(n)
    for j in range(1, rules.window):  # the best of the window that starts at each run, inside its text
        other = np.minimum(np.arange(n) + j, max(n - 1, 0))
        better = (np.arange(n) + j < n) & (text[other] == text) & (run[other] <= run[best])
        best = np.where(better, other, best)
    # windows that end behind the text are shorter; only the first of a text may be, if there is no whole one
    whole = np.zeros(n, bool)
    last = np.minimum(np.arange(n) + rules.window - 1, max(n - 1, 0))
    whole[:] = (np.arange(n) + rules.window - 1 < n) & (text[last] == text)
    start = np.ones(n, bool)
    start[1:] = text[1:] != text[:-1]
    picked[best[whole | start]] = True
    return run[picked], at[picked]


class Index:
    """Templates and the inverted index of their fingerprints; small by construction."""

    def __init__(self, templates: dict[str, str], rules: Winnow = Winnow()):
        self.rules, self.names, self.words = rules, [], []
        hashes: dict[bool, list] = {False: [], True: []}
        where: dict[bool, list] = {False: [], True: []}
        for name, text in templates.items():
            texts = next(blocks(pa.array([text]), 1 << 30))[2]
            words = cores(texts).hashes
            if len(words) < rules.run:
                raise ValueError(f"the template {name} has fewer words than a run")
            short, bounds = len(words) <= rules.short, np.array([0, len(words)])
            found, at = runs(words, bounds, rules.run) if short else fingerprints(words, bounds, rules)
            hashes[short].append(found)
            where[short].append(np.stack([np.full(len(at), len(self.names)), at], 1))
            self.names.append(name)
            self.words.append(words)
        self.known = {}
        for short in hashes:
            found = np.concatenate([np.zeros(0, np.uint64), *hashes[short]])
            order = np.argsort(found, kind="stable")
            self.known[short] = found[order], np.concatenate([np.zeros((0, 2), np.int64), *where[short]])[order]

    def hits(self, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, template and diagonal of every fingerprint of a template in the texts."""
        rows = []
        for short, (hashes, where) in self.known.items():
            seen, at = runs(found.hashes, found.first, self.rules.run) if short else fingerprints(found.hashes, found.first, self.rules)
            low, high = np.searchsorted(hashes, seen), np.searchsorted(hashes, seen, "right")
            n = high - low
            pick = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            position = np.repeat(at, n)
            rows.append((position, where[pick, 0], position - where[pick, 1]))
        return tuple(np.concatenate(x) for x in zip(*rows))

    def candidates(self, texts: Texts, found) -> Iterator[tuple[int, int, list[int]]]:
        """(text, template, diagonals in ascending order) where hits of a template lie close together."""
        position, template, diagonal = self.hits(found)
        text = np.searchsorted(found.first, position, "right") - 1
        order = np.lexsort((diagonal, template, text))
        open_one: tuple | None = None
        for i in order.tolist():
            t, k, d = int(text[i]), int(template[i]), int(diagonal[i])
            if open_one and open_one[:2] == (t, k) and d - open_one[2][-1] <= self.band(k):
                if d > open_one[2][-1]:
                    open_one[2].append(d)
                continue
            if open_one:
                yield open_one
            open_one = (t, k, [d])
        if open_one:
            yield open_one

    def band(self, template: int) -> int:
        return self.rules.slack + int(self.rules.slack_share * len(self.words[template]))

    def copies(self, k: int, words: np.ndarray, diagonals: list[int]) -> Iterator[tuple[int, int, int]]:
        """(matched, first, last word) of each copy of a template near the diagonals.

        What is enough of a copy without inserted or missing words parts the text, so that no alignment takes words of two copies.
        Each part is aligned, unless it has a copy word for word, and then what lies before and behind the alignment.
        """
        template, band = self.words[k], self.band(k)
        n, least = len(template), self.rules.coverage * len(template)
        straight: list[tuple[int, int, int]] = []
        for d in diagonals:
            i = np.arange(max(0, -d), max(0, -d, min(n, len(words) - d)))
            same = i[words[i + d] == template[i]]
            if len(same) >= least:
                straight.append((-len(same), int(same[0]) + d, int(same[-1]) + d + 1))
        chosen, whole = [], set()
        for less, first, end in sorted(straight):
            if _add_apart(chosen, first, end) and -less == n:
                whole.add((first, end))
        ends, starts = [0, *(b for _, b in chosen)], [*(a for a, _ in chosen), len(words)]
        # each of the chosen with the words up to its neighbours; without one, the whole text
        parts = list(zip(ends, starts[1:], chosen)) if chosen else [(0, len(words), None)]
        parts.reverse()
        while parts:
            begin, end, copy = parts.pop()
            if copy in whole:
                first, last = copy[0], copy[1] - 1
                yield n, first, last
                parts += [(last + 1, end, None), (begin, first, None)]
                continue
            low, high = max(diagonals[0] - band, begin - n), min(diagonals[-1] + band, end)
            if min(end - begin, min(n, end - low) - max(0, begin - high)) < least:
                continue  # too few of the template's words can lie in this part
            if reachable(template, words[begin:end], low - begin, high - begin) < least:
                continue
            matched, first, last = aligned(template, words[begin:end], low - begin, high - begin)
            if matched < least:
                continue
            first, last = first + begin, last + begin
            yield matched, first, last
            parts += [(last + 1, end, None), (begin, first, None)]

    def matches(self, texts: Texts) -> Iterator[tuple[int, tuple]]:
        """(text, (license, first word, end, matched, template words, coverage)); a span inside a longer match is left out."""
        found = cores(texts)
        best: dict[int, list[tuple]] = {}
        for t, k, diagonals in self.candidates(texts, found):
            begin, end = int(found.first[t]), int(found.first[t + 1])
            place = found.place[begin:end] - texts.first_word[t]
            for matched, first, last in self.copies(k, found.hashes[begin:end], [d - begin for d in diagonals]):
                span = (matched, int(place[first]), int(place[last]) + 1, k)
                best.setdefault(t, []).append(span)
        for t in sorted(best):
            taken: list[tuple[int, int]] = []
            chosen = [span for span in sorted(best[t], key=lambda s: (-s[0], s[1:])) if _add_apart(taken, span[1], span[2])]
            for matched, first, last, k in sorted(chosen, key=lambda s: s[1]):
                size = len(self.words[k])
                yield t, (self.names[k], first, last, matched, size, matched / size)


def _add_apart(spans: list[tuple[int, int]], first: int, end: int) -> bool:
    """Put a span in its place among ascending ones if it overlaps none of them."""
    at = bisect_left(spans, (first, end))
    if (at and spans[at - 1][1] > first) or (at < len(spans) and spans[at][0] < end):
        return False
    spans.insert(at, (first, end))
    return True


def reachable(template: np.ndarray, words: np.ndarray, low: int, high: int) -> int:
    """Template words that stand anywhere at diagonals ``low..high``: at least as many as any alignment has."""
    n, width = len(template), high - low + 1
    if n * width > CELLS:
        return n
    places = np.arange(n)[:, None] + np.arange(low, high + 1)
    there = (places >= 0) & (places < len(words))
    return int((there & (words[np.clip(places, 0, len(words) - 1)] == template[:, None])).any(1).sum())


def aligned(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most template words found in order at diagonals ``low..high``, in the shortest span; (matched, first, last word).

    A longest common subsequence in a band: cell (i, j) has the matches of the first words of both and where the first was, as
    one number, ``matches * base + first + 1``, so a row is a running maximum. Of equal numbers of matches the later start wins.
    """
    width, base = high - low + 1, len(words) + 2
    above = np.zeros(width + 1, np.int64)  # cell d holds text position i + low + d
    best, last = 0, 0
    for i, word in enumerate(template):
        begin, end = max(0, -(i + low)), min(width, len(words) - i - low)
        row = above[1:].copy()
        same = np.flatnonzero(words[i + low + begin : i + low + end] == word) + begin if begin < end else []
        if len(same):
            before = above[same]
            row[same] = np.maximum(row[same], np.where(before >= base, before + base, base + same + (i + low + 1)))
        row = np.maximum.accumulate(row)
        if len(same):
            reached = row[same]
            top = int(np.argmax(reached))
            if reached[top] > best:
                best, last = int(reached[top]), i + low + int(same[top])
        above = np.concatenate([row, row[-1:]])
    return best // base, max(best % base - 1, 0), last


def scanning(index: Index):
    """An Arrow function from texts to lists of matches."""
    names = ("license", "start", "end", "matched", "template_words", "coverage")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())))))

    def scan(column: pa.Array) -> pa.Array:
        found: list[list[dict]] = [[] for _ in range(len(column))]
        for begin, _, texts in blocks(column):
            for text, match in index.matches(texts):
                found[begin + text].append(dict(zip(names, match)))
        return pa.array(found, kind)

    return F.arrow_udf(scan, KIND)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, rules: Winnow = Winnow(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and license text in it: ``doc_id, license, start, end, matched, template_words, coverage``.

    ``start`` and ``end`` (exclusive) count the words of the document. Whole texts are scanned, whatever their length. Documents
    without a license, with a null or an empty text have no row, repeated rows have their rows each. No shuffle: the templates
    are a parameter that goes with the task. An empty table gives an empty table; other columns are not read.
    """
    index = Index(TEMPLATES if templates is None else templates, rules)
    rated = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rated.select("doc_id", F.explode(scanning(index)(F.col("text"))).alias("match")).select("doc_id", "match.*")
