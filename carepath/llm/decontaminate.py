"""Benchmark decontamination on templates: numbers, names and units become typed slots.

Documents and benchmark items are turned into template tokens: words without punctuation and case, with numbers, names
and units replaced by typed placeholders. Windows of template tokens are joined by hash, and so are windows in which names
are words, whatever their case, windows of plain words, and windows behind a first word that may be a name. Windows that
match on one diagonal of a document and an item, or on neighbouring ones where words were put in or left out, form an alignment. The
original values in its slots must then be consistent: an item's value always has the same value in the document, and
different names stay different. That finds copied items as well as items with other numbers, names or units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.words import ODD, U64, Texts, blocks, cores, mix, runs
from carepath.session import materialise

LITERAL, NUMBER, NAME, UNIT = range(4)
#: Unit words, which count as units behind a number, and number words.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet yard yards g mg kg lb lbs oz ton tons gram grams "
    "pound pounds ounce ounces l ml cl liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees w kw v hz mb gb tb"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
KIND = "array<struct<item_id:bigint,start:int,end:int,matched:int,item_tokens:int,slots:int,exact:boolean>>"


@dataclass(frozen=True)
class Templates:
    """Parameters: tokens of a window, literals it needs at least, matched tokens that make a leak, tokens of a block of items, and how
    far apart diagonals of one alignment are at most.

    A leak needs ``leak`` matched tokens of an item, or all of a shorter one. Items of fewer tokens than a
    window have one window: the whole item. Windows of plain words need no literals, so copies of any item are found, also of an item of
    one word; items with fewer literals than ``literals`` are not found with other values.
    """

    window: int = 8
    literals: int = 4
    leak: int = 13
    block: int = 1_000_000
    shift: int = 4


@dataclass
class Tokens:
    """Template tokens of some texts: hash, hash of the original word, type, number of the word, offsets by text, may be a name."""

    hashes: np.ndarray
    words: np.ndarray
    kinds: np.ndarray
    place: np.ndarray
    first: np.ndarray
    named: np.ndarray


def hashes_of(words: list[str]) -> np.ndarray:
    texts = next(blocks(pa.array([" ".join(words)])))[2]
    return np.sort(texts.span_hashes(texts.starts, texts.ends))


UNIT_HASHES, NUMBER_HASHES = hashes_of(UNITS), hashes_of(NUMBER_WORDS)
PLACES = mix(np.arange(1, 5, dtype=U64) * U64(ODD))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def template_tokens(texts: Texts) -> Tokens:
    data, found = texts.data, cores(texts)
    words, begin, place, first, capital = found.hashes, found.begin, found.place, found.first, found.capital
    # a capital tells a name unless a sentence or line may begin there
    before = data[np.maximum(texts.ends[np.maximum(place - 1, 0)] - 1, 0)]
    fresh = np.zeros(len(place), bool)
    fresh[first[:-1][np.diff(first) > 0]] = True
    fresh |= (before == 0x2E) | (before == 0x21) | (before == 0x3F) | (before == 0x3A)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    fresh |= (place > 0) & (lines[texts.starts[place]] > lines[texts.ends[np.maximum(place - 1, 0)]])
    digit = (data >= 0x30) & (data <= 0x39)
    kinds = np.zeros(len(place), np.int8)
    kinds[capital[begin] & ~fresh] = NAME
    kinds[digit[begin] | among(words, NUMBER_HASHES)] = NUMBER
    starts_text = np.zeros(len(place) + 1, bool)
    starts_text[first] = True
    behind = np.zeros(len(place), bool)
    behind[1:] = (kinds[:-1] == NUMBER) & ~starts_text[1:-1]
    kinds[behind & among(words, UNIT_HASHES) & (kinds != NUMBER)] = UNIT
    return Tokens(np.where(kinds == LITERAL, words, PLACES[kinds]), words, kinds, place, first, (kinds == NAME) | (capital[begin] & (kinds == LITERAL)))


#: readings of a window: typed slots, names as words, plain words, a first word that may be a name
TYPED, CASELESS, PLAIN, NAMED = range(4)


def windows(tokens: Tokens, size: int, literals: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window of ``size`` tokens of one text with enough literals."""
    if reading == PLAIN:
        return runs(tokens.words, tokens.first, size)
    words = (tokens.kinds == LITERAL) | ((tokens.kinds == NAME) & (reading == CASELESS))
    sums = np.concatenate([[0], np.cumsum(words)])
    if reading == NAMED:  # the hash of the window without its first token
        hashes, at = runs(tokens.hashes, tokens.first, size - 1)
        there = at > 0
        there[there] = tokens.named[at[there] - 1]
        text = np.searchsorted(tokens.first, at, "right") - 1
        there &= at > tokens.first[text]
        hashes, at = mix(hashes[there] ^ PLACES[NAME]), at[there]
        enough = sums[at + size - 1] - sums[at] >= literals
        return hashes[enough], at[enough] - 1
    hashes, at = runs(np.where(words, tokens.words, tokens.hashes), tokens.first, size)
    enough = sums[at + size] - sums[at] >= literals
    return hashes[enough], at[enough]


class Items:
    """Templates of a bounded block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]], rules: Templates):
        self.rules = rules
        self.ids = np.array([i if i is not None else -1 for i, _ in rows], np.int64)
        shift = 0
        found = [template_tokens(t) for _, _, t in blocks(pa.array([t for _, t in rows], pa.string()))]
        self.words = np.concatenate([t.words for t in found]) if found else np.zeros(0, U64)
        self.kinds = np.concatenate([t.kinds for t in found]) if found else np.zeros(0, np.int8)
        firsts = [np.zeros(1, np.int64)]
        found_of: dict[tuple[int, int], list] = {}
        for t in found:
            counts = np.diff(t.first)
            for size in np.unique(np.minimum(counts[counts > 0], rules.window)):
                for reading in (TYPED, CASELESS, PLAIN, NAMED):
                    if reading != PLAIN and size < rules.literals + (reading == NAMED):
                        continue
                    hashed, at = windows(t, int(size), rules.literals, reading)
                    item = np.searchsorted(t.first, at, "right") - 1
                    right = counts[item] == size if size < rules.window else counts[item] >= size
                    if reading == NAMED:
                        right &= at == t.first[item]
                    found_of.setdefault((int(size), reading), []).append((hashed[right], at[right] + shift))
            firsts.append(t.first[1:] + shift)
            shift += t.first[-1]
        self.first = np.concatenate(firsts)
        self.known = {}
        self.bits = np.zeros(1 << 20, bool)
        for size_and_reading, parts in sorted(found_of.items()):
            hashed, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashed, kind="stable")
            if len(order):
                self.known[size_and_reading] = hashed[order], at[order]
                self.bits[(hashed & U64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, tokens: Tokens) -> np.ndarray:
        """Rows of document token, item token, size and reading for every pair of equal windows."""
        rows = []
        for (size, reading), (hashes, where) in self.known.items():
            hashed, at = windows(tokens, size, self.rules.literals, reading)
            likely = self.bits[(hashed & U64((1 << 20) - 1)).astype(np.int64)]
            hashed, at = hashed[likely], at[likely]
            low, high = np.searchsorted(hashes, hashed), np.searchsorted(hashes, hashed, "right")
            n = high - low
            pick = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            rows.append(np.stack([np.repeat(at, n), where[pick], np.full(len(pick), size), np.full(len(pick), reading)], 1))
        return np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)

    def leaks(self, texts: Texts) -> Iterator[tuple[int, tuple]]:
        """(text, (item id, first word, end, matched tokens, item tokens, slots, exact)) of a block, the best alignment of each pair."""
        tokens = template_tokens(texts)
        hits = self.hits(tokens)
        if not len(hits):
            return
        text = np.searchsorted(tokens.first, hits[:, 0], "right") - 1
        item = np.searchsorted(self.first, hits[:, 1], "right") - 1
        diagonal = hits[:, 0] - hits[:, 1]
        order = np.lexsort((hits[:, 0], diagonal, item, text))
        keys = np.stack([text, item], 1)[order]
        step = np.diff(diagonal[order])
        other = np.any(keys[1:] != keys[:-1], axis=1)
        cuts = np.flatnonzero(other | (step > self.rules.shift)) + 1
        best: dict[tuple[int, int], tuple] = {}
        for group in np.split(order, cuts):
            t, i = int(text[group[0]]), int(item[group[0]])
            rows, lines = hits[group], diagonal[group]
            # neighbouring diagonals together and each by itself; all readings, or else the words that are there as they are
            sets = [rows, *(rows[lines == d] for d in np.unique(lines) if lines[0] != lines[-1])]
            for some in sets:
                for part in (some, some[some[:, 3] == PLAIN]):
                    found = self.aligned(tokens, part, i) if len(part) else None
                    if found and found > best.get((t, i), ()):
                        best[t, i] = found
                    if found:
                        break
        for (t, i), (matched, exact, begin, end, size, slots) in sorted(best.items()):
            word = tokens.place - texts.first_word[t]
            yield t, (int(self.ids[i]), int(word[begin]), int(word[end - 1]) + 1, matched, size, slots, bool(exact))

    def aligned(self, tokens: Tokens, hits: np.ndarray, item: int) -> tuple | None:
        """The tokens that the windows of one alignment cover, if there are enough and their slots are consistent.

        Of neighbouring diagonals the one that covers most goes first; the others add the tokens that it leaves.
        """
        parts = []
        diagonal = hits[:, 0] - hits[:, 1]
        for d in np.unique(diagonal):
            one = hits[diagonal == d]
            begin, end = int(one[:, 0].min()), int((one[:, 0] + one[:, 2]).max())
            covered = np.zeros(end - begin + 1, np.int64)
            np.add.at(covered, one[:, 0] - begin, 1)
            np.add.at(covered, one[:, 0] + one[:, 2] - begin, -1)
            mine = begin + np.flatnonzero(np.cumsum(covered)[:-1] > 0)
            parts.append((mine, mine - d))
        parts.sort(key=lambda p: -len(p[0]))
        mine, theirs = parts[0]
        for here, there in parts[1:]:
            free = ~np.isin(here, mine) & ~np.isin(there, theirs)
            mine, theirs = np.concatenate([mine, here[free]]), np.concatenate([theirs, there[free]])
        size = int(self.first[item + 1] - self.first[item])
        if len(mine) < min(self.rules.leak, size):
            return None
        slot = (self.kinds[theirs] != LITERAL) | (self.words[theirs] != tokens.words[mine])
        kinds = np.where(self.kinds[theirs] == LITERAL, NAME, self.kinds[theirs])  # a first word that was read as a name
        pairs = set(zip(kinds[slot].tolist(), self.words[theirs][slot].tolist(), tokens.words[mine][slot].tolist()))
        names = [p for p in pairs if p[0] == NAME]
        if len({p[:2] for p in pairs}) < len(pairs) or len({p[2] for p in names}) < len(names):
            return None  # one value of the item became two, or two names became one
        begin, end = int(mine.min()), int(mine.max()) + 1
        return len(mine), int(all(a == b for _, a, b in pairs)), begin, end, size, int(slot.sum())


def item_blocks(benchmark: DataFrame, rules: Templates, item: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of a bounded number of bytes, one after the other; a null text has no windows."""
    rows, size = [], 0
    for row in benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        rows.append((row["i"], row["t"]))
        size += len(row["t"] or "") // 4
        if size >= rules.block:
            yield Items(rows, rules)
            rows, size = [], 0
    if rows:
        yield Items(rows, rules)


def leak_function(spark, items: Items):
    """An Arrow function from texts to lists of leaks; the items are sent to each executor once."""
    sent = spark.sparkContext.broadcast(items)

    def find(column: pa.Array) -> pa.Array:
        known = sent.value
        found: list[list[dict]] = [[] for _ in range(len(column))]
        names = ("item_id", "start", "end", "matched", "item_tokens", "slots", "exact")
        for begin, _, texts in blocks(column):
            for text, leak in known.leaks(texts):
                found[begin + text].append(dict(zip(names, leak)))
        whole, short = pa.int64(), pa.int32()
        kind = pa.list_(pa.struct(list(zip(names, (whole, short, short, short, short, short, pa.bool_())))))
        return pa.array(found, kind)

    return F.arrow_udf(find, KIND)


def leaks(docs: DataFrame, benchmark: DataFrame, rules: Templates = Templates(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and leaked item: ``doc_id, item_id``, words of the document (end exclusive), matched and item tokens, slots, ``exact``.

    ``exact`` tells whether all slots hold the item's own values. Documents without a leak, with a null or an empty text have no
    row; repeated rows have their rows each; items with equal texts are reported each. The benchmark is the query set: it
    goes to the executors in blocks of bounded size, each against all documents, and documents are not shuffled.
    """
    spark = docs.sparkSession
    found = None
    rated = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    for items in item_blocks(benchmark, rules):
        one = rated.select("doc_id", F.explode(leak_function(spark, items)(F.col("text"))).alias("leak")).select("doc_id", "leak.*")
        one = one if found is None else materialise(one, "leaks")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rated.limit(0).select("doc_id", F.explode(F.lit(None).cast(KIND)).alias("leak")).select("doc_id", "leak.*")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rules: Templates = Templates(), text: str = "text") -> DataFrame:
    """The documents without a leak, with all their columns: a filter per block of items, without a shuffle."""
    left = docs
    for n, items in enumerate(item_blocks(benchmark, rules)):
        left = materialise(left, "clean") if n else left  # one block of items at a time in a worker
        left = left.filter(F.size(leak_function(docs.sparkSession, items)(F.coalesce(F.col(text).cast("string"), F.lit("")))) == 0)
    return left
