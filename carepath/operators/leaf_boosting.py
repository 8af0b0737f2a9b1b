"""Gradient boosting of trees that are limited by leaves, for many labels, folds and parameters together.

Trees grow best first: of all leaves the one whose split lowers the loss most is split next, until there are ``leaves`` of them. Values are
cut into bins once. The gradients of a node are summed by (feature, bin) in the tasks; of two children only the smaller one is
summed, the other is the rest of its parent. A pass over the rows serves all models, and in each of them all leaves that can still be
split, as far as leaves remain: what is looked at in vain changes no choice. Passes follow the depth of the
trees and not their leaves, nor the number of models. Margins are written with the rows every few rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.operators.joint import rows_of, sigmoid
from carepath.session import materialise

#: sums of one pass, and of all its tasks where the driver adds them up itself (8 bytes each); rounds between two writes of the margins
SUMS = 1 << 24
PARTIAL_SUMS = 1 << 22
ROUNDS_KEPT = 10


@dataclass(frozen=True)
class Growth:
    """Rounds, bins of a feature, least rows and least sum of second derivatives of a leaf, penalty, and when to stop early."""

    rounds: int = 100
    bins: int = 255
    least_rows: int = 20
    least_hessian: float = 1e-3
    penalty: float = 0.0
    patience: int = 10
    tolerance: float = 1e-7


@dataclass(frozen=True)
class Boost:
    """One model: its label, the fold it leaves out (none: -2), its step and leaves, and the weights of other rows and of cases."""

    label: int = 0
    fold: int = -2
    rate: float = 0.1
    leaves: int = 31
    weights: tuple[float, float] = (1.0, 1.0)


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1. A row goes left where its bin is at most ``cut``, its value at most ``threshold``."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def nodes(self, rows: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The leaf of each row; ``limits`` are cuts for rows of bins, thresholds for rows of values."""
        at, line = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            goes_left = rows[line, np.maximum(feature, 0)] <= limits[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)

    @property
    def n_leaves(self) -> int:
        return int((self.feature < 0).sum())


@dataclass
class BoostedTrees:
    """The trees of one model."""

    base: float
    trees: list[Tree] = field(default_factory=list)

    def margins(self, values: np.ndarray) -> np.ndarray:
        return self.base + sum((t.value[t.nodes(values, t.threshold)] for t in self.trees), np.zeros(len(values)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with ``probability``, a vector of the probabilities of 0 and 1."""
        p = F.get(tree_probabilities([self])(vector_to_array("features")), F.lit(0))
        return rows.withColumn("probability", array_to_vector(F.array(1 - p, p)))


@dataclass
class JointTrees:
    """Trees of one model for each class."""

    classes: list[str]
    models: list[BoostedTrees]

    def probabilities(self, features: Column) -> Column:
        return tree_probabilities(self.models)(features)


def tree_probabilities(models: list[BoostedTrees]):
    """An Arrow function from features to the probabilities of all models."""

    def score(column: pa.Array) -> pa.Array:
        n = len(column)
        values = rows_of(column, len(column[0]) if n else 0)
        found = sigmoid(np.column_stack([m.margins(values) for m in models])) if n else np.zeros((0, len(models)))
        ends = np.arange(n + 1, dtype=np.int32) * len(models)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.reshape(-1)))

    return F.arrow_udf(score, "array<double>")


def _bytes_of(column: pa.Array, kind) -> np.ndarray:
    """Rows of a column of equally long byte strings as a matrix."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.reshape(len(column), -1).view(kind) if len(column) else np.zeros((0, 0), kind)


def _as_bytes(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    ends = (np.arange(len(matrix) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(matrix.tobytes())])


def cut_points(rows: DataFrame, size: int, bins: int = 255) -> list[np.ndarray]:
    """Ascending cuts of each feature of ``x``: all its values but the greatest, if there are at most ``bins``, else quantiles.

    Distinct values are kept in the tasks until there are too many; quantiles are Spark's sketches. Values that are no numbers
    lie behind all cuts.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0) for _ in range(size)]
        for batch in batches:
            x = rows_of(batch.column(0), size)
            for i, known in enumerate(seen):
                if known is not None:
                    column = x[:, i]
                    known = np.union1d(known, column[~np.isnan(column)])
                    seen[i] = known if len(known) <= bins else None
        lists = pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), lists], names=["i", "found"])

    lists = rows.select("x").mapInArrow(distinct, "i int, found array<double>")
    values = F.array_sort(F.array_distinct(F.flatten(F.collect_set("found"))))
    several = lists.groupBy("i").agg(F.bool_or(F.col("found").isNull()).alias("many"), values.alias("values"))
    several = several.select("i", F.when(~F.col("many") & (F.size("values") <= bins), F.col("values")).alias("values"))
    cuts: list[np.ndarray | None] = [None] * size
    for row in several.collect():
        cuts[row["i"]] = None if row["values"] is None else np.array(row["values"])[:-1]
    many = [i for i, c in enumerate(cuts) if c is None]
    if many:
        shares = [k / bins for k in range(1, bins)]
        exploded = rows.select(F.posexplode("x").alias("i", "v")).filter(F.col("i").isin(many) & ~F.isnan("v"))
        for row in exploded.groupBy("i").agg(F.percentile_approx("v", shares).alias("q"), F.max("v").alias("top")).collect():
            found = np.unique(row["q"])
            cuts[row["i"]] = found[found < row["top"]]
    return [np.zeros(0) if c is None else c for c in cuts]


def binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``x, y, fold, held`` with the bins of ``x`` as bytes: a value's bin is the number of cuts below it."""

    def encode(column: pa.Array) -> pa.Array:
        x = rows_of(column, len(cuts))
        found = np.empty(x.shape, np.uint8)
        for i, points in enumerate(cuts):
            found[:, i] = np.searchsorted(points, x[:, i])
        return _as_bytes(found)

    return rows.withColumn("x", F.arrow_udf(encode, "binary")("x"))


@dataclass
class Node:
    """A node while its tree grows: its sums of gradient, second derivative and rows, its histogram and best split."""

    sums: np.ndarray
    histogram: np.ndarray | None = None
    gain: float = 0.0
    feature: int = -1
    cut: int = -1
    left_sums: np.ndarray | None = None
    children: tuple[int, int] | None = None


class GrowingTree:
    """Best-first growth on histograms that come pass by pass."""

    def __init__(self, layout: "Layout", leaves: int, rules: Growth):
        self.layout, self.most, self.rules = layout, leaves, rules
        self.nodes: list[Node] = []
        self.open: list[int] = []
        self.inner: set[int] = set()
        self.asked: list[tuple[int, int, int]] = []  # parent, the child that is summed, the other one

    def root(self, histogram: np.ndarray) -> None:
        first = self.layout.cells(0)
        node = Node(histogram[first].sum(0))
        self.nodes.append(node)
        self._split(node, histogram)
        if node.gain > 0:
            self.open.append(0)

    def _split(self, node: Node, histogram: np.ndarray) -> None:
        node.histogram = histogram
        node.gain, node.feature, node.cut, node.left_sums = self.layout.best(histogram, node.sums, self.rules)

    def advance(self) -> list[tuple[int, int, int]]:
        """Split while the best leaf and its children are known; then (parent, child to sum, other child) of all leaves that may follow."""
        while self.open and len(self.inner) + 1 < self.most:
            at = min(self.open, key=lambda i: (-self.nodes[i].gain, i))
            node = self.nodes[at]
            last = len(self.inner) + 2 == self.most
            if node.children is None and last:
                self._add_children(node)
            elif node.children is None:
                break
            self.open.remove(at)
            self.inner.add(at)
            if not last:
                self.open += [c for c in node.children if self.nodes[c].gain > 0]
        else:
            return []
        # what would be split if no more nodes were to come; more of them can only push others back
        ahead, room, self.asked = list(self.open), self.most - len(self.inner) - 1, []
        while ahead and room:
            at = min(ahead, key=lambda i: (-self.nodes[i].gain, i))
            node = self.nodes[at]
            ahead.remove(at)
            room -= 1
            if node.children is not None:
                ahead += [c for c in node.children if self.nodes[c].gain > 0]
            else:
                left, right = self._add_children(node)
                small, other = (left, right) if self.nodes[left].sums[2] <= self.nodes[right].sums[2] else (right, left)
                self.asked.append((at, small, other))
        return self.asked

    def _add_children(self, node: Node) -> tuple[int, int]:
        node.children = len(self.nodes), len(self.nodes) + 1
        self.nodes += [Node(node.left_sums), Node(node.sums - node.left_sums)]
        return node.children

    def receive(self, histograms: np.ndarray) -> None:
        """Histograms of the children that were asked for, in order."""
        for (parent, small, other), found in zip(self.asked, histograms):
            rest, self.nodes[parent].histogram = self.nodes[parent].histogram - found, None
            self._split(self.nodes[small], found)
            self._split(self.nodes[other], rest)

    def tree(self, rate: float, whole: bool = False) -> Tree:
        """The tree so far; ``whole`` with all children that were looked at."""
        kept = [n.children is not None and (whole or i in self.inner) for i, n in enumerate(self.nodes)]
        cuts = self.layout.cuts
        pick = lambda of, other, kind: np.array([of(n) if k else other for n, k in zip(self.nodes, kept)], kind)
        value = [-rate * n.sums[0] / max(n.sums[1] + self.rules.penalty, 1e-300) for n in self.nodes]
        tree = Tree(pick(lambda n: n.feature, -1, np.int64), pick(lambda n: n.cut, -1, np.int64),
                    pick(lambda n: cuts[n.feature][n.cut], 0.0, np.float64), pick(lambda n: n.children[0], 0, np.int64),
                    pick(lambda n: n.children[1], 0, np.int64), np.array(value))
        return tree if whole else _compact(tree)


def _compact(tree: Tree) -> Tree:
    """The same tree without nodes that no row can come to."""
    order, at = [0], 0
    while at < len(order):
        node = order[at]
        if tree.feature[node] >= 0:
            order += [int(tree.left[node]), int(tree.right[node])]
        at += 1
    new = {old: i for i, old in enumerate(order)}
    child = lambda of: np.array([new[int(of[o])] if tree.feature[o] >= 0 else 0 for o in order], np.int64)
    return Tree(tree.feature[order], tree.cut[order], tree.threshold[order], child(tree.left), child(tree.right), tree.value[order])


class Layout:
    """Where the bins of each feature lie in a histogram, and the best split of one."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts = cuts
        self.width = np.array([len(c) + 1 for c in cuts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.width)])
        self.size = int(self.start[-1])
        self.feature = np.repeat(np.arange(len(cuts)), self.width)
        self.is_last = np.zeros(self.size, bool)
        self.is_last[self.start[1:] - 1] = True

    def cells(self, feature: int) -> slice:
        return slice(int(self.start[feature]), int(self.start[feature + 1]))

    def best(self, histogram: np.ndarray, sums: np.ndarray, rules: Growth) -> tuple[float, int, int, np.ndarray]:
        """Gain, feature, bin and sums on the left of the best split; gain 0 without one. Of equal gains the first feature and bin win."""
        running = np.cumsum(histogram, axis=0)
        before = np.concatenate([np.zeros((1, 3)), running])[self.start[:-1]]
        left = running - before[self.feature]
        right = sums - left
        ok = (~self.is_last & (left[:, 2] >= rules.least_rows) & (right[:, 2] >= rules.least_rows)
              & (left[:, 1] >= rules.least_hessian) & (right[:, 1] >= rules.least_hessian))
        score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + rules.penalty, 1e-300)
        gain = np.where(ok, score(left) + score(right) - score(sums), 0.0)
        at = int(np.argmax(gain)) if len(gain) else 0
        # what rounding leaves of a split that gains nothing is no gain
        if not len(gain) or gain[at] <= 1e-12 * max(1.0, abs(float(score(sums)))):
            return 0.0, -1, -1, np.zeros(3)
        feature = int(self.feature[at])
        return float(gain[at]), feature, at - int(self.start[feature]), left[at]

    def histograms(self, bins: np.ndarray, slot: np.ndarray, slots: int, parts: np.ndarray) -> np.ndarray:
        """Sums of ``parts`` (rows × 3) by slot, feature and bin."""
        found = np.zeros((slots, self.size, 3))
        for i, width in enumerate(self.width.tolist()):
            cell = slot * width + bins[:, i]
            for j in range(3):
                counted = np.bincount(cell, parts[:, j], slots * width)
                found[:, self.cells(i), j] = counted.reshape(slots, width)
        return found


def summed(rows: DataFrame, function: Callable, size: int) -> np.ndarray:
    """The sum over all batches of the flat array that ``function`` makes of bins, labels, folds, held rows and margins.

    A task adds up its batches; beyond ``PARTIAL_SUMS``, blocks of the arrays are added up in tasks too.
    """
    block = max(1, size // 64 + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += function(_bytes_of(b.column(0), np.uint8), _bytes_of(b.column(1), np.uint8), b.column(2).to_numpy(zero_copy_only=False),
                                  b.column(3).to_numpy(zero_copy_only=False).astype(bool), _bytes_of(b.column(4), np.float64))
        parts = [total[a : a + block].tobytes() for a in range(0, size, block)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "sums"])

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in table.column("sums")], axis=0)
        return pa.table({"block": table.column("block")[:1].cast(pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.select("x", "y", "fold", "held", "margin").mapInArrow(partial, "block int, sums binary")
    if len(rows.inputFiles()) * size > PARTIAL_SUMS:
        sums = sums.groupBy("block").applyInArrow(added, "block int, sums binary")
    total = np.zeros(size)
    for row in sums.collect():
        found = np.frombuffer(row["sums"])
        total[row["block"] * block : row["block"] * block + len(found)] += found
    return total


def _parts(model: Boost, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Gradient, second derivative and count of each row."""
    w, p = np.where(y > 0, model.weights[1], model.weights[0]), sigmoid(margin)
    return np.stack([w * (p - y), w * p * (1 - p), np.ones(len(y))], 1)


def _now(recent: list[list[Tree]], bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Margins with the trees that have come since they were written."""
    return margin + np.column_stack([sum((t.value[t.nodes(bins, t.cut)] for t in trees), np.zeros(len(bins))) for trees in recent])


def fit_boosted(rows: DataFrame, fits: list[Boost], rules: Growth = Growth()) -> tuple[list[BoostedTrees], int]:
    """A model for each of ``fits`` and the number of passes, from ``x`` (numbers), ``y`` (0 or 1 by label), ``fold`` and ``held``.

    Rows of a model's fold are left out; held rows (null: not held) only tell when to stop: when none of the last ``patience`` rounds has lowered their mean
    loss. A model whose rows are all of one class is a constant. A null label is 0. Without rows this is an error.
    """
    first = rows.select(F.size("x"), F.size("y")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    size = int(first[0])
    # even files, and few of them for few rows: a pass is a job, and each file a task
    kept = materialise(rows.select(
        "x", F.transform("y", lambda v: F.coalesce(v, F.lit(0)).cast("double")).alias("y"), F.col("fold").cast("int").alias("fold"),
        F.coalesce("held", F.lit(False)).alias("held")).hint("rebalance"), "boosting")
    cuts = cut_points(kept, size, rules.bins)
    layout, k = Layout(cuts), len(fits)
    labels = F.arrow_udf(lambda c: _as_bytes(rows_of(c, int(first[1])).astype(np.uint8)), "binary")
    base_margin = F.lit(np.zeros(k).tobytes())
    table = materialise(binned(kept, cuts).withColumn("y", labels("y")).withColumn("margin", base_margin), "boosting")

    def classes(bins, y, fold, held, margin):
        found = []
        for f in fits:
            there = (fold != f.fold) & ~held
            found += [(there & (y[:, f.label] > 0)).sum(), (there & (y[:, f.label] == 0)).sum()]
        return np.array(found, np.float64)

    counts, passes = summed(table, classes, 2 * k).reshape(k, 2), 3
    models, losses = [], [[] for _ in fits]
    for f, (cases, others) in zip(fits, counts):
        odds = cases * f.weights[1] / (others * f.weights[0]) if cases and others and f.weights[0] else np.inf
        models.append(BoostedTrees(float(np.log(odds)) if cases and others else (np.inf if cases else -np.inf)))
    base = np.array([m.base if np.isfinite(m.base) else 0.0 for m in models])
    running = [i for i in range(k) if np.isfinite(models[i].base)]
    recent: list[list[Tree]] = [[] for _ in fits]

    def ask(wanted: dict[int, tuple[Tree | None, list[int]]]) -> dict[int, np.ndarray]:
        """Histograms of nodes, and the loss of the held rows where the root is asked for (no tree given)."""
        offset, places = 0, {}
        for i, (_, nodes) in wanted.items():
            places[i] = offset
            offset += len(nodes) * layout.size * 3 + 2
        old = [list(t) for t in recent]

        def sums(bins, y, fold, held, margin):
            found, margins = np.zeros(offset), _now(old, bins, margin + base)
            for i, (tree, nodes) in wanted.items():
                f = fits[i]
                label, there = y[:, f.label].astype(np.float64), fold != f.fold
                at, end = places[i], places[i] + len(nodes) * layout.size * 3
                slots = np.full(len(tree.feature) if tree else 1, -1)
                slots[nodes] = np.arange(len(nodes))
                slot = slots[tree.nodes(bins, tree.cut)] if tree else np.zeros(len(bins), np.int64)
                use = there & ~held & (slot >= 0)
                parts = _parts(f, label[use], margins[use, i])
                found[at:end] = layout.histograms(bins[use], slot[use], len(nodes), parts).ravel()
                if tree is None:
                    out = there & held
                    w = np.where(label[out] > 0, f.weights[1], f.weights[0])
                    m = margins[out, i]
                    found[end : end + 2] = (w * (np.logaddexp(0.0, m) - label[out] * m)).sum(), w.sum()
            return found

        found = summed(table, sums, offset)
        answers = {}
        for i, (_, nodes) in wanted.items():
            end = places[i] + len(nodes) * layout.size * 3
            answers[i] = found[places[i] : end].reshape(len(nodes), layout.size, 3), found[end : end + 2]
        return answers

    def in_groups(wanted: dict) -> dict:
        """As many nodes in a pass as its sums may have."""
        nonlocal passes
        answers, group, cells = {}, {}, 0
        for i, (tree, nodes) in wanted.items():
            more = max(1, len(nodes)) * layout.size * 3
            if group and cells + more > SUMS:
                answers.update(ask(group))
                passes, group, cells = passes + 1, {}, 0
            group[i] = (tree, nodes)
            cells += more
        if group:
            answers.update(ask(group))
            passes += 1
        return answers

    for number in range(rules.rounds):
        if not running:
            break
        growing: dict[int, GrowingTree] = {}
        for i, (histogram, (loss, weight)) in in_groups({i: (None, [0]) for i in running}).items():
            if weight > 0:
                losses[i].append(loss / weight)
                before = losses[i][-rules.patience - 1] if len(losses[i]) > rules.patience else np.inf
                if min(losses[i][-rules.patience :]) >= before - rules.tolerance:
                    running.remove(i)
                    continue
            growing[i] = GrowingTree(layout, fits[i].leaves, rules)
            growing[i].root(histogram[0])
        while wanted := {i: (g, asked) for i, g in growing.items() if (asked := g.advance())}:
            nodes = {i: (g.tree(1.0, whole=True), [small for _, small, _ in asked]) for i, (g, asked) in wanted.items()}
            for i, (found, _) in in_groups(nodes).items():
                growing[i].receive(found)
        for i, g in growing.items():
            tree = g.tree(fits[i].rate)
            if tree.n_leaves == 1:  # nothing is left to split
                running.remove(i)
                continue
            models[i].trees.append(tree)
            recent[i].append(tree)
        if running and (number + 1) % ROUNDS_KEPT == 0 and number + 1 < rules.rounds:
            written = [list(t) for t in recent]
            moved = F.arrow_udf(lambda x, m: _as_bytes(_now(written, _bytes_of(x, np.uint8), _bytes_of(m, np.float64))), "binary")
            table, recent = materialise(table.withColumn("margin", moved("x", "margin")), "boosting"), [[] for _ in fits]
            passes += 1
    return models, passes
