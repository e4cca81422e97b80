"""Second-order histogram boosting (M4): squared loss, leaves with an L2 term, shrinkage.

Every feature is cut into bins at quantiles, trees split between bins.  With
squared loss a row's gradient is its prediction minus its label and its second
derivative is 1, and rows with the same bins always have the same prediction.
So rows are first summed per combination of bins (count and label sum: one
aggregate with partial sums, whatever the table), and the rounds need nothing
else.  A level of a tree needs gradient and count sums per (node, feature, bin);
a node splits where

    G_left^2 / (n_left + l2) + G_right^2 / (n_right + l2) - G^2 / (n + l2)

is largest, and a leaf adds -rate * G / (n + l2).

Up to ``MAX_CELLS`` combinations (they are bounded by the bins, not by the rows)
are summed as arrays; more than that stay a table, and each level's sums are one
DataFrame aggregate.  Both ways grow the same trees.

Rows with a NULL input or label do not train; a row with a NULL input gets no
prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.config import BOOST_FEATURES, BOOST_PARAMS
from wattlane.session import scratch_table

MAX_CELLS = 1 << 18
#: Rows that a quantile may be off by, as a share: 1 / ACCURACY.
ACCURACY = 100_000


@dataclass
class Tree:
    """Nodes in heap order: split feature (-1 in a leaf), last bin that goes left, and what a leaf adds."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), np.int64)
        row = np.arange(len(bins))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[row, f] > self.bin[node]), node)
        return node


@dataclass
class Boosted:
    """A fitted ensemble; ``losses`` is the mean squared error on the training rows before each round and at the end."""

    inputs: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    #: Codes of the combinations trained on, sorted, with what the first ``summed`` trees give each of them.
    codes: np.ndarray | None = None
    sums: np.ndarray | None = None
    summed: int = 0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1)

    def code(self, bins: np.ndarray) -> np.ndarray | None:
        """One number per combination of bins; None where 63 bits do not hold them."""
        width = max(map(len, self.edges), default=0) + 1
        if width ** len(self.edges) >= 1 << 63:
            return None
        return bins.astype(np.int64) @ (width ** np.arange(len(self.edges), dtype=np.int64))

    def keep_sums(self, bins: np.ndarray, sums: np.ndarray) -> None:
        """Rows of one combination have one prediction: what the trees gave the combinations in training serves their rows."""
        if (codes := self.code(bins)) is not None:
            order = np.argsort(codes)
            self.codes, self.sums, self.summed = codes[order], sums[order], len(self.trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.bins(x), np.full(len(x), self.base)
        left = np.arange(len(x))
        if self.codes is not None and self.summed == len(self.trees):
            code = self.code(bins)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            found = self.codes[at] == code
            out[found] = self.sums[at[found]]
            left = left[~found]
        if len(left):
            own = bins[left]
            for t in self.trees:
                out[left] += t.value[t.leaf(own)]
        return out

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with the prediction, in Arrow batches; NULL where an input is NULL."""
        model = df.sparkSession.sparkContext.broadcast(self)  # bounded by rounds and depth

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], axis=1)
                known = ~np.isnan(x).any(axis=1)
                out = np.full(len(x), np.nan)
                out[known] = model.value.predict(x[known])
                yield pd.Series(out).where(known, None).astype("Float64")

        return df.withColumn(prediction, score(*[F.col(c).cast("double") for c in self.inputs]))


def bin_edges(df: DataFrame, inputs: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each feature, one aggregate for all."""
    at = [k / max_bins for k in range(1, max_bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, ACCURACY) for c in inputs]).first()
    return [np.unique(np.array(q if q is not None else [], np.float64)) for q in row]


def bin_of(c: str, edges: np.ndarray) -> Column:
    """How many edges lie below the value (0 for NULL): a search by halves in compiled comparisons."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(c).cast("double") > float(edges[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(edges))


def best_splits(grad: np.ndarray, count: np.ndarray, l2: float, rows: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, gain per row) of the best split of each node, from sums [node, feature, bin]; feature -1 if none gains.
    Equal gains (to six places, so that two orders of summing agree) go to the first feature and bin."""
    left_g, left_n = np.cumsum(grad, axis=2), np.cumsum(count, axis=2)
    all_g, all_n = left_g[:, :, -1:], left_n[:, :, -1:]
    right_g, right_n = all_g - left_g, all_n - left_n
    with np.errstate(invalid="ignore"):  # without an L2 term, 0 / 0 where a side is empty
        gain = left_g ** 2 / (left_n + l2) + right_g ** 2 / (right_n + l2) - all_g ** 2 / (all_n + l2)
    gain = np.where((left_n >= 1) & (right_n >= 1), np.round(gain / rows, 6), -np.inf).reshape(len(grad), -1)
    best = gain.argmax(axis=1)
    value = gain[np.arange(len(grad)), best]
    return np.where(value > 0, best // grad.shape[2], -1), best % grad.shape[2], value


class ArrayCells:
    """Combinations of bins as arrays."""

    def __init__(self, rows: list, base: float, width: int):
        self.bins = np.array([r["bins"] for r in rows], np.int64)
        self.n, self.sum_y = (np.array([r[c] for r in rows], np.float64) for c in ("n", "sum_y"))
        self.pred, self.width = np.full(len(rows), base), width
        self.slot = self.bins + np.arange(self.bins.shape[1]) * width

    def start(self) -> None:
        self.grad = self.n * self.pred - self.sum_y

    def sums(self, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        first, size = (1 << level) - 1, 1 << level
        node = tree.leaf(self.bins) - first
        own = node >= 0
        k = self.bins.shape[1]
        key = (node[own, None] * k * self.width + self.slot[own]).ravel()
        shape = (size, k, self.width)
        return tuple(np.bincount(key, np.repeat(w[own], k), size * k * self.width).reshape(shape) for w in (self.grad, self.n))

    def end(self, tree: Tree) -> None:
        self.pred += tree.value[tree.leaf(self.bins)]

    def loss(self) -> float:
        """Sum of squared errors, but for a term that no tree changes."""
        return float((self.n * self.pred ** 2 - 2 * self.pred * self.sum_y).sum())


class TableCells:
    """Combinations of bins as a table: sums are DataFrame aggregates, the driver sees (node, feature, bin) sums only."""

    def __init__(self, cells: DataFrame, base: float, features: int, width: int):
        self.rows, self.features, self.width = scratch_table(cells.withColumn("pred", F.lit(base)), "boost-cells"), features, width

    @staticmethod
    def _node(tree: Tree, values: bool = False) -> Column:
        feature, at = (F.array(*[F.lit(int(x)) for x in a]) for a in (tree.feature, tree.bin))
        depth = int(np.log2(len(tree.feature) + 1)) - 1
        node = F.lit(0)
        if depth:
            node = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda n, _: F.when(F.get(feature, n) < 0, n).otherwise(
                2 * n + 1 + (F.get("bins", F.greatest(F.lit(0), F.get(feature, n))) > F.get(at, n)).cast("int")))
        return F.get(F.array(*[F.lit(float(v)) for v in tree.value]), node) if values else node

    def start(self) -> None:
        pass

    def sums(self, tree: Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        first, size = (1 << level) - 1, 1 << level
        rows = self.rows.select((self._node(tree) - first).alias("node"), (F.col("n") * F.col("pred") - F.col("sum_y")).alias("g"), "n",
                                F.posexplode("bins").alias("feature", "bin")).where("node >= 0")
        out = np.zeros((2, size, self.features, self.width))
        for node, f, b, g, n in rows.groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("n")).collect():  # bounded by nodes and bins
            out[:, node, f, b] = g, n
        return out[0], out[1]

    def end(self, tree: Tree) -> None:
        self.rows = scratch_table(self.rows.withColumn("pred", F.col("pred") + self._node(tree, True)), "boost-cells")

    def loss(self) -> float:
        return self.rows.agg(F.sum(F.expr("n * pred * pred - 2 * pred * sum_y"))).first()[0]


def grow(cells: ArrayCells | TableCells, depth: int, rate: float, l2: float, rows: float) -> Tree:
    size = (1 << (depth + 1)) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
    cells.start()
    for level in range(depth + 1):
        first, here = (1 << level) - 1, np.arange(1 << level)
        grad, count = cells.sums(tree, level)
        g, n = grad[:, 0].sum(axis=1), count[:, 0].sum(axis=1)
        tree.value[first + here] = np.where(n > 0, -rate * g / np.maximum(n + l2, 1e-300), 0.0)
        if level == depth:
            break
        feature, bin_, _ = best_splits(grad, count, l2, rows)
        tree.feature[first + here], tree.bin[first + here] = feature, bin_
        if (feature < 0).all():
            break
    tree.value[tree.feature >= 0] = 0.0
    return tree


def train_histogram_boosted(df: DataFrame, label: str = "Power_Consumption", inputs: Sequence[str] = BOOST_FEATURES, rounds: int = BOOST_PARAMS["maxIter"],
                            rate: float = BOOST_PARAMS["stepSize"], depth: int = BOOST_PARAMS["maxDepth"], l2: float = 1.0, max_bins: int = 32,
                            max_cells: int = MAX_CELLS) -> Boosted:
    """M4: by default 500 rounds of depth 6 at rate 0.05, L2 term 1, from the mean label."""
    inputs = list(inputs)
    train = df.select(*inputs, label).dropna().persist()  # read for the edges and for the sums
    try:
        edges = bin_edges(train, inputs, max_bins)
        bins = F.array(*[bin_of(c, e) for c, e in zip(inputs, edges)]).alias("bins")
        y = F.col(label)
        cells = scratch_table(train.groupBy(bins).agg(F.count("*").cast("double").alias("n"), F.sum(y.cast("double")).alias("sum_y"),
                                                      F.sum(y.cast("double") * y).alias("sum_yy")), "boost-cells")
    finally:
        train.unpersist()
    size, rows, total, squares = cells.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("n", "sum_y", "sum_yy")]).first()
    if not size:
        raise ValueError("no complete row to train on")
    cells = cells.drop("sum_yy")
    model = Boosted(inputs, edges, total / rows)
    width = max(map(len, edges), default=0) + 1
    held = ArrayCells(cells.collect(), model.base, width) if size <= max_cells else TableCells(cells, model.base, len(inputs), width)
    for _ in range(rounds):
        model.losses.append((held.loss() + squares) / rows)
        tree = grow(held, depth, rate, l2, rows)
        held.end(tree)
        model.trees.append(tree)
    model.losses.append((held.loss() + squares) / rows)
    if isinstance(held, ArrayCells):
        model.keep_sums(held.bins, held.pred)
    return model
