"""Random forest whose bootstrap follows the rows, not the partitions (M2).

Spark ML draws a bootstrap per partition, so the same rows in another layout give
another forest.  Here a row's number of draws in a tree is Poisson(1) by a hash
of (row key, tree, seed); features are replaced by the number of their quantile
bin, and the quantiles are exact, so the candidate splits do not depend on the
layout or on a sample either.

Training rows are stored once in blocks (``ROWS_A_BLOCK`` rows as arrays in one row of a
table).  A pass over the blocks sums, for each node of a level and each of the node's features,
rows, draws and labels per bin; all trees of a group share a pass.  The nodes'
sums are added and their best splits are found in the tasks: the driver sees a
split and a mean per node.  Sums that decide a split are whole numbers (labels
are counted in a fixed unit), so the order of summing decides nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.config import LABEL, RF_PARAMS, TREE_FEATURES
from wattlane.session import scratch_table

#: Chances, in 2**32nds, that a row is drawn at most 0, 1, ... times.
DRAWN_AT_MOST = [int(2 ** 32 * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(12)]
KEY = ("series_id", "arrival_no")
ROWS_A_BLOCK = 1 << 14
BLOCKS_A_BATCH = 16
#: Nodes whose sums one task holds at a time, and nodes that are added and split together.
NODES_A_PASS, NODES_A_GROUP = 1 << 12, 16
#: Bits of a value that one pass over the blocks settles when quantiles are searched.
DIGITS = (16, 12, 12, 12, 12)


def _digest(key: Sequence[str], tree: int, seed: int) -> Column:
    """32 bits as hex digits."""
    return F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key], F.lit(str(tree)), F.lit(str(seed))).cast("binary")), 1, 8)


def draws(key: Sequence[str], tree: int, seed: int) -> Column:
    """How often the row is drawn for this tree."""
    # bound to a name, so that the row is hashed once and not for each chance; eight hex digits order like their numbers
    return F.get(F.transform(F.array(_digest(key, tree, seed)), lambda u: sum((F.when(u >= f"{c:08x}", 1).otherwise(0) for c in DRAWN_AT_MOST), F.lit(0))), F.lit(0))


@dataclass
class Tree:
    """Nodes in the order they were found: split feature (-1 in a leaf), last bin that goes left, the left child (the right one
    is next to it) and the mean label of the draws."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int) -> list[int]:
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, len(self.feature)
        for column, blank in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.value, 0.0)):
            column += [blank, blank]
        return [self.left[node], self.left[node] + 1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int64), np.array(self.bin, np.int64), np.array(self.left, np.int64), np.array(self.value)


def _walk(tree: tuple[np.ndarray, ...], bins: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row (a column of ``bins``) has come to."""
    feature, bin_, left, _ = tree
    node, row = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(depth):
        f = feature[node]
        if (f < 0).all():
            break
        node = np.where(f >= 0, left[node] + (bins[f, row] > bin_[node]), node)
    return node


@dataclass
class HashedForest:
    inputs: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    depth: int

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """``df`` with the mean of the trees, in Arrow batches; rows with a NULL input are skipped."""
        model = df.sparkSession.sparkContext.broadcast((self.edges, [t.arrays() for t in self.trees], self.depth))

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            edges, trees, depth = model.value
            for columns in batches:
                bins = np.stack([np.searchsorted(e, c.to_numpy(np.float64), "left") for e, c in zip(edges, columns)])
                yield pd.Series(sum((t[3][_walk(t, bins, depth)] for t in trees), np.zeros(bins.shape[1])) / max(len(trees), 1))

        return df.dropna(subset=self.inputs).withColumn(prediction, score(*[F.col(c).cast("double") for c in self.inputs])).select(*df.columns, prediction)


def _record(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


@contextmanager
def _few_blocks_a_batch(df: DataFrame) -> Iterator[None]:
    """A block is one row to Arrow: as many as otherwise go to Python at once would be gigabytes."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(BLOCKS_A_BATCH))
    try:
        yield
    finally:
        conf.set(name, before)


def _blocks(train: DataFrame, inputs: list[str], label: str, key: Sequence[str], trees: range, seed: int) -> DataFrame:
    """The training rows in blocks: ``n``, each input (``x0`` ...) and the label as doubles, and a byte a row and tree, tree by tree, with its draws."""
    width, count = len(inputs), len(trees)
    digests = F.concat(*[F.unhex(_digest(key, k, seed)) for k in trees])
    rows = train.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(inputs)], F.col(label).cast("double").alias("y"), digests.alias("u"))
    names = [f"x{k}" for k in range(width)] + ["y"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_most, held, n = np.array(DRAWN_AT_MOST, np.int64), [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            u = np.frombuffer(b"".join(t["u"].to_pylist()), ">u4").reshape(-1, count)
            drawn = np.searchsorted(at_most, u.T.astype(np.int64), "right").astype(np.uint8)
            return _record(n=pa.array([len(t)], pa.int64()), drawn=[drawn.tobytes()],
                           **{c: [(t[c].to_numpy() + 0.0).tobytes()] for c in names})  # + 0.0: no negative zero

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS_A_BLOCK:
                yield block()
                held, n = [], 0
        if n:
            yield block()

    schema = "n long, drawn binary, " + ", ".join(f"{c} binary" for c in names)
    return scratch_table(rows.mapInArrow(pack, schema), "forest-rows")


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(bits: int) -> float:
    raw = bits & ~(1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def exact_edges(blocks: DataFrame, width: int, n_rows: int, max_bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each input, exact: a pass over the blocks counts the next digits of the values that share the
    digits known so far with a quantile."""
    ranks = [max(math.ceil(k / max_bins * n_rows), 1) for k in range(1, max_bins)]
    known = [{0: list(zip(ranks, ranks))} for _ in range(width)]  # leading digits: (wanted rank, rank among the values that begin so)
    done = 0
    for digits in DIGITS if n_rows else ():
        heads, low = [np.array(sorted(k), np.uint64) for k in known], 64 - done - digits

        def count(batches: Iterator[pa.RecordBatch], heads=heads, digits=digits, low=low, done=done) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(h), 1 << digits), np.int64) for h in heads]
            for b in batches:
                for f, h in enumerate(heads):
                    for blob in b.column(f"x{f}"):
                        v = _ordered(np.frombuffer(blob.as_buffer()))
                        if done:
                            head = v >> np.uint64(64 - done)
                            at = np.minimum(np.searchsorted(h, head), len(h) - 1)
                            own = h[at] == head
                            v, at = v[own], at[own]
                        else:
                            at = 0
                        digit = ((v >> np.uint64(low)) & np.uint64((1 << digits) - 1)).astype(np.int64)
                        sums[f] += np.bincount(at * (1 << digits) + digit, minlength=sums[f].size).reshape(sums[f].shape)
            for f, s in enumerate(sums):
                row, digit = np.nonzero(s)
                yield _record(f=np.full(len(row), f, np.int32), head=row.astype(np.int32), digit=digit.astype(np.int32), n=s[row, digit])

        tallies = blocks.select(*[f"x{k}" for k in range(width)]).mapInArrow(count, "f int, head int, digit int, n long")
        tallies = tallies.groupBy("f", "head", "digit").agg(F.sum("n").alias("n")).toPandas().sort_values(["f", "head", "digit"])  # the digits of few heads
        for f in range(width):
            deeper: dict[int, list] = {}
            for i, h in enumerate(heads[f].tolist()):
                t = tallies[(tallies.f == f) & (tallies["head"] == i)]
                upto, digit = np.cumsum(t.n.to_numpy()), t.digit.to_numpy()
                for rank, inside in known[f][h]:
                    j = int(np.searchsorted(upto, inside, "left"))
                    deeper.setdefault((h << digits) | int(digit[j]), []).append((rank, inside - int(upto[j - 1] if j else 0)))
            known[f] = deeper
        done += digits
    return [np.array(sorted(_value(v) for v in k), np.float64) if n_rows else np.zeros(0) for k in known]


def _features_a_node(strategy: str, width: int) -> int:
    """As Spark ML counts them for a single tree: by name, as a number, or as a share."""
    named = {"auto": width, "all": width, "onethird": math.ceil(width / 3), "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width)))}
    if strategy in named:
        return named[strategy]
    return min(width, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * width)


def _chosen(seed: int, tree: int, node: int, width: int, some: int) -> np.ndarray:
    """The features that a node may split on."""
    return np.sort(np.random.default_rng([seed & 0xFFFFFFFF, tree, node]).permutation(width)[:some])


def _best(sums: np.ndarray, totals: np.ndarray, least: int, gain_over: float, unit: float) -> tuple[int, int]:
    """(place among the node's features, bin) of the split that takes most from the variance, (-1, 0) if none does.
    ``sums``: rows, draws and labels by feature and bin; equal gains go to the first."""
    rows, n, y = np.cumsum(sums, axis=2)
    all_rows, all_n, all_y = totals
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = (y - n * (all_y / all_n)) ** 2 / (n * (all_n - n)) * unit ** 2
        gain = np.where((rows >= max(least, 1)) & (all_rows - rows >= max(least, 1)) & (gain >= gain_over) & (gain > 0), gain, -np.inf)
    f, b = divmod(int(np.argmax(gain)), gain.shape[1])
    return (f, b) if gain[f, b] > 0 else (-1, 0)


def _grow(bins: DataFrame, trees: list[Tree], group: list[int], width: int, slots: int, p: dict, unit: float) -> None:
    """Grow the trees ``group`` level by level; ``bins`` holds their draws, tree by tree."""
    context, some, depth = bins.sparkSession.sparkContext, _features_a_node(p["featureSubsetStrategy"], width), p["maxDepth"]
    seed, least, gain_over = p["seed"], p["minInstancesPerNode"], p["minInfoGain"]
    live = {k: [0] for k in group}
    for level in range(depth + 1):
        todo, live = [(k, node) for k in group for node in live[k]], {k: [] for k in group}
        for lo in range(0, len(todo), NODES_A_PASS):
            part: dict[int, list[int]] = {}
            for k, node in todo[lo:lo + NODES_A_PASS]:
                part.setdefault(k, []).append(node)
            plan = context.broadcast({k: (trees[k].arrays(), np.array(nodes)) for k, nodes in part.items()})
            leaf = level == depth

            def tally(batches: Iterator[pa.RecordBatch], plan=plan, level=level, leaf=leaf) -> Iterator[pa.RecordBatch]:
                sums, totals, chosen = {}, {}, {}
                for k, (_, nodes) in plan.value.items():
                    totals[k] = np.zeros((4, len(nodes)))
                    if not leaf:
                        sums[k] = np.zeros((3, len(nodes) * some * slots))
                        chosen[k] = np.stack([_chosen(seed, k, int(i), width, some) for i in nodes])
                for b in batches:
                    for n, blob, labels, drawn in zip(*(b.column(c) for c in ("n", "bins", "y", "drawn"))):
                        n = n.as_py()
                        x = np.frombuffer(blob.as_buffer(), np.uint8 if slots <= 256 else np.uint16).reshape(width, n)
                        y = np.frombuffer(labels.as_buffer())
                        times = np.frombuffer(drawn.as_buffer(), np.uint8).reshape(len(group), n)
                        for k, (tree, nodes) in plan.value.items():
                            own = np.flatnonzero(times[group.index(k)])
                            bx = x[:, own]
                            at = _walk(tree, bx, level)
                            place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                            here = nodes[place] == at
                            if not here.all():
                                own, bx, place = own[here], bx[:, here], place[here]
                            w = times[group.index(k), own].astype(np.float64)
                            whole = np.rint(y[own] / unit)
                            weighted = w * whole
                            for i, v in enumerate((None, w, weighted, w * (y[own] - whole * unit))):
                                totals[k][i] += np.bincount(place, v, len(nodes))
                            if not leaf:
                                row = np.arange(len(own))
                                for j in range(some):
                                    slot = (place * some + j) * slots + bx[chosen[k][place, j], row]
                                    for i, v in enumerate((None, w, weighted)):
                                        sums[k][i] += np.bincount(slot, v, sums[k].shape[1])
                for k, (_, nodes) in plan.value.items():
                    for lo in range(0, len(nodes), NODES_A_GROUP):
                        hi = min(lo + NODES_A_GROUP, len(nodes))
                        cells = b"" if leaf else sums[k].reshape(3, len(nodes), -1)[:, lo:hi].tobytes()
                        yield _record(tree=pa.array([k], pa.int32()), first=pa.array([lo], pa.int32()), totals=[totals[k][:, lo:hi].tobytes()], cells=[cells])

            def split(pdf: pd.DataFrame) -> pd.DataFrame:
                k, lo = int(pdf.tree.iloc[0]), int(pdf["first"].iloc[0])
                nodes = plan.value[k][1][lo:lo + NODES_A_GROUP]
                totals = sum(np.frombuffer(t).reshape(4, len(nodes)) for t in pdf.totals)
                cells = None if leaf else sum(np.frombuffer(c).reshape(3, len(nodes), some, slots) for c in pdf.cells)
                out = []
                for i, node in enumerate(nodes.tolist()):
                    rows, n, whole, rest = totals[:, i]
                    f, b = (-1, 0) if leaf or not n else _best(cells[:, i], totals[:3, i], least, gain_over, unit)
                    out.append((k, node, int(_chosen(seed, k, node, width, some)[f]) if f >= 0 else -1, b, (whole * unit + rest) / n if n else 0.0))
                return pd.DataFrame(out, columns=["tree", "node", "feature", "bin", "value"])

            found = (bins.mapInArrow(tally, "tree int, first int, totals binary, cells binary").groupBy("tree", "first")
                     .applyInPandas(split, "tree int, node long, feature int, bin int, value double")).collect()  # a row a node
            plan.unpersist()
            for r in sorted(found):
                trees[r.tree].value[r.node] = r.value
                if r.feature >= 0:
                    live[r.tree] += trees[r.tree].split(r.node, r.feature, r.bin)
        if not any(live.values()):
            break


def _fit(rows: DataFrame, inputs: list[str], max_bins: int, parallel: int, p: dict) -> HashedForest:
    number, width = p["numTrees"], len(inputs)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _record(n=b.column("n"), top=pa.array([float(np.abs(np.frombuffer(y.as_buffer())).max()) for y in b.column("y")]))

    n_rows, top = rows.select("n", "y").mapInArrow(largest, "n long, top double").agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("top")).first()
    if not n_rows:
        raise ValueError("no complete row to train on")
    edges = exact_edges(rows, width, n_rows, max_bins)
    slots = max(map(len, edges), default=0) + 1
    kind = np.uint8 if slots <= 256 else np.uint16
    # labels in units of which all draws together stay below 2**53; a row is drawn twelve times at most
    unit = 2.0 ** (math.frexp(top)[1] + math.frexp(12.0 * n_rows)[1] - 53) if 0 < top < math.inf else 1.0
    model = HashedForest(inputs, edges, [Tree() for _ in range(number)], p["maxDepth"])
    for lo in range(0, number, parallel):
        group = list(range(lo, min(lo + parallel, number)))

        def bin_(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, n in enumerate(b.column("n").to_pylist()):
                    x = [np.searchsorted(e, np.frombuffer(b.column(f"x{k}")[i].as_buffer()), "left").astype(kind) for k, e in enumerate(edges)]
                    drawn = np.frombuffer(b.column("drawn")[i].as_buffer(), np.uint8).reshape(number, n)[group]
                    yield _record(n=pa.array([n], pa.int64()), bins=[b"".join(c.tobytes() for c in x)], y=[b.column("y")[i].as_py()], drawn=[drawn.tobytes()])

        bins = scratch_table(rows.mapInArrow(bin_, "n long, bins binary, y binary, drawn binary"), "forest-bins")
        _grow(bins, model.trees, group, width, slots, p, unit)
    return model


def train_hashed_forest(df: DataFrame, label: str = LABEL, inputs: Sequence[str] = TREE_FEATURES, key: Sequence[str] = KEY, parallel: int = 16,
                        max_bins: int = 32, **params) -> HashedForest:
    """M2: by default the stored 200 trees of depth 15; ``key`` names each row; ``parallel`` trees share their passes."""
    p = {**RF_PARAMS, "featureSubsetStrategy": "onethird", "minInfoGain": 0.0, **params}
    if unknown := set(p) - {"numTrees", "maxDepth", "minInstancesPerNode", "minInfoGain", "seed", "featureSubsetStrategy"}:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    inputs = list(inputs)
    rows = _blocks(df.dropna(subset=[label, *inputs]), inputs, label, key, range(p["numTrees"]), p["seed"])
    with _few_blocks_a_batch(df):
        return _fit(rows, inputs, max_bins, max(parallel, 1), p)
