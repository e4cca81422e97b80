"""Approximate nearest neighbours with a hierarchical k-means tree (operator 9).

Method.
1. A tree is fitted on at most ``SAMPLE`` unit vectors (picked by a hash of
   vec_id, a documented bound): k-means with ``BRANCHES`` centres, repeated in
   each cell of more than ``LEAF`` sample vectors.  Vectors of each length have
   a tree of their own; a length that the sample misses is one leaf.  The size
   is bounded by the sample, so the trees are broadcast.
2. Every vector descends to the leaf of the nearest centres: the index.  A leaf
   is cut by a hash into slots of about ``SLOT`` vectors, so a leaf that holds a
   third of all rows is many row groups.
3. A query traverses the tree best bin first: a priority queue holds the
   branches not taken, and the nearest is opened next; leaves come out in the
   order in which they should be visited.  It goes on until the visited leaves
   hold ``k + 1`` vectors or more (itself among them), however few the visits.
4. How many leaves to visit is calibrated for each tree of more than one leaf:
   for ``CALIBRATION`` vectors that are no queries the exact neighbours over all
   rows are found, and the visits widen (a leaf at a time) until ``RECALL`` of
   those neighbours are in visited leaves.
5. Queries meet the slots of their leaves in one shuffle; a task streams the
   queries of a slot against its vectors and keeps the k best of each, and a
   ranking over slots keeps the k best of all.

Nearness is the cosine of the original vectors in double precision; ties go to
the smaller vec_id.  Only vectors of one length have a cosine, so the candidates
of a query are the rows of its length; if they are ``k`` or fewer, all are returned.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without vec_id; a query with the only
vector of its length has no neighbours; a repeated vec_id with the same vector
is one candidate; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import cut
from wattlane.llm.crosspolytope import usable

SAMPLE, CALIBRATION = 20_000, 400
BRANCHES, LEAF, ROUNDS = 16, 400, 12
SLOT = 4000
RECALL = 0.94
FOUND = "query_id long, vec_id long, score double"


@dataclass
class Tree:
    """Inner nodes as (centres, children); a child below 0 is leaf -child - 1."""

    nodes: list[tuple[np.ndarray, list[int]]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, rng: np.random.Generator) -> int:
        """Fit the subtree of the sample vectors ``x``; returns its reference."""
        if len(x) > LEAF:
            centres = kmeans(x, BRANCHES, rng)
            own = nearest(x, centres)
            if len(np.unique(own)) > 1:
                at = len(self.nodes)
                self.nodes.append((centres, []))
                self.nodes[at][1].extend([self.grow(x[own == c], rng) for c in range(len(centres))])
                return at
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row by greedy descent."""
        out = np.zeros(len(x), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            centres, children = self.nodes[node]
            own = nearest(x[rows], centres)
            todo += [(child, rows[own == c]) for c, child in enumerate(children) if (own == c).any()]
        return out

    def best_bins(self, x: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves of one vector, best bin first, and more until they hold ``least`` vectors (``sizes`` of each leaf)."""
        queue: list[tuple[float, int]] = [(0.0, 0 if self.nodes else -1)]
        out: list[int] = []
        held = 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-node - 1)
                held += 0 if sizes is None else int(sizes[-node - 1])
                continue
            centres, children = self.nodes[node]
            for far, child in zip(((centres - x) ** 2).sum(1).tolist(), children, strict=True):
                heapq.heappush(queue, (far, child))
        return out


@dataclass
class Forest:
    """A tree for each vector length. Leaves are numbered through; a length without a tree is the leaf -length."""

    trees: dict[int, Tree] = field(default_factory=dict)
    first: dict[int, int] = field(default_factory=dict)
    leaves: int = 0

    def plant(self, x: np.ndarray, rng: np.random.Generator) -> None:
        tree = Tree()
        tree.grow(x, rng)
        self.trees[x.shape[1]], self.first[x.shape[1]] = tree, self.leaves
        self.leaves += tree.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        return self.trees[d].leaf_of(x) + self.first[d] if d in self.trees else np.full(len(x), -d, np.int64)

    def best_bins(self, x: np.ndarray, visits: int | None = None, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """As of a tree; all leaves of the length where ``visits`` is None."""
        d = len(x)
        if d not in self.trees:
            return [-d]
        tree, first = self.trees[d], self.first[d]
        own = None if sizes is None else sizes[first : first + tree.leaves]
        return [first + leaf for leaf in tree.best_bins(x, tree.leaves if visits is None else visits, own, least)]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        used = np.unique(own)
        centres = np.stack([x[own == c].mean(0) for c in used])
    return centres


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of vectors of one length, without a detour over Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    lengths = column.value_lengths().to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, matrix(column if len(rows) == len(column) else column.take(pa.array(rows)))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors_column(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest of ``x`` for each of ``q``: cosines, then ties by id. Equal vectors get equal scores."""
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    rough = (q / qn[:, None]) @ (x / xn[:, None]).T
    rough[query_ids[:, None] == ids] = -np.inf
    edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
    who, near = np.nonzero((rough >= edge[:, None] - 1e-9) & (rough > -np.inf))
    score = (x[near] * q[who]).sum(1) / (xn[near] * qn[who])
    order = np.lexsort((ids[near], -score, who))
    who, near, score = who[order], near[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    top = place < k
    return [(query_ids[who[top]], ids[near[top]], score[top])]


def found_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding: array<double>) of the vectors that take part, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            values = column.flatten()
            if len(values) and not column.null_count and not values.null_count and len(set(column.value_lengths().to_pylist())) == 1:
                x = matrix(column)
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt((x * x).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                ids, x = b.column(0).filter(pa.array(ok)), vectors_column(x[ok])
            else:
                rows = [(i, v) for i, v in zip(*(c.to_pylist() for c in b.columns), strict=True) if usable(v) is not None]
                ids, x = pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, x], names=["vec_id", "embedding"])

    good = vectors.selectExpr("cast(vec_id as long) vec_id", "embedding").where("vec_id is not null").mapInArrow(run, "vec_id long, embedding array<double>")
    return cut(good.dropDuplicates(["vec_id", "embedding"]), "ann-vectors")


def fit_forest(vectors: DataFrame, seed: int = 9) -> Forest:
    """Fit on the bounded sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0)
    forest = Forest()
    for _, x in by_length(rows.combine_chunks()) if len(rows) else ():
        forest.plant(units(x), np.random.default_rng(seed))
    return forest


def indexed(vectors: DataFrame, forest: Forest) -> DataFrame:
    """(vec_id, embedding, leaf) of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(forest)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                leaf = np.empty(part.num_rows, np.int64)
                for rows, x in by_length(part.column(1)):
                    leaf[rows] = shared.value.leaf_of(units(x))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, leaf long")


def k_best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated_visits(index: DataFrame, forest: Forest, is_query: Column, k: int) -> dict[int, int]:
    """Leaves to visit by length, so that RECALL of the exact neighbours of its calibration vectors are in visited ones."""
    deep = [d for d, tree in forest.trees.items() if tree.leaves > 1]  # each has over LEAF of the sample: at most SAMPLE / LEAF lengths
    if not deep:
        return {}
    d = F.size("embedding")
    order = Window.partitionBy(d).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
    rows = (index.where(~is_query & d.isin(deep)).select("vec_id", "embedding", F.row_number().over(order).alias("n"))
            .where(F.col("n") <= CALIBRATION).select("vec_id", "embedding").toArrow())
    if not rows.num_rows:
        return {}
    ids, own = rows.column(0).to_numpy(), {x.shape[1]: (r, x) for r, x in by_length(rows.column(1).combine_chunks())}
    shared = index.sparkSession.sparkContext.broadcast((ids, own))  # CALIBRATION vectors of each deep tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                for rows, x in by_length(part.column(1)):
                    if x.shape[1] in own:
                        r, q = own[x.shape[1]]
                        yield found_batch(best(ids[r], q, part.column(0).to_numpy()[rows], x, k))

    vectors = index.where(d.isin(deep))
    # a vec_id may have vectors of several lengths: the length goes with it
    keyed = vectors.select("vec_id", d.alias("d"), "leaf").distinct()
    found = k_best(vectors.select("vec_id", "embedding").mapInArrow(run, FOUND), k)
    truth = found.join(keyed, "vec_id").select("query_id", "d", "leaf").collect()  # at most CALIBRATION * k of each deep tree
    visits = {}
    for size, (r, q) in own.items():
        first = {int(i): {leaf: n for n, leaf in enumerate(forest.best_bins(v), 1)} for i, v in zip(ids[r], units(q), strict=True)}
        needed = np.sort([first[t.query_id][t.leaf] for t in truth if t.d == size and t.query_id in first])
        if len(needed):
            visits[size] = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)])
    return visits


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` marks, over all other rows."""
    own = clean(vectors)
    forest = fit_forest(own)
    index = cut(indexed(own, forest), "ann-index")
    visits = calibrated_visits(index, forest, is_query, k)
    counts = cut(index.groupBy("leaf").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids")), "ann-leaves")
    held = np.zeros(forest.leaves, np.int64)
    for leaf, ids in counts.where("leaf >= 0").select("leaf", "ids").collect():  # one row of each leaf of a tree: bounded by SAMPLE
        held[leaf] = ids
    shared = own.sparkSession.sparkContext.broadcast((forest, held))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sizes = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                leaves: list[list[int]] = [[]] * part.num_rows
                for rows, x in by_length(part.column(1)):
                    for row, v in zip(rows.tolist(), units(x), strict=True):
                        leaves[row] = trees.best_bins(v, visits.get(len(v)), sizes, k + 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaves, pa.list_(pa.int64()))], names=["query_id", "embedding", "leaves"])

    sizes = counts.select("leaf", F.expr(f"cast(ceil(n / {SLOT}D) as int)").alias("slots"))
    data = (index.join(sizes, "leaf")
            .select("leaf", F.expr("cast(pmod(xxhash64(vec_id), slots) as int)").alias("slot"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "embedding"))
    asked = (index.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
             .mapInArrow(route, "query_id long, embedding array<double>, leaves array<long>")
             .select("query_id", "embedding", F.explode("leaves").alias("leaf")).join(sizes, "leaf")
             .select("leaf", F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "embedding"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []  # the slot at hand, and its vectors
        for b in batches:
            leaf, slot, kind, who = (b.column(c).to_numpy() for c in range(4))
            cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (slot[1:] != slot[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(leaf)], strict=True):
                x = matrix(b.column(4).slice(lo, hi - lo))  # one leaf, one length
                if at != (leaf[lo], slot[lo]):
                    at, ids, held = (leaf[lo], slot[lo]), [], []
                if kind[lo] == 0:  # vectors come before the queries of their slot
                    ids.append(who[lo:hi])
                    held.append(x)
                elif ids:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    for start in range(lo, hi, 256):
                        end = min(hi, start + 256)
                        yield found_batch(best(who[start:end], x[start - lo : end - lo], ids[0], held[0], k))

    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = data.union(asked).repartition(parts, "leaf", "slot").sortWithinPartitions("leaf", "slot", "kind", "id").mapInArrow(search, FOUND)
    return k_best(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
