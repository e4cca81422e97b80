"""Embedding near-dedup by cross-polytope hashing (operator 8).

Two vectors link if their labels are equal and not null and their cosine, in
double precision, is 0.98 or more.

Method.
1. Equal vectors of a label are one class; its smallest vec_id stands for it.
2. A vector is rotated by three rounds of random signs and a fast Hadamard
   transform (one of ``SHORT`` components or fewer by a random matrix); its hash is the axis of the cross-polytope (index and sign of the
   largest coordinate) nearest to it. ``keys`` such hashes make the bucket of a
   table.  Multiprobe: a vector is also filed under the buckets in which one of
   the hashes is its second-nearest axis, the closest calls first.  Both sides
   probe, so a pair meets if their probes overlap in any table.
3. Each bucket hangs its members on the smallest one; the components of these
   stars are candidate groups, and inside a group all pairs are verified by
   their cosines, block against block (at most ``BLOCK`` vectors a side; pairs
   are never rows).  Blocks give on link counts and a spanning forest.

``keys`` follows, for each length of vectors, from the number of vectors of that
length in its largest label, by the rule of the hashing scheme (it grows with
log n / log 2d), so that with TABLES tables unrelated vectors of a label meet by
chance less than once in ten.  A length whose ``keys`` need more than TABLES
tables for a computed miss rate of ``MISS`` at cosine 0.98 gets more of them.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, or have no label, link with nothing and get their row; vectors of
different lengths never link; rows without vec_id get null results; rows that
share vec_id and vector are one vector, rows that share only the vec_id belong
to one component; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import LINKS, comparison_blocks, components, cut, link_rows, solve_blocks
from wattlane.llm.repeats import U, mix

COSINE = 0.98
TABLES, PROBES = 20, 4
#: Chance that a pair at the threshold shares no bucket, and how many pairs it is estimated on.
MISS, TRIALS = 1e-4, 200
#: Vectors up to this length are turned by a random orthogonal matrix: signs and Hadamard steps have too few outcomes there.
SHORT = 16
BLOCK = 2000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two)."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / math.sqrt(d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if x.shape[1] <= SHORT:
        return x @ np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), x.shape[1]))
    return x


def buckets(x: np.ndarray, keys: int, tables: int = TABLES) -> np.ndarray:
    """The buckets of each row of unit vectors: 1 + PROBES (fewer with few keys) of each table, one table after the other."""
    n, d = x.shape
    size = max(2, d if d <= SHORT else 1 << (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    rows, out = np.arange(n), []
    for table in range(tables):
        best, second, gap = [], [], []
        for key in range(keys):
            y = rotated(x, 1000 * table + key)
            order = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size2 = np.abs(y[rows[:, None], order])
            swap = size2[:, 0] < size2[:, 1]
            order[swap], size2[swap] = order[swap, ::-1], size2[swap, ::-1]
            axis = order * 2 + (y[rows[:, None], order] < 0)
            best.append(axis[:, 0])
            second.append(axis[:, 1])
            gap.append(size2[:, 0] - size2[:, 1])
        best, second, gap = np.stack(best, 1), np.stack(second, 1), np.stack(gap, 1)
        # the likeliest changes: one axis, or the two closest calls together
        closest = np.argsort(gap, axis=1)
        probes = [best]
        for k in range(min(PROBES - 1, keys)):
            p = best.copy()
            p[rows, closest[:, k]] = second[rows, closest[:, k]]
            probes.append(p)
        if keys > 1:
            p = best.copy()
            for k in (0, 1):
                p[rows, closest[:, k]] = second[rows, closest[:, k]]
            probes.append(p)
        for p in probes:
            h = np.full(n, (table + 1) << 32, U)
            for k in range(keys):
                h = mix(h ^ p[:, k].astype(U))
            out.append(h)
    return np.stack(out, 1)


def usable(v: list | None) -> np.ndarray | None:
    """A vector as unit doubles, or None if it takes no part."""
    if not v or None in v:
        return None
    x = np.array(v, np.float64)
    norm = np.sqrt((x * x).sum())
    return x if np.isfinite(x).all() and np.isfinite(norm) and norm > 0 else None


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, h1, h2, dim) of the vectors that take part; h1 and h2 stand for the vector within its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for vec_id, v, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = usable(v)
                if x is not None:
                    raw = (x + 0.0).view(U) * (np.arange(1, len(x) + 1).astype(U) * U(0x9E3779B97F4A7C15) | U(1))
                    own = U(hash(label) & 0xFFFFFFFFFFFFFFFF)
                    h = [int((mix(raw ^ U(k)).sum() ^ mix(np.array([own ^ U(k)]))[0]).view(np.int64)) for k in (11, 13)]
                    rows.append((vec_id, label, *h, len(x)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["vec_id", "label", "h1", "h2", "dim"])

    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "embedding", "cast(label as long) label").where("vec_id is not null and label is not null")
    return rows.mapInArrow(run, "vec_id long, label long, h1 long, h2 long, dim long")


def keys_for(n: int, dim: int) -> int:
    """Hashes per bucket, so that a vector meets one of n unrelated ones with a chance of a tenth at most."""
    return max(2, math.ceil(math.log(max(2, n) * TABLES * (1 + PROBES) ** 2 * 10) / math.log(2 * max(2, dim))))


@lru_cache(maxsize=None)
def tables_for(keys: int, dim: int) -> int:
    """Tables (TABLES at least), so that a pair at the threshold misses all of them with a chance of MISS.

    A table's own chance is estimated on pairs of random vectors, less three standard errors.
    """
    if dim < 2:
        return TABLES  # vectors of one component are equal or opposite
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (buckets(v, keys).reshape(TRIALS, TABLES, -1) for v in (a, COSINE * a + math.sqrt(1 - COSINE**2) * b))
    met = (x[:, :, :, None] == y[:, :, None, :]).any((2, 3)).mean()
    met = max(met - 3 * math.sqrt(met * (1 - met) / (TRIALS * TABLES)), 1 / (TRIALS * TABLES))
    return max(TABLES, math.ceil(math.log(MISS) / math.log1p(-met))) if met < 1 else TABLES


def filed(vectors: DataFrame, representatives: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """(node, bucket) of the representatives; a bucket is of one label and one length. ``sizes``: keys and tables of each length
    that several vectors of one label have; a vector of another length has no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                node, found, label = (c.to_pylist() for c in part.columns)
                by_size: dict[int, list[int]] = {}
                for i, v in enumerate(found):
                    by_size.setdefault(len(v), []).append(i)
                for size, own in by_size.items():
                    if size not in sizes:
                        continue
                    x = np.array([found[i] for i in own], np.float64)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    h = buckets(x, *sizes[size])
                    salt = mix(np.array([label[i] * 4096 + size for i in own], np.int64).view(U))
                    h = np.sort((h ^ salt[:, None]).view(np.int64), axis=1)
                    fresh = np.concatenate((np.ones((len(own), 1), bool), h[:, 1:] != h[:, :-1]), axis=1)
                    who = np.repeat(np.array([node[i] for i in own], np.int64), h.shape[1])[fresh.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(h.ravel()[fresh.ravel()])], names=["node", "bucket"])

    return representatives.select("node", "embedding", "label").mapInArrow(run, "node long, bucket long")


def linked(rows: list[tuple]) -> list[tuple]:
    """Link counts and spanning forest of one comparison block; rows are (side, node, copies, label, embedding)."""
    rows = [r for r in rows if usable(r[4]) is not None]
    out: list[tuple] = []
    kinds: dict[tuple[int, int], list[tuple]] = {}
    for r in rows:  # a chance collision of bucket hashes may bring labels together
        kinds.setdefault((r[3], len(r[4])), []).append(r)
    for own in kinds.values():
        x = np.array([r[4] for r in own], np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        side = np.array([r[0] for r in own])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs = []
        for lo in range(0, len(left), 512):
            rows_at = left[lo:lo + 512]
            columns = right if len(right) else left[lo:]
            cosine = x[rows_at] @ x[columns].T
            a, b = np.nonzero(cosine >= COSINE - 1e-9)
            a, b = rows_at[a], columns[b]
            if not len(right):
                a, b = a[a < b], b[a < b]
            ok = (x[a] * x[b]).sum(1) >= COSINE
            pairs.append((a[ok], b[ok]))
        a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        out += link_rows([r[1] for r in own], np.array([r[2] for r in own], np.int64), a, b)
    return out


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    own = cut(classes(vectors).distinct(), "vec-own")
    known = cut(own.groupBy("label", "h1", "h2", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vec-classes")
    key = ["label", "h1", "h2", "dim"]
    # one row of each class carries its vector
    bare = known.select(F.col("rep").alias("node"), "copies", "label", "h1", "h2", "dim")
    with_vector = vectors.selectExpr("cast(vec_id as long) node", "embedding", "cast(label as long) label").where("node is not null and label is not null")
    named = with_vector.join(bare.select("node", "label", "copies", "dim"), ["node", "label"]).where("size(embedding) = dim").dropDuplicates(["node", "label", "dim"])
    reps = cut(named, "vec-reps")
    # one row of each length; its hashes are as many as its own largest label needs
    counts = reps.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).where("n > 1").collect()
    keys = {r.dim: keys_for(r.n, r.dim) for r in counts}
    stands = cut(filed(vectors, reps, {d: (k, tables_for(k, d)) for d, k in keys.items()}), "vec-buckets")
    centre = cut(stands.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
                 .select("bucket", "centre"), "vec-centres")
    groups = components(stands.join(centre, "bucket").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    found = cut(solve_blocks(comparison_blocks(groups, reps.select("node", "copies", "label", "embedding"), BLOCK), linked, LINKS), "vec-links")
    links = found.where("links > 0").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    shared = own.join(own.groupBy("vec_id").count().where("count > 1"), "vec_id").join(known, key)
    edges = found.where("other is not null").selectExpr("node a", "other b").union(
        shared.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    tops = components(edges).select(F.col("node").alias("rep"), "component")
    solved = cut(known.join(links, "rep", "left").join(tops, "rep", "left"), "vec-solved")
    result = (own.join(solved, key).groupBy("vec_id")
              .agg(F.max(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    return rows.join(result, "vec_id", "left").select(
        "vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"))
