"""Helpers that several operators share: tables cut from their lineage, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.session import ensure_checkpoint_dir


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: its lineage ends here, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, quoted: names with dots or back-ticks stay whole."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): smallest node reachable over ``edges`` (a, b: long), for every node with an edge.

    Alternates two star steps (every node hangs its larger neighbours, then its
    smaller ones, on the smallest node it sees) until no edge changes.  A star
    of any size is one aggregate and one join, so a hot node is never gathered.
    The number of rounds grows with the logarithm of the longest path.
    """
    spark: SparkSession = edges.sparkSession
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        # written, so that AQE can split the join at a node with very many edges
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # large star: larger neighbours go to the smallest one
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node and its smaller neighbours go to its smallest one
        large = cut(large, "large")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        edges = cut(small, "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"connected components did not settle within {max_rounds} rounds of {spark.sparkContext.applicationId}")


def comparison_blocks(groups: DataFrame, payload: DataFrame, block: int) -> DataFrame:
    """(component, block_a, block_b, side, *payload): members of candidate groups, dealt to comparison blocks.

    ``groups`` is (node, component); ``payload`` has node and what a comparison needs. A group of more than ``block``
    members is cut by a hash into slots, and every pair of slots is a row group of its own (``side`` 0 against ``side`` 1;
    a slot against itself is all side 0), so no task holds more than about two slots.
    """
    sizes = cut(groups.groupBy("component").agg(F.count("*").alias("size")), "group-sizes")
    members = (groups.join(sizes, "component")
               .withColumn("slots", F.expr(f"cast(ceil(size / {block}D) as int)"))
               .withColumn("slot", F.expr("cast(pmod(xxhash64(node), slots) as int)")).drop("size"))
    return (payload.join(members, "node").withColumn("other", F.explode(F.expr("sequence(0, slots - 1)")))
            .select("component", F.least("slot", "other").alias("block_a"), F.greatest("slot", "other").alias("block_b"),
                    F.expr("cast(slot > other as int)").alias("side"), *payload.columns))


def solve_blocks(rows: DataFrame, solve: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``solve`` on the rows (side, *payload) of each comparison block; it returns rows of longs."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    key = ["component", "block_a", "block_b"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for _, group in groupby(stream, itemgetter(0, 1, 2)):
            out += solve([r[3:] for r in group])
            if len(out) > 5000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs (a, b) of 0..n-1: each node and the smallest of its tree."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = np.minimum(least, least[least])
        if (least == root).all():
            return [(i, int(r)) for i, r in enumerate(root) if i != r]
        root = least


def link_rows(nodes: list[int], copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """(node, links, other): the links of each node, counted in copies of the other end, and the spanning forest of the pairs."""
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    return ([(nodes[i], int(n), None) for i, n in enumerate(links) if n]
            + [(nodes[i], 0, nodes[r]) for i, r in forest(len(nodes), a, b)])


LINKS = "node long, links long, other long"
