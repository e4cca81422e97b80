"""N-gram Jaccard join with Bayesian candidate pruning (operator 10).

Documents are sets of five-word shingles (words ``[^\\x20\\x09-\\x0D]+`` as they
stand; a text of one to four words is one shingle).  Two documents link if the
Jaccard similarity of their sets is 0.8 or more.

Method.
1. Documents with equal sets are one class (hash of the set); its smallest
   doc_id stands for it from here on, the copies only count.
2. MinHash values of each representative make 32 bands of 6; a band value with
   several members hangs them on its smallest one (a star: as many edges as
   members).  The components of these stars are the candidate groups: a pair
   that shares a band is inside one.  At similarity 0.8 a pair shares no band
   with probability 6e-5, at 0.85 with 1e-7.
3. Inside a group, pairs that share a band are compared value by value: after
   each 24 MinHash values the posterior probability (uniform prior) that the
   similarity reaches 0.8 follows from the matches so far, and a pair whose
   posterior is below 1e-6 drops out.  What is left is verified exactly on the
   sets.
4. Links are counted where they are found, and each comparison block gives on
   only a spanning forest of its links; components of those are the classes.

A group with more than ``BLOCK`` members is compared as blocks against blocks,
each pair of blocks a row group of its own, so no task holds more than two
blocks; pairs of documents are never rows.

Edge cases: null and empty texts have no shingles and link with nothing; rows
without doc_id get null results; repeated rows are one document (each row gets
its result); rows that share only the doc_id belong to one class; ties go to
the smaller doc_id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import LINKS, comparison_blocks, components, cut, link_rows, own_columns, solve_blocks
from wattlane.llm.repeats import U, Hasher, mix, packed_texts
from wattlane.llm.rlz import word_units

SHINGLE = 5
BANDS, ROWS, STEP = 32, 6, 24
HASHES = BANDS * ROWS
#: Similarity 0.8 as a fraction, so that the check is exact.
ENOUGH, OF = 4, 5
TOLERANCE = 1e-6
BLOCK = 1000
_rng = np.random.default_rng(10)
_FACTOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(data: bytes) -> np.ndarray:
    """Sorted hashes of the shingle set."""
    words = word_units(data)
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    at = np.arange(len(words) - size + 1)
    return np.unique(Hasher(words).of(at, at + size) + U(size))


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """Two hashes that stand for a shingle set."""
    h1, h2 = (int(np.bitwise_xor.reduce(mix(found * U(f))).view(np.int64)) for f in (3, 5))
    return h1, h2 ^ len(found)


def minhash(found: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(found), 2048):
        x = (found[lo:lo + 2048] >> U(32)).astype(np.uint32)
        np.minimum(out, (x[:, None] * _FACTOR + _SHIFT).min(0), out=out)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.astype(U).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1).astype(U) << U(40)
    for k in range(ROWS):
        h = mix(h ^ parts[:, k])
    return h.view(np.int64)


def least_matches(n: int, threshold: float = ENOUGH / OF, tolerance: float = TOLERANCE) -> int:
    """Fewest of ``n`` equal MinHash values that keep P(similarity >= threshold | matches) at ``tolerance`` or more.

    With a uniform prior the posterior is a Beta, whose upper tail is P(Binomial(n + 1, threshold) <= matches).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


PRUNE = [(n, least_matches(n)) for n in range(STEP, HASHES + 1, STEP)]


def verified_pairs(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs reach the similarity, counted on the sets themselves."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(a) <= 8 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    else:  # many pairs: shared shingles as columns, some thousands at a time
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        used = np.bincount(column)
        rank = np.cumsum(used > 1) - 1
        keep = used[column] > 1
        row, column = row[keep], rank[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        counts = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, [lo, lo + width])
            dense = np.zeros((len(sets), width), np.float32)
            dense[row[s:e], column[s:e] - lo] = 1
            counts += dense @ dense.T
        common = counts[a, b].astype(np.int64)
    return OF * common >= ENOUGH * (size[a] + size[b] - common)


def block_links(sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions) of one comparison block; ``side`` 0 and 1 are compared with each other, all 0 among themselves."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int64, m)
    signature = np.stack([minhash(s) for s in sets])
    band = np.stack([bands(s) for s in signature])
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    across = len(right) > 0
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, len(left), 256):
        rows = left[lo:lo + 256]
        columns = right if across else left[lo:]
        near = OF * np.minimum(size[rows][:, None], size[columns]) >= ENOUGH * np.maximum(size[rows][:, None], size[columns])
        if not across:
            near &= rows[:, None] < columns
        a, b = np.nonzero(near)
        a, b = rows[a], columns[b]
        for start in range(0, len(a), 20_000):
            i, j = a[start:start + 20_000], b[start:start + 20_000]
            meet = (band[i] == band[j]).any(1)
            i, j = i[meet], j[meet]
            matches = np.zeros(len(i), np.int64)
            for n, least in PRUNE:
                matches += (signature[i, n - STEP:n] == signature[j, n - STEP:n]).sum(1)
                stay = matches >= least
                i, j, matches = i[stay], j[stay], matches[stay]
            pairs.append((i, j))
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    if len(a):
        ok = verified_pairs(sets, a, b)
        a, b = a[ok], b[ok]
    return a, b


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, bands) of each document that has a shingle; h1 and h2 stand for its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = shingles((text or "").encode("utf-8", "surrogatepass"))
                    if len(found):
                        rows.append((doc_id, *set_hash(found), bands(minhash(found))))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                         pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * BANDS, np.concatenate(cols[3]))],
                        names=["doc_id", "h1", "h2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def candidate_groups(representatives: DataFrame) -> DataFrame:
    """(node, component): components of the stars of all bands."""
    member = representatives.select("doc_id", F.explode("bands").alias("band"))
    star = cut(member.groupBy("band").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"))
               .where("centre <> last").select("band", "centre"), "ngram-stars")
    return components(member.join(star, "band").where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")))


def compared(groups: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, links, other): per block the links of a node (counted in documents), and its edge of the spanning forest."""

    def solve(rows: list[tuple]) -> list[tuple]:
        unpress = zstandard.ZstdDecompressor()
        # rows that share a doc_id bring all their texts to each of its sets: only the text with that set stands for it
        own: dict[tuple[int, int], tuple] = {}
        for r in rows:
            if (r[1], r[3]) not in own:
                found = shingles(unpress.decompress(r[4]))
                if len(found) and set_hash(found)[0] == r[3]:
                    own[r[1], r[3]] = r, found
        rows, sets = [r for r, _ in own.values()], [s for _, s in own.values()]
        if len(sets) < 2:
            return []
        a, b = block_links(sets, np.array([r[0] for r in rows]))
        return link_rows([r[1] for r in rows], np.array([r[2] for r in rows], np.int64), a, b)

    needed = groups.select("node").join(classes.select(F.col("rep").alias("node"), "copies", "h1"), "node")
    payload = needed.join(texts.select(F.col("doc_id").alias("node"), "z"), "node").select("node", "copies", "h1", "z")
    return solve_blocks(comparison_blocks(groups, payload, BLOCK), solve, LINKS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links, kept) of each row.

    class_id: smallest doc_id reachable over links; copy_of: smallest doc_id with the same shingles; n_links: other documents
    linked directly; kept: the document stands for its class.
    """
    marks = cut(signed(docs), "ngram-signed")
    own = marks.select("doc_id", "h1", "h2").distinct()
    classes = cut(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "ngram-classes")
    representatives = marks.join(classes, ["h1", "h2"]).where("doc_id = rep").select("doc_id", "bands")
    groups = candidate_groups(representatives)
    found = cut(compared(groups, classes, packed_texts(docs)), "ngram-links")
    links = found.where("links > 0").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    # rows that share a doc_id belong to one class
    shared = own.join(classes, ["h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = shared.join(own.groupBy(F.col("doc_id").alias("a")).count().where("count > 1"), "a").select("a", "b")
    edges = found.where("other is not null").selectExpr("node a", "other b").union(several)
    tops = components(edges).select(F.col("node").alias("rep"), "component")
    solved = cut(classes.join(links, "rep", "left").join(tops, "rep", "left"), "ngram-solved")
    result = (own.join(solved, ["h1", "h2"]).groupBy("doc_id")
              .agg(F.min(F.coalesce("component", "rep")).alias("class_id"), F.min("rep").alias("copy_of"),
                   F.max(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(result, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True))).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, once each; rows without doc_id stay."""
    gone = near_duplicates(docs).where("not kept").select("doc_id")
    named = docs.where("doc_id is not null").join(gone, "doc_id", "leftanti").withColumn("ngram_join_text", F.xxhash64("text"))
    return named.dropDuplicates(["doc_id", "ngram_join_text"]).select(*own_columns(docs)).union(docs.where("doc_id is null"))
