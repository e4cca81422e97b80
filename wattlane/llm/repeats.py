"""Repeated windows of documents: what the two exact substring operators share.

A document is a sequence of units (words or bytes); a window is ``length``
consecutive units of one document.  Every window is filed under its *anchor*,
the smallest hash of the ``gram``-unit grams inside it (the leftmost of equal
ones), so equal windows have the same anchor at the same offset.  A *segment* is
a run of neighbouring windows with their anchor at one place.  Only segments whose anchor occurs more than once can hold a repeated
window, and of those only the anchors with different segment contents need a
look at the windows themselves.  Grams thin the rows that are shuffled to about
2 / (length - gram + 2) per unit; hot anchors are counted with partial
aggregates and joined (AQE can split such joins), never gathered.

A document is known by doc_id and a 64-bit hash of its text (``text_key``), so
rows that share a doc_id, or have none, stay apart and no list is longer than one
text.  A segment travels as one long: 1 bit "stands at several places of this
text", 35 bits of the first window, 12 bits of the number of windows.  A segment
that stands at several places of one text is shuffled once; the text itself
tells the other places when it is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import cut

U = np.uint64
NO_ID = -(1 << 63)
#: Odd multipliers of the polynomial hashes (modulo 2**64) and of the final mixing.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
RUN_BITS, AT_BITS = 12, 35
#: What a document is known by.
DOC = ["doc_id", "text_key"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(MIX[0])
    x ^= x >> U(33)
    x = x * U(MIX[1])
    x ^= x >> U(33)
    return x


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least ``n`` of them; the longest table so far is kept."""
    if which in _tables and len(_tables[which][0]) >= n:
        return _tables[which]
    n = 1 << max(16, (n - 1).bit_length())
    base = BASES[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.empty(n, U)
        p[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            p[done:done + step] = p[:step] * U(pow(b, done, 1 << 64))
            done += step
        out.append(p)
    _tables[which] = out[0], out[1]
    return _tables[which]


class Hasher:
    """Hashes of any stretch of one array of units, in constant time each."""

    def __init__(self, units: np.ndarray, which: int = 0):
        powers, self.inverse = _powers(which, len(units) + 1)
        self.prefix = np.zeros(len(units) + 1, U)
        np.cumsum(units * powers[:len(units)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def segments(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first window, windows, place of the anchor) of each segment of one document."""
    n = len(units)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    h = Hasher(units)
    at = np.arange(n - gram + 1)
    grams = h.of(at, at + gram)
    width = length - gram + 1
    least = sliding_min(grams, width)
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(cut[1:], len(least)) - 1
    # places that hold the smallest gram of some window come in the order of the runs of equal minima
    pad = np.zeros(width - 1, U)
    place = np.flatnonzero(grams == ~sliding_min(~np.concatenate((pad, least, pad)), width))
    value = grams[place]
    fresh = np.concatenate(([True], value[1:] != value[:-1]))
    run = np.cumsum(fresh) - 1
    first = np.where(fresh, cut[run], np.concatenate(([0], place[:-1] + 1)))
    count = np.minimum(place, last[run]) - first + 1
    some = count > 0
    place, first, count = place[some], first[some], count[some]
    content = h.of(first, first + count + length - 1) + mix(((place - first) << 32 | count).astype(U))
    return grams[place], content, first, count, place


def pack(again: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (again.astype(np.int64) << (RUN_BITS + AT_BITS)) | (first.astype(np.int64) << RUN_BITS) | count.astype(np.int64)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows)."""
    return (packed >> RUN_BITS) & ((1 << AT_BITS) - 1), packed & ((1 << RUN_BITS) - 1)


#: The parts of a packed segment in SQL; {} is the column.
SQL_AGAIN = f"shiftright({{}}, {RUN_BITS + AT_BITS})"
SQL_FIRST, SQL_COUNT = f"(shiftright({{}}, {RUN_BITS}) & {(1 << AT_BITS) - 1}L)", f"({{}} & {(1 << RUN_BITS) - 1}L)"


def local_copies(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the index of the first with the same content in this text, and how often it stands there."""
    _, first, inverse, n = np.unique(mix(anchor) ^ content, return_index=True, return_inverse=True, return_counts=True)
    return first[inverse], n[inverse]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short batches, so that a task holds few whole texts as Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, z): texts under zstd, which halves what the two joins by document shuffle. Null: the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            z = [press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], names=[*DOC, "z"])

    return keyed(docs).mapInArrow(run, "doc_id long, text_key long, z binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text; a null doc_id travels as the smallest long."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def occurrences(docs: DataFrame, units_of, length: int, gram: int) -> DataFrame:
    """(anchor, content, doc_id, text_key, segment): each distinct segment of each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc_id, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                anchor, content, first, count, _ = segments(units_of(data), length, gram)
                if len(anchor):
                    copy_of, times = local_copies(anchor, content)
                    own = np.flatnonzero(copy_of == np.arange(len(anchor)))
                    for to, a in zip(out, (anchor[own].view(np.int64), content[own].view(np.int64),
                                           np.full(len(own), doc_id, np.int64), np.full(len(own), key, np.int64),
                                           pack(times[own] > 1, first[own], count[own])), strict=True):
                        to.append(a)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["anchor", "content", *DOC, "segment"])

    return keyed(docs).mapInArrow(run, "anchor long, content long, doc_id long, text_key long, segment long")


def repeated_anchors(found: DataFrame) -> DataFrame:
    """The occurrences whose anchor stands in more than one of them, or that stand at several places of their text."""
    twice = found.groupBy("anchor").agg(F.count("*").alias("n"), F.max(F.expr(SQL_AGAIN.format("segment"))).alias("again"))
    twice = cut(twice.where("n > 1 or again = 1").select("anchor"), "anchors")  # written, so that AQE can split the join
    return found.join(twice, "anchor", "leftsemi")


def contents(candidates: DataFrame) -> DataFrame:
    """(anchor, content, first, last, mixed): first and last place of each content; whether its anchor has other contents."""
    place = F.struct(*DOC, "segment")
    own = cut(candidates.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.max(place).alias("last")), "contents")
    kinds = candidates.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    mixed = cut(kinds.where("lo <> hi").select("anchor", F.lit(True).alias("mixed")), "mixed")
    return own.join(mixed, "anchor", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
