"""Suffix-array dedup over bytes by column-wise multi-document construction (operator 6).

Method.  The suffix order of a collection is built one column at a time: each
round every document puts one more symbol in front of its suffix, a stable
counting step by that symbol turns the old order into the new one (the symbols
in the old order are that round's column of the collection's Burrows-Wheeler
transform), and the common prefixes of neighbours follow from range minima over
the old ones.  Neighbours with a common prefix of 400 bytes or more hold a
repeated string.

The collection that is built holds only strings that can repeat: ``repeats``
files every 400-byte string under its anchor gram, equal segments are found by
their content hash, and the first stands of the differing segments of one anchor
form a block.  All strings of a block have the anchor in common, so their
columns are aligned on it and only suffixes of one column need an order: a
round costs the strings of the block, not the size of the transform so far.
The order, the common prefixes and the strings' next symbols are arrays that
are read and rewritten front to back each round, as the external files of the
method are; a block is bounded by ``BLOCK_STRINGS`` plus the strings of one
anchor, so they stay in the task's memory and no file outlives a lost executor.
An anchor with more than ``ANCHOR_STRINGS`` different segments is split: its
strings are hashed one by one and counted by an ordinary aggregate.

Edge cases: a null text is the empty text; texts under 400 bytes are kept; a
text may repeat strings of its own; rows that share doc_id and text are one
document (each row gets its result), rows that share only the doc_id are
different documents; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlane.llm.common import cut
from wattlane.llm.repeats import (DOC, NO_ID, SQL_AGAIN, SQL_COUNT, U, Hasher, contents, local_copies, occurrences, packed_texts,
                                  repeated_anchors, segments, slices, unpack)

BYTES, GRAM = 400, 64
BLOCK_STRINGS, ANCHOR_STRINGS = 4000, 20_000
_BYTE = np.random.default_rng(6).integers(1, 1 << 63, (2, 256), dtype=U)


def byte_units(data: bytes, which: int = 0) -> np.ndarray:
    return _BYTE[which][np.frombuffer(data, np.uint8)]


def range_minima(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of x[lo..hi] for many ranges, hi included."""
    out = x[hi].copy()
    wide = np.flatnonzero(hi > lo)
    if len(wide):
        span = hi[wide] - lo[wide] + 1
        level = np.frexp(span)[1] - 1
        table, k = x, 0
        while True:
            now = wide[level == k]
            out[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << k) + 1])
            if k == level.max():
                break
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
            k += 1
    return out


def repeated_starts(group: np.ndarray, strings: list[bytes], left: np.ndarray, windows: np.ndarray, length: int = BYTES) -> list[np.ndarray]:
    """For each string the starts of its ``length``-byte windows that another string of its group holds at the same column.

    ``left`` is the number of bytes before the anchor; ``windows`` how many windows the string holds.
    """
    m = len(strings)
    size = np.fromiter(map(len, strings), np.int64, m)
    data = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(size) - size
    right = size - left  # columns run from right - 1 down to -left
    enter = np.argsort(-right, kind="stable")
    entered = 0
    order = np.zeros(0, np.int64)  # strings in suffix order, group by group
    common = np.zeros(0, np.int64)  # common prefix with the string before
    # group ranks keep each group's strings together
    _, rank = np.unique(group, return_inverse=True)
    hits: list[tuple[np.ndarray, int]] = []
    for column in range(int(right.max()) - 1, -int(left.max()) - 1, -1):
        # strings that begin here: their empty suffix comes first in its group
        to = entered
        while to < m and right[enter[to]] - 1 == column:
            to += 1
        if to > entered:
            new = enter[entered:to]
            entered = to
            merged = np.concatenate((new, order))
            prefix = np.concatenate((np.zeros(len(new), np.int64), common))
            at = np.argsort(rank[merged], kind="stable")
            order, moved = merged[at], prefix[at]
            fresh = np.concatenate((np.ones(len(new), bool), np.zeros(len(common), bool)))[at]
            # behind a new (empty) suffix nothing is common
            moved[1:][fresh[:-1]] = 0
            common = moved
        # strings that have no byte here leave; the next one inherits the minimum
        stay = left[order] + column >= 0
        if not stay.all():
            kept = np.flatnonzero(stay)
            if len(kept):
                common = range_minima(common, np.concatenate(([0], kept[:-1] + 1)), kept)
            else:
                common = common[:0]
            order = order[kept]
        if not len(order):
            continue
        symbol = data[base[order] + left[order] + column]
        key = rank[order] * 256 + symbol
        at = np.argsort(key, kind="stable")
        key = key[at]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        grown = np.zeros(len(order), np.int64)
        grown[same] = range_minima(common, at[same - 1] + 1, at[same]) + 1
        order, common = order[at], grown
        long = common >= length
        if long.any():
            both = long.copy()
            both[:-1] |= long[1:]
            hits.append((order[both], column))
    out: list[list[int]] = [[] for _ in range(m)]
    for who, column in hits:
        for s in who[left[who] + column < windows[who]].tolist():
            out[s].append(column + int(left[s]))
    return [np.array(x[::-1], np.int64) for x in out]


STRINGS = "anchor long, doc_id long, text_key long, segment long, before int, string binary"


def segment_strings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted segments, with the bytes before the anchor counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in slices(batches):
            for doc_id, key, z, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = unpress.decompress(z)
                packed = np.unique(np.array(found, np.int64))
                start, count = unpack(packed)
                anchor, _, first, _, place = segments(byte_units(data), BYTES, GRAM)
                at = np.searchsorted(first, start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[at].view(np.int64)), pa.array(np.full(len(at), doc_id, np.int64)), pa.array(np.full(len(at), key, np.int64)),
                     pa.array(packed), pa.array((place[at] - first[at]).astype(np.int32)),
                     pa.array([data[f:f + c + BYTES - 1] for f, c in zip(start.tolist(), count.tolist(), strict=True)], pa.binary())],
                    names=["anchor", *DOC, "segment", "before", "string"])

    by_doc = wanted.groupBy(*DOC).agg(F.collect_list("segment").alias("found"))  # bounded by the text's own length
    return texts.join(by_doc, DOC).select(*DOC, "z", "found").mapInArrow(run, STRINGS)


FLAGS = "doc_id long, text_key long, segment long, start long, windows long"
FLAG_COLUMNS = [*DOC, "segment", "start", "windows"]


def block_repeats(strings: DataFrame) -> DataFrame:
    """Runs of repeated windows in the blocks; ``strings`` of one anchor are in one block."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[1:4]: r for r in rows}.values())  # rows that are repeated are one document
        anchor, doc_id, key, segment, before, string = zip(*rows, strict=True)
        _, count = unpack(np.array(segment, np.int64))
        found = repeated_starts(np.array(anchor), list(string), np.array(before, np.int64), count)
        out = []
        for i, starts in enumerate(found):
            if len(starts):
                head = np.concatenate(([True], starts[1:] != starts[:-1] + 1))
                size = np.diff(np.append(np.flatnonzero(head), len(starts)))
                out += [(doc_id[i], key[i], segment[i], s, n) for s, n in zip(starts[head].tolist(), size.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(5)], names=FLAG_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(rows) >= BLOCK_STRINGS and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strings.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(run, FLAGS)


def counted_repeats(strings: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: every window is hashed and counted, so no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, doc_id, key, segment, _, string in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.arange(len(string) - BYTES + 1)
                h = [Hasher(byte_units(string, w), w).of(at, at + BYTES).view(np.int64) for w in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(at), doc_id, np.int64)), pa.array(np.full(len(at), key, np.int64)),
                     pa.array(np.full(len(at), segment, np.int64)), pa.array(at)], names=["h1", "h2", *DOC, "segment", "start"])

    windows = strings.mapInArrow(run, "h1 long, h2 long, doc_id long, text_key long, segment long, start long")
    place = F.struct(*DOC, "segment", "start")
    twice = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h1", "h2")
    return windows.join(twice, ["h1", "h2"], "leftsemi").selectExpr(*DOC, "segment", "start", "1L windows")


def repeated_runs(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, segment, start, windows): windows of a segment (from its first one) that start somewhere else too."""
    found = cut(repeated_anchors(occurrences(docs, byte_units, BYTES, GRAM)), "suffix")
    known = contents(found)
    copies = known.where("first < last").select("anchor", "content")
    whole = (found.join(copies, ["anchor", "content"], "leftsemi")
             .selectExpr(*DOC, "segment", "0L start", f"{SQL_COUNT.format('segment')} windows"))
    # no windows: a mark that the text repeats segments of its own
    marks = found.where(f"{SQL_AGAIN.format('segment')} = 1").selectExpr(*DOC, "segment", "0L start", "0L windows")
    mixed = known.where("mixed").select("anchor", "first.*")
    strings = segment_strings(texts, mixed.select(*DOC, "segment"))
    huge = mixed.groupBy("anchor").count().where(f"count > {ANCHOR_STRINGS}").select("anchor")
    strings = cut(strings, "suffix-strings")
    return (whole.union(marks).union(block_repeats(strings.join(huge, "anchor", "leftanti").select(*strings.columns)))
            .union(counted_repeats(strings.join(huge, "anchor", "leftsemi").select(*strings.columns))))


def removed_bytes(data: bytes, segment: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Which bytes of a text are covered by a repeated window."""
    n = len(data)
    change = np.zeros(n + 1, np.int64)

    def add(at: np.ndarray, count: np.ndarray) -> None:
        np.add.at(change, at, 1)
        np.add.at(change, at + count + BYTES - 1, -1)

    some = windows > 0
    add(unpack(segment[some])[0] + start[some], windows[some])
    if not some.all():  # segments that stand at several places of this very text
        anchor, content, at, count, _ = segments(byte_units(data), BYTES, GRAM)
        _, times = local_copies(anchor, content)
        add(at[times > 1], count[times > 1])
    return np.cumsum(change[:-1]) > 0


def _per_text(docs: DataFrame, schema: str, emit) -> DataFrame:
    texts = packed_texts(docs)
    by_doc = repeated_runs(docs, texts).groupBy(*DOC).agg(F.collect_list(F.struct("segment", "start", "windows")).alias("found"))
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part in slices(batches):
            rows = []
            for doc_id, z, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = unpress.decompress(z)
                own = np.array([[f["segment"], f["start"], f["windows"]] for f in found or ()], np.int64).reshape(-1, 3)
                rows += emit(None if doc_id == NO_ID else doc_id, data, removed_bytes(data, *own.T))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return texts.join(by_doc, DOC, "left").select("doc_id", "z", "found").mapInArrow(run, schema)


def spans_of(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal removed runs."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _span_rows(doc_id, data, gone):
    return [(doc_id, s, e) for s, e in zip(*(x.tolist() for x in spans_of(gone)), strict=True)]


def _digest_rows(doc_id, data, gone):
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return [(doc_id, len(data), int(gone.sum()), len(spans_of(gone)[0]), hashlib.sha256(kept).hexdigest())]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): maximal byte ranges covered by repeated 400-byte strings."""
    return _per_text(docs, "doc_id long, start long, end long", _span_rows)


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), hashed inside the tasks."""
    return _per_text(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digest_rows)
