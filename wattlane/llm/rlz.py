"""Substring dedup by relative Lempel-Ziv parsing over words (operator 5).

Method.  Every document is a reference for all later text.  The reference is
indexed by its 20-word windows, in blocks (shuffle partitions): a window hash
leads to the place where the window starts first.  Only windows that can repeat
enter the index: the grams of ``repeats`` thin the corpus first, and a whole
segment that stands earlier is a match by itself.  A document is then factored
greedily from left to right: at each word the index gives the earlier place of
the longest match begun there; the factor runs on while the next windows
continue at the next places of the same reference text, and where it ends the
index is asked again from the next window on, so a match that crosses a factor
boundary is found too.  Factors of 20 words or more are the duplicate spans.

A window is judged on the input: it goes if the same words start earlier (a
smaller doc_id, or an earlier word of the same document).

Edge cases: a null text has no words; a text under 20 words keeps all; a null
doc_id sorts before all others; rows that share a doc_id and the text are one
document (each row gets its result), rows that share only the doc_id are
ordered by a hash of their texts; extra columns are ignored.
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
from wattlane.llm.repeats import (BASES, DOC, NO_ID, SQL_AGAIN, SQL_COUNT, SQL_FIRST, U, Hasher, contents, local_copies, occurrences,
                                  packed_texts, repeated_anchors, segments, slices, unpack)

WORDS, GRAM = 20, 8
#: The white space between words.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=U)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    gap = np.concatenate(([True], _IS_SPACE[np.frombuffer(data, np.uint8)], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_units(data: bytes, which: int = 0) -> np.ndarray:
    """A hash of each word."""
    start, end = word_bounds(data)
    return Hasher(_BYTE[np.frombuffer(data, np.uint8)], which).of(start, end) + (end - start).astype(U) * U(BASES[1 - which])


def index_windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, text_key, at): the windows of the wanted segments; ``at`` is the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in slices(batches):
            for doc_id, key, z, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = unpress.decompress(z)
                first, count = unpack(np.unique(np.array(found, np.int64)))
                at = np.unique(np.concatenate([np.arange(f, f + c) for f, c in zip(first, count, strict=True)]))
                h = [Hasher(word_units(data, w), w).of(at, at + WORDS).view(np.int64) for w in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[0]), pa.array(h[1]), pa.array(np.full(len(at), doc_id, np.int64)),
                     pa.array(np.full(len(at), key, np.int64)), pa.array(at)], names=["h1", "h2", *DOC, "at"])

    by_doc = wanted.groupBy(*DOC).agg(F.collect_list("segment").alias("found"))  # bounded by the text's own length
    return texts.join(by_doc, DOC).select(*DOC, "z", "found").mapInArrow(run, "h1 long, h2 long, doc_id long, text_key long, at long")


SOURCE = ["src_doc", "src_key", "src_at"]


def duplicate_sources(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, windows, src_doc, src_key, src_at): runs of windows of a document that start earlier elsewhere."""
    found = cut(repeated_anchors(occurrences(docs, word_units, WORDS, GRAM)), "rlz")
    known = contents(found)
    here = F.struct(*DOC, "segment")
    # whole segments that stand earlier
    whole = found.join(known.select("anchor", "content", "first"), ["anchor", "content"]).where(here > F.col("first"))
    runs = whole.selectExpr(*DOC, f"{SQL_FIRST.format('segment')} at", f"{SQL_COUNT.format('segment')} windows",
                            "first.doc_id src_doc", "first.text_key src_key", f"{SQL_FIRST.format('first.segment')} src_at")
    # no windows: a mark that the text repeats segments of its own
    marks = found.where(f"{SQL_AGAIN.format('segment')} = 1").selectExpr(*DOC, "0L at", "0L windows", "0L src_doc", "0L src_key", "0L src_at")
    # first stands of contents whose anchor also has other contents: ask the index window by window
    wanted = known.where("mixed").select("first.*")
    windows = cut(index_windows(texts, wanted), "rlz-windows")
    place = F.struct(*DOC, "at")
    index = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    index = cut(index.where("first < last").select("h1", "h2", "first"), "rlz-index")
    hits = (windows.join(index, ["h1", "h2"]).where(place > F.col("first"))
            .selectExpr(*DOC, "at", "1L windows", "first.doc_id src_doc", "first.text_key src_key", "first.at src_at"))
    return runs.union(hits).union(marks)


def factors(data: bytes, doc_id: int, key: int, at: np.ndarray, windows: np.ndarray, src_doc: np.ndarray, src_key: np.ndarray, src_at: np.ndarray):
    """Greedy factors of one document: (first word, words, reference document, its first word)."""
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    n = len(word_bounds(data)[0])
    doc = np.full(n - WORDS + 1, NO_ID, np.int64)
    text = np.zeros(n - WORDS + 1, np.int64)
    source = np.full(n - WORDS + 1, -1, np.int64)
    each = np.repeat(np.arange(len(at)), windows)
    offset = np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
    doc[at[each] + offset] = src_doc[each]
    text[at[each] + offset] = src_key[each]
    source[at[each] + offset] = src_at[each] + offset
    if (windows == 0).any():  # later places of a segment of this very text
        anchor, content, first, count, _ = segments(word_units(data), WORDS, GRAM)
        copy_of, _ = local_copies(anchor, content)
        for i in np.flatnonzero(copy_of != np.arange(len(anchor))):
            f, g, c = first[i], first[copy_of[i]], count[i]
            doc[f:f + c], text[f:f + c] = doc_id, key
            source[f:f + c] = np.arange(g, g + c)
    found = np.flatnonzero(source >= 0)
    if not len(found):
        return found, found, found, found
    goes_on = (found[1:] == found[:-1] + 1) & (doc[found[1:]] == doc[found[:-1]]) & (text[found[1:]] == text[found[:-1]]) & (source[found[1:]] == source[found[:-1]] + 1)
    head = np.concatenate(([True], ~goes_on))
    size = np.diff(np.append(np.flatnonzero(head), len(found))) + WORDS - 1
    return found[head], size, doc[found[head]], source[found[head]]


def _per_text(docs: DataFrame, schema: str, emit) -> DataFrame:
    """Factor every text and emit rows of (doc_id, text bytes, factors)."""
    texts = packed_texts(docs)
    found = duplicate_sources(docs, texts)
    by_doc = found.groupBy(*DOC).agg(F.collect_list(F.struct("at", "windows", *SOURCE)).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for part in slices(batches):
            rows = []
            lists = part.column(3)
            flat = np.stack([lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(5)]) if lists.null_count < len(lists) else None
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            end = np.cumsum(size)
            for i, (doc_id, key, z) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)):
                data = unpress.decompress(z)
                own = flat[:, end[i] - size[i]:end[i]] if size[i] else np.zeros((5, 0), np.int64)
                rows += emit(None if doc_id == NO_ID else doc_id, data, factors(data, doc_id, key, *own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    return texts.join(by_doc, DOC, "left").select(*DOC, "z", "found").mapInArrow(run, schema)


def _factor_rows(doc_id, data, found):
    return [(doc_id, int(f), int(n), None if d == NO_ID else int(d), int(s)) for f, n, d, s in zip(*found, strict=True)]


def kept_words(data: bytes, first: np.ndarray, size: np.ndarray) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by a space)."""
    if not len(first):
        words = data.split()  # of bytes: the same white space
        return len(words), 0, b" ".join(words)
    start, end = word_bounds(data)
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + size, -1)
    gone = np.cumsum(change[:-1]) > 0
    # the bytes of kept words, each with the one byte behind it made a space
    out = np.append(np.frombuffer(data, np.uint8), np.uint8(0x20))
    out[end] = 0x20
    edge = np.zeros(len(out) + 1, np.int8)
    edge[start[~gone]] = 1
    edge[end[~gone] + 1] -= 1
    kept = out[np.cumsum(edge[:-1]) > 0].tobytes()[:-1]
    return len(start), int(gone.sum()), kept


def _digest_rows(doc_id, data, found):
    n, gone, kept = kept_words(data, found[0], found[1])
    return [(doc_id, n, gone, hashlib.sha256(kept).hexdigest())]


def _kept_rows(doc_id, data, found):
    return [(doc_id, kept_words(data, found[0], found[1])[2].decode("utf-8", "surrogatepass"))]


def duplicate_factors(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words, src_doc_id, src_word): the duplicate spans and where each was first read."""
    return _per_text(docs, "doc_id long, first_word long, n_words long, src_doc_id long, src_word long", _factor_rows)


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words that are left, joined by one space."""
    return _per_text(docs, "doc_id long, text string", _kept_rows)


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), hashed inside the tasks."""
    return _per_text(docs, "doc_id long, n_words long, n_removed long, kept_sha256 string", _digest_rows)
