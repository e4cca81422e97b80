"""Fill-in-middle transformation by displacement scatter (operator 12).

A text is cut twice between its tokens (``[A-Za-z]+|[^A-Za-z]``) into prefix,
middle and suffix, which are put into another order behind marks:

    psm    <P> prefix <S> suffix <M> middle
    spm    <S> suffix <P> prefix <M> middle
    plain  the text as it is

Method.  All texts of a stretch of a batch are one array of bytes.  One scan
finds where tokens start, running counts give each text's cuts.  Every segment
moves by one shift; the shifts are entered in a difference array at the
segment's two ends, its running sum gives every byte its displacement, and one
scatter writes all outputs (``arrange``).  ``restore`` reads outputs and forms
only: it finds the marks, gets the lengths of the segments from them, and
gathers the bytes back by the same displacements.

The draws come from sha256 of ``seed:doc_id``: reruns and lost executors change
nothing, and no row needs another, so the plan has no shuffle.

Edge cases: a null text is the empty text; empty texts, and texts that hold a
mark, stay plain; a null doc_id draws like the empty string; repeated rows are
cut alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattlane.llm.arrays import rows_of, text_parts

PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
#: The marks before prefix, suffix and middle.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
MARK = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Spec(NamedTuple):
    """Percent of texts that are rearranged, percent of those in the order suffix first, and the seed of the draws."""

    rate: int = 90
    suffix_first: int = 20
    seed: int = 1


def token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the bytes that begin a token, over all texts."""
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(start)


def marks_in(data: np.ndarray, offsets: np.ndarray, letters: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every mark with one of these letters that lies inside one text, in order of place."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_, letter, close = (ord(c) for c in "<X>")
    at = np.flatnonzero((data[:-2] == open_) & (data[2:] == close) & np.isin(data[1:-1], [ord(c) for c in letters]))
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + MARK <= offsets[row + 1]
    return row[inside], at[inside]


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four unsigned 32-bit draws of each id."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest() for i in ids]
    return np.array([struct.unpack(">4I", d[:16]) for d in digests], np.int64).reshape(-1, 4)


class Cuts(NamedTuple):
    """Per text: tokens, form, and the bytes at which the middle begins and ends."""

    tokens: np.ndarray
    form: np.ndarray
    first: np.ndarray
    last: np.ndarray


def scan_cuts(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, spec: Spec) -> Cuts:
    starts = token_starts(data, offsets)
    before = np.searchsorted(starts, offsets)  # tokens before each text
    n = np.diff(before)
    ends = np.append(starts, offsets[-1])

    def place(token: np.ndarray) -> np.ndarray:
        # the first byte of this token of the text, or the text's end behind its last token
        return np.where(token < n, ends[np.minimum(before[:-1] + token, len(starts))], offsets[1:])

    a, b = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    form = np.where(drawn[:, 3] % 100 < spec.suffix_first, SPM, PSM)
    form[(drawn[:, 2] % 100 >= spec.rate) | (n == 0)] = PLAIN
    form[marks_in(data, offsets, "PSM")[0]] = PLAIN
    return Cuts(n, form, place(np.minimum(a, b)), place(np.maximum(a, b)))


def displacements(offsets: np.ndarray, outputs: np.ndarray, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Where each byte of the texts stands in the outputs: running sum over the difference array of segment shifts."""
    suffix = np.diff(offsets) - prefix - middle
    base = outputs[:-1] - offsets[:-1]
    cut, first = form != PLAIN, form == SPM
    shifts = (base + cut * MARK + first * (suffix + MARK),  # prefix
              base + cut * (3 * MARK + suffix),  # middle
              base + cut * (2 * MARK - middle) - first * (prefix + MARK))  # suffix
    bounds = (offsets[:-1], offsets[:-1] + prefix, offsets[:-1] + prefix + middle, offsets[1:])
    change = np.zeros(offsets[-1] + 1, np.int64)
    for shift, lo, hi in zip(shifts, bounds[:-1], bounds[1:], strict=True):
        np.add.at(change, lo, shift)
        np.add.at(change, hi, -shift)
    return np.arange(offsets[-1]) + np.cumsum(change[:-1])


def arrange(data: np.ndarray, offsets: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs."""
    cut, first = cuts.form != PLAIN, cuts.form == SPM
    outputs = np.concatenate(([0], np.cumsum(np.diff(offsets) + 3 * MARK * cut)))
    prefix, middle = cuts.first - offsets[:-1], cuts.last - cuts.first
    suffix = offsets[1:] - cuts.last
    out = np.empty(outputs[-1], np.uint8)
    out[displacements(offsets, outputs, cuts.form, prefix, middle)] = data
    places = {"P": outputs[:-1] + first * (suffix + MARK), "S": outputs[:-1] + ~first * (prefix + MARK), "M": outputs[:-1] + prefix + suffix + 2 * MARK}
    for letter, at in places.items():
        for k, byte in enumerate(MARKS[letter]):
            out[at[cut] + k] = byte
    return out, outputs


def restore(out: np.ndarray, outputs: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, from outputs and forms alone."""
    cut, first = form != PLAIN, form == SPM
    size = np.diff(outputs)
    at = {}
    for letter in MARKS:
        row, place = marks_in(out, outputs, letter)
        own = cut[row]
        if not np.array_equal(row[own], np.flatnonzero(cut)):
            raise ValueError("a rearranged text must hold each mark once")
        at[letter] = np.zeros(len(form), np.int64)
        at[letter][cut] = place[own] - outputs[:-1][cut]
    # a mark's distance from what stands before it is the length of the segment between
    prefix = np.where(first, at["M"] - at["P"], at["S"] - at["P"]) - MARK
    middle = size - at["M"] - MARK
    prefix[~cut], middle[~cut] = 0, 0
    offsets = np.concatenate(([0], np.cumsum(size - 3 * MARK * cut)))
    return out[displacements(offsets, outputs, form, prefix, middle)], offsets


def code_points(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Code points between bytes lo and hi."""
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return before[hi] - before[lo]


def _over_texts(docs: DataFrame, spec: Spec, schema: str, emit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_parts(batches):
            cuts = scan_cuts(data, offsets, draws(rows.column(0).to_pylist(), spec.seed), spec)
            out, outputs = arrange(data, offsets, cuts)
            plain = cuts.form == PLAIN
            yield rows_of({"doc_id": rows.column(0), "n": cuts.tokens, "form": FORMS[cuts.form],
                           "prefix_chars": pa.array(code_points(data, offsets[:-1], cuts.first), mask=plain),
                           "middle_chars": pa.array(code_points(data, cuts.first, cuts.last), mask=plain), **emit(out, outputs, cuts.form)}, schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _sha256(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    held = memoryview(data)
    return [hashlib.sha256(held[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def fill_in_middle(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, text): the rearranged texts."""
    return _over_texts(docs, spec, COLUMNS + ", text string", lambda out, outputs, form: {"text": _strings(out, outputs)})


def restore_texts(arranged: DataFrame) -> DataFrame:
    """(doc_id, text): the original texts of (doc_id, form, text)."""
    schema = "doc_id long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_parts(batches, column=2):
            form = np.array([FORMS.tolist().index(f) for f in rows.column(1).to_pylist()], np.int64)
            yield rows_of({"doc_id": rows.column(0), "text": _strings(*restore(data, offsets, form))}, schema)

    return arranged.selectExpr("cast(doc_id as long) doc_id", "form", "cast(text as string) text").mapInArrow(run, schema)


def infill_digests(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), hashed inside the tasks."""
    return _over_texts(docs, spec, COLUMNS + ", output_sha256 string, restored_sha256 string", lambda out, outputs, form: {
        "output_sha256": _sha256(out, outputs), "restored_sha256": _sha256(*restore(out, outputs, form))})
