"""Periodic run detection by recursive frequency splitting (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), of at least ``MIN_RUN`` words and two periods, which neither
neighbour extends.

Method.  Every word of a run stands in it twice or more, as the run holds two
periods.  So a word that occurs once in its segment (at first: its document)
joins no run and splits the segment there; counts are taken anew in the parts,
parts that are too short go, and so on until nothing changes.  Prose falls
apart within a few rounds, and only the segments that are left get a lag scan:

* lags under ``DENSE``: words that equal the word one lag on, runs of such;
* longer lags in octaves [2g, 4g): 2g matches in a row hold a whole stretch of g
  words that starts at a multiple of g, so a lag is scanned only where that
  stretch occurs again one lag on.  Stretches are compared by exact ranks of all
  2**t-word stretches (ranks of pairs of ranks, as in prefix doubling), and the
  same ranks extend a match to both sides.  This is near linear in the segment,
  whatever it holds: an octave has at most two candidates a word.

Of the stretches with the same ends the smallest lag is the period: stretches
are maximal and hold two periods, so any smaller period has the same stretch.

Documents do not meet, so the plan has no shuffle; a stretch of a batch is
worked on as one array.

Edge cases: a null text has no words; a text under ``MIN_RUN`` words has no
run; a text of one repeated word is one run of period 1; repeated rows give
equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattlane.llm.arrays import rows_of, text_parts

MIN_RUN = 12
#: Lags under this are all scanned; a power of two.
DENSE = 16
#: Splitting rounds; what a text built to peel off one word a round still holds then is lag-scanned unsplit, with the same result.
MAX_ROUNDS = 200


class Runs(NamedTuple):
    """Runs in order of start, then period: place of the first word, words, period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def word_codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for equal words of one text and for no others; and where texts begin and end."""
    ends = np.cumsum([0, *map(len, texts)])
    out = np.empty(ends[-1], np.int64)
    for words, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        known: dict[bytes, int] = {}
        out[lo:hi] = np.fromiter(map(known.setdefault, words, count(lo)), np.int64, hi - lo)
    return out, ends


def split_rare(code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, segment, code) of the words that are left when no segment holds a word only once; segments in order."""
    at = np.arange(len(code))
    seg = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    times = np.bincount(code)[code] if len(code) else code  # codes differ between texts
    for _ in range(MAX_ROUNDS):
        keep = times > 1
        at, seg, code = at[keep], seg[keep], code[keep]
        if not len(at):
            break
        seg = np.cumsum(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1])))) - 1
        long = np.bincount(seg)[seg] >= MIN_RUN
        if keep.all() and long.all():
            break
        at, seg, code = at[long], seg[long], code[long]
        _, same, times = np.unique(seg * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
        times = times[same]
    return at, np.unique(seg, return_inverse=True)[1], code


def stretch_ranks(seg: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
    """For t = 0, 1, ...: numbers of the 2**t-word stretches from each place, equal exactly for equal stretches of one segment.
    Places whose stretch would leave the array have numbers of their own."""
    ranks = [np.unique(seg * (code.max() + 1) + code, return_inverse=True)[1]]
    longest = int(np.bincount(seg).max())
    n = len(code)
    while 2 << (len(ranks) - 1) <= longest:
        half, last = 1 << (len(ranks) - 1), ranks[-1]
        pair = np.unique(last[:n - half] * (2 * n + 1) + last[half:], return_inverse=True)[1]
        ranks.append(np.concatenate((pair, pair.max(initial=-1) + 1 + np.arange(half))))
    return ranks


def matched(ranks: list[np.ndarray], at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from lo up to hi around ``at`` at which each word equals the word ``lag`` on."""
    n = len(ranks[0])
    lo, hi = at.copy(), at.copy()
    for t in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << t, ranks[t]
        fits = hi + lag + size <= n
        fits[fits] = rank[hi[fits]] == rank[hi[fits] + lag[fits]]
        hi[fits] += size
        fits = lo >= size
        fits[fits] = rank[lo[fits] - size] == rank[lo[fits] - size + lag[fits]]
        lo[fits] -= size
    return lo, hi


def recurrences(rank: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of stretches from multiples of ``g`` that occur again 2g to 4g - 1 words on."""
    n = len(rank)
    wide = n + 4 * g
    key = np.sort(rank * wide + np.arange(n))
    place = np.arange(0, n, g)
    own = rank[place] * wide + place
    lo, hi = np.searchsorted(key, own + 2 * g), np.searchsorted(key, own + 4 * g)
    found = np.repeat(np.arange(len(place)), hi - lo)
    nth = np.arange(len(found)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    return place[found], key[lo[found] + nth] % wide - place[found]


def lag_scan(seg: np.ndarray, code: np.ndarray) -> Runs:
    """All runs of the segments; places count over the arrays."""
    ranks = stretch_ranks(seg, code)
    word, longest = ranks[0], int(np.bincount(seg).max())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lag in range(1, min(DENSE, len(word))):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word[lag:] == word[:-lag], [False])).astype(np.int8)))
        lo, size = edge[::2], edge[1::2] - edge[::2] + lag
        fits = size >= max(MIN_RUN, 2 * lag)
        found.append((lo[fits], size[fits], np.full(fits.sum(), lag)))
    t = DENSE.bit_length() - 2
    while 4 << t <= longest:  # lags from 2 << t need segments of twice as many words
        held = np.bincount(seg)[seg] >= 4 << t
        place = np.flatnonzero(held)
        at, lag = recurrences(ranks[t][held], 1 << t)
        lo, hi = matched(ranks, place[at], lag)
        fits = hi - lo >= lag
        found.append((lo[fits], (hi - lo + lag)[fits], lag[fits]))
        t += 1
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])))[:len(start)]
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def find_runs(texts: list[list[bytes]]) -> tuple[Runs, np.ndarray]:
    """The runs of many texts, places counted over all their words; and where each text's words begin and end."""
    code, ends = word_codes(texts)
    at, seg, code = split_rare(code, ends)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none), ends
    runs = lag_scan(seg, code)
    return Runs(at[runs.start], runs.length, runs.period), ends


def repeated_words(runs: Runs, n: int) -> np.ndarray:
    """Which of n words stand in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) > 0


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a planted run: in every tenth document, by crc32 of doc_id, the tail repeats its first words.
    A null doc_id keeps its words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _over_texts(docs: DataFrame, schema: str, emit, rewrite: Rewrite | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_parts(batches):
            ids, held = rows.column(0).to_pylist(), data.tobytes()
            texts = [held[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]  # of bytes: ASCII white space
            if rewrite is not None:
                texts = [rewrite(i, w) for i, w in zip(ids, texts, strict=True)]
            runs, ends = find_runs(texts)
            yield rows_of(emit(ids, texts, runs, ends), schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def _run_rows(ids, texts, runs, ends):
    text = np.searchsorted(ends, runs.start, "right") - 1
    return {"doc_id": [ids[t] for t in text.tolist()], "start": runs.start - ends[text], "length": runs.length, "period": runs.period}


def _kept(texts, runs, ends) -> list[bytes]:
    gone = repeated_words(runs, int(ends[-1]))
    some = np.concatenate(([0], np.cumsum(gone)))
    out = []
    for words, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if some[hi] > some[lo]:
            words = [w for w, g in zip(words, gone[lo:hi].tolist(), strict=True) if not g]
        out.append(b" ".join(words))
    return out


def _text_rows(ids, texts, runs, ends):
    return {"doc_id": ids, "text": [k.decode("utf-8", "replace") for k in _kept(texts, runs, ends)]}


def _digest_rows(ids, texts, runs, ends):
    bounds = np.searchsorted(runs.start, ends).tolist()
    out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256")}
    for first, lo, hi in zip(ends[:-1].tolist(), bounds[:-1], bounds[1:], strict=True):
        own = [(s - first, n, q) for s, n, q in zip(*(x[lo:hi].tolist() for x in runs), strict=True)]
        best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        out["n_runs"].append(len(own))
        for c, v in zip(("start", "length", "period"), best, strict=True):
            out[c].append(v)
        out["exponent_milli"].append(None if best[1] is None else 1000 * best[1] // best[2])
        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest())
    return {"doc_id": ids, **out, "collapsed_sha256": [hashlib.sha256(k).hexdigest() for k in _kept(texts, runs, ends)]}


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, start, length, period): every run of every text."""
    return _over_texts(docs, "doc_id long, start long, length long, period long", _run_rows, rewrite)


def collapse_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, text): texts whose runs keep one period, words joined by one space."""
    return _over_texts(docs, "doc_id long, text string", _text_rows, rewrite)


def run_digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256), hashed inside the tasks."""
    return _over_texts(docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                       "runs_sha256 string, collapsed_sha256 string", _digest_rows, rewrite)
