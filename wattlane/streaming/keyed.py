"""Keyed state of the streaming scorer (M13), in Spark's own state store.

One state per bucket of series (a hash of the series key): calling Python for a
series costs far more than its few rows, so ``advance`` sees the micro-batch of a
bucket in Arrow chunks and works on the rows of all its series at once.  It holds,
between batches and for each series of the bucket,

* its newest ``RECENT`` placed rows,
* totals: rows placed, late and repeated, running sums of the measures,
* which deliveries were read, for each ``BLOCK`` of arrival numbers as a list of
  places or, once that is shorter, as one bitmap; what no row has touched for
  ``SEEN_TTL_MS`` is dropped.

Its output is what the batch plan needs: the stored rows of the touched series as
they were before the batch, the rows that can be placed behind them, and one row
of totals a series.  Features and scores are computed by the batch plan
downstream, where a hot series is chunked; here a hot series passes through in
chunks and nothing of it is gathered but its newest rows.  A group gives out one
frame a chunk, and holds the newest rows of its series: the number of buckets
bounds both the calls and what one call holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from wattlane.operators.score import RECENT

#: What a row is in the output: stored before, placed by this batch, or the totals.
OLD, NEW, TOTALS = 0, 1, 2
BLOCK = 1 << 14
#: A delivery that comes again within this time is known as repeated.
SEEN_TTL_MS = 30 * 24 * 3600 * 1000

MEASURES = ["Power_Consumption", "temperature", "humidity"]
STORED = ["micros", "arrival_no", *MEASURES]
#: Stored rows as bytes: the columns in this order, each as its type; ``numbered`` says which rows have an arrival number.
TAIL = {"micros": "<i8", "arrival_no": "<i8", "numbered": "?"} | dict.fromkeys(MEASURES, "<f8")
COUNTS = ["n_seen", "late_rows", "repeated_rows", "t_cnt", "h_cnt"]
SUMS = ["t_sum", "h_sum"]
KINDS = {c: T.LongType() for c in (*STORED[:2], *COUNTS)} | {c: T.DoubleType() for c in (*MEASURES, *SUMS)}
OUTPUT = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("kind", T.IntegerType()),
                       *[T.StructField(c, KINDS[c]) for c in (*STORED, *COUNTS, *SUMS)]])
#: Series of the bucket, their totals, how many rows of each are stored, those rows series by series, and the deliveries seen.
STATE = T.StructType([T.StructField("series", T.ArrayType(T.StringType())),
                      *[T.StructField(c, T.ArrayType(KINDS[c])) for c in (*COUNTS, *SUMS)],
                      T.StructField("stored", T.ArrayType(T.LongType())), *[T.StructField(c, T.BinaryType()) for c in TAIL],
                      T.StructField("owner", T.ArrayType(T.LongType())),
                      T.StructField("block", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.BinaryType())),
                      T.StructField("touched_ms", T.ArrayType(T.LongType()))])


def _longs(c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none) and which are there."""
    known = c.notna().to_numpy()
    out = np.zeros(len(c), np.int64)
    out[known] = c.to_numpy()[known].astype(np.int64)
    return out, known


class Rows:
    """Rows as arrays: the series (its place in the bucket), stamps, arrival numbers and which of either are there, measures (NaN for NULL)."""

    def __init__(self, owner: np.ndarray, micros: np.ndarray, stamped: np.ndarray, arrival: np.ndarray, known: np.ndarray, measures: list[np.ndarray]):
        self.owner, self.micros, self.stamped, self.arrival, self.known, self.measures = owner, micros, stamped, arrival, known, measures

    @staticmethod
    def of(owner: np.ndarray, columns: dict[str, pd.Series]) -> "Rows":
        return Rows(owner, *_longs(columns["micros"]), *_longs(columns["arrival_no"]), [columns[m].astype("float64").to_numpy() for m in MEASURES])

    @staticmethod
    def unpacked(stored: list[int], columns: dict[str, bytes]) -> "Rows":
        at = {c: np.frombuffer(columns[c], kind) for c, kind in TAIL.items()}
        owner = np.repeat(np.arange(len(stored)), stored)
        return Rows(owner, at["micros"], np.ones(len(owner), bool), at["arrival_no"], at["numbered"], [at[m] for m in MEASURES])

    def packed(self, series: int) -> tuple[list[int], list[bytes]]:
        """How many rows each series has, and the columns; the rows are stamped and stand series by series."""
        columns = [self.micros, self.arrival, self.known, *self.measures]
        return (np.bincount(self.owner, minlength=series).tolist(),
                [x.astype(kind).tobytes() for x, kind in zip(columns, TAIL.values(), strict=True)])

    def __len__(self) -> int:
        return len(self.micros)

    def take(self, which: np.ndarray | slice) -> "Rows":
        return Rows(self.owner[which], self.micros[which], self.stamped[which], self.arrival[which], self.known[which], [m[which] for m in self.measures])

    def and_(self, other: "Rows") -> "Rows":
        mine, others = ([r.owner, r.micros, r.stamped, r.arrival, r.known, *r.measures] for r in (self, other))
        both = [np.concatenate(x) for x in zip(mine, others)]
        return Rows(*both[:5], both[5:])

    def places(self) -> np.ndarray:
        """Arrival numbers to sort by: rows without one stand first."""
        return np.where(self.known, self.arrival, -(1 << 63))

    def newest(self, n: int) -> "Rows":
        """The newest ``n`` rows of each series, series by series in order."""
        at = np.lexsort((self.places(), self.micros, self.owner))
        owner = self.owner[at]
        return self.take(at[np.searchsorted(owner, owner, "right") - np.arange(len(at)) <= n])


def _out(series: np.ndarray, old: Rows, new: Rows, ended: np.ndarray | None = None, totals: dict[str, np.ndarray] | None = None) -> pd.DataFrame:
    """Stored rows, placed rows and, at the end, the totals of the series ``ended``."""
    rows = old.and_(new)
    ended = np.zeros(0, np.int64) if ended is None else ended
    last, n = len(ended), len(rows) + len(ended)
    blank = np.zeros(last, np.int64)
    longs = {"micros": (np.concatenate((rows.micros, blank)), np.concatenate((~rows.stamped, blank == 0))),
             "arrival_no": (np.concatenate((rows.arrival, blank)), np.concatenate((~rows.known, blank == 0)))}
    doubles = {c: np.concatenate((m, np.full(last, np.nan))) for c, m in zip(MEASURES, rows.measures)}
    for c in COUNTS:
        longs[c] = np.zeros(n, np.int64), np.ones(n, bool)
    for c in SUMS:
        doubles[c] = np.full(n, np.nan)
    if last:
        for c in COUNTS:
            longs[c][0][-last:], longs[c][1][-last:] = totals[c][ended], False
        for c in SUMS:
            doubles[c][-last:] = totals[c][ended]
    kinds = np.repeat(np.array([OLD, NEW, TOTALS], np.int32), (len(old), len(new), last))
    return pd.DataFrame({"series_id": series[np.concatenate((rows.owner, ended))], "kind": kinds}
                        | {c: pd.arrays.IntegerArray(*longs[c]) if c in longs else doubles[c] for c in OUTPUT.names[2:]}, copy=False)


class Seen:
    """The arrival numbers that series have delivered, by series and block: places as 16-bit numbers while that is shorter, then a bitmap."""

    def __init__(self, block: list[int], bits: list[bytes], touched: list[int], now: int, owner: list[int] | None = None):
        self.now = now
        self.held = {(o, b): (x, t) for o, b, x, t in zip(owner or [0] * len(block), block, bits, touched) if now - t < SEEN_TTL_MS}

    def fresh(self, arrival: pd.Series) -> np.ndarray:
        """Which rows bring an arrival number for the first time; they are marked as seen. Rows without one are never repeats."""
        return self.first(*_longs(arrival))

    def first(self, number: np.ndarray, known: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        out = ~known
        rows = np.flatnonzero(known)
        owner = np.zeros(len(number), np.int64) if owner is None else owner
        rows = rows[np.lexsort((number[rows], owner[rows]))]  # stable: the first of equal numbers stands first
        own, num = owner[rows], number[rows]
        again = np.zeros(len(rows), bool)
        again[1:] = (own[1:] == own[:-1]) & (num[1:] == num[:-1])
        rows, own, num = rows[~again], own[~again], num[~again]
        block, place = num // BLOCK, num % BLOCK
        head = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(block, prepend=block[:1] - 1) != 0))
        new = np.ones(len(rows), bool)
        for lo, hi, key in zip(head.tolist(), [*head[1:].tolist(), len(rows)], zip(own[head].tolist(), block[head].tolist())):
            places = place[lo:hi]
            if key in self.held:
                before = self.places(key[1], key[0])
                new[lo:hi] = ~np.isin(places, before)
                places = np.union1d(before, places)
            if 2 * len(places) < BLOCK // 8:
                held = places.astype("<u2").tobytes()
            else:
                bits = np.zeros(BLOCK, bool)
                bits[places] = True
                held = np.packbits(bits).tobytes()
            self.held[key] = held, self.now
        out[rows[new]] = True
        return out

    def places(self, block: int, owner: int = 0) -> np.ndarray:
        """Places that are seen in a block of a series, in order."""
        held = self.held.get((owner, block), (b"",))[0]
        if len(held) < BLOCK // 8:
            return np.frombuffer(held, "<u2").astype(np.int64)
        return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8)))

    def stored(self) -> tuple[list[int], list[bytes], list[int]]:
        return [b for _, b in self.held], [x for x, _ in self.held.values()], [t for _, t in self.held.values()]

    def owners(self) -> list[int]:
        """The series of each stored block."""
        return [o for o, _ in self.held]


class Series:
    """The series of a bucket by name (NULL is a name like any other), each with a place."""

    def __init__(self, names: list[str | None]):
        self.names = names
        self.place = {n: k for k, n in enumerate(names)}

    def owners(self, column: pd.Series) -> np.ndarray:
        """The place of each row's series; new ones get the next."""
        code, found = pd.factorize(column.to_numpy(dtype=object, na_value=None), use_na_sentinel=False)
        own = np.empty(len(found), np.int64)
        for k, name in enumerate(found.tolist()):
            name = name if isinstance(name, str) else None
            if name not in self.place:
                self.place[name] = len(self.names)
                self.names.append(name)
            own[k] = self.place[name]
        return own[code]

    def array(self) -> np.ndarray:
        out = np.empty(len(self.names), object)
        out[:] = self.names
        return out


def _later(rows: Rows, last: Rows) -> np.ndarray:
    """Which rows stand behind the newest placed row of their series (``last``: one row for each that has any)."""
    at = np.searchsorted(last.owner, rows.owner)
    out = rows.stamped.copy()
    held = np.flatnonzero(np.append(last.owner, -1)[at] == rows.owner)
    at, micros = at[held], rows.micros[held]
    out[held] &= (micros > last.micros[at]) | ((micros == last.micros[at]) & (rows.places()[held] > last.places()[at]))
    return out


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate((x, np.zeros(n - len(x), x.dtype)))


def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Place the rows of one bucket's micro-batch and move its state on.  Chunks without ``series_id`` are rows of the series ``key``."""
    names = [f.name for f in STATE.fields]
    held = dict(zip(names, state.get if state.exists else [b"" if c in TAIL else [] for c in names]))
    series = Series(list(held["series"]))
    totals = {c: np.array(held[c], np.int64 if c in COUNTS else np.float64) for c in (*COUNTS, *SUMS)}
    seen = Seen(held["block"], held["bits"], held["touched_ms"], state.getCurrentProcessingTimeMs(), held["owner"])
    before = tail = Rows.unpacked(held["stored"], held)
    last = before.newest(1)
    touched = np.zeros(len(series.names), bool)
    none = before.take(slice(0, 0))
    old, new = none, none  # what has yet to come out
    for chunk in chunks:
        if len(new):
            yield _out(series.array(), old, new)
            old = none
        owner = series.owners(chunk["series_id"] if "series_id" in chunk else pd.Series([key[0]] * len(chunk), dtype=object))
        n = len(series.names)
        touched, totals = _grown(touched, n), {c: _grown(x, n) for c, x in totals.items()}
        here = np.zeros(n, bool)
        here[owner] = True
        old = old.and_(before.take((here & ~touched)[before.owner]))
        touched |= here
        rows = Rows.of(owner, chunk)
        fresh = seen.first(rows.arrival, rows.known, owner)
        placed = fresh & _later(rows, last)
        new = rows.take(placed)
        for c, which in (("n_seen", placed), ("repeated_rows", ~fresh), ("late_rows", fresh & ~placed)):
            totals[c] += np.bincount(owner[which], minlength=n)
        for p, m in (("t", "temperature"), ("h", "humidity")):
            values = new.measures[MEASURES.index(m)]
            some = ~np.isnan(values)
            totals[f"{p}_sum"] += np.bincount(new.owner[some], values[some], minlength=n)
            totals[f"{p}_cnt"] += np.bincount(new.owner[some], minlength=n)
        if len(new):
            tail = tail.and_(new).newest(RECENT)
    stored, columns = tail.packed(len(series.names))
    state.update((series.names, *[totals[c].tolist() for c in (*COUNTS, *SUMS)], stored, *columns, seen.owners(), *seen.stored()))
    yield _out(series.array(), old, new, np.flatnonzero(touched), totals)
