"""Best-fit packing of token sequences by swap-based local search (operator 13).

Every document becomes its token ids and an end id; one longer than a sequence
is cut into full pieces, the first of which takes the rest.  Pieces are packed
whole into as few sequences as can be found.

Method.
1. One pass over the texts gives the pieces (ids are hashed or carried there),
   written as a table.
2. Pieces are dealt by a hash of their row number into groups of about
   ``GROUP`` pieces.  A group starts from best fit (longest piece first, into
   the fullest sequence that takes it) and is improved by local search: the
   emptiest sequence gives its pieces away one by one: a piece moves into the
   fullest other sequence with room, or changes places with a shorter piece, or
   with two pieces of one sequence, or two of its pieces change places with one,
   whichever fills the other sequence most.  Each step takes from the emptiest
   sequence and gives to a fuller one, so the sum of squared fills grows and the
   search ends; an emptied sequence is gone.  It stops at the lower bound.
3. The squares have pushed each group's free room into its last few sequences.
   Those under ``SPARE`` of full go back into a pool, which is dealt into fewer
   groups, round by round, until one group holds it or a round saves nothing.

Scale: no group grows with the data (their number does), a pool shrinks from
round to round, and what a round decided is a written table.  The only numbers
that reach the driver are counts.

Edge cases: a null text is the empty text, a document of one end id; the string
of the special token in a text is its id, as the library has it; repeated rows
and rows without doc_id are documents of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattlane.llm.arrays import rows_of, text_parts
from wattlane.llm.common import cut

CAPACITY, END_ID = 2048, 0
GROUP = 1 << 14
#: Sequences filled less than this go into the next round's pool.
SPARE = 0.98
#: A round that saves less than this share of its pool's sequences is the last.
LEAST_SAVED, MAX_ROUNDS = 1e-3, 12
GROUP_BITS, BIN_BITS = 34, 24


# ---- token ids ------------------------------------------------------------------------

class Encoder:
    """Ids as the tokenizers library gives them for a byte-level file, by way of tiktoken, which knows the same vocabulary as
    ranks and is several times as fast. The tests hold the two together on every code point; the library itself takes over where
    tiktoken gives up (very long white space)."""

    def __init__(self, ranks: str, spec: str):
        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.spec = spec
        self.special = {t["content"]: t["id"] for t in json.loads(spec).get("added_tokens", [])}

    @functools.cached_property
    def library(self) -> Tokenizer:
        t = Tokenizer.from_str(self.spec)
        t.no_truncation()
        t.no_padding()
        return t

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a panic is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self.library.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def encoder_of(ranks: str, spec: str) -> Encoder:
    """One per Python worker."""
    return Encoder(ranks, spec)


def _read(path: str) -> str:
    """A tokenizer file; bounded by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def piece_starts(n: int, capacity: int) -> range:
    """Where the pieces of n ids begin: all but the first are full."""
    first = (n - 1) % capacity + 1
    return range(first - capacity, n, capacity)


PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID, carry: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) and with ``carry`` the ids; ``row`` numbers the rows of ``docs``."""
    files = docs.sparkSession.sparkContext.broadcast((_read(ranks_path), _read(tokenizer_path)))  # bounded by the vocabulary
    schema = PIECES + (", ids array<int>" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(*files.value).encode
        for rows, _, _ in text_parts(batches, column=2):
            out: dict[str, list] = {c.split(" ")[0]: [] for c in schema.split(", ")}
            for row, doc_id, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for k, at in enumerate(piece_starts(len(ids), capacity)):
                    own = ids[max(at, 0):at + capacity]
                    for c, v in zip(out.values(), (row, doc_id, k, max(at, 0), len(own), zlib.crc32(own), own.astype(np.int32)), strict=False):
                        c.append(v)
            yield rows_of(out, schema)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# ---- packing of one group --------------------------------------------------------------

def best_fit(size: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece: longest first, each into the fullest sequence that takes it."""
    out = np.empty(len(size), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # sequences by free room
    some = n = 0  # bit r of some: a sequence with r free
    for i in np.argsort(-size, kind="stable").tolist():
        need = int(size[i])
        fits = some >> need
        if fits:
            r = need + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r, n = n, capacity, n + 1
        out[i] = b
        room[r - need].append(b)
        some |= 1 << (r - need)
    return out


def least_sequences(size: np.ndarray, capacity: int) -> int:
    """No packing has fewer: by the total, and by the pieces over half a sequence with what cannot join them."""
    return max(-(-int(size.sum()) // capacity), int((2 * size > capacity).sum()))


class Search:
    """Local search over the sequences of a group: ``of`` is each piece's sequence, ``room`` what each has free."""

    def __init__(self, size: np.ndarray, of: np.ndarray, capacity: int):
        self.size, self.of, self.capacity = size, of.copy(), capacity
        self.room = capacity - np.bincount(of, weights=size).astype(np.int64)
        self.live = np.ones(len(self.room), bool)

    def put(self, piece: int, to: int) -> None:
        self.room[self.of[piece]] += self.size[piece]
        self.room[to] -= self.size[piece]
        self.of[piece] = to

    def move(self, source: int, piece: int) -> bool:
        """The piece goes into the fullest other sequence with room for it."""
        others = np.where(self.live & (self.room >= self.size[piece]), self.room, self.capacity + 1)
        others[source] = self.capacity + 1
        to = int(others.argmin())
        if others[to] > self.capacity:
            return False
        self.put(piece, to)
        return True

    def exchange(self, source: int, mine: tuple[int, ...]) -> bool:
        """Pieces of the source change places with one shorter piece elsewhere, the one that leaves the least room there."""
        need = int(self.size[list(mine)].sum())
        left = self.size + self.room[self.of] - need  # room left in the other sequence
        left[(left < 0) | (self.size >= need) | (self.of == source)] = self.capacity + 1
        other = int(left.argmin())
        if left[other] > self.capacity:
            return False
        to = int(self.of[other])
        self.put(other, source)
        for m in mine:
            self.put(m, to)
        return True

    def exchange_for_two(self, source: int, piece: int) -> bool:
        """A piece of the source changes places with two of one other sequence that are shorter together."""
        need = int(self.size[piece])
        near = np.flatnonzero((self.size < need) & (self.room[self.of] > 0) & (self.of != source))
        near = near[np.lexsort((self.size[near], self.of[near]))]
        for apart in range(1, len(near)):
            a, b = near[:-apart], near[apart:]
            same = self.of[a] == self.of[b]
            if not same.any():
                return False
            both = self.size[a] + self.size[b]
            left = both + self.room[self.of[a]] - need
            fits = np.flatnonzero(same & (both < need) & (left >= 0))
            if len(fits):
                k = fits[left[fits].argmin()]
                to = int(self.of[a[k]])
                self.put(int(a[k]), source)
                self.put(int(b[k]), source)
                self.put(piece, to)
                return True
        return False

    def step(self, source: int) -> bool:
        """One improving step that takes tokens from the source."""
        own = np.flatnonzero(self.of == source)
        own = own[np.argsort(-self.size[own], kind="stable")].tolist()
        if any(self.move(source, p) for p in own) or any(self.exchange(source, (p,)) for p in own) or any(self.exchange_for_two(source, p) for p in own):
            return True
        pairs = {(int(self.size[p]), int(self.size[q])): (p, q) for k, p in enumerate(own) for q in own[k + 1:]}
        return any(self.exchange(source, pair) for pair in pairs.values())

    def run(self, least: int) -> np.ndarray:
        """Empty the emptiest sequences until the lower bound is reached or none can be emptied."""
        stuck = np.zeros(len(self.live), bool)
        while self.live.sum() > least:
            open_ = np.flatnonzero(self.live & ~stuck)
            if not len(open_):
                break
            source = int(open_[self.room[open_].argmax()])
            while self.room[source] < self.capacity and self.step(source):
                pass
            if self.room[source] == self.capacity:
                self.live[source] = False
                stuck[:] = False
            elif self.room[self.live].sum() < self.capacity:
                break
            else:
                stuck[source] = True
                if stuck.sum() >= TRIES:
                    break
        return np.unique(self.of, return_inverse=True)[1]


#: Sequences of a group that may resist one after the other before its search ends.
TRIES = 32


def pack(size: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence (0, 1, ...) of each piece."""
    return Search(size, best_fit(size, capacity), capacity).run(least_sequences(size, capacity))


# ---- packing of all groups --------------------------------------------------------------

def _dealt(pool: DataFrame, groups: int, round_: int) -> DataFrame:
    key = F.pmod(F.xxhash64("row", "piece", F.lit(round_)), F.lit(groups)).alias("dealt")
    parts = min(groups, int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pool.select(key, *PIECE_COLUMNS).repartition(parts, "dealt").sortWithinPartitions("dealt", "row", "piece")


PIECE_COLUMNS = [c.split(" ")[0] for c in PIECES.split(", ")]
PACKED = PIECES + ", sequence_id long, offset long, spare int"


def _pack_groups(dealt: DataFrame, round_: int, capacity: int) -> DataFrame:
    """Each group packed by itself, with the sequences that may go into the next pool marked."""
    length = PIECE_COLUMNS.index("length")

    def solve(group: int, rows: list[tuple]) -> pa.RecordBatch:
        size = np.array([r[length] for r in rows], np.int64)
        of = pack(size, capacity)
        order = np.argsort(of, kind="stable")
        fill = np.bincount(of, weights=size)
        ends = np.cumsum(size[order])
        first = np.concatenate(([True], of[order][1:] != of[order][:-1]))
        offset = ends - size[order]
        offset -= offset[first][np.cumsum(first) - 1]
        columns = dict(zip(PIECE_COLUMNS, zip(*(rows[i] for i in order.tolist()), strict=True), strict=True))
        sequence = (np.int64(round_) << (GROUP_BITS + BIN_BITS)) | (np.int64(group) << BIN_BITS) | of[order]
        return rows_of({**columns, "sequence_id": sequence, "offset": offset, "spare": (fill < SPARE * capacity)[of[order]].astype(np.int32)}, PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for group, rows in groupby(stream, itemgetter(0)):
            yield solve(group, [r[1:] for r in rows])

    return dealt.mapInArrow(run, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    done, pool, before = [], pieces.select(*PIECE_COLUMNS), None
    for round_ in range(MAX_ROUNDS):
        groups = max(1, math.ceil(pool.count() / group))
        packed = cut(_pack_groups(_dealt(pool, groups, round_), round_, capacity), "packed")
        sequences, spare = packed.where("offset = 0").agg(F.count("*"), F.coalesce(F.sum("spare"), F.lit(0))).first()
        last = groups == 1 or spare < 2 or (before is not None and before - sequences < LEAST_SAVED * before)
        if last or round_ == MAX_ROUNDS - 1:
            done.append(packed)
            break
        done.append(packed.where("spare = 0"))
        pool, before = packed.where("spare = 1").select(*PIECE_COLUMNS), spare
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.drop("spare")


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = cut(encode_pieces(docs, tokenizer_path, ranks_path, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity).drop("row")


def packed_sequences(docs: DataFrame, tokenizer_path: str, ranks_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): what a training job reads; a row holds at most ``capacity`` ids."""
    pieces = cut(encode_pieces(docs, tokenizer_path, ranks_path, capacity, end_id, carry=True), "pieces")
    packed = pack_pieces(pieces, capacity).select("row", "piece", "sequence_id", "offset")
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (packed.join(pieces, ["row", "piece"]).groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("held"))
            .selectExpr("sequence_id", "n_tokens", "flatten(held.ids) ids", "held.doc_id doc_ids"))
