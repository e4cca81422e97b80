"""Operator 13: pieces against the tokenizers library, and packings against what any packing must hold to."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SF as SF001
from wattlane.llm import packing
from wattlane.llm.queries import PIECE_RANKS, PIECE_TOKENIZER, QUERIES

SPEC, RANKS = public_tokenizers.path(PIECE_TOKENIZER), public_tokenizers.path(PIECE_RANKS)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(SPEC)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing._read(RANKS), packing._read(SPEC))


def test_ids_equal_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["", "<|endoftext|> hi <|endoftext|>", "<|endoftext", "don't I'LL’s", "  \n\n\t x ", "\x00\x1c\x85​", " " * 3000, "la " * 500, "東京😀é" * 50]
    texts += ["".join(rng.choice("aetn'sx12 \n,.é東😀") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts += [f"a{chr(p)}b1{chr(p)}2 {chr(p)}{chr(p)}! {chr(p)} x\n{chr(p)}  " for p in [*range(0, 0x3100), *range(0x3100, 0x20000, 23)] if not 0xD800 <= p < 0xE000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == want.ids, text


def test_library_takes_over_where_the_fast_way_gives_up(encoder, library):
    text = "x" + " " * 400_000 + "y"
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def check_packed(rows, texts, library, capacity=2048):
    """Pieces are those of the contract; sequences are gapless and not too long. Returns their number."""
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_planted_rows(spark, planted, library):
    texts = [(r.doc_id, r.text) for r in planted.select("doc_id", "text").collect()] + [(None, None), (None, "la"), (None, "la"), (9, "x " * 9000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"row": F.lit(1), "piece": F.lit(2), "a.b": F.lit(3)}).repartition(3)
    rows = packing.pack_documents(df, SPEC, RANKS).collect()
    n = check_packed(rows, texts, library)
    assert n == packing.least_sequences(np.array([r.length for r in rows]), 2048)


def test_registered_query_reaches_the_lower_bound(spark, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op13_packing"](spark, SF001).collect()
    assert check_packed(rows, texts, library) <= packing.least_sequences(np.array([r.length for r in rows]), 2048) + 1


def test_sequences_carry_their_ids(spark, library):
    texts = [(1, "one two"), (2, "x " * 5000), (3, None)]
    out = packing.packed_sequences(spark.createDataFrame(texts, "doc_id long, text string"), SPEC, RANKS).collect()
    assert sum(r.n_tokens for r in out) == sum(len(r.ids) for r in out) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert {d for r in out for d in r.doc_ids} == {1, 2, 3} and max(len(r.ids) for r in out) <= 2048


def test_groups_lose_little_against_one_group(spark):
    """Pooling the spare sequences of many small groups brings back what the split costs."""
    rng = random.Random(3)
    size = [rng.randint(300, 900) for _ in range(6000)]
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(size)]
    pieces = spark.createDataFrame(rows, packing.PIECES)
    out = packing.pack_pieces(pieces, group=200).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in out) == sum(size) and max(r.n for r in out) <= 2048
    one = packing.pack(np.array(size)).max() + 1
    assert len(out) <= 1.02 * one


def test_pieces_that_cannot_join_end_the_rounds(spark):
    pieces = spark.createDataFrame([(i, i, 0, 0, 1500, 0) for i in range(500)], packing.PIECES)
    assert packing.pack_pieces(pieces, group=50).select("sequence_id").distinct().count() == 500


@pytest.mark.parametrize("low, high", [(1, 60), (1, 2048), (600, 760), (400, 1100), (1000, 2048)])
def test_search_never_loses_to_best_fit(low, high):
    rng = random.Random(low)
    size = np.array([rng.randint(low, high) for _ in range(1500)])
    start = packing.best_fit(size, 2048)
    search = packing.Search(size, start, 2048)
    squares = [float((np.bincount(search.of, weights=size) ** 2).sum())]
    source = int(search.room.argmax())
    while search.room[source] < 2048 and search.step(source):
        squares.append(float((np.bincount(search.of, weights=size) ** 2).sum()))
    assert all(a < b for a, b in zip(squares, squares[1:]))  # every step increases the squared fill
    of = packing.pack(size)
    assert np.bincount(of, weights=size).max() <= 2048 and of.max() <= start.max()
    assert of.max() + 1 >= packing.least_sequences(size, 2048)
    if (low, high) == (600, 760):
        assert of.max() < 0.97 * start.max()  # three of a kind: best fit alone is far off


def test_empty_table(no_documents):
    assert packing.pack_documents(no_documents, SPEC, RANKS).collect() == []
