"""Operator 11: every run against a plain scan of all lags; digests against a plain reading of the contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF as SF001
from wattlane.llm import periodic
from wattlane.llm.queries import QUERIES


def plain_runs(words):
    """(start, length, period) of every run, by all lags."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def some_texts(rng):
    texts = []
    for _ in range(rng.randint(1, 6)):
        n, kinds = rng.choice([0, 5, 12, 13, 40, 200, 700]), rng.choice([1, 2, 2, 3, 5, 50, 1000])
        words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.6:  # a tail with a period
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = words[:a] + (words[a:a + p] * n)[:n - a]
        texts.append(fibonacci(n) if rng.random() < 0.2 else words)
    return texts


def test_runs_equal_a_scan_of_all_lags():
    rng = random.Random(5)
    for _ in range(150):
        texts = some_texts(rng)
        runs, ends = periodic.find_runs(texts)
        want = [(s + int(e), n, q) for w, e in zip(texts, ends) for s, n, q in plain_runs(w)]
        assert sorted(zip(*(x.tolist() for x in runs))) == sorted(want)


@pytest.mark.parametrize("rounds", [1, 3])
def test_unsplit_segments_give_the_same_runs(monkeypatch, rounds):
    monkeypatch.setattr(periodic, "MAX_ROUNDS", rounds)
    test_runs_equal_a_scan_of_all_lags()


def test_splitting_leaves_little_of_prose_and_whole_runs():
    rng = random.Random(2)
    prose = [b"w%d" % rng.randrange(3000) for _ in range(2000)]
    words = prose[:1000] + [b"x", b"y", b"z"] * 20 + prose[1000:]
    code, ends = periodic.word_codes([words])
    at, seg, _ = periodic.split_rare(code, ends)
    assert set(range(1000, 1060)) <= set(at.tolist()) and len(at) < 400


def test_long_texts_stay_near_linear():
    """2**17 words of one kind, and a long period: an all-lags scan would take 2**33 steps."""
    runs, _ = periodic.find_runs([[b"la"] * (1 << 17), [b"%d" % (i % 5000) for i in range(100_000)]])
    assert list(zip(*(x.tolist() for x in runs))) == [(0, 1 << 17, 1), (1 << 17, 100_000, 5000)]


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def nulls_first(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_query_equals_plain_reading_on_planted_rows(planted):
    rows = [(r.doc_id, r.text) for r in planted.select("doc_id", "text").collect()] + [(None, "la " * 30), (None, None), (None, "la " * 30)]
    rows = [r for r in rows if len((r[1] or "").split()) < 2000]
    df = planted.sparkSession.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "a.b": F.lit(2)})
    got = periodic.run_digests(df, periodic.repeat_tail).collect()
    assert nulls_first(map(tuple, got)) == nulls_first(plain_digest(*r) for r in rows)


def test_registered_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_periodic"](spark, SF001).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) > 3
    for r in got:
        if len(docs[r.doc_id]) < 8000:
            assert tuple(r) == plain_digest(r.doc_id, docs[r.doc_id])


def test_collapse_and_empty_table(spark, no_documents):
    df = spark.createDataFrame([(1, "go " + "tick tock " * 9 + "end"), (2, "a b c"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in periodic.collapse_runs(df).collect()} == {1: "go tick tock end", 2: "a b c", 3: ""}
    assert [tuple(r) for r in periodic.periodic_runs(df).collect()] == [(1, 1, 18, 2)]
    assert periodic.run_digests(no_documents).collect() == []


def test_runs_do_not_depend_on_the_batch():
    rng = random.Random(8)
    texts = [t for _ in range(20) for t in some_texts(rng)]
    whole, ends = periodic.find_runs(texts)
    parts = []
    for t, e in zip(texts, ends):
        runs, _ = periodic.find_runs([t])
        parts += list(zip((runs.start + e).tolist(), runs.length.tolist(), runs.period.tolist()))
    assert sorted(parts) == sorted(zip(*(x.tolist() for x in whole)))
    assert np.all(np.diff(whole.start) >= 0)
