"""Operator 6 against brute force over all 400-byte strings; the split of hot anchors gives the same."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF001

from wattlane.llm import queries, suffix

from .conftest import prose


def brute(rows, size=400):
    docs = {(d, (t or "").encode()) for d, t in rows}
    places = defaultdict(set)
    for d, b in docs:
        for p in range(len(b) - size + 1):
            places[b[p:p + size]].add(hash((d, b, p)))
    out = set()
    for d, b in docs:
        change = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if len(places[b[p:p + size]]) > 1:
                change[p] += 1
                change[p + size] -= 1
        gone = np.cumsum(change[:-1]) > 0
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.add((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def results(df):
    return {tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert results(queries.op6_suffix(spark, SF001)) == brute(rows)


@pytest.mark.parametrize("most", [20_000, 2])
def test_edge_rows(spark, planted, no_documents, monkeypatch, most):
    monkeypatch.setattr(suffix, "ANCHOR_STRINGS", most)  # 2: nearly all anchors take the split path
    rows = [tuple(r) for r in planted.select("doc_id", "text").collect()]
    got = suffix.removal_digests(planted)
    assert got.count() == len(rows)
    assert results(got) == brute(rows)
    if most == 2:
        assert suffix.repeated_spans(no_documents).count() == 0


def test_columns_equal_plain_comparison():
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 100, 40).astype(np.uint8))
    strings, left, windows, group = [], [], [], []
    for _ in range(60):
        s = bytearray(base)
        for at in rng.integers(0, 40, 2):
            s[at] = 97 + int(rng.integers(0, 3))
        lo, hi = int(rng.integers(0, 10)), int(rng.integers(30, 40))
        strings.append(bytes(s[lo:hi]))
        left.append(18 - lo)
        windows.append(hi - lo - 12 + 1)
        group.append(int(rng.integers(0, 3)))
    found = suffix.repeated_starts(np.array(group), strings, np.array(left), np.array(windows), 12)
    held = defaultdict(set)
    for i, s in enumerate(strings):
        for p in range(windows[i]):
            held[group[i], p - left[i], s[p:p + 12]].add(i)
    for i, s in enumerate(strings):
        assert found[i].tolist() == [p for p in range(windows[i]) if len(held[group[i], p - left[i], s[p:p + 12]]) > 1]


def test_contents_that_agree_in_half_of_their_hash_stay_apart(spark):
    rows = [(d, "a" * 160 + f"{8851:064d}" + "b" * 160 + f"{v:016d}") for d, v in ((1, 17263), (2, 84081))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(suffix.removal_digests(docs)) == brute(rows)


def test_rows_without_or_with_shared_ids(spark):
    """Many different texts under one id, or under none, are as many documents; repeated rows are one."""
    rng = random.Random(7)
    passages = [prose(rng, 70) for _ in range(6)]
    rows = [(None if i % 5 else 3, prose(rng, rng.randint(3, 40)) + "\n" + rng.choice(passages) + f" {i}") for i in range(2500)]
    rows += rows[:3] + [(8, passages[0][:450] + " tail"), (8, passages[0][:450] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert results(suffix.removal_digests(docs)) == brute(rows)
