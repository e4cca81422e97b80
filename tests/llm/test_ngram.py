"""Operator 10 against brute force, whole and cut into small blocks."""

import re
from collections import defaultdict

import numpy as np
import pytest

from wattlane.llm import common, ngram

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = defaultdict(set)
    for d, t in rows:
        w = WORD.findall(t or "")
        k = min(5, len(w))
        if d is not None and w:
            sets[d].add(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)))
    one = {d: next(iter(s)) for d, s in sets.items()}
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(int)
    for a in one:
        for b in one:
            if a != b and 5 * len(one[a] & one[b]) >= 4 * len(one[a] | one[b]):
                links[a] += 1
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {d: (top(d), links[d]) for d in parent}


@pytest.mark.parametrize("block", [1000, 4])
def test_equals_brute_force(spark, planted, monkeypatch, block):
    monkeypatch.setattr(ngram, "BLOCK", block)
    rows = [tuple(r) for r in planted.select("doc_id", "text").collect()]
    got = ngram.near_duplicates(planted).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_rows_without_id_shared_ids_and_empty_table(spark, planted, no_documents):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (3, text), (9, text), (9, "quite another text of some words here"), (12, "quite another text of some words here"), (13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.kept) for r in ngram.near_duplicates(docs).collect()}
    assert got == {(None, None, None), (3, 3, True), (9, 3, False), (12, 3, False), (13, 13, True)}
    kept = ngram.keep_one_of_each(docs)
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, text), (3, text), (13, None)}
    assert ngram.near_duplicates(no_documents).count() == 0 and ngram.keep_one_of_each(no_documents).columns == no_documents.columns


def test_a_text_among_others_of_its_id_keeps_its_links(spark):
    text = " ".join(f"w{i}" for i in range(100))
    others = [(9, " ".join(f"x{k}y{i}" for i in range(30))) for k in range(10)]
    docs = spark.createDataFrame([(3, text), *others[:5], (9, text + " tail"), *others[5:]], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in ngram.near_duplicates(docs).collect()}
    assert got == {(3, 3, 1), (9, 3, 1)}


def test_pruning_keeps_what_reaches_the_threshold():
    for n, least in ngram.PRUNE:
        rng = np.random.default_rng(n)
        assert (rng.binomial(n, 0.8, 200_000) < least).mean() < 1e-4  # a pair at the threshold is dropped almost never
        assert (rng.binomial(n, 0.3, 2000) >= least).mean() < (0.6 if n == ngram.STEP else 0.2)


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {300: 300, 301: 300, 302: 300}
    assert got == want
