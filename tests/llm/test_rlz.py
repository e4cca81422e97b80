"""Operator 5 against brute force over all windows."""

import hashlib
import random
import re

from conftest import SF01

from wattlane.llm import queries, rlz

from .conftest import prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, size=20):
    docs = sorted({(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows})
    first, out = {}, {}
    words = [(d, t, WORD.findall(t)) for d, t in docs]
    for d, _, w in words:
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p:p + size]), (d, p))
    for d, t, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p:p + size])] != (d, p):
                gone[p:p + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] = 1
    return out


def by_text(rows):
    """Brute force where texts that share an id stand in the order of their keys, as the docstring says."""
    from conftest import build_session

    spark = build_session()
    keys = {t: k for t, k in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").distinct().collect()}
    docs = sorted({(-(1 << 63) if d is None else d, keys[t or ""], (t or "").encode()) for d, t in rows})
    first = {}
    words = [(n, WORD.findall(t)) for n, (_, _, t) in enumerate(docs)]
    for n, w in words:
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p:p + 20]), (n, p))
    out = set()
    for n, w in words:
        gone = {i for p in range(len(w) - 19) if first[tuple(w[p:p + 20])] != (n, p) for i in range(p, p + 20)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((docs[n][0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def results(df):
    return {(-(1 << 63) if r[0] is None else r[0], *r[1:]): 1 for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    assert results(queries.op5_substring(spark, SF01)) == brute(rows)


def test_edge_rows(spark, planted, no_documents):
    rows = [tuple(r) for r in planted.select("doc_id", "text").collect()]
    got = rlz.removal_digests(planted)
    assert got.count() == len(rows)
    assert results(got) == brute(rows)
    assert rlz.removal_digests(no_documents).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    twins = spark.createDataFrame([(None, text), (1, text), (2, text + " x"), (2, "other")], "doc_id long, text string")
    found = sorted(tuple(r) for r in rlz.duplicate_factors(twins).collect())
    assert found == [(1, 0, 30, None, 0), (2, 0, 30, None, 0)]
    kept = {(r.doc_id, r.text) for r in rlz.remove_duplicates(twins).collect()}
    assert kept == {(None, text), (1, ""), (2, "x"), (2, "other")}


def test_contents_that_agree_in_half_of_their_hash_stay_apart(spark):
    shared = "p1 p2 p3 p4 p5 p6 " + " ".join(f"a12790x{k}" for k in range(8)) + " q1 q2 q3 q4 q5 "
    rows = [(1, shared + "v49368"), (2, shared + "v52409")]  # one anchor; the content hashes have their upper 32 bits in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rlz.occurrences(docs, rlz.word_units, rlz.WORDS, rlz.GRAM).select("anchor", "content").collect()
    assert len({r.anchor for r in found}) == 1 and len({r.content for r in found}) == 2 and len({r.content >> 32 for r in found}) == 1
    assert results(rlz.removal_digests(docs)) == brute(rows)


def test_rows_without_or_with_shared_ids(spark):
    """Many different texts under one id, or under none, are as many documents; repeated rows are one."""
    rng = random.Random(7)
    passages = [prose(rng, 70) for _ in range(6)]
    rows = [(None if i % 5 else 3, prose(rng, rng.randint(3, 40)) + "\n" + rng.choice(passages) + f" {i}") for i in range(2500)]
    rows += rows[:3] + [(8, passages[0][:450] + " tail"), (8, passages[0][:450] + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert results(rlz.removal_digests(docs)).keys() == by_text(rows)
