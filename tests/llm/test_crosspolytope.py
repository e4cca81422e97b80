"""Operator 8 against brute force; recall of the hashing at the threshold; odd vectors."""

import math

import numpy as np
import pytest

from wattlane.llm import crosspolytope as cp


def vectors(seed=1, groups=12, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rng.normal(size=dim)
        for _ in range(6):
            rows.append((base + rng.normal(size=dim) * rng.choice((0.02, 0.1, 0.15, 0.3))).tolist())
        rows.append(rows[-1])
        rows.append((np.array(rows[-1]) * 3).tolist())
    return [(1000 - i, v, i % 2) for i, v in enumerate(rows)]


def brute(rows):
    parent, links, ok = {}, {}, []
    for i, v, label in rows:
        if i is None:
            continue
        parent[i], links[i] = i, 0
        if v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v):
            ok.append((i, np.array(v), label))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, a in ok:
        for j, w, b in ok:
            if i != j and a == b and len(v) == len(w) and (v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[i] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (links[i], top(i)) for i in parent}


ODD = [(1, None, 0), (2, [], 0), (3, [0.0] * 24, 0), (4, [float("nan")] + [1.0] * 23, 0), (5, [None] + [1.0] * 23, 0), (6, [1.0] * 24, None),
       (7, [1.0] * 24, None), (8, [1.0] * 24, 1), (9, [1.0] * 23, 1), (10, [1.0] * 24, 0), (11, [float("inf")] + [1.0] * 23, 0), (12, [2.0] * 24, 1),
       (13, [1.0], 1), (14, [2.0], 1)]


@pytest.mark.parametrize("block", [2000, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cp, "BLOCK", block)
    rows = vectors() + ODD
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, copies int, h1 int")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got = cp.near_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_rows_without_id_repeated_rows_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    got = sorted((tuple(r) for r in cp.near_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, None, None, None)]
    assert cp.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    d, n = 64, 3000
    a = rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(n, d))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b
    for keys in (cp.keys_for(5_000, d), cp.keys_for(1_000_000, d)):
        x, y = cp.buckets(a, keys), cp.buckets(b, keys)
        met = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)])
        assert met.mean() >= 0.9985, (keys, met.mean())


def test_hadamard_is_orthogonal():
    h = cp.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def pairs_at_the_threshold(n, d):
    a, b = np.random.default_rng(7).normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, 0.981 * a + math.sqrt(1 - 0.981**2) * b


@pytest.mark.parametrize("dim,keys", [(2, 17), (3, 13), (64, 5), (64, 12)])
def test_tables_grow_with_keys(dim, keys):
    tables = cp.tables_for(keys, dim)
    x, y = (cp.buckets(v, keys, tables) for v in pairs_at_the_threshold(800, dim))
    met = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y, strict=True)])
    assert met.mean() >= 0.9985, (keys, tables, met.mean())


def test_a_stray_length_changes_no_hashes(spark, monkeypatch):
    used = []
    filed = cp.filed
    monkeypatch.setattr(cp, "filed", lambda vectors, reps, sizes: used.append(sizes) or filed(vectors, reps, sizes))
    a, b = pairs_at_the_threshold(150, 64)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate((a, b)))] + [(900, [1.0, 2.0], 0), (901, [2.0, 1.0], 0), (902, [1.0], 0)]
    got = cp.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert used == [{2: (cp.keys_for(2, 2), cp.tables_for(cp.keys_for(2, 2), 2)), 64: (cp.keys_for(300, 64), cp.TABLES)}]
    assert {r.vec_id: r.n_links for r in got} == {r[0]: int(r[0] < 900) for r in rows}
