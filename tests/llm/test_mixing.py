"""Operator 1: targets met, rates against a plain projected gradient, edge cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.llm import mixing, queries

from .conftest import SF


def plain_rates(n, p, goal, max_rate=None, rounds=20_000):
    """Least squares over single rows by plain projected gradient from rate 1, without any grid; rows of one text length and posterior are one."""
    some = n > 0
    sums = p[some] * n[some, None]
    step = 1 / np.linalg.eigvalsh(sums.T @ p[some])[-1]
    r = np.ones(some.sum())
    for _ in range(rounds):
        after = np.clip(r - step * (p[some] @ (r @ sums - goal)), 0, max_rate)
        moved = np.abs((after - r) @ sums).max()
        r = after
        if moved <= 1e-11 * max(1.0, np.abs(goal).max()):
            break
    out = np.ones(len(n))
    out[some] = r
    return out


@pytest.fixture(scope="module")
def members(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        p = rng.dirichlet((0.2, 0.2, 0.2))
        rows.append((i, int(rng.integers(0, 500)) if i % 40 else 0, *map(float, p)))
    return spark.createDataFrame(rows, ["doc_id", mixing.N, *mixing.P])


@pytest.mark.parametrize("weights,max_rate", [((0.9, 0.05, 0.05), None), ((0.2, 0.3, 0.5), None), ((1.0, 0.0, 0.0), 1.0), ((0.4, 0.2, 0.4), None), ((0.0, 0.0, 0.0), None)])
def test_totals_are_as_near_as_plain_descent(members, weights, max_rate):
    rows = members.orderBy("doc_id").collect()
    n, p = np.array([r[1] for r in rows], float), np.array([r[2:] for r in rows])
    goal = np.array(weights) * n.sum()
    rate, totals = mixing.fit_rates(members, dict(zip(mixing.DOMAINS, goal, strict=True)), max_rate)
    got = np.array([r[0] for r in members.orderBy("doc_id").select(rate).collect()])
    assert (got >= 0).all() and np.allclose((got * n) @ p, totals, rtol=1e-9, atol=1e-6 * n.sum())
    assert np.linalg.norm(totals - goal) <= np.linalg.norm((plain_rates(n, p, goal, max_rate) * n) @ p - goal) + 1e-3 * n.sum()
    if max_rate is None:
        assert np.allclose(totals, goal, atol=2e-4 * n.sum())
    else:
        assert got.max() <= max_rate
    assert (got[n == 0] == 1).all()


def test_query_meets_its_targets(spark):
    out = queries.op1_mixing(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "p_clean", "p_low", "p_toxic", "rate", "copies"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    n = sum(r.n_tokens for r in rows)
    for d, w in queries.WEIGHTS.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / n - w) < 0.01
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 and abs(r.copies - r.rate) < 1 for r in rows)


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit = labels.where("crc32(cast(doc_id as string)) % 5 <> 0")
    test = mixing.domain_of(labels.where("crc32(cast(doc_id as string)) % 5 = 0"))
    rows = mixing.with_posteriors(docs, fit).join(test, "doc_id").select("mixing_label", *mixing.P).collect()
    right = np.mean([np.argmax(r[1:]) == r[0] for r in rows])
    assert right >= 0.93, right


def test_edge_rows(spark, planted, no_documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 40)] + [(20, None, None), (None, 1, 0), (21, 1, 1)], "doc_id long, quality int, toxic int")
    out = mixing.mix(planted, labels, {"clean": 0.7, "low": 0.3}).collect()
    assert len(out) == planted.count()
    blank = [r for r in out if r.doc_id in (75, 76, 77)]
    assert all(r[mixing.N] == 0 and r[mixing.RATE] == 1 and r[mixing.COPIES] == 1 for r in blank)
    assert len({(r[mixing.RATE], r[mixing.COPIES]) for r in out if r.doc_id == 5}) == 1
    kept = mixing.mixed(planted, labels, {"clean": 0.7, "low": 0.3}, max_rate=1.0)
    assert kept.columns == planted.columns and kept.count() <= planted.count()
    more = mixing.mixed(planted, labels, {"clean": 1.4, "low": 0.6})
    assert more.count() > planted.count()
    assert mixing.mixed(no_documents, labels, {"clean": 1.0}).count() == 0
    none = mixing.mix(planted, labels.where("doc_id < 0"), {"clean": 1.0})
    assert none.select(F.min(mixing.P[0]), F.max(mixing.RATE)).first()[:] == (1.0, 1.0)


def test_unreachable_targets_end_nearest_to_them(spark):
    rng = np.random.default_rng(8)
    kind = rng.choice(3, 1500, p=(0.8, 0.15, 0.05))
    p = np.stack([rng.dirichlet(np.where(np.arange(3) == k, 3.0, 0.15)) for k in kind])
    n = rng.integers(50, 500, len(p)).astype(float)
    rows = [(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(n, p, strict=True))]
    members = spark.createDataFrame(rows, ["doc_id", mixing.N, *mixing.P])
    for goal, bound in (((n.sum(), 0.0, 0.0), 1.0), ((0.0, 0.0, 2 * n.sum()), 1.0), ((0.0, 9 * n.sum(), 0.0), None)):
        rate, totals = mixing.fit_rates(members, dict(zip(mixing.DOMAINS, goal, strict=True)), bound)
        got = np.array([r[0] for r in members.orderBy("doc_id").select(rate).collect()])
        best = plain_rates(n, p, np.array(goal), bound)
        assert np.linalg.norm(totals - goal) <= np.linalg.norm((best * n) @ p - goal) + 1e-3 * np.linalg.norm(goal)
        if bound == 1.0 and goal[0]:
            assert (got[p[:, 2] > 0.99] == 0).all() and (got[p[:, 0] > 0.99] == 1).all()


def test_a_domain_with_hardly_any_tokens_steers_nothing(spark):
    """Clean and toxic texts, and one short text of the third domain: toxic texts go, clean ones stay, whatever the third does."""
    rows = [(i, 300, 0.9985, 0.0005, 0.001) for i in range(500)] + [(500 + i, 300, 0.0004, 0.0001, 0.9995) for i in range(60)]
    rows += [(600, 20, 0.2, 0.7, 0.1)]
    members = spark.createDataFrame(rows, ["doc_id", mixing.N, *mixing.P])
    total = float(sum(r[1] for r in rows))
    rate, _ = mixing.fit_rates(members, {"clean": total, "low": 0.0, "toxic": 0.0}, 1.0)
    got = [r[0] for r in members.orderBy("doc_id").select(rate).collect()]
    assert got[:500] == [1.0] * 500 and got[500:560] == [0.0] * 60


def test_words_are_those_of_the_contract(spark):
    texts = ["a  b\tc\x0bd\x0ce\r\n", "", " \t\n", None, "\u00a0x\u2003y z", "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r[0] for r in mixing.with_slots(df, F.col("doc_id")).orderBy("doc_id").select(mixing.N).collect()]
    assert got == [len(re.findall("[^\x20\x09-\x0D]+", t or "")) for t in texts]
