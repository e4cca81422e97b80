"""Operator 4: the identity of the pairwise term, held-out accuracy, edge cases."""

import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from wattlane.llm import quality, queries


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)) / 9,
                                      np.zeros(len(quality.DENSE)), np.ones(len(quality.DENSE)))
    docs = [quality.vector(t) for t in ("", "one two two three!", "A B c d e " * 5)]
    got = fm.score(docs)
    for (slots, weights, dense), score in zip(docs, got, strict=True):
        x = np.zeros(quality.SIZE)
        x[slots] = weights
        x[quality.WORD_SLOTS:] = fm.inputs(dense.astype(float))
        nz = np.flatnonzero(x)
        z = fm.bias + fm.linear @ x + sum((fm.factors[i] @ fm.factors[j]) * x[i] * x[j] for i in nz for j in nz if i < j)
        assert abs(quality.sigmoid(np.array(z)) - score) < 1e-9


def test_held_out_accuracy(spark):
    out = queries.op4_quality(spark, SF01)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert len(bad) > 3 and np.mean(good) >= 0.95 and np.mean(bad) <= 0.1


def test_edge_rows(spark, planted, no_documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20, 40)] + [(20, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    fm = quality.fit_quality(planted, labels)
    scored = quality.score_quality(planted, fm)  # the caller's own "score" gives way
    assert scored.columns.count("score") == 1 and scored.count() == planted.count()
    rows = scored.where("doc_id in (75, 76, 77)").select("score").distinct().collect()
    assert len(rows) == 1 and 0 <= rows[0].score <= 1  # empty, null and blank texts
    assert scored.where("doc_id = 5").select("score").distinct().count() == 1
    kept = quality.keep_quality(planted, labels)
    assert kept.columns == planted.columns
    assert quality.keep_quality(no_documents, labels).count() == 0
    none = labels.where("doc_id < 0")
    assert quality.score_quality(planted, quality.fit_quality(planted, none)).agg(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)
    ones = labels.where("quality = 1")
    share = quality.score_quality(planted, quality.fit_quality(planted, ones)).select("score").distinct().collect()
    assert len(share) == 1 and share[0].score > 0.5
