"""The pipeline against a brute-force version of its stages, on the smallest tables and on planted ones."""

import hashlib
import os
import tempfile
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from wattlane.llm import lines, mixing, quality

from .conftest import SF
from .test_mixing import plain_rates
from .test_ngram import brute as near_groups


def brute_lines(docs):
    """Windows of two lines and long lines against their first stand."""
    order = sorted(docs, key=lambda d: d["doc_id"])
    full = {d["doc_id"]: [(i, s.strip(" \t\r")) for i, s in enumerate((d["text"] or "").split("\n")) if s.strip(" \t\r")] for d in order}
    first = {}
    for d in order:
        f = full[d["doc_id"]]
        for k, (_, s) in enumerate(f):
            first.setdefault(s, (d["doc_id"], k))
            if k + 1 < len(f):
                first.setdefault((s, f[k + 1][1]), (d["doc_id"], k))
    out = []
    for d in order:
        f, gone = full[d["doc_id"]], set()
        for k, (i, s) in enumerate(f):
            if len(s.split()) >= lines.LONG_LINE and first[s] != (d["doc_id"], k):
                gone.add(i)
            if k + 1 < len(f) and first[s, f[k + 1][1]] != (d["doc_id"], k):
                gone |= {i, f[k + 1][0]}
        if not gone or len(gone) < len(f):
            text = d["text"] if not gone else "\n".join(s for i, s in enumerate(d["text"].split("\n")) if i not in gone)
            out.append({**d, "text": text, "n_chars": d["n_chars"] if not gone else len(text)})
    return out


def brute(spark, sf):
    """The stages one by one over plain rows; only the two fitted models come from the library, scored here by hand."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = [r.asDict() for r in table.collect()]
    fm = quality.fit_quality(table, labels)
    docs = [d for d in docs if fm.score([quality.vector(d["text"] or "")])[0] >= quality.THRESHOLD]
    docs = brute_lines(docs)
    group = near_groups([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if group[d["doc_id"]][0] == d["doc_id"]]
    frame = spark.createDataFrame(docs, table.schema)
    posterior = {r.doc_id: r for r in mixing.with_posteriors(frame, labels).select("doc_id", *mixing.P).collect()}
    n = np.array([len((d["text"] or "").split()) for d in docs], float)
    p = np.array([[posterior[d["doc_id"]][c] for c in mixing.P] for d in docs])
    goal = np.array([corpus_pipeline.WEIGHTS[d] for d in mixing.DOMAINS]) * n.sum()
    rate = plain_rates(n, p, goal, 1.0)
    draws = {r[0]: r[1] for r in frame.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'mixing'), 1073741824) / 1073741824D").collect()}
    kept = [d for d, r in zip(docs, rate, strict=True) if np.floor(r + 1e-9) + (draws[d["doc_id"]] < (r + 1e-9) % 1) > 0]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for d in kept:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        out[d["doc_id"]] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
    return out


def test_run_equals_brute_force(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    want = brute(spark, SF)
    assert got == want and len(got) > 50


def test_mixing_keeps_clean_and_drops_toxic_by_label(spark):
    """Labels decide, not the descent: of what reaches the stage, toxic documents go and clean ones stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = corpus_pipeline.keep_quality(spark, docs, sf)
    left = {r.doc_id for r in corpus_pipeline.mix_domains(spark, docs, sf).select("doc_id").collect()}
    rows = docs.join(mixing.domain_of(labels), "doc_id").select("doc_id", "mixing_label").collect()
    toxic, clean = ([r.doc_id for r in rows if r.mixing_label == k] for k in (2.0, 0.0))
    assert len(toxic) > 20 and not left & set(toxic)
    assert len(clean) > 200 and len(left & set(clean)) >= 0.99 * len(clean)


def test_stages_on_planted_rows(spark, planted, tmp_path):
    """Each stage keeps the columns, clean texts stay, copies go."""
    from pyspark.sql import functions as F

    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(20, 40)] + [(72, 0, 0), (71, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = planted.withColumn("n_chars", F.length("text").cast("long"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{sf}/{name}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
    ids = defaultdict(int)
    for r in docs.select("doc_id").collect():
        ids[r.doc_id] += 1
    assert max(ids.values()) == 1
    assert set(range(23, 40)) <= set(ids) and not {41, 42, 43, 44} & set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_empty_documents(spark, no_documents):
    sf = tempfile.mkdtemp(prefix="wattlane-pipeline-", dir=os.environ.get("TMPDIR", "/tmp"))
    no_documents.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
