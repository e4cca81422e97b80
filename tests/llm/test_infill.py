"""Operator 12: outputs against a plain reading of the contract, and the exact round trip."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SF as SF001
from wattlane.llm import infill
from wattlane.llm.queries import QUERIES


def plain(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(4)
    texts = ["", None, "x", "é", "<P>", "a<S>b", "a<M", "<", "S>", "<<S", "P>rest<", "\n\n", "東京abc😀Z", "a" * 50_000, "<P" * 40, "nul\x00l"]
    return texts + ["".join(rng.choice("aZ é<SPM>東😀\n") for _ in range(rng.randint(0, 30))) for _ in range(600)]


def digest(row):
    text = row[5]
    return (*row[:5], hashlib.sha256(text.encode()).hexdigest())


def nulls_first(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_outputs_and_round_trip(spark):
    rows = list(enumerate(odd_texts())) + [(None, "no id " * 9), (None, None), (3, "é"), (3, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form": F.lit("x"), "a.b": F.lit(1)}).repartition(3)
    want = [plain(*r) for r in rows]
    out = infill.fill_in_middle(df)
    assert nulls_first(map(tuple, out.collect())) == nulls_first(want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = infill.restore_texts(out)
    assert nulls_first(map(tuple, back.collect())) == nulls_first((i, t or "") for i, t in rows)
    got = infill.infill_digests(df).collect()
    whole = [(*digest(w), hashlib.sha256((t or "").encode()).hexdigest()) for w, (_, t) in zip(want, rows)]
    assert nulls_first(map(tuple, got)) == nulls_first(whole)


def test_other_rates(spark):
    df = spark.createDataFrame([(i, "some words here") for i in range(200)], "doc_id long, text string")
    forms = [r.form for r in infill.fill_in_middle(df, infill.Spec(100, 0, 7)).collect()]
    assert set(forms) == {"psm"}
    assert {r.form for r in infill.fill_in_middle(df, infill.Spec(0, 50, 7)).collect()} == {"plain"}


def test_texts_of_a_batch_do_not_meet():
    """A mark that only two neighbouring texts make together is none."""
    texts = ["ab<", "S>cd", "<P", ">"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    assert len(infill.marks_in(data, offsets, "PSM")[0]) == 0
    form = np.array([infill.PSM, infill.SPM, infill.PSM, infill.PLAIN])
    cuts = infill.Cuts(np.array([3, 4, 2, 1]), form, offsets[:-1] + [1, 0, 2, 0], offsets[:-1] + [3, 2, 2, 1])
    out, outputs = infill.arrange(data, offsets, cuts)
    assert out.tobytes() == b"<P>a<S><M>b<" + b"<S>cd<P><M>S>" + b"<P><P<S><M>" + b">"
    back, at = infill.restore(out, outputs, form)
    assert back.tobytes() == data.tobytes() and at.tolist() == offsets.tolist()


def test_broken_outputs_raise(spark):
    import pytest

    with pytest.raises(ValueError):
        infill.restore(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([0, 8]), np.array([infill.PSM]))


def test_registered_query_and_empty_table(spark, no_documents):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op12_infill"](spark, SF001).collect()
    want = [(*digest(plain(r.doc_id, r.text)), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs]
    assert nulls_first(map(tuple, got)) == nulls_first(want)
    assert infill.infill_digests(no_documents).collect() == []
