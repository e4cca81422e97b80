"""Operator 3 against its SQL form, which knows no fingerprints."""

import duckdb
from pyspark.sql import functions as F

from wattlane.llm import lines

LONG = " ".join(f"w{i}" for i in range(25))


def digest(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.m) for r in df.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("m")).collect()), key=str)


def test_equals_sql_on_odd_texts(spark):
    rows = [(1, "a\nb\nc"), (2, "x\n a \n\n\tb\ny"), (3, "a\nx"), (4, LONG), (5, "q\n" + LONG + "\nr"), (6, ""), (7, "\n\n"), (8, "a\nb\na\nb\na\nb"),
            (9, "b\nc"), (10, "\r\nb\r\nc\r\n"), (11, "r " * 9000), (12, "z\nz\nz\nz"), (13, "z\nz"), (14, None), (-3, "c\nd"), (15, "c\nd\ne"), (16, " \x0b\n \x0b\nk")]
    rows += [(100 + i, f"own {i}\nhead one\nhead two\ntail {i}\nfoot") for i in range(30)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, runs int").repartition(4)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = sorted(con.sql(f"SELECT doc_id, n_lines, n_removed, text_md5 FROM ({lines.ORACLE_SQL})").fetchall(), key=str)
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "runs", "n_lines", "n_removed"]
    assert digest(got) == want
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] == "a\nb\nc" and texts[2] == "x\n\ny" and texts[5] == "q\nr" and texts[3] == "a\nx" and texts[101] == "own 1\ntail 1\nfoot"


def test_runs_name_their_source(spark):
    docs = spark.createDataFrame([(1, "k\na\nb\nc\nd"), (2, "m\na\nb\nc\nn")], "doc_id long, text string")
    run = lines.repeated_runs(docs).collect()
    assert [(r.doc.id, r.first, r.last, r.src.id, r.src_first) for r in run] == [(2, 1, 3, 1, 1)]


def test_repeated_rows_null_ids_and_empty_table(spark, no_documents):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "p\na\nb"), (None, "a\nb\nc"), (None, None)]
    got = [(r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got.count((1, "", 2)) == 2 and (1, "p", 2) in got and (None, "a\nb\nc", 0) in got and (None, None, 0) in got
    assert lines.dedup_lines(no_documents).count() == 0
