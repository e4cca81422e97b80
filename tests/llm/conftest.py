"""Fixtures of the training-data operators; the Spark session is the one of tests/conftest.py."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "pages", "embeddings", "benchmark", "conversations")
#: Extra columns whose names clash with what the operators use inside.
CLASH = ("score", "z", "segment", "found", "n_removed", "h1", "bands", "a.b", "copies", "component", "src")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(("an", "er", "th", "ou", "ti", "en")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def planted_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Exact and near copies, shared passages, repeats inside a text, long and short texts, nulls and repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng, rng.randint(30, 150))) for i in range(20, 40)]
    rows += [(40 + k, rows[0][1]) for k in range(5)]  # exact copies
    for k in range(8):  # near copies: one word of many differs
        w = rows[1][1].split(" ")
        w[(7 * k) % len(w)] = "changed%d" % k
        rows.append((50 + k, " ".join(w)))
    rows += [(60 + k, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 25)) for k in range(4)]
    rows += [(70, passage + "\n" + prose(rng, 10) + "\n" + passage), (71, "la " * 300), (72, "ab" * 900), (73, prose(rng, 6000)), (74, "word"), (75, ""),
             (76, None), (77, " \t\n "), (78, "Zoë\tnaïve 東京 \U0001f600 " * 40), (79, rows[3][1] + " tail"), (5, rows[2][1]), (5, rows[2][1])]
    return rows


@pytest.fixture(scope="session")
def planted(spark):
    """The planted rows as documents, with null ids and clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(planted_texts(), "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASH}).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
