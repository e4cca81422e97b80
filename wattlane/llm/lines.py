"""Line dedup by winnowing over line hashes (operator 3, DataFrame functions only).

A line is the text between line feeds, without surrounding blanks (space, tab,
carriage return); empty lines are kept and never counted.  A later repeated run
goes: two or more neighbouring lines that stood in the same order earlier (a
smaller doc_id, or further up in the document), or one line of ``LONG_LINE`` or
more words that stood earlier.  Everything is judged on the input.

Method.
1. Each document becomes an array of line hashes.  Of every window of two lines
   the one with the smaller hash is the fingerprint (the first of equal ones), so
   any run of two lines or more shares a fingerprint with its earlier stand: the
   guarantee of winnowing.  Long lines are fingerprints of their own.
2. Fingerprints are counted; only repeated ones go on.
3. Positions are joined: a fingerprint with the neighbour that completes its
   window leads to the first place where the two stood.
4. Matches grow both ways: neighbouring matched lines that follow each other at
   the source too are one run.  Runs are what is deleted.

Scale: rows are fingerprints (a few numbers each); counts use partial
aggregates, the tables that hot lines meet are written first so that AQE can
split the joins, and a document's runs are bounded by its own lines.

Edge cases: a null text stays null and has no lines; an empty text has one empty
line; a null doc_id sorts before all others; rows that share doc_id and text are
one document (each is rewritten alike), rows that share only the doc_id are
ordered by a hash of their texts; extra columns stay as they are (but for
``n_lines`` and ``n_removed``, which the result has of its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import cut, own_columns

LONG_LINE = 20
NO_ID = -(1 << 63)
#: Names of helper columns; long, so that no column of a caller's table clashes.
ID, TEXT, RUNS = "line_dedup_id", "line_dedup_text", "line_dedup_runs"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(TEXT, F.xxhash64("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc, at, no, fp, left, right, long_line): ``left``/``right`` hold the neighbour if the window with it chose this line.

    ``doc`` is (doc_id, text hash), ``at`` counts the lines that are not empty, ``no`` all lines.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(" \t\r")).alias("x"), i.alias("no")))
    # two hashes as one value: 64 bits to compare and join on, 32 more against chance
    hashed = F.transform(F.filter(lines, lambda s: s["x"] != ""), lambda s: F.struct(
        F.xxhash64(s["x"]).alias("h"), F.hash(s["x"]).alias("g"), s["no"].alias("no"),
        (F.size(F.split(s["x"], "[\\x20\\x09-\\x0D]+")) >= LONG_LINE).alias("long_line")))
    arrays = keyed(docs).where("text is not null").select(F.struct(F.col(ID).alias("id"), F.col(TEXT).alias("text")).alias("doc"), hashed.alias("ls"))
    rows = arrays.dropDuplicates(["doc"]).select("doc", "ls", F.posexplode("ls").alias("at", "line"))
    before, after = F.get("ls", F.col("at") - 1), F.get("ls", F.col("at") + 1)

    def value(x: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["g"].alias("g"))

    def mate(x: Column) -> Column:
        return F.struct(value(x).alias("fp"), x["no"].alias("no"))

    own = value(F.col("line"))
    rows = rows.select("doc", "at", F.col("line.no").alias("no"), own.alias("fp"),
                       F.when(before.isNotNull() & (own < value(before)), mate(before)).alias("left"),
                       F.when(after.isNotNull() & (own <= value(after)), mate(after)).alias("right"), F.col("line.long_line").alias("long_line"))
    return rows.where("left is not null or right is not null or long_line")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc, first, last, src, src_first, first_no, last_no): runs of lines that stood earlier.

    first, last and src_first are numbers among the lines that are not empty, first_no and last_no among all lines.
    """
    found = cut(fingerprints(docs), "lines")
    twice = cut(found.groupBy("fp").count().where("count > 1").select("fp"), "lines-twice")
    found = found.join(twice, "fp", "leftsemi")
    # the windows of a fingerprint, and the long line itself
    side = F.explode(F.filter(F.array(
        F.struct(F.lit(-1).alias("side"), F.col("left").alias("mate"), F.col("left").isNotNull().alias("is")),
        F.struct(F.lit(1).alias("side"), F.col("right").alias("mate"), F.col("right").isNotNull().alias("is")),
        F.struct(F.lit(0).alias("side"), F.lit(None).alias("mate"), F.col("long_line").alias("is"))), lambda x: x["is"]))
    windows = found.select("doc", "at", "no", "fp", side.alias("w")).select(
        "doc", "at", "no", F.xxhash64("fp", "w.side", "w.mate.fp").alias("k1"), F.hash("fp", "w.side", "w.mate.fp").alias("k2"),
        F.col("w.side").alias("side"), F.col("w.mate.no").alias("mate_no"))
    windows = cut(windows, "lines-windows")
    place = F.struct("doc", "at")
    first = (windows.groupBy("k1", "k2").agg(F.min(place).alias("src"), F.max(place).alias("end")).where("src < end").select("k1", "k2", "src"))
    first = cut(first, "lines-first")
    matched = windows.join(first, ["k1", "k2"]).where(place > F.col("src"))
    # each match covers its fingerprint and the neighbour that completed the window
    cover = F.explode(F.expr("filter(array(struct(0 as d, no), struct(side as d, mate_no as no)), x -> x.no is not null)"))
    lines = (matched.select("doc", "at", "src", cover.alias("c"))
             .select("doc", (F.col("at") + F.col("c.d")).alias("at"), F.col("c.no").alias("no"), F.col("src.doc").alias("src"),
                     (F.col("src.at") + F.col("c.d")).alias("src_at")).distinct())
    run = Window.partitionBy("doc", "src", F.col("at") - F.col("src_at")).orderBy("at")
    return (lines.withColumn("island", F.col("at") - F.row_number().over(run))
            .groupBy("doc", "src", F.expr("at - src_at").alias("shift"), "island")
            .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("src_at").alias("src_first"),
                 F.min("no").alias("first_no"), F.max("no").alias("last_no"))
            .select("doc", "first", "last", "src", "src_first", "first_no", "last_no"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later repeated runs taken out of ``text``, and n_lines, n_removed (lines that are not empty) behind."""
    runs = (repeated_runs(docs).groupBy(F.col("doc.id").alias(ID), F.col("doc.text").alias(TEXT))
            .agg(F.collect_set(F.struct("first_no", "last_no")).alias(RUNS)))
    split = F.split("text", "\n", -1)
    out = keyed(docs).join(runs, [ID, TEXT], "left")

    # the lambdas look only at a line, its number and the runs: nothing in them is worked out again for each line
    def full(x: Column) -> Column:
        return F.btrim(x, F.lit(" \t\r")) != ""

    def gone(x: Column, i: Column) -> Column:
        return full(x) & F.exists(RUNS, lambda r: (r["first_no"] <= i) & (i <= r["last_no"]))

    kept = F.array_join(F.filter(split, lambda x, i: ~gone(x, i)), "\n")
    removed = F.size(F.filter(split, gone))
    return out.select(
        *[(F.when(F.col(RUNS).isNull(), F.col("text")).otherwise(kept).alias("text") if name == "text" else c)
          for name, c in zip(docs.columns, own_columns(docs), strict=True) if name not in ("n_lines", "n_removed")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(split, full))).cast("long").alias("n_lines"),
        F.when(F.col(RUNS).isNull(), 0).otherwise(removed).cast("long").alias("n_removed"))


#: What the operator returns, stated without fingerprints: windows of two lines and long lines, against their first stand.
ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(13)) AS s FROM l),
f AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM t WHERE s <> ''),
w AS (SELECT doc_id, i, s, pos, nxt, row_number() OVER (PARTITION BY s, nxt ORDER BY doc_id, pos) > 1 AND nxt IS NOT NULL AS again,
  row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) > 1 AND len(string_split_regex(s, '[\\x20\\x09-\\x0D]+')) >= {LONG_LINE} AS long_again FROM f),
g AS (SELECT doc_id, i, again OR long_again OR coalesce(lag(again) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM w),
k AS (SELECT t.doc_id, count(*) FILTER (s <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
  md5(coalesce(string_agg(x, chr(10) ORDER BY t.i) FILTER (NOT coalesce(gone, false)), '')) AS text_md5 FROM t LEFT JOIN g USING (doc_id, i) GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, text_md5 FROM documents d LEFT JOIN k USING (doc_id)"""
