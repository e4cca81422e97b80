"""URL filters: fixed host/path rules, and a path-template tree for the rest (operator 7, DataFrame functions only).

Method.  Per host the path segments form a tree, built level by level over all
pages, down to the deepest level that any node of ``MIN_PAGES`` pages reaches
(below smaller nodes nothing can be literal).  A segment stays literal if it
leads at least ``MIN_PAGES`` pages of its node, whatever else stands there; every
other one becomes the wildcard ``*``.  From the deepest level up, sibling
branches merge if their shares of bad labels are alike: in the order of their
shares, a branch joins the one before unless a two-proportion z-test tells them
apart; a merged segment reads as its first name and how many more there are
(``a|+1``).  A template is rejected if its smoothed purity

    (good + SMOOTHING * overall purity) / (labelled + SMOOTHING)

is under ``MIN_PURITY``.  Rules come first; the longest that fits wins.

Scale: each level is one aggregate (with partial counts, so a host that holds a
third of all pages sends a few rows a task) and one join of short rows, written
as a table.  Keys with a thousandth of the pages or more, so at most a thousand
of them, are joined by broadcast, the others by shuffle: no task gets a hot key.
Siblings with equal counts are one row of the merge window, so a node with very
many branches is sorted by its kinds of counts, which grow far slower.  Only
single numbers reach the driver.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
rule, and is judged by the template of the empty host; pages without a label
count for the tree but not for purity; without any labels the overall purity is
1 and nothing is rejected; repeated rows are judged alike; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import cut

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_PAGES = 5
#: Keys with at least one in HOT_SHARE of the pages are joined by broadcast: there are at most so many.
HOT_SHARE = 1000
SMOOTHING, MIN_PURITY = 10.0, 0.5
#: Square of the z value under which two shares count as alike (95 %).
SAME_Z2 = 3.84
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path by the plain rule of the contract."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.lit(2_000_000_000))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, "^(?s)([^?#]*)", 1)
    return F.translate(F.regexp_extract(rest, "^(?s)([^/]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^(?s)[^/]*(.*)$", 1)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for what, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages name their document by the number that ends the path; bad is low quality or toxic, the worst label counts."""
    named = pages.select("url").distinct().withColumn("doc_id", F.regexp_extract(split_url(F.col("url"))[1], r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long"))
    bad = (labels.where("doc_id is not null and (quality is not null or toxic is not null)")
           .groupBy("doc_id").agg(F.max(F.expr("cast(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 as int)")).alias("bad")))
    return named.join(bad, "doc_id").select("url", "bad")


def join_by_count(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row a key; ``n`` of the rows hold it), hot keys by broadcast."""
    hot = table.where(f"n * {HOT_SHARE} >= {total}")  # at most HOT_SHARE keys
    found = rows.join(F.broadcast(hot), keys)
    return found.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "leftanti").join(table.where(f"n * {HOT_SHARE} < {total}"), keys, "left"))


def generalise(paths: DataFrame) -> DataFrame:
    """``paths`` (host, segs, ...) with ``t``: the segments of each page's template."""
    rest, done, level = paths.withColumn("t", F.array().cast("array<string>")), [], 0
    while True:
        done.append(rest.where(f"size(segs) <= {level}"))
        work = rest.where(f"size(segs) > {level}").withColumn("s", F.element_at("segs", level + 1))
        seen = cut(work.groupBy("host", "t", "s").agg(F.count("*").alias("n")), "url-nodes")
        total, most = seen.groupBy("host", "t").agg(F.sum("n").alias("n")).agg(F.sum("n"), F.max("n")).first()
        if most is None or most < MIN_PAGES:
            done.append(work.withColumn("t", F.expr(f"concat(t, array_repeat('*', size(segs) - {level}))")).drop("s"))
            break
        literal = seen.where(f"n >= {MIN_PAGES}").withColumn("kept", F.col("s"))
        named = join_by_count(work, literal, ["host", "t", "s"], total).withColumn("t", F.expr("concat(t, array(coalesce(kept, '*')))"))
        rest = cut(named.select(*rest.columns), "url-level")  # short rows; each level would else run all levels before it again
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def merge_branches(templates: DataFrame) -> DataFrame:
    """``templates`` (host, t, labelled, bad, ...) with ``m``: the segments of t after siblings that are alike merged."""
    out = templates.withColumn("m", F.col("t"))
    # below, no template with labels has another one of its host and depth to merge with
    shapes = templates.where("labelled > 0").groupBy("host", F.size("t").alias("depth")).count().where("count > 1")
    depth = shapes.agg(F.max("depth")).first()[0] or 0
    for level in range(depth, 0, -1):
        name, rest = f"element_at(m, {level})", f"concat(slice(m, 1, {level} - 1), array('*'), slice(m, {level} + 1, size(m)))"
        branch = (out.where(f"size(m) >= {level}").groupBy("host", "m").agg(F.sum("labelled").cast("double").alias("n"), F.sum("bad").cast("double").alias("b"))
                  .where("n > 0").select("host", F.expr(rest).alias("node"), F.expr(name).alias("name"), "n", "b"))
        kinds = branch.groupBy("host", "node", "n", "b").agg(F.min("name").alias("name"), F.count("*").alias("size"))
        by_share = Window.partitionBy("host", "node").orderBy(F.expr("b / n"), "n")
        near = kinds.withColumns({"pn": F.lag("n").over(by_share), "pb": F.lag("b").over(by_share)}).withColumn("cut", F.expr(_differs("n", "b", "pn", "pb")))
        kin = cut(near.withColumn("kin", F.sum("cut").over(by_share)).select("host", "node", "n", "b", "name", "size", "kin"), "url-kin")
        names = kin.groupBy("host", "node", "kin").agg(F.min("name").alias("name"), F.sum("size").alias("size"))
        merged = (kin.select("host", "node", "n", "b", "kin").join(names.selectExpr("host", "node", "kin", "name || if(size > 1, '|+' || (size - 1), '') as merged"), ["host", "node", "kin"])
                  .select("host", "node", "n", "b", "merged"))
        joint = branch.join(merged, ["host", "node", "n", "b"]).select(
            "host", F.expr(f"concat(slice(node, 1, {level} - 1), array(name), slice(node, {level} + 1, size(node)))").alias("m"), "merged")
        out = out.join(joint, ["host", "m"], "left").withColumn(
            "m", F.expr(f"if(merged is null, m, concat(slice(m, 1, {level} - 1), array(merged), slice(m, {level} + 1, size(m))))")).drop("merged")
        out = cut(out, "url-branches")
    return out


def _differs(n: str, b: str, pn: str, pb: str) -> str:
    """1 if two shares of bad labels differ (pooled two-proportion z-test), else 0; the text is the same for both engines."""
    pooled = f"(({b} + {pb}) / ({n} + {pn}))"
    return (f"case when {pn} is null or {b} + {pb} = 0 or {b} + {pb} = {n} + {pn} then 0 when power({b} / {n} - {pb} / {pn}, 2) < "
            f"cast({SAME_Z2} as double) * {pooled} * (1 - {pooled}) * (1 / {n} + 1 / {pn}) then 0 else 1 end")


def judge_urls(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page; ``labelled``: (url, bad)."""
    host, path = split_url(F.col("url"))
    segs = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    paths = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("segs", segs)
    marks = labelled.select(F.col("url").alias("of_url"), "bad")
    paths = generalise(cut(paths.join(marks, paths.url == marks.of_url, "left").drop("url", "of_url"), "url-paths"))
    templates = cut(paths.groupBy("host", "t").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "url-templates")
    merged = merge_branches(templates)
    overall = labelled.agg(F.coalesce(1 - F.avg("bad"), F.lit(1.0))).first()[0]
    total = templates.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    purity = (merged.groupBy("host", "m").agg(F.sum("labelled").alias("good"), F.sum("bad").alias("b"))
              .withColumn("purity", (F.col("good") - F.col("b") + F.lit(SMOOTHING * overall)) / (F.col("good") + F.lit(SMOOTHING))))
    verdicts = (merged.select("host", "t", "m", "n").join(purity, ["host", "m"])
                .select("host", "t", "n", "purity", F.expr("concat_ws('/', host, if(size(m) > 0, array_join(m, '/'), null))").alias("template")))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return join_by_count(paths.drop("bad"), cut(verdicts, "url-verdicts"), ["host", "t"], total).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def _oracle() -> str:
    """The same query for DuckDB: both level loops as recursion, over rows instead of aggregates."""
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(v, h + q, f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{q}'))") for v, h, q in longest]
    return f"""WITH RECURSIVE
u AS (SELECT row_number() OVER () AS page, page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END AS rest FROM pages),
p AS (SELECT page, page_id, url, translate(split_part(rest, '/', 1), '{UPPER}', '{LOWER}') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u),
bad_docs AS (SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
urls AS (SELECT url, any_value(path) AS path FROM p GROUP BY url),
labelled AS (SELECT url, bad FROM urls JOIN bad_docs ON try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html)?/?$', 1) AS BIGINT) = doc_id),
overall AS (SELECT coalesce(1 - avg(bad), 1.0) AS pure FROM labelled),
g AS (SELECT p.*, labelled.bad, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM p LEFT JOIN labelled ON p.url = labelled.url),
grown AS (
  SELECT page, host, segs, CAST([] AS VARCHAR[]) AS t, 0 AS d FROM g
  UNION ALL
  SELECT page, host, segs, list_append(t, CASE WHEN count(*) OVER (PARTITION BY host, t, segs[d + 1]) >= {MIN_PAGES} THEN segs[d + 1] ELSE '*' END), d + 1
  FROM grown WHERE d < len(segs)),
named AS (SELECT g.page_id, g.host, g.path, g.bad, t FROM grown JOIN g ON grown.page = g.page AND d = len(g.segs)),
templates AS (SELECT host, t, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM named GROUP BY host, t),
joined AS (
  SELECT host, t, t AS m, labelled, bad, (SELECT coalesce(max(len(t)), 0) FROM templates) AS l FROM templates
  UNION ALL
  SELECT host, t, CASE WHEN len(m) >= l AND n > 0 THEN list_concat(list_concat(m[1:l - 1], [CASE WHEN kinds > 1 THEN first_name || '|+' || (kinds - 1) ELSE m[l] END]), m[l + 1:]) ELSE m END, labelled, bad, l - 1
  FROM (SELECT *, min(m[l]) OVER w AS first_name, count(DISTINCT m[l]) OVER (PARTITION BY host, deep, node, n > 0, kin) AS kinds
    FROM (SELECT *, sum(differs) OVER (PARTITION BY host, deep, node, n > 0 ORDER BY b / n, n) AS kin
      FROM (SELECT *, {_differs("n", "b", "pn", "pb")} AS differs
        FROM (SELECT *, lag(n) OVER k AS pn, lag(b) OVER k AS pb
          FROM (SELECT *, len(m) >= l AS deep, list_concat(list_concat(m[1:l - 1], ['*']), m[l + 1:]) AS node,
              CAST(sum(labelled) OVER (PARTITION BY host, m) AS DOUBLE) AS n, CAST(sum(bad) OVER (PARTITION BY host, m) AS DOUBLE) AS b
            FROM joined WHERE l > 0)
          WINDOW k AS (PARTITION BY host, deep, node, n > 0 ORDER BY b / n, n))))
    WINDOW w AS (PARTITION BY host, deep, node, n > 0, kin))),
last AS (SELECT host, t, m, labelled, bad FROM joined WHERE l = 0),
q AS (SELECT host, m, sum(labelled)::DOUBLE AS n, sum(bad)::DOUBLE AS b FROM last GROUP BY host, m),
v AS (SELECT last.host, last.t, (n - b + {SMOOTHING} * pure) / (n + {SMOOTHING}) AS purity, last.host || CASE WHEN len(last.m) > 0 THEN '/' || array_to_string(last.m, '/') ELSE '' END AS template
  FROM last JOIN q ON last.host = q.host AND last.m = q.m, overall)
SELECT page_id, named.host, path, CASE {' '.join(f"WHEN {f} THEN '{r}'" for _, r, f in fits)} END AS rule,
  CASE {' '.join(f"WHEN {f} THEN '{x}'" for x, _, f in fits)} WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END AS verdict, template, round(purity, 9) AS purity
FROM named JOIN v ON named.host = v.host AND named.t = v.t""".replace("(host = '", "(named.host = '").replace("ends_with(host,", "ends_with(named.host,")


ORACLE_SQL = _oracle()
