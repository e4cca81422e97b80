"""Operator 7: rules by hand, the template tree against its SQL form on odd urls."""

import duckdb
import pytest

from wattlane.llm import urls

URLS = [None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://Sub.A.NET/x?y#z", "http://example.net/en/1", "http://x.example.net/en/",
        "http://example.net/enx", "http://example.com/de/5.html", "http://notexample.com/de/5", "http://example.org/fr/3", "http://org/fr/", "http://b.org/FR/3",
        "http://É.Org/fr/1", "http://net?x://y/z", "a://b://c/d", "http://h.io//a//7", "http://h.io/" + "long/" * 400, "http://h.io/a\nb/8", "http://h.io/x#/en/9",
        "http://user@net:80/p", *[f"http://hot.io/{'ab'[i % 2]}/{i}.html" for i in range(60)], *[f"http://hot.io/bad/{100 + i}" for i in range(30)]]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, "http://hot.io/a/4.html")]
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in rows], "page_id long, url string, rule int, template string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)] + [(4, None, 0), (5, None, None), (None, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    return pages, labels


def test_rules_and_parts(tables):
    pages, labels = tables
    got = {r.page_id: r for r in urls.judge_urls(pages, urls.page_labels(pages, labels)).collect()}

    def part(u):
        r = got[URLS.index(u)]
        return r.host, r.path, r.rule

    assert part(None) == part("no scheme") == ("", "", None)
    assert part("http://a.net") == ("a.net", "", None)
    assert part("http://a.net/") == ("a.net", "/", "net/")
    assert part("HTTP://Sub.A.NET/x?y#z") == ("sub.a.net", "/x", "net/")
    assert part("http://example.net/en/1") == ("example.net", "/en/1", "example.net/en/")
    assert part("http://x.example.net/en/")[2] == "example.net/en/" and part("http://example.net/enx")[2] == "net/"
    assert part("http://example.com/de/5.html")[2] == "example.com/de/" and part("http://notexample.com/de/5")[2] is None
    assert part("http://org/fr/")[2] == part("http://example.org/fr/3")[2] == "org/fr/" and part("http://b.org/FR/3")[2] is None
    assert part("http://É.Org/fr/1")[0] == "É.org"
    assert part("http://net?x://y/z") == ("net", "", None) and part("a://b://c/d") == ("b:", "//c/d", None)
    assert part("http://h.io/a\nb/8")[1] == "/a\nb/8" and part("http://user@net:80/p")[:2] == ("user@net:80", "/p")
    assert got[URLS.index("http://example.net/en/1")].verdict == "allow" and got[URLS.index("http://a.net/")].verdict == "block"
    # ids become wildcards, the bad branch stands alone and goes, the two good ones merge
    bad, good = got[URLS.index("http://hot.io/bad/100")], got[URLS.index("http://hot.io/a/2.html")]
    assert (bad.template, bad.verdict, good.template, good.verdict) == ("hot.io/bad/*", "block", "hot.io/a|+1/*", "allow")


def test_equals_sql(tables):
    pages, labels = tables
    con = duckdb.connect()
    con.register("pages", pages.select("page_id", "url").toArrow())
    con.register("labels", labels.toArrow())
    want = {tuple(r) for r in con.sql(f"SELECT page_id, host, path, rule, verdict, template, purity FROM ({urls.ORACLE_SQL})").fetchall()}
    got = urls.judge_urls(pages, urls.page_labels(pages, labels)).collect()
    assert len(got) == pages.count()
    assert {(*r[:6], round(r.purity, 9)) for r in got} == want


def test_empty_tables(tables):
    pages, labels = tables
    none = pages.where("page_id < 0")
    assert urls.judge_urls(none, urls.page_labels(none, labels)).count() == 0
    without = urls.judge_urls(pages, urls.page_labels(pages, labels.where("doc_id < 0"))).where("rule is null")
    assert {r.verdict for r in without.select("verdict").distinct().collect()} == {"allow"}


def judged(spark, pages, bad):
    """Verdict and template by url; ``bad``: the ids of bad documents among those that the urls name."""
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    ids = [int(u.rstrip("/").rpartition("/")[2]) for u in pages if u.rstrip("/").rpartition("/")[2].isdigit()]
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i in ids], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("pages", table.toArrow())
    con.register("labels", labels.toArrow())
    rows = urls.judge_urls(table, urls.page_labels(table, labels)).collect()
    want = {tuple(r) for r in con.sql(f"SELECT page_id, host, path, rule, verdict, template, purity FROM ({urls.ORACLE_SQL})").fetchall()}
    assert {(*r[:6], round(r.purity, 9)) for r in rows} == want
    return {pages[r.page_id]: (r.verdict, r.template) for r in rows}


def test_a_bad_section_at_any_level_goes(spark):
    """Deep sections, and few bad ones among very many: literal by their own count, not by their share of the host."""
    deep = [f"http://h.io/en/2024/05/{s}/{i}" for i, s in enumerate(["spam"] * 200 + ["news"] * 200)]
    fifth = [f"http://d.io/a/b/c/d/{s}/{1000 + i}" for i, s in enumerate(["ok"] * 60 + ["worse"] * 60)]
    wide = [f"http://k.io/s{i // 10}/{2000 + i}" for i in range(2000)]
    bad = set(range(200)) | set(range(1060, 1120)) | {2000 + i for i in range(2000) if i // 10 in (7, 50, 51, 120, 199)}
    got = judged(spark, deep + fifth + wide, bad)
    assert {u for u, (v, _) in got.items() if v == "block"} == {u for u in got if int(u.rpartition("/")[2]) in bad}
    assert got[deep[0]][1] == "h.io/en/2024/05/spam/*" and got[wide[0]][1] == "k.io/s0|+194/*" and got[wide[70]][1] == "k.io/s120|+4/*"


def test_literals_below_wildcards_and_stars(spark):
    """Ids may stand above a section; a segment that is itself a star counts as variable."""
    pages = [f"http://u.io/{i}x/{'good' if i % 2 else 'bad'}/{i}" for i in range(80)] + [f"http://u.io/*/good/{500 + i}" for i in range(9)]
    got = judged(spark, pages, {i for i in range(80) if i % 2 == 0})
    assert got[pages[0]] == ("block", "u.io/*/bad/*") and got[pages[1]] == got[pages[-1]] == ("allow", "u.io/*/good/*")


def test_hot_keys_by_either_join(spark, monkeypatch):
    pages = [f"http://h.io/{s}/{i}" for i, s in enumerate(["a"] * 50 + ["b"] * 20 + [f"c{k}" for k in range(30)])]
    want = judged(spark, pages, set(range(40, 70)))
    monkeypatch.setattr(urls, "HOT_SHARE", 2)  # hardly any key is hot
    assert judged(spark, pages, set(range(40, 70))) == want
