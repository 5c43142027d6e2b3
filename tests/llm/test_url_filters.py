import duckdb

from corpusloom.llm import url_filters as U
from corpusloom.llm.components import connected_components
from corpusloom.llm.queries import OP1_SQL, URL_RULES

SCHEMA = "page_id long, url string, html string, host string, node string"


def page(i, url, html=""):
    return (i, url, html, "clash", "clash")


PAGES = [
    page(1, "https://a.example.com/en/1", ""),
    page(2, "https://a.example.com/fr/1", '<link rel="canonical" href="/en/1">'),
    page(3, "http://Z.test/x?q=1#f", "<LINK href='https://a.example.com/fr/1' REL=canonical>"),
    page(4, "https://example.com/en/7", '<link rel=canonical href="https://a.example.com/en/1">'),
    page(5, None, None),
    page(6, "no scheme", None),
    page(7, "https://w.test", '<meta http-equiv="refresh" content="0; url=//z.test/x?q=1">'),
    page(7, "https://w.test", '<meta http-equiv="refresh" content="0; url=//z.test/x?q=1">'),
    page(8, "https://v.test/a/b", '<link rel="stylesheet" href="https://a.example.com/en/1">'),
    page(9, "https://v.test/a/b?page=2", '<link rel="canonical" href="c">'),
    page(None, "ftp://com/en/", None),
    page(11, "x://" + "y" * 50000 + "/en/", "<link" * 1000),
    page(12, "://notexample.com/en/x", None),
    page(13, "https://www.example.net/de/8/y", ""),
    page(14, "https://www.example.net/de/9/y", ""),
    page(15, "https://u.test/de/9/y#top", '<link rel="canonical" href="#part">'),
    page(16, "https://u.test/fr/1?x=1", '<link rel="canonical" href="?x=2">'),
    page(17, "https://a.example.com/en/1?x=2", '<link rel="canonical" href="https://u.test/fr/1?x=2">'),
    page(None, None, "<link rel=canonical href='https://a.example.com/en/1'>"),
]


def test_rules_aliases_and_edge_cases(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    rows = [r.asDict() for r in U.filter_urls(df, URL_RULES).collect()]
    assert len(rows) == len(PAGES)
    got = {(r["page_id"], r["host"][:12]): r for r in rows}
    assert got[1, "a.example.co"]["rule"] == "com/en/"
    assert got[2, "a.example.co"]["verdict"] == "block" and got[2, "a.example.co"]["propagated"]
    assert got[3, "z.test"]["verdict"] == "block" and got[7, "w.test"]["verdict"] == "block"
    assert got[4, "example.com"]["verdict"] == "allow" and not got[4, "example.com"]["propagated"]
    assert got[5, ""]["verdict"] == "allow" and got[6, ""]["rule"] is None
    assert got[8, "v.test"]["verdict"] == "allow" and got[9, "v.test"]["verdict"] == "allow"
    assert got[15, "u.test"]["verdict"] == "allow" and got[16, "u.test"]["propagated"]
    assert got[12, "notexample.c"]["rule"] == "com/en/"
    assert got[13, "www.example."]["verdict"] == "block" and got[14, "www.example."]["verdict"] == "allow"


def test_same_as_sql(spark, tmp_path):
    df = spark.createDataFrame(PAGES, SCHEMA)
    con = duckdb.connect()
    df.write.parquet(str(tmp_path / "p"))
    con.execute(f"create view pages as select page_id, url, html from read_parquet('{tmp_path}/p/*.parquet')")
    key = lambda r: tuple(str(x) for x in r)
    cols = ["page_id", "host", "path", "rule", "verdict", "propagated"]
    want = sorted(map(key, con.execute(OP1_SQL).fetchall()))
    assert sorted(map(key, U.filter_urls(df, URL_RULES).select(*cols).collect())) == want


def test_redirect_table_and_empty_input(spark):
    df = spark.createDataFrame([page(1, "http://a.test/1"), page(2, "http://b.test/2")], SCHEMA)
    moved = spark.createDataFrame([("http://a.test/1", "http://b.test/2"), (None, "http://a.test/1")], "src string, dst string")
    got = {r.page_id: r.verdict for r in U.filter_urls(df, [("block", "b.test/")], moved).collect()}
    assert got == {1: "block", 2: "block"}
    assert U.filter_urls(df.limit(0), URL_RULES).collect() == []


def test_components_of_a_path_a_star_and_repeats(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(5, 5), (None, 3), (100, 101)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 160)}
