import pytest
from pyspark.sql import functions as F

from stratacat.llm import url_reputation as U

CASES = [
    ("http://A.Example.NET/en/x?q=/de/", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("https://example.net/de/1#t", "example.net", "/de/1", "net/", "block"),
    ("https://myexample.net", "myexample.net", "", None, "allow"),
    ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("ftp://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    ("http://net/?a", "net", "/", "net/", "block"),
    ("http://h?u=http://b.net/", "h", "", None, "allow"),
    ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("x://", "", "", None, "allow"), ("a\nb://H.org/fr/\n?", "h.org", "/fr/\n", "org/fr/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(None, None)], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = {r.page_id: r for r in U.judge(pages, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert got[None].verdict == "allow"
    assert U.judge(pages.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://spam{i % 3}.bad.info/{i}" if bad else f"http://h{i % 10}.good.info/{i}"))
        marks.append((i, 0 if bad or i % 40 == 1 else 1))
    rows += [(1000, "http://new.bad.info/"), (1001, "http://new.good.info/"), (1002, "http://other.dev/"), (0, rows[0][1])]
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([*marks, (None, 0), (5, None)], "doc_id long, quality int"))
    return {r.page_id: r for r in out.collect()}


def test_bad_hosts_are_blocked_and_good_ones_stay(judged):
    assert judged[0].verdict == "block" and judged[3].verdict == "allow" and judged[2].verdict == "allow"
    assert judged[3].bad_rate < 0.2 < 0.8 < judged[0].bad_rate


def test_unseen_hosts_inherit(judged):
    assert judged[1000].bad_rate > judged[1001].bad_rate  # from their domains
    assert judged[1002].verdict == "allow"


def test_levels(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("localhost",), ("10.0.0.1:80",), ("u@h.org:8080",), ("",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in U.with_levels(hosts).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "localhost": ("localhost", "localhost"), "10.0.0.1:80": ("10.0.0.1", ""), "u@h.org:8080": ("h.org", "org"), "": ("", "")}
