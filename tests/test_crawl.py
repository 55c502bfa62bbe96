import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from stratacat.operators import ranks as R
from stratacat.sources import crawl as C

BASES = ["https://a.example.com", "https://a.example.com/x", "https://A.example.com:8443/x/y/z.html?q=1#f", "http://a.example.com/x/"]
LINKS = ["b", "./b", "../b", "../../../b", "/b/../c/./d", "?p=2", "#top", "", "//c.example.com/k", "https://d.example.com/q?x=/../y", "b/..", "b/.", " b ", "/", "c.html?u=../z"]


def test_links_resolve_as_browsers_do(spark):
    rows = [(b, x) for b in BASES for x in LINKS]
    got = {(r.b, r.x): r.u for r in spark.createDataFrame(rows, "b string, x string").select("b", "x", C.resolve(F.col("b"), F.col("x")).alias("u")).collect()}
    for b, x in rows:
        want = urljoin(b if "/" in b[8:] else b + "/", x.strip())
        plain = lambda u: u.replace("//A.", "//a.").split("#")[0].rstrip("/")
        assert plain(got[b, x]) == plain(want), (b, x)
    whole = spark.createDataFrame([("https://d.example.com/p/../q?x=/../y",)], "x string").select(C.resolve(F.lit(BASES[0]), F.col("x")).alias("u")).first()
    assert whole.u == "https://d.example.com/q?x=/../y"
    other = spark.createDataFrame([("https://a.example.com/", "mailto:x@y.z"), ("https://a.example.com/", "javascript:void(0)"), (None, "b"), ("https://a.example.com/", None)], "b string, x string")
    assert [r.u for r in other.select(C.resolve(F.col("b"), F.col("x")).alias("u")).collect()] == [None] * 4


def test_title_from_url(spark):
    rows = {"https://a/products/Sky-Ranger__II/123456789012": "Sky Ranger II", "https://a/p/caf%C3%A9+x": "café+x", "https://a/products/": "", "https://a": "", "https://a/p/bad%zz": ""}
    frame = spark.createDataFrame([(u,) for u in rows], "u string")
    assert {r.u: r.t for r in frame.select("u", C.title_from_url(F.col("u")).alias("t")).collect()} == rows


def test_a_crawl_ends_in_cycles_and_keeps_its_bounds(spark):
    roots = spark.createDataFrame([(1, "https://s.example.com", "https://s.example.com/shop"), (2, "https://t.example.com", "https://t.example.com/none")], "source_id long, home_url string, root_url string")
    many = "".join(f'<a href="/shop/c{i}">x</a>' for i in range(50))
    pages = [(1, "https://s.example.com/shop", many), (1, "https://s.example.com/shop/c0", '<a href="/shop">r</a><a href="c0">self</a><a href="c49">last</a>'), (1, "https://s.example.com/shop/c1", None)]
    got = C.crawl(roots, spark.createDataFrame(pages, "source_id long, url string, html string"), 7).collect()
    assert sorted((r.source_id, r.place, r.url.rpartition("/")[2]) for r in got) == [(1, 0, "shop"), *[(1, k, f"c{k - 1}") for k in range(1, 7)], (2, 0, "none")]


@pytest.mark.parametrize("parts", [1, 5])
def test_dense_ids(spark, parts):
    rows = spark.createDataFrame([(k * 7 % 101, f"n{k}") for k in range(101)], "k long, n string").repartition(parts)
    got = R.dense_ids(rows, ["k"], 40).orderBy("k").collect()
    assert [r.id for r in got] == list(range(41, 142)) and R.dense_ids(rows.limit(0), ["k"]).count() == 0


def test_anchored_windows(spark):
    rng = random.Random(3)
    rows = [(key, at) for key in range(6) for at in [rng.randrange(3000) for _ in range(60 if key else 1)]] + [(7, 5), (7, 5), (7, 105), (7, 104)]
    want = {}
    for key in {k for k, _ in rows}:
        start = None
        for at in sorted({a for k, a in rows if k == key}):
            start = at if start is None or at - start >= 100 else start
            want[key, at] = start
    got = R.anchored_windows(spark.createDataFrame(rows, "key long, at long"), 100).collect()
    assert len(got) == len(rows) and all(r.start == want[r.key, r["at"]] for r in got)
    assert R.anchored_windows(spark.createDataFrame([], "key long, at long"), 100).count() == 0


def test_sitemaps_of_any_depth(spark):
    loc = lambda tag, *urls: "".join(f"<{tag}><loc>{u}</loc></{tag}>" for u in urls)
    home = "https://w.example.com"
    docs = [
        (1, f"{home}/sitemap.xml", f"<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>{loc('sitemap', home + '/pages.xml', home + '/Store-Products-Sitemap.xml', home + '/store-products-sitemap-2.xml')}</sitemapindex>"),
        (1, f"{home}/Store-Products-Sitemap.xml", f"<sitemapindex>{loc('sitemap', home + '/a.xml', home + '/sitemap.xml', home + '/a.xml')}</sitemapindex>"),
        (1, f"{home}/a.xml", f"<urlset>{loc('url', home + '/product-page/x?v=1', home + '/blog', home + '/product-page/y', home + '/product-page/x')}</urlset>"),
        (1, f"{home}/pages.xml", f"<urlset>{loc('url', home + '/product-page/late')}</urlset>"), (2, "https://v.example.com/sitemap.xml", None), (2, "https://v.example.com/store-products-sitemap.xml", "<urlset/>"),
    ]
    sources = spark.createDataFrame([(1, home, home + "/shop?currency=INR"), (2, "https://v.example.com", "https://v.example.com"), (3, "https://u.example.com", "")], "source_id long, home_url string, list_url string")
    got = C.sitemap_products(sources, spark.createDataFrame(docs, "source_id long, url string, xml string"), size=2).collect()
    assert sorted((r.place, r.page, r.url, r.title) for r in got) == [(k, k // 2, f"{home}/product-page/{n}?currency=INR", n) for k, n in enumerate(("x", "y", "late"))]


def test_no_page_goes_through_the_driver(spark, monkeypatch):
    """Joins of a crawl sort both sides, also where Spark takes them for small."""
    roots = spark.createDataFrame([(1, "https://a.example", "https://a.example/shop", "woo")], "source_id long, home_url string, root_url string, platform string")
    pages = spark.createDataFrame([(1, "https://a.example/shop", '<a href="/shop/c1">1</a><a href="/product/x">X</a>')], "source_id long, url string, html string")
    plans, cut = [], C.cut
    monkeypatch.setattr(C, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    found = C.listed_products(roots, pages)
    assert [r.url for r in found.collect()] == ["https://a.example/product/x"]
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 3 and not any("BroadcastHashJoin" in p for p in plans)
