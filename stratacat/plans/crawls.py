"""Crawls and sitemaps over pages made of parts, and budgets in anchored windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.operators import ranks
from stratacat.sources import crawl
from stratacat.views import derived, table

#: Shops of 25 parts: a tree of 24 listing pages and a second page of the first, with links of every form. Every third shop's page 7 has not landed.
SITE = """SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS source_id, CAST(p_partkey % 25 AS INT) AS i, p_partkey AS n, concat('https://s', CAST(floor(p_partkey / 25) AS BIGINT), '.example.com') AS home FROM part"""
SITE_PAGE = f"""SELECT source_id, i, n, home, concat(home, CASE i WHEN 0 THEN '/shop' WHEN 24 THEN '/shop?page=2' ELSE concat('/shop/c', i) END) AS url,
concat('<html><a href="', home, '/shop/">Home</a><a href="/blog/c1">B</a><a href=''https://other.example.com/shop/c9''>O</a><a href="/shop/feed/">F</a><a href="mailto:a@b.c">M</a>',
CASE WHEN i = 0 THEN '<a class="x next y" href="/shop?utm_source=z&page=2">more</a>' ELSE '' END,
CASE WHEN 2 * i + 1 < 24 THEN concat('<a href="', CASE WHEN i = 0 THEN './shop/c1' WHEN i % 3 = 1 THEN concat('../shop/x/../c', 2 * i + 1, '?orderby=price') ELSE concat('c', 2 * i + 1, '/#top') END, '">1</a>') ELSE '' END,
CASE WHEN 2 * i + 2 < 24 THEN concat('<a href="', CASE WHEN i % 2 = 0 THEN concat('/shop/c', 2 * i + 2, '/') ELSE concat('//s', source_id, '.EXAMPLE.com/shop/c', 2 * i + 2) END, '">2</a>') ELSE '' END,
CASE WHEN source_id % 2 = 0 THEN concat('<a href="/product/w-', i, '_A%20b/?ref=q">P</a><a href="/product/a/b">N</a>') ELSE concat('<a href="/products/Plane_', i, '/', 100000000000 + n, '">P</a><a href="/products/short/123">Q</a>') END, '</html>') AS html FROM ({SITE}) x"""

#: Shops of a hundred parts with sitemaps; of odd ones the sitemap of products is an index of two, the second of which leads back.
MAPS = """SELECT CAST(floor(p_partkey / 100) AS BIGINT) AS source_id, p_partkey % 100 AS i, p_partkey AS n, CASE WHEN floor(p_partkey / 100) % 2 = 1 AND p_partkey % 100 >= 60 THEN 2 WHEN floor(p_partkey / 100) % 2 = 1 THEN 1 ELSE 0 END AS part FROM part"""


def _pages(s, d):
    return derived(s, d, f"SELECT source_id, url, html FROM ({SITE_PAGE}) x WHERE NOT (i = 7 AND source_id % 3 = 0)")


def _roots(s, d):
    return derived(s, d, f"SELECT DISTINCT source_id, home AS home_url, concat(home, '/shop') AS root_url, CASE WHEN source_id % 2 = 0 THEN 'woo' ELSE 'zoho' END AS platform FROM ({SITE}) x")


def _sitemaps(s, d):
    rows = derived(s, d, MAPS)
    host = F.concat(F.lit("https://w"), "source_id", F.lit(".example.com"))
    loc = lambda tag, url: F.concat(F.lit(f"<{tag}><loc> "), url, F.lit(f" </loc></{tag}>"))
    item = F.concat(host, F.lit("/product-page/plane-"), (F.col("i") - F.when(F.col("i") == 90, 1).otherwise(0)).cast("string"), F.lit("?a=1&amp;b=2"))
    lists = rows.groupBy("source_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", loc("url", item).alias("x")))), lambda e: e["x"]), "").alias("items"))  # a hundred a shop
    back = F.when(F.col("part") == 2, loc("sitemap", F.concat(host, F.lit("/store-products-sitemap.xml")))).otherwise("")
    name = F.when(F.col("part") == 0, "/store-products-sitemap.xml").otherwise(F.concat(F.lit("/products-"), "part", F.lit(".xml")))
    leaves = lists.select("source_id", F.concat(host, name).alias("url"), F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), loc("url", F.concat(host, F.lit("/about"))), "items", back, F.lit("</urlset>")).alias("xml"))
    sources = rows.select("source_id").distinct()
    inner = sources.filter("source_id % 2 = 1").select("source_id", F.concat(host, F.lit("/store-products-sitemap.xml")).alias("url"), F.concat(F.lit("<sitemapindex>"), *[loc("sitemap", F.concat(host, F.lit(f"/products-{k}.xml"))) for k in (1, 2)], F.lit("</sitemapindex>")).alias("xml"))
    whole = F.concat(F.lit("<sitemapindex>"), loc("sitemap", F.concat(host, F.lit("/pages-sitemap.xml"))), loc("sitemap", F.concat(host, F.lit("/store-products-sitemap.xml"))), F.lit("</sitemapindex>"))
    index = sources.filter("source_id % 4 <> 0").select("source_id", F.concat(host, F.lit("/sitemap.xml")).alias("url"), F.when(F.col("source_id") % 5 == 3, "<sitemapindex><broken").otherwise(whole).alias("xml"))
    home = sources.select("source_id", F.concat(host, F.lit("/")).alias("home_url"), F.concat(host, F.when(F.col("source_id") % 3 == 0, "/all").otherwise("/all?x=1&currency=INR")).alias("list_url"))
    return crawl.sitemap_products(home, leaves.unionByName(inner).unionByName(index))


def _quota(s, d):
    uses = table(s, d, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    fits = ranks.within_anchored_budget(uses, (F.col("event_id") % 4 + 1).cast("long"), 3, 86_400_000_000, ["event_id"])
    return fits.select(F.col("key").alias("user_id"), "event_id", F.timestamp_micros("start").cast("timestamp_ntz").alias("start"), "spent")


QUERIES = {
    "src_html_crawl": lambda s, d: crawl.crawl(_roots(s, d), _pages(s, d)).select("source_id", "url", "place"),
    "src_html_products": lambda s, d: crawl.listed_products(_roots(s, d), _pages(s, d)),
    "src_wix_sitemap": _sitemaps,
    "t_rolling_quota_anchored": _quota,
}
_QUEUE = f"""RECURSIVE p AS (SELECT source_id, i, url FROM ({SITE_PAGE}) x)
, l AS (SELECT source_id, i, list_concat(CASE WHEN i = 0 THEN [24] ELSE [] END, list_filter([2 * i + 1, 2 * i + 2], lambda j: j < 24)) AS links FROM p WHERE NOT (i = 7 AND source_id % 3 = 0))
, q(source_id, queue, k) AS (SELECT DISTINCT source_id, [0], 1 FROM p
  UNION ALL SELECT q.source_id, list_slice(list_concat(queue, list_filter(coalesce(links, []), lambda j: NOT list_contains(queue, j))), 1, 20), k + 1 FROM q LEFT JOIN l ON l.source_id = q.source_id AND l.i = queue[k] WHERE k <= len(queue))
, f AS (SELECT source_id, arg_max(queue, k) AS queue FROM q GROUP BY source_id), v AS (SELECT source_id, unnest(queue) AS i, unnest(range(len(queue))) AS place FROM f)"""
ORACLE = {
    "src_html_crawl": f"WITH {_QUEUE} SELECT v.source_id, url, CAST(place AS INT) AS place FROM v JOIN p ON p.source_id = v.source_id AND p.i = v.i",
    "src_html_products": f"""WITH {_QUEUE}, o AS (SELECT v.source_id, v.i, 100000000000 + v.source_id * 25 + v.i AS long FROM v JOIN l ON l.source_id = v.source_id AND l.i = v.i)
SELECT source_id, concat('https://s', source_id, '.example.com/product/w-', i, '_A%20b') AS url, NULL AS pid, concat('w ', i, ' A b') AS title FROM o WHERE source_id % 2 = 0
UNION ALL SELECT source_id, concat('https://s', source_id, '.example.com/products/Plane_', i, '/', long), CAST(long AS VARCHAR), concat('Plane ', i) FROM o WHERE source_id % 2 = 1
UNION ALL SELECT DISTINCT source_id, concat('https://s', source_id, '.example.com/products/short/123'), NULL, 'short' FROM o WHERE source_id % 2 = 1""",
    "src_wix_sitemap": f"""WITH m AS (SELECT DISTINCT source_id, i - CASE WHEN i = 90 THEN 1 ELSE 0 END AS i FROM ({MAPS}) x), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS place FROM m)
SELECT source_id, place // 20 AS page, CAST(place AS INT) AS place, concat('https://w', source_id, '.example.com/product-page/plane-', i, CASE WHEN source_id % 3 <> 0 THEN '?currency=INR' ELSE '' END) AS url, concat('plane ', i) AS title FROM r""",
    "t_rolling_quota_anchored": """WITH RECURSIVE u AS (SELECT user_id, event_id, ts, event_id % 4 + 1 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_id % 4 + 1 <= 3)
, w(user_id, n, event_id, start, spent) AS (SELECT user_id, n, event_id, ts, cost FROM u WHERE n = 1
  UNION ALL SELECT u.user_id, u.n, u.event_id, CASE WHEN ts - start >= INTERVAL 24 HOUR THEN ts ELSE start END, CASE WHEN ts - start >= INTERVAL 24 HOUR THEN cost ELSE spent + cost END FROM w JOIN u ON u.user_id = w.user_id AND u.n = w.n + 1)
SELECT user_id, event_id, start, CAST(spent AS BIGINT) AS spent FROM w WHERE spent <= 3""",
}
