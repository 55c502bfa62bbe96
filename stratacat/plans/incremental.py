"""Incremental operators and feeds over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.operators import upsert as U
from stratacat.plans.identity import _CLUSTER, _clusters
from stratacat.sources import feeds
from stratacat.streaming import catalog as ST
from stratacat.views import master, table, with_views

NOW = 1_735_689_600_000


def stored(s, d):
    """Skus before a scan: one per part, at one of ten sources."""
    k = F.col("p_partkey")
    return table(s, d, "part").select(
        (k % 10).alias("source_id"), F.when(k % 4 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("pid"), F.concat(F.lit("https://shop/"), k.cast("string")).alias("url"), F.col("p_name").alias("title"),
        F.when(k % 6 != 0, F.floor("p_retailprice").cast("bigint")).alias("price"), (k % 2).cast("int").alias("stock"), F.when(k % 3 == 0, "new").otherwise("approved").alias("review_status"), F.lit(None).cast("string").alias("flag"),
        F.lit(NOW - 10).cast("bigint").alias("first_seen"), F.lit(NOW - 10).cast("bigint").alias("last_seen"), F.lit(1).alias("misses"), (k % 17 == 0).cast("int").alias("dead"),
    )


def scanned(s, d):
    """What a scan sees: parts again with other prices, some moved to a new URL or to another's, some with another pid at an old URL, some new."""
    k = F.col("p_partkey")
    return table(s, d, "part").filter("p_partkey % 5 <> 0").select(
        (k % 10).alias("source_id"),
        F.when(k % 8 == 0, None).when(k % 11 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("pid"),
        F.when(k % 23 == 0, F.concat(F.lit("https://shop/"), (k + 10).cast("string"))).when(k % 7 == 0, F.concat(F.lit("https://shop/new/"), k.cast("string"))).otherwise(F.concat(F.lit("https://shop/"), k.cast("string"))).alias("url"),
        F.concat("p_name", F.lit(" v2")).alias("title"), F.when(k % 9 != 0, F.floor("p_retailprice").cast("bigint") + k % 3).alias("price"), F.when(k % 13 != 0, (k % 4 == 1).cast("int")).alias("stock"),
    )


def _scan(s, d):
    return ST.scan_upsert(stored(s, d), scanned(s, d), NOW)


def _verify(s, d):
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = table(s, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("sku_key"), F.floor("l_extendedprice").cast("bigint").alias("price"), (k % 2).cast("int").alias("stock"),
        F.when(k % 7 == 0, "missing").alias("flag"), (k % 4).cast("int").alias("misses"), F.lit(0).alias("dead"), (F.lit(NOW) - (k % 48) * ST.HOUR_MS).alias("last_seen_ms"),
        F.when(k % 5 == 0, "blocked").when(k % 5 == 1, "gone").when(k % 5 == 2, "missing").otherwise("ok").alias("state"), (k % 3 == 0).alias("quote_only"),
        F.when(k % 9 != 0, F.floor(F.col("l_extendedprice") * (1 + F.col("l_discount") * 4)).cast("bigint")).alias("r_price"), (k % 3 == 1).cast("int").alias("r_stock"),
    ).dropDuplicates(["sku_key"])
    reads = rows.select("sku_key", "state", "quote_only", F.col("r_price").alias("price"), F.col("r_stock").alias("stock"))
    return ST.verify(rows.drop("state", "quote_only", "r_price", "r_stock"), reads, NOW).filter("sku_key IS NOT NULL")


def _upsert(s, d):
    k = F.col("c_custkey")
    c = table(s, d, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.floor("c_acctbal").cast("bigint").alias("balance"), (k % 5 == 0).alias("decided"))
    n = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.floor("s_acctbal").cast("bigint").alias("balance"), F.lit(False).alias("decided"))
    more = n.union(n.select((F.col("id") + 1_000_000).alias("id"), "name", "balance", "decided"))
    return U.upsert(c, more, ["id"], {"name": "new", "balance": "max", "decided": "old"}, F.col("decided"))


def _ignore(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ref"))
    c = table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("bigint").alias("ref"))
    return U.insert_ignore(c, o, ["id"], [F.col("ref")])


def _merge(s, d):
    m = master(s, d).select("id", "name", "span_mm", "power", "pop_score", (F.col("status") == "ready").alias("ready"))
    return U.merge_rows(m, _clusters(s, d), "id", {"name": "own", "span_mm": "fill", "power": "fill", "pop_score": "max", "ready": "any"})


def _woo(s, d):
    """Supplier feeds made of lines: JSON pages of a supplier and a thousand order keys, parsed again. More lines make more pages, not longer ones."""
    price = (F.round(F.col("l_extendedprice") * 100)).cast("bigint")
    item = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.concat(F.lit("https://Shop.example.com/p/"), F.col("l_partkey"), F.lit("/?utm_source=x&b=2&a=1#t")).alias("permalink"), F.concat(F.lit("A &amp; <b>"), F.col("l_partkey")).alias("name"),
        (F.col("l_linenumber") % 2 == 0).alias("is_in_stock"), F.struct(F.when(F.col("l_linenumber") == 3, "0").otherwise(price.cast("string")).alias("price"), F.lit(2).alias("currency_minor_unit")).alias("prices"),
    )
    pages = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.floor(F.col("l_orderkey") / 1000).alias("page")).agg(F.to_json(F.collect_list(item)).alias("json"))
    return feeds.woocommerce(pages).select("source_id", "pid", "url", "title", "price", "stock")


def _sitemaps(s, d):
    """Sitemaps of a thousand page ids each, parsed again."""
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    return feeds.sitemap_urls(table(s, d, "pages").groupBy(F.floor(F.col("page_id") / 1000).alias("g")).agg(F.concat_ws("", F.collect_list(loc)).alias("xml")))


def _hash_gate(s, d):
    p = table(s, d, "pages")
    old = p.filter("page_id % 2 = 0").select("page_id", F.sha2(F.when(F.col("page_id") % 4 == 0, F.col("html")).otherwise(F.lit("other")), 256).alias("hash"))
    return ST.hash_gate(old, p, "page_id").select("page_id", "hash")


def _windows(s, d):
    return ST.windowed_counts(table(s, d, "events")).select(F.to_date("start").alias("d"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {
    "k_scan_upsert": lambda s, d: _scan(s, d)[0],
    "k_scan_observations": lambda s, d: _scan(s, d)[1],
    "k_verify": _verify,
    "sink_upsert_guarded": _upsert,
    "sink_insert_ignore": _ignore,
    "k_merge": _merge,
    "src_woo_feed": _woo,
    "src_sitemap_urls": _sitemaps,
    "src_platform_probe": lambda s, d: table(s, d, "pages").select(F.coalesce(feeds.platform_of(F.col("html")), F.lit("none")).alias("platform")).groupBy("platform").agg(F.count("*").alias("n")),
    "t_hash_gate": _hash_gate,
    "t_windowed_counts": _windows,
}
_ROW = """k AS (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem)
, r AS (SELECT DISTINCT ON (sku_key) * FROM (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS sku_key, CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(k % 2 AS INT) AS stock,
  CASE WHEN k % 7 = 0 THEN 'missing' END AS flag, CAST(k % 4 AS INT) AS misses, 0 AS dead, k % 48 AS hours, CASE k % 5 WHEN 0 THEN 'blocked' WHEN 1 THEN 'gone' WHEN 2 THEN 'missing' ELSE 'ok' END AS state,
  k % 3 = 0 AS quote_only, CASE WHEN k % 9 <> 0 THEN CAST(floor(l_extendedprice * (1 + l_discount * 4)) AS BIGINT) END AS r_price, CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END AS r_stock FROM k))
, a AS (SELECT *, CASE WHEN state = 'blocked' THEN 'checked' WHEN state = 'gone' AND hours >= 24 THEN CASE WHEN misses + 1 >= 3 THEN 'dead' ELSE 'miss' END
  WHEN quote_only AND r_price IS NULL AND price IS NOT NULL THEN 'missing' WHEN state IN ('missing', 'gone') THEN 'missing'
  WHEN coalesce(price, 0) <> 0 AND coalesce(r_price, 0) <> 0 AND abs(r_price - price) / price > 0.25 THEN 'price-jump' ELSE 'write' END AS action FROM r)"""
_SCAN = f"""WITH s AS (SELECT p_partkey % 10 AS source_id, CASE WHEN p_partkey % 4 <> 0 THEN concat('p', p_partkey) END AS pid, concat('https://shop/', p_partkey) AS url, p_name AS title, CASE WHEN p_partkey % 6 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS price,
  CAST(p_partkey % 2 AS INT) AS stock, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'approved' END AS review_status, CAST({NOW - 10} AS BIGINT) AS seen, CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE 0 END AS dead FROM part)
, p AS (SELECT p_partkey % 10 AS source_id, CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN concat('x', p_partkey) ELSE concat('p', p_partkey) END AS pid,
  CASE WHEN p_partkey % 23 = 0 THEN concat('https://shop/', p_partkey + 10) WHEN p_partkey % 7 = 0 THEN concat('https://shop/new/', p_partkey) ELSE concat('https://shop/', p_partkey) END AS url, concat(p_name, ' v2') AS title,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) + p_partkey % 3 END AS price, CASE WHEN p_partkey % 13 <> 0 THEN CASE WHEN p_partkey % 4 = 1 THEN 1 ELSE 0 END END AS stock FROM part WHERE p_partkey % 5 <> 0)
, h AS (SELECT p.*, a.url AS a_url, b.url AS b_url, coalesce(a.url, b.url) AS k, a.url IS NULL AND b.url IS NOT NULL AND p.pid IS NOT NULL AND b.pid IS NOT NULL AND p.pid <> b.pid AS reused, coalesce(a.url <> b.url, false) AS clash
  FROM p LEFT JOIN s a ON a.source_id = p.source_id AND a.pid = p.pid LEFT JOIN s b ON b.source_id = p.source_id AND b.url = p.url)
, one AS (SELECT *, row_number() OVER (PARTITION BY source_id, k ORDER BY reused, pid NULLS LAST, url) AS n FROM h WHERE k IS NOT NULL)
, j AS (SELECT s.*, o.pid AS p_pid, o.url AS p_url, o.title AS p_title, o.price AS p_price, o.stock AS p_stock, coalesce(o.reused, false) AS taken, coalesce(o.clash, false) AS clash, o.url IS NOT NULL AND NOT coalesce(o.reused, false) AS used FROM s LEFT JOIN one o ON o.source_id = s.source_id AND o.k = s.url AND o.n = 1)
, f1 AS (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY pid NULLS LAST, title) AS n FROM h WHERE k IS NULL)
, f2 AS (SELECT *, row_number() OVER (PARTITION BY source_id, coalesce(pid, url) ORDER BY url) AS turn FROM f1 WHERE n = 1)
, fresh AS (SELECT * FROM f2 WHERE turn = 1)"""
ORACLE = {
    "k_scan_upsert": f"""{_SCAN} SELECT source_id, CASE WHEN used THEN coalesce(pid, p_pid) ELSE pid END AS pid, CASE WHEN used AND NOT clash THEN p_url ELSE url END AS url, CASE WHEN used AND review_status = 'new' THEN p_title ELSE title END AS title,
CASE WHEN used THEN coalesce(p_price, price) ELSE price END AS price, CASE WHEN used THEN coalesce(p_stock, stock) ELSE stock END AS stock, review_status, CASE WHEN taken THEN 'missing' WHEN used AND clash THEN 'url-collision' END AS flag,
seen AS first_seen, CASE WHEN used THEN {NOW} ELSE seen END AS last_seen, CASE WHEN used THEN 0 ELSE 1 END AS misses, CASE WHEN used THEN 0 ELSE dead END AS dead FROM j
UNION ALL SELECT source_id, pid, url, title, price, stock, 'new', NULL, {NOW}, {NOW}, 0, 0 FROM fresh""",
    "k_scan_observations": f"""{_SCAN} SELECT source_id, url, p_price AS price, p_stock AS stock, CAST({NOW} AS BIGINT) AS "at" FROM j WHERE used AND ((p_price IS NOT NULL AND p_price IS DISTINCT FROM price) OR (p_stock IS NOT NULL AND p_stock <> coalesce(stock, 0)))
UNION ALL SELECT source_id, url, price, stock, {NOW} FROM fresh""",
    "k_verify": f"""WITH {_ROW} SELECT sku_key, action, CASE WHEN action = 'write' THEN coalesce(r_price, price) ELSE price END AS price, CASE WHEN action = 'write' THEN coalesce(r_stock, stock) ELSE stock END AS stock,
CASE WHEN action IN ('missing', 'price-jump') THEN action WHEN action = 'write' AND flag = 'missing' THEN NULL ELSE flag END AS flag,
CASE WHEN action IN ('miss', 'dead') THEN misses + 1 WHEN action = 'write' THEN 0 ELSE misses END AS misses, CASE WHEN action = 'dead' THEN 1 WHEN action = 'write' THEN 0 ELSE dead END AS dead FROM a""",
    "sink_upsert_guarded": """WITH c AS (SELECT c_custkey AS id, c_name AS name, CAST(floor(c_acctbal) AS BIGINT) AS balance, c_custkey % 5 = 0 AS decided FROM customer)
, s AS (SELECT s_suppkey AS id, s_name AS name, CAST(floor(s_acctbal) AS BIGINT) AS balance FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, CAST(floor(s_acctbal) AS BIGINT) FROM supplier)
SELECT coalesce(c.id, s.id) AS id, CASE WHEN c.id IS NULL OR (s.id IS NOT NULL AND NOT c.decided) THEN s.name ELSE c.name END AS name,
CASE WHEN c.id IS NULL THEN s.balance WHEN s.id IS NOT NULL AND NOT c.decided THEN greatest(c.balance, s.balance) ELSE c.balance END AS balance, coalesce(c.decided, false) AS decided FROM c FULL JOIN s ON c.id = s.id""",
    "sink_insert_ignore": """SELECT c_custkey AS id, CAST(-1 AS BIGINT) AS ref FROM customer WHERE c_custkey % 2 = 0 UNION ALL
SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1""",
    "k_merge": with_views(
        _CLUSTER
        + """, t AS (SELECT m.*, coalesce(survivor, m.id) AS target FROM v_master m LEFT JOIN cl ON cl.id = m.id), u AS (SELECT *, CASE WHEN id = target THEN 0 ELSE 1 END AS o FROM t)
SELECT target AS id, max(CASE WHEN o = 0 THEN name END) AS name, arg_min(span_mm, (o, id)) FILTER (WHERE span_mm IS NOT NULL) AS span_mm, arg_min(power, (o, id)) FILTER (WHERE power IS NOT NULL) AS power,
max(pop_score) AS pop_score, max(CASE WHEN status = 'ready' THEN 1 ELSE 0 END) AS ready FROM u GROUP BY target"""
    ).replace("WITH v_master", "WITH RECURSIVE v_master", 1),
    "src_woo_feed": """SELECT l_suppkey AS source_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS pid, concat('https://shop.example.com/p/', l_partkey, '?a=1&b=2') AS url, concat('A & ', l_partkey) AS title,
CASE WHEN l_linenumber <> 3 AND floor(round(l_extendedprice * 100) / 100 + 0.5) > 0 THEN CAST(floor(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 + 0.5) AS BIGINT) END AS price, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS stock FROM lineitem""",
    "src_sitemap_urls": "SELECT DISTINCT url FROM pages",
    "src_platform_probe": """SELECT CASE WHEN regexp_matches(html, '(?i)cdn\\.shopify\\.com|Shopify\\.theme') THEN 'shopify' WHEN regexp_matches(html, '(?i)woocommerce|wp-content') THEN 'woo' WHEN regexp_matches(html, '(?i)data-zs-|zohostratus|zohocommerce') THEN 'zoho'
WHEN regexp_matches(html, '(?i)Magento|mage/') THEN 'magento' WHEN regexp_matches(html, '(?i)wixstatic|wix\\.com') THEN 'wix' ELSE 'none' END AS platform, count(*) AS n FROM pages GROUP BY 1""",
    "t_hash_gate": "SELECT page_id, sha256(html) AS hash FROM pages WHERE page_id % 4 <> 0 AND octet_length(encode(html)) >= 200",
    "t_windowed_counts": "SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
