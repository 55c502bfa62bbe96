"""Landed pages and feeds made of parts, parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.operators import stats as S
from stratacat.plans.facts import maker_span_sql
from stratacat.sources import feeds, pages
from stratacat.views import derived, spread, table

_PRICE = "CAST(floor(p_retailprice) AS BIGINT)"
#: A page of each shop system per part, some with several signals, so that precedence shows.
_LD = f"""concat('<script type="application/ld+json">{{"@type":"Product","offers":[{{"price":"', {_PRICE}, '","priceCurrency":"', CASE WHEN p_size % 4 = 0 THEN 'USD' ELSE 'INR' END, '","availability":"https://schema.org/', CASE WHEN p_size % 2 = 0 THEN 'InStock' ELSE 'OutOfStock' END, '"}}]}}</script>')"""
_CART = f"""concat('<div class="theme-product-price"> ₹ ', {_PRICE}, '</div><button class="x theme-cart-button y">', '</button>')"""
_WOO = f"""concat('<form data-product_variations="[{{&quot;variation_id&quot;:', p_partkey, ',&quot;attributes&quot;:{{&quot;c&quot;:&quot;PNP&quot;}},&quot;display_price&quot;:', {_PRICE}, ',&quot;is_in_stock&quot;:', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}},{{&quot;variation_id&quot;:1,&quot;attributes&quot;:{{}},&quot;display_price&quot;:', {_PRICE} + 100, ',&quot;is_in_stock&quot;:', CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END, '}}]">')"""
_SHOP = f"""concat('<span class="price">Rs. ', {_PRICE}, '</span>', CASE WHEN p_size % 2 = 0 THEN '<a>Add to Cart</a>' ELSE '<a>Add to cart</a> Out of stock' END)"""
PAGE = f"""SELECT p_partkey AS id, p_size, CAST(CASE p_partkey % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL ELSE 200 END AS INT) AS status,
CASE p_partkey % 7 WHEN 0 THEN 'magento' WHEN 1 THEN 'woocommerce' WHEN 2 THEN 'woocommerce' ELSE 'zoho' END AS platform, {_PRICE} AS price,
concat('<html><title>', p_name, ' - Best  Shop</title>', CASE WHEN p_partkey % 13 = 0 THEN 'Checking your browser' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN concat('<meta property="og:image" content="https://i/', p_partkey, '.jpg">') ELSE '' END,
CASE p_partkey % 7 WHEN 0 THEN concat({_SHOP}, {_LD}) WHEN 1 THEN concat({_WOO}, {_LD}) WHEN 2 THEN {_LD} WHEN 3 THEN concat({_LD}, {_CART}) WHEN 4 THEN {_CART} WHEN 5 THEN 'nothing' ELSE '<script type="application/ld+json">broken</script>' END) AS html FROM part"""
LISTED = f"""SELECT p_partkey AS n, p_partkey % 50 AS source_id, CAST(floor(p_partkey / 500) AS INT) + 1 AS page, p_size, {_PRICE} AS price,
concat('<a title="x" class="product-image" href="https://', CASE WHEN p_partkey % 17 = 0 THEN 'other' ELSE 'shop' END, '.example.com/p', p_partkey, '.html"><img src="i', p_partkey, '.jpg"></a><h2 class="product-name"><a>A &amp;  ', p_name, '</a></h2><div id="product-price-', p_partkey - CASE WHEN p_partkey % 100 = 50 THEN 50 ELSE 0 END, '"></div>', {_SHOP}) AS item FROM part"""


def _listed(s, d):
    """Listing pages of ten products, the first page of every third source served twice."""
    items = derived(s, d, LISTED)
    whole = items.groupBy("source_id", "page").agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), "")).alias("html"))  # ten a page
    again = whole.filter("page = 1 AND source_id % 3 = 0").withColumn("page", F.lit(2))
    rest = whole.join(again.select("source_id", "page"), ["source_id", "page"], "left_anti")
    return rest.unionByName(again.select(*rest.columns)).withColumn("home_url", F.lit("https://shop.example.com"))


def _listing(s, d):
    return pages.magento_listing(_listed(s, d)).select("source_id", "page", "pid", "url", "title", "price", "stock", "image")


def _paged(s, d):
    return pages.until_repeated(pages.magento_listing(_listed(s, d))).select("source_id", "page", "pid")


def _parsed(s, d):
    p = derived(s, d, PAGE, part=spread(table(s, d, "part"), "p_partkey"))
    return p.select("id", F.explode(F.array(pages.parse_page(F.col("html"), F.col("platform")))).alias("p")).select("id", "p.title", "p.image", "p.price", "p.stock", "p.quote_only", "p.via", F.size("p.variants").alias("n_variants"))


def _store(s, d):
    """Store pages of twenty products each."""
    variant = F.struct((F.col("p_partkey") * 10).cast("string").alias("id"), F.lit("A").alias("title"), F.col("p_retailprice").cast("string").alias("price"), (F.col("p_size") % 2 == 0).alias("available"))
    second = F.struct((F.col("p_partkey") * 10 + 1).cast("string").alias("id"), F.lit("B").alias("title"), F.lit("1").alias("price"), (F.col("p_size") % 3 == 0).alias("available"))
    title = F.concat("p_name", F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), (F.col("p_size") * 50).cast("string"), F.lit("mm"))).otherwise(""))
    product = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("h"), "p_partkey").alias("handle"), title.alias("title"), F.lit("<p>Wing span: 1200 mm<br>of foam</p>").alias("body_html"), F.col("p_type").alias("product_type"),
        F.array(F.struct(F.concat(F.lit("i"), "p_partkey").alias("src"))).alias("images"), F.array(variant, second).alias("variants"),
    )
    rows = table(s, d, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("g")).agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("json"))
    return rows.select((F.col("g") % 7).alias("source_id"), F.lit("https://shop.example.com").alias("origin"), F.lit("maker.example.com").alias("domain"), "json")


def _dispatched(s, d):
    woo = table(s, d, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.lit("woocommerce").alias("platform"), F.lit("https://w.example.com").alias("home_url"), F.lit(1).alias("page"),
        F.concat(F.lit('[{"id":"'), "s_suppkey", F.lit('","permalink":"https://w.example.com/x","name":"'), "s_name", F.lit('","is_in_stock":true,"prices":{"price":"12300","currency_minor_unit":2}}]')).alias("payload"),
    )
    shop = _store(s, d).select((F.col("source_id") + 1000).alias("source_id"), F.lit("shopify").alias("platform"), F.col("origin").alias("home_url"), F.lit(1).alias("page"), F.col("json").alias("payload"))
    listed = _listed(s, d).select((F.col("source_id") + 2000).alias("source_id"), F.lit("magento").alias("platform"), "home_url", "page", F.col("html").alias("payload"))
    other = listed.withColumn("platform", F.lit("unknown"))
    return pages.dispatch(woo.unionByName(shop).unionByName(listed).unionByName(other)).select("source_id", "pid", "url", "title", "price", "stock", "image")


def _maker_pages(s, d):
    node = """concat('<html><head><meta name="description" content="Span text"></head><script type="application/ld+json">', CASE p_size % 3 WHEN 0 THEN '{"@graph":[{"@type":"WebPage"},' ELSE '' END, '{"@type":"', CASE WHEN p_partkey % 5 = 0 THEN 'Offer' ELSE 'Product' END, '","name":"', p_name, ' ', p_size * 20, 'mm"',
CASE p_size % 2 WHEN 0 THEN concat(',"sku":"S', p_partkey, '","brand":{"name":"', p_brand, '"}') ELSE concat(',"description":"<b>Light</b> foam","brand":"', p_brand, '"') END, '}', CASE p_size % 3 WHEN 0 THEN ']}' ELSE '' END, '</script></html>')"""
    return pages.maker_jsonld(derived(s, d, f"SELECT concat('https://m.example.com/', p_partkey) AS url, {node} AS html FROM part"))


def _feed(s, d):
    """Video feeds of fifty events each."""
    e = """SELECT event_id, concat('<entry><yt:videoId>', CASE WHEN event_id % 20 = 0 THEN '' ELSE CAST(event_id AS STRING) END, '</yt:videoId><title>T &amp; ', event_type, '</title><published>2024-01-01T00:00:00Z</published><media:starRating count="', event_id % 50, '"/><media:statistics views="', event_id % 1000, '"/></entry>') AS x FROM events"""
    xml = derived(s, d, e).groupBy(F.floor(F.col("event_id") / 50).alias("g")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("x"), ""), F.lit("</feed>")).alias("xml"))
    return feeds.atom_entries(xml)


def _rollup(s, d):
    rows = _feed(s, d).select(F.col("video_id").cast("long").alias("video_id"), "views", "likes", F.unix_millis("published").alias("published_ms"))
    return S.feed_rollup(rows, 1_704_067_200_000 + 1000)


QUERIES = {
    "k_page_parse": _parsed,
    "src_page_check": lambda s, d: derived(s, d, PAGE).select("id", pages.read_state(F.col("status"), F.col("html")).alias("state")),
    "f_woo_variants": lambda s, d: derived(s, d, PAGE).select("id", F.explode(pages.woo_variants(F.col("html"))).alias("v")).select("id", "v.*"),
    "f_jsonld_product": lambda s, d: derived(s, d, PAGE).select("id", feeds.jsonld_product(F.col("html")).alias("p")).filter("p IS NOT NULL").select("id", "p.price", "p.stock"),
    "f_cart_signals": lambda s, d: derived(s, d, PAGE).select("id", feeds.cart_signals(F.col("html")).alias("p")).filter("p IS NOT NULL").select("id", "p.price", "p.stock"),
    "f_meta_content": lambda s, d: derived(s, d, PAGE).select("id", feeds_meta(F.col("html")).alias("image")),
    "src_magento_list": _listing,
    "src_magento_paging": _paged,
    "src_shopify_feed": lambda s, d: feeds.shopify(_store(s, d)).select("source_id", "pid", "url", "title", "price", "stock", "image", F.size("variants").alias("n_variants")),
    "src_mfr_shopify": lambda s, d: pages.maker_shopify(_store(s, d)).select("ext_id", "title", "product_type", "url", "body", F.get("images", F.lit(0)).alias("image"), "span"),
    "src_mfr_jsonld_sitemap": lambda s, d: _maker_pages(s, d).select("ext_id", "title", "url", "body", "brand", "span"),
    "src_feed_dispatch": _dispatched,
    "src_rss_xml": lambda s, d: _feed(s, d).withColumn("published", F.to_date("published")),
    "k_feed": _rollup,
}


def feeds_meta(html):
    return pages.meta_content(html, "og:image")


_OK = f"({PAGE})"
_STOCK2, _INR = "CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END", "p_size % 4 <> 0"
_VIA = f"""CASE id % 7 WHEN 0 THEN 'magento' WHEN 1 THEN 'variants' WHEN 2 THEN CASE WHEN {_INR} THEN 'jsonld' ELSE 'quote' END WHEN 3 THEN CASE WHEN {_INR} THEN 'jsonld' ELSE 'cart' END WHEN 4 THEN 'cart' ELSE 'quote' END"""
_ITEM = f"""(SELECT * FROM ({LISTED}))"""
_PAGED = f"""SELECT l.*, CASE WHEN page = 1 AND source_id % 3 = 0 THEN 2 ELSE page END AS copy FROM {_ITEM} l"""
#: Listing rows: every page, and the first of every third source as its second too.
_ROWS = f"""(SELECT source_id, page, n, p_size, price, item FROM {_ITEM} WHERE NOT (page = 2 AND source_id % 3 = 0) UNION ALL SELECT source_id, 2, n, p_size, price, item FROM {_ITEM} WHERE page = 1 AND source_id % 3 = 0)"""
_OWN = f"""(SELECT *, CAST(n - CASE WHEN n % 100 = 50 THEN 50 ELSE 0 END AS VARCHAR) AS pid, row_number() OVER (PARTITION BY source_id, page, n - CASE WHEN n % 100 = 50 THEN 50 ELSE 0 END ORDER BY n) AS k FROM {_ROWS} WHERE n % 17 <> 0)"""
_STORE = "(SELECT *, CAST(floor(p_partkey / 20) AS BIGINT) % 7 AS source_id, concat(p_name, CASE WHEN p_size % 4 = 0 THEN concat(' ', p_size * 50, 'mm') ELSE '' END) AS title FROM part)"
_ANY2 = "CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN 1 ELSE 0 END"
ORACLE = {
    "k_page_parse": f"""WITH p AS (SELECT *, {_VIA} AS via FROM {_OK} x)
SELECT p.id, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title, CASE WHEN id % 2 = 0 THEN concat('https://i/', id, '.jpg') END AS image,
CASE via WHEN 'variants' THEN CASE WHEN p.p_size % 2 = 0 THEN price WHEN p.p_size % 3 = 0 THEN price + 100 END WHEN 'quote' THEN NULL ELSE price END AS price,
CASE via WHEN 'variants' THEN CASE WHEN p.p_size % 2 = 0 OR p.p_size % 3 = 0 THEN 1 ELSE 0 END WHEN 'quote' THEN 0 WHEN 'cart' THEN 1 ELSE CASE WHEN p.p_size % 2 = 0 THEN 1 ELSE 0 END END AS stock,
via = 'quote' AS quote_only, via, CASE WHEN via = 'variants' THEN 2 ELSE 0 END AS n_variants FROM p JOIN part ON p_partkey = id""",
    "src_page_check": f"SELECT id, CASE WHEN status = 404 THEN 'gone' WHEN coalesce(status, 0) <> 200 OR id % 13 = 0 THEN 'blocked' ELSE 'ok' END AS state FROM {_OK}",
    "f_woo_variants": f"""SELECT id, CAST(id AS VARCHAR) AS vkey, 'PNP' AS label, price, {_STOCK2} AS stock FROM {_OK} WHERE id % 7 = 1 UNION ALL SELECT id, '1', 'Standard', price + 100, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END FROM {_OK} WHERE id % 7 = 1""",
    "f_jsonld_product": f"SELECT id, price, {_STOCK2} AS stock FROM {_OK} WHERE id % 7 < 4 AND {_INR}",
    "f_cart_signals": f"SELECT id, price, 1 AS stock FROM {_OK} WHERE id % 7 IN (3, 4)",
    "f_meta_content": f"SELECT id, CASE WHEN id % 2 = 0 THEN concat('https://i/', id, '.jpg') END AS image FROM {_OK}",
    "src_magento_list": f"""SELECT source_id, page, pid, concat('https://shop.example.com/p', n, '.html') AS url, concat('A & ', trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS title, price, CASE WHEN o.p_size % 2 = 0 THEN 1 ELSE 0 END AS stock, concat('i', n, '.jpg') AS image
FROM {_OWN} o JOIN part ON p_partkey = n WHERE k = 1""",
    "src_magento_paging": f"""WITH o AS (SELECT * FROM {_OWN} WHERE k = 1), f AS (SELECT source_id, page, arg_min(pid, n) AS first FROM o GROUP BY 1, 2)
, g AS (SELECT *, CASE WHEN first = lag(first) OVER w OR page <> row_number() OVER w OR page > 8 THEN 1 ELSE 0 END AS stop FROM f WINDOW w AS (PARTITION BY source_id ORDER BY page)), h AS (SELECT *, sum(stop) OVER (PARTITION BY source_id ORDER BY page) AS stops FROM g)
SELECT o.source_id, o.page, pid FROM o JOIN h ON h.source_id = o.source_id AND h.page = o.page WHERE stops = 0""",
    "src_shopify_feed": f"""SELECT source_id, CAST(p_partkey AS VARCHAR) AS pid, concat('https://shop.example.com/products/h', p_partkey) AS url, title, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS price, {_ANY2} AS stock, concat('i', p_partkey) AS image, 2 AS n_variants FROM {_STORE}""",
    "src_mfr_shopify": f"""SELECT concat('sh:', p_partkey) AS ext_id, title, p_type AS product_type, concat('https://maker.example.com/products/h', p_partkey) AS url, 'Wing span: 1200 mm of foam' AS body, concat('i', p_partkey) AS image, coalesce({maker_span_sql('title')}, 1200) AS span FROM {_STORE}""",
    "src_mfr_jsonld_sitemap": f"""WITH x AS (SELECT *, concat(p_name, ' ', p_size * 20, 'mm') AS name, CASE WHEN p_size % 2 = 0 THEN 'Span text' ELSE 'Light foam' END AS body FROM part WHERE p_partkey % 5 <> 0)
SELECT CASE WHEN p_size % 2 = 0 THEN concat('ld:S', p_partkey) ELSE concat('ld:https://m.example.com/', p_partkey) END AS ext_id, name AS title, concat('https://m.example.com/', p_partkey) AS url, body, p_brand AS brand, {maker_span_sql("concat(name, ' ', body)")} AS span FROM x""",
    "src_feed_dispatch": f"""SELECT s_suppkey AS source_id, CAST(s_suppkey AS VARCHAR) AS pid, 'https://w.example.com/x' AS url, s_name AS title, 123 AS price, 1 AS stock, NULL AS image FROM supplier
UNION ALL SELECT source_id + 1000, CAST(p_partkey AS VARCHAR), concat('https://shop.example.com/products/h', p_partkey), title, CAST(floor(p_retailprice + 0.5) AS BIGINT), {_ANY2}, concat('i', p_partkey) FROM {_STORE}
UNION ALL SELECT source_id + 2000, pid, concat('https://shop.example.com/p', n, '.html'), concat('A & ', trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), price, CASE WHEN o.p_size % 2 = 0 THEN 1 ELSE 0 END, concat('i', n, '.jpg') FROM {_OWN} o JOIN part ON p_partkey = n WHERE k = 1""",
    "src_rss_xml": """SELECT CAST(event_id AS VARCHAR) AS video_id, concat('T & ', event_type) AS title, DATE '2024-01-01' AS published, event_id % 1000 AS views, event_id % 50 AS likes FROM events WHERE event_id % 20 <> 0""",
    "k_feed": """WITH f AS (SELECT event_id, event_id % 1000 AS views, event_id % 50 AS likes FROM events WHERE event_id % 20 <> 0)
SELECT count(*) AS in_feed, CAST(sum(views) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes, count(*) AS recent, (SELECT string_agg(event_id, ',' ORDER BY views DESC, event_id) FROM (SELECT * FROM f ORDER BY views DESC, event_id LIMIT 10)) AS top FROM f""",
}
