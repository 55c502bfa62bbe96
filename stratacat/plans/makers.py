"""Makers' pages of six layouts, made of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.sources import makers as M
from stratacat.views import derived, spread, table

PRICE_FREE = "concat('<p>Span ', p_size * 20, 'mm</p><ul><li>foam</li><li>A &amp; B</li></ul><script>var x = 1;</script>')"
#: One page of each part for each layout, and what a shop would wrap around it.
DEEP = f"""SELECT p_partkey AS n, concat('https://deep.example.com/', CASE WHEN p_partkey % 5 = 0 THEN 'planes/' ELSE 'planes/series/' END, 'p', p_partkey) AS url, concat('<html><meta property="og:title" content="', p_name, ' - Deep Shop"><meta content="Short &amp; sweet..." property="og:description"><div id="product-', CASE WHEN p_partkey % 7 = 0 THEN 'list' ELSE 'info' END, '">',
CASE WHEN p_partkey % 2 = 0 THEN concat('<h1 class="x">', p_name, ' <b>II</b></h1>') ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat('<span id="sku" class="s"> S-', p_partkey, ' </span>') ELSE '' END, CASE WHEN p_partkey % 4 <> 3 THEN concat('<div class="tab" id="details" role="x">', {PRICE_FREE}, '<div class="product-list">other</div>') ELSE '' END,
CASE WHEN p_partkey % 2 = 1 THEN concat('<a class="product-cover big" title="t" href="/i/', p_partkey, '.jpg"></a><img data-full-image="//cdn.example.com/', p_partkey, '.png"><img data-full-image="/i/', p_partkey, '.jpg">') ELSE '<meta property="og:image" content="/og.jpg">' END, '</html>') AS html FROM part"""
HEAD = """SELECT p_partkey AS n, concat('https://head.example.com/de/', CASE p_partkey % 4 WHEN 0 THEN 'rr-' WHEN 1 THEN 'kit-' WHEN 2 THEN 'ersatz-' ELSE 'rtf-' END, 'x', CASE WHEN p_partkey % 8 = 1 THEN '-rumpf' ELSE '' END, '-p', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '' END) AS url,
concat('<title> 1-00', p_partkey, ' ', p_name, ' &uuml; | Head | HEAD </title><meta name="Description" content="Made of  ', p_type, ' &#8211; &quot;good&quot;">') AS html FROM part"""
POST = f"""SELECT p_partkey AS n, p_partkey % 9 AS category, p_name, p_size, concat(CASE WHEN p_partkey % 11 = 0 THEN 'servo-' ELSE 'plane-' END, p_partkey) AS slug, {PRICE_FREE} AS content FROM part"""
GRAPH = """SELECT p_partkey AS n, concat('https://graph.example.com/en/', p_partkey, 'bk.html') AS url, concat('<meta property="og:title" content="', p_name, ' - Graph RC">', CASE WHEN p_partkey % 4 < 3 THEN concat('<script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":', CASE WHEN p_partkey % 4 = 1 THEN '["Product","Thing"]' ELSE '"Product"' END, ',"name":"', p_name, ' GP - Graph RC"',
CASE WHEN p_partkey % 4 = 0 THEN concat(',"sku":"G', p_partkey, '","url":"https://graph.example.com/en/real-', p_partkey, '.html","description":"<p>One<br>two</p>"') ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN ',"image":["https://g/1.jpg","https://g/2.jpg"]' WHEN p_partkey % 3 = 1 THEN ',"image":"https://g/one.jpg"' ELSE '' END, '}]}</script>') ELSE '' END,
CASE WHEN p_partkey % 5 = 0 THEN '<script>x({"data": [{"full":"https://g/full.jpg","img":"a"},{"img":"https://g/img.jpg"}], "options": {}})</script>' ELSE '' END, '<meta property="og:description" content="told"><meta property="og:image" content="https://g/og.jpg">') AS html FROM part"""
LINK = f"""SELECT p_partkey AS n, concat('https://link.example.com/xf-', p_partkey, CASE WHEN p_partkey % 6 = 5 THEN '-parts.html' ELSE '-rc-airplane.html' END) AS url, concat('<html><title>', p_name, ', cheap, best</title><!-- x --><a href="xf-', p_partkey + 2, '-RC-Airplane.html">next</a><a href="https://www.LINK.example.com/xf-', p_partkey * 2, '-rc-airplane.html">double</a><a href="https://else.example.com/xf-1-rc-airplane.html">away</a>',
CASE WHEN p_partkey % 2 = 0 THEN concat('<div class="a product_title b"> ', p_name, '&nbsp;<i>Pro</i></div>') ELSE '' END, '<img src="../products/', p_partkey, '.jpg"><img data-src="/products/', p_partkey, '.jpg?x"><img src="/other/1.jpg"><div class="product_des">', {PRICE_FREE}, '</div><div class="w" id="sidebar">nav</div></html>') AS html FROM part"""
LISTED = """SELECT p_partkey AS n, CAST(floor(p_partkey / 40) AS BIGINT) AS page, concat(CASE p_partkey % 4 WHEN 0 THEN 'gas' WHEN 1 THEN 'electric' WHEN 2 THEN 'scale' ELSE 'accessories-x' END, '/m-', p_partkey, '.html') AS href, concat('<div class="Home-Product a"><a title="', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, '" href="', CASE p_partkey % 4 WHEN 0 THEN 'gas' WHEN 1 THEN 'electric' WHEN 2 THEN 'scale' ELSE 'accessories-x' END,
'/m-', p_partkey, '.html"><img class="i" src="/t/', p_partkey, '.jpg"></a></div>') AS item, concat('<meta property="og:title" content="', p_name, ' big, gas - List Models">', CASE WHEN p_partkey % 5 = 0 THEN '<meta name="og:description" content="only told">' ELSE '<article class="c" id="Context"><h2>Head</h2><p>Line one<br/>line two</p></article>' END, CASE WHEN p_partkey % 2 = 0 THEN concat('<img data-zoom-image="/z/', p_partkey, '.jpg"><img data-zoom-image="/z/', p_partkey, '.jpg">') ELSE '' END) AS html FROM part"""

# Where shops of these layouts keep what is read; results depend on them.
DEEP_LAYOUT = M.Layout(
    wanted=r"^/planes/[^/]+/[^/]+", marker=r"id=[\"']product-(info|detail)[\"']", title=[("match", r"(?is)<h1[^>]*>(.*?)</h1>"), ("meta", "og:title")], title_cuts=[r"(?i)\s*-\s*Deep Shop\s*$"],
    body=[("block", r"(?i)id=[\"']details[\"']", r"(?i)<div[^>]*id=[\"']product-category[\"']|<div[^>]*class=[\"']product-list|<script"), ("meta", "og:description")], least_body=20, item="\n- ",
    images=[[("match", r"(?is)class=[\"']product-cover[^\"']*[\"'].*?href=[\"']([^\"']+)[\"']"), ("match", r"(?i)data-full-image=[\"']([^\"']+)[\"']")], [("meta", "og:image")]], ext_id=[("match", r"(?is)id=[\"']sku[\"'][^>]*>(.*?)</span>"), ("url", r"([^/]+)/?$")],
)
HEAD_LAYOUT = M.Layout(
    wanted=r"/de/(rr|rtf|bk|kit|arf|pnp)-.*-p\d+/?$", unwanted="rumpf|ersatz", title=[("match", r"(?is)<title>(.*?)</title>")], title_cuts=[r"(?i)\s*\|\s*Head\s*\|\s*HEAD\s*$", r"^\s*[0-9][0-9-]*\s+"], body=[("meta", "[Dd]escription")], images=[], ext_id=[("url", r"-(p\d+)/?$")], lines=False,
)
POST_LAYOUT = M.Layout(wanted="", title=[("given", "named")], body=[("given", "html")], images=[[("match", r"(?i)<img[^>]+?src=[\"']([^\"']+)[\"']")]], ext_id=[("given", "slug")])
GRAPH_LAYOUT = M.Layout(
    wanted=r"/en/[^/]+\.html$", title=[("ld", "name"), ("meta", "og:title")], title_cuts=[r"(?i)\s*-\s*Graph RC\s*$"], body=[("ld", "description"), ("meta", "og:description")], url=[("ld", "url")], ext_id=[("ld", "sku"), ("ld", "url")],
    images=[[("gallery", r"(?s)\"data\"\s*:\s*(\[\s*\{.*?\}\s*\])\s*,\s*\"options\"")], [("ld", "image")], [("meta", "og:image")]],
)
LINK_LAYOUT = M.Layout(
    wanted=r"^/xf-.*rc-(airplane|jet)\.html?$", title=[("match", r"(?is)<div[^>]*class=[\"'][^\"']*product_title[^\"']*[\"'][^>]*>(.*?)</div>"), ("match", r"(?is)<title>([^<,]*)")], body=[("block", r"(?i)<div[^>]*class=[\"'][^\"']*product_des[^\"']*[\"']", r"(?i)<div[^>]+id=[\"']sidebar[\"']")],
    images=[[("match", r"(?i)(?:src|data-src)\s*=\s*[\"']([^\"'?]*/products/[^\"'?]+\.(?:jpg|jpeg|png|webp|gif))")]], ext_id=[("url", r"([^/]+)\.html?$")],
)
LISTED_LAYOUT = M.Layout(
    wanted=r"\.html$", title=[("given", "listed"), ("meta", "og:title")], title_cuts=[r"(?i)\s*-\s*List Models?\s*$", r",\s*[^,]*$"], body=[("match", r"(?is)<article[^>]*id=[\"']Context[\"'][^>]*>(.*?)</article>"), ("meta", "og:description")],
    images=[[("match", r"(?i)data-zoom-image=[\"']([^\"']+)[\"']")], [("meta", "og:image")], [("given", "thumb")]], ext_id=[("url", r"-(\d+)\.html$")], prefix="li-", tag="",
)
# End of fixed values.


def _pages(sql: str, layout: M.Layout):
    return lambda s, d: _flat(M.read_pages(_spread_pages(s, d, sql), layout))


def _spread_pages(s, d, sql):
    """Pages made of parts on all cores, so that they are also read there."""
    return derived(s, d, sql, part=spread(table(s, d, "part"), "p_partkey")).select("url", "html")


def _flat(rows):
    return rows.select("ext_id", "title", "url", "body", F.array_join("images", " ").alias("images"))


def _posts(s, d):
    rows = derived(s, d, POST)
    post = F.struct(
        F.col("n").alias("id"), "slug", F.concat(F.lit("https://post.example.com/"), "slug", F.lit("/")).alias("link"), F.struct(F.concat("p_name", F.lit(" &#8211; X")).alias("rendered")).alias("title"), F.struct("content").alias("content_"), F.array(F.col("category"), F.lit(77).cast("long")).alias("categories")
    )
    post = post.dropFields("content_").withField("content", F.struct(F.concat("content", F.lit('<img src="/wp/a.jpg">')).alias("rendered")))
    pages = rows.groupBy(F.floor(F.col("n") / 100).alias("page")).agg(F.to_json(F.collect_list(post)).alias("json"))  # a hundred posts a page
    # 1 holds 2, which holds 3; 4 and 5 hold each other; 8 is discontinued
    tree = s.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 5), (5, 4), (6, 0), (7, 4)], "id long, parent long")
    return _flat(M.read_pages(M.posts(pages, tree, [1, 5], 8, "servo|motor"), POST_LAYOUT))


def _linked(s, d):
    pages = _spread_pages(s, d, LINK)
    seeds = s.createDataFrame([('<urlset><url><loc> https://link.example.com/xf-1-rc-airplane.html </loc></url></urlset><a href="/contact.html">c</a>',)], "html string")
    found = M.reached(seeds, pages, LINK_LAYOUT.wanted, "https://link.example.com")
    return _flat(M.read_pages(pages.join(found.hint("merge"), "url", "left_semi"), LINK_LAYOUT))


def _listed(s, d):
    rows = derived(s, d, LISTED)
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), "").alias("h"))  # forty a page
    envelopes = pages.select("page", F.to_json(F.struct(F.concat(F.lit("<div>"), "h", F.lit("</div>")).alias("Data"))).alias("json"))
    base = "https://list.example.com/"
    listed = M.envelope_rows(envelopes, r'(?i)<div class="Home-Product', r"(?i)href=\"([^\"]+\.html)\"", r"(?i)<a[^>]+title=\"([^\"]*)\"", r"(?i)<img[^>]+src=\"([^\"]+)\"", base, "(?i)^accessories")
    html = rows.select(F.concat(F.lit(base), "href").alias("url"), "html")
    read = M.read_pages(listed.join(html, "url", "left").withColumn("html", F.coalesce("html", F.lit(""))), LISTED_LAYOUT)
    return _flat(read).join(listed.select("url", "turn"), "url")


QUERIES = {
    "src_mfr_sitemap_depth": _pages(DEEP, DEEP_LAYOUT),
    "src_mfr_title_meta": _pages(HEAD, HEAD_LAYOUT),
    "src_mfr_posts": _posts,
    "src_mfr_shop_jsonld": _pages(GRAPH, GRAPH_LAYOUT),
    "src_mfr_linked": _linked,
    "src_mfr_envelope": _listed,
}
_TOLD = "concat('Span ', p_size * 20, 'mm\n{0}foam\n{1}A & B')"
ORACLE = {
    "src_mfr_sitemap_depth": f"""SELECT CASE WHEN n % 3 = 0 THEN concat('S-', n) ELSE concat('p', n) END AS ext_id, CASE WHEN n % 2 = 0 THEN concat(p_name, ' II') ELSE p_name END AS title, concat('https://deep.example.com/planes/series/p', n) AS url,
CASE WHEN n % 4 <> 3 THEN concat('Span ', p_size * 20, 'mm\n\n- foam\n\n- A & B') ELSE 'Short & sweet...' END AS body, CASE WHEN n % 2 = 1 THEN concat('https://deep.example.com/i/', n, '.jpg https://cdn.example.com/', n, '.png') ELSE 'https://deep.example.com/og.jpg' END AS images FROM (SELECT *, p_partkey AS n FROM part) WHERE n % 5 <> 0 AND n % 7 <> 0""",
    "src_mfr_title_meta": """SELECT concat('p', n) AS ext_id, concat(p_name, ' &uuml;') AS title, concat('https://head.example.com/de/', CASE n % 4 WHEN 0 THEN 'rr-' WHEN 1 THEN 'kit-' ELSE 'rtf-' END, 'x-p', n, CASE WHEN n % 3 = 0 THEN '/' ELSE '' END) AS url, concat('Made of ', p_type, ' – "good"') AS body, '' AS images
FROM (SELECT *, p_partkey AS n FROM part) WHERE n % 4 <> 2 AND n % 8 <> 1""",
    "src_mfr_posts": """SELECT concat('plane-', n) AS ext_id, concat(p_name, ' – X') AS title, concat('https://post.example.com/plane-', n, '/') AS url, concat('Span ', p_size * 20, 'mm\n\nfoam\n\nA & B') AS body, 'https://post.example.com/wp/a.jpg' AS images FROM (SELECT *, p_partkey AS n FROM part) WHERE n % 9 IN (1, 2, 3, 4, 5, 7, 8) AND n % 11 <> 0""",
    "src_mfr_shop_jsonld": """SELECT CASE WHEN n % 4 = 0 THEN concat('G', n) ELSE concat('https://graph.example.com/en/', n, 'bk.html') END AS ext_id, CASE WHEN n % 4 < 3 THEN concat(p_name, ' GP') ELSE p_name END AS title, concat('https://graph.example.com/en/', CASE WHEN n % 4 = 0 THEN concat('real-', n) ELSE concat(n, 'bk') END, '.html') AS url,
CASE WHEN n % 4 = 0 THEN 'One\ntwo' ELSE 'told' END AS body, CASE WHEN n % 5 = 0 THEN 'https://g/full.jpg https://g/img.jpg' WHEN n % 4 = 3 OR n % 3 = 2 THEN 'https://g/og.jpg' WHEN n % 3 = 0 THEN 'https://g/1.jpg https://g/2.jpg' ELSE 'https://g/one.jpg' END AS images FROM (SELECT *, p_partkey AS n FROM part)""",
    "src_mfr_linked": """WITH RECURSIVE r(n) AS (SELECT 1::BIGINT UNION SELECT m FROM (SELECT unnest([p_partkey + 2, p_partkey * 2])::BIGINT AS m FROM r JOIN part ON p_partkey = r.n AND p_partkey % 6 <> 5))
SELECT concat('xf-', n, '-rc-airplane') AS ext_id, CASE WHEN n % 2 = 0 THEN concat(p_name, ' Pro') ELSE p_name END AS title, concat('https://link.example.com/xf-', n, '-rc-airplane.html') AS url, concat('Span ', p_size * 20, 'mm\n\nfoam\n\nA & B') AS body, concat('https://link.example.com/products/', n, '.jpg') AS images FROM r JOIN part ON p_partkey = n WHERE n % 6 <> 5""",
    "src_mfr_envelope": """SELECT concat('li-', n) AS ext_id, CASE WHEN n % 3 = 0 THEN concat(p_name, ' big') ELSE p_name END AS title, concat('https://list.example.com/', kind, '/m-', n, '.html') AS url, CASE WHEN n % 5 = 0 THEN 'only told' ELSE 'Head\nLine one\nline two' END AS body,
concat('https://list.example.com/', CASE WHEN n % 2 = 0 THEN 'z/' ELSE 't/' END, n, '.jpg') AS images, CAST(row_number() OVER (PARTITION BY kind ORDER BY n) AS INT) AS turn FROM (SELECT *, p_partkey AS n, CASE p_partkey % 4 WHEN 0 THEN 'gas' WHEN 1 THEN 'electric' ELSE 'scale' END AS kind FROM part) WHERE n % 4 <> 3""",
}
