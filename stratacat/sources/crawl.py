"""Listings and sitemaps that lead from page to page, over pages that have landed.

Nothing is fetched: a page that has not landed says nothing. Each round is a join of the addresses to visit with the landed pages, written
to the shared folder; addresses known already drop out by an anti join, so cycles end. Pages hold far more text than Spark takes them for, so
these joins are told to sort both sides: none is sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.durable import cut
from stratacat.functions.text import canonical_url, first_match, let
from stratacat.operators.ranks import dense_ids

# Markup and paths that results depend on.
HREF = r"(?i)href=[\"']([^\"']+)[\"']"
NEXT = [r"(?i)rel=[\"']next[\"'][^>]+href=[\"']([^\"']+)[\"']", r"(?i)<a[^>]+class=\"[^\"]*next[^\"]*\"[^>]+href=\"([^\"]+)\""]
NO_CATEGORY, NO_PRODUCT = r"/(product|products|page|feed|tag|category)(/|$)", r"/(page|category|tag|feed)/"
PRODUCT_PATH = {"zoho": r"^/products/.+", "other": r"^/product/[^/]+/?$"}
LONG_PID = r"/(\d{12,})$"
PRODUCT_SITEMAP, PRODUCT_PAGE = "(?i)store-products-sitemap", r"/product-page/"
# End of fixed values.

QUEUE, PAGE = 20, 20
_SITEMAP = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>"


def _part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def origin(url: Column) -> Column:
    return F.concat(F.lower(_part(url, "PROTOCOL")), F.lit("://"), F.lower(_part(url, "AUTHORITY")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.nullif(_part(url, "PATH"), F.lit("")), F.lit("/"))


def resolve(base: Column, href: Column) -> Column:
    """The address that ``href`` means on the page ``base``, dots in its path worked out; null for other schemes."""
    link = F.trim(href)
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    bare = F.concat(origin(base), path_of(base))
    full = (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.lower(_part(base, "PROTOCOL")), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin(base), link))
        .when(link.startswith("?"), F.concat(bare, link))
        .when((link == "") | link.startswith("#"), F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(origin(base), folder, link))
    )
    return let(full, _without_dots)


def _without_dots(full: Column) -> Column:
    head, path, rest = F.regexp_extract(full, r"^([^:]+://[^/?#]*)", 1), F.regexp_extract(full, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.regexp_extract(full, r"([?#].*)$", 1)

    def fold(done, p):
        return F.when(p == ".", done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(p)))

    def joined(parts):
        clean = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array(F.lit("")), fold)
        return F.concat(F.array_join(clean, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))

    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(head, let(F.split(path, "/"), joined), rest)).otherwise(full)


def title_from_url(url: Column) -> Column:
    """The last part of the path that has a letter, as words; empty if there is none, or for what is no URL."""
    names = F.filter(F.split(path_of(url), "/"), lambda p: p.rlike("(?i)[a-z]") & (p != "products"))
    name = F.element_at(names, -1)
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.when(F.size(names) > 0, F.trim(F.regexp_replace(F.regexp_replace(plain, "[-_]+", " "), r"\s+", " "))).otherwise("")


def _hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))


def crawl(roots: DataFrame, pages: DataFrame, most: int = QUEUE) -> DataFrame:
    """``source_id, root_url, url, place``: the listing pages that each root leads to, in the order of a visit that takes the oldest address first.

    ``roots``: source_id, home_url, root_url; ``pages``: source_id, url (canonical), html. A page leads to its next page and to the addresses below the root's path on
    the shop's own origin, without their queries. A root's queue holds ``most`` addresses, itself included; what comes later is left out.
    """
    rows = roots.select("source_id", "home_url", "root_url")
    queue = cut(rows.select("*", F.col("root_url").alias("url"), F.lit(0).alias("place")))
    fresh = queue
    while True:
        here = fresh.join(pages.select("source_id", "url", "html").hint("merge"), ["source_id", "url"])
        root = F.regexp_replace(path_of(F.col("root_url")), "/$", "")
        follow = F.transform(F.filter(F.array(F.coalesce(*[first_match(F.col("html"), p) for p in NEXT])), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(True).alias("next"), x.alias("href")))
        both = F.concat(follow, F.transform(_hrefs(F.col("html")), lambda x: F.struct(F.lit(False).alias("next"), x.alias("href"))))
        link = lambda x: let(resolve(F.col("url"), x["href"]), lambda to: F.struct(x["next"].alias("next"), to.alias("to"), path_of(to).alias("path"), origin(to).alias("origin")))
        links = here.select("source_id", "home_url", "root_url", F.col("place").alias("parent"), root.alias("root"), F.posexplode(F.transform(both, link)).alias("at", "l"))
        tail = F.substr(F.regexp_replace("l.path", "/$", ""), F.char_length("root") + 1)
        below = (F.col("l.origin") == origin(F.col("home_url"))) & (F.char_length(tail) > 1) & F.col("l.path").startswith(F.concat("root", F.lit("/"))) & ~tail.rlike(NO_CATEGORY)
        bare = F.when(F.col("l.next"), F.col("l.to")).when(below, F.regexp_replace("l.to", r"[?#].*$", ""))
        found = links.select("source_id", "home_url", "root_url", bare.alias("bare"), "parent", "at").filter("bare IS NOT NULL")
        found = found.select("source_id", "home_url", "root_url", let(F.col("bare"), canonical_url).alias("url"), "parent", "at").filter("url IS NOT NULL")
        first = found.groupBy("source_id", "home_url", "root_url", "url").agg(F.min(F.struct("parent", "at")).alias("seen"))
        new = first.join(queue.select("source_id", "root_url", "url").hint("merge"), ["source_id", "root_url", "url"], "left_anti")
        # a root has at most so many pages, whose links are ranked here
        known = queue.groupBy("source_id", "root_url").agg(F.count("*").alias("known"))
        order = F.row_number().over(Window.partitionBy("source_id", "root_url").orderBy("seen"))
        fresh = cut(new.join(known.hint("merge"), ["source_id", "root_url"]).withColumn("place", F.col("known") + order - 1).filter(F.col("place") < most).select("source_id", "home_url", "root_url", "url", "place"))
        if fresh.isEmpty():
            return queue.select("source_id", "root_url", "url", "place")
        queue = cut(queue.unionByName(fresh.select(*queue.columns)))


def listed_products(roots: DataFrame, pages: DataFrame, most: int = QUEUE) -> DataFrame:
    """``source_id, url, pid, title``: the products that the crawled pages link to, by the platform's path; an address that ends in twelve digits or more has them as pid.

    ``roots`` also has the platform.
    """
    visited = crawl(roots, pages, most).select("source_id", "root_url", "url")
    here = visited.join(roots.select("source_id", "root_url", "platform", "home_url").hint("merge"), ["source_id", "root_url"]).join(pages.select("source_id", "url", "html").hint("merge"), ["source_id", "url"])
    link = lambda x: let(resolve(F.col("url"), x), lambda to: F.struct(to.alias("to"), path_of(to).alias("path"), origin(to).alias("origin")))
    links = here.select("source_id", "platform", origin(F.col("home_url")).alias("home"), F.explode(F.transform(F.array_distinct(_hrefs(F.col("html"))), link)).alias("l"))
    fits = F.when(F.col("platform") == "zoho", F.col("l.path").rlike(PRODUCT_PATH["zoho"])).otherwise(F.col("l.path").rlike(PRODUCT_PATH["other"])) & ~F.col("l.path").rlike(NO_PRODUCT)
    own = links.filter((F.col("l.origin") == F.col("home")) & fits).select("source_id", let(F.col("l.to"), canonical_url).alias("url")).distinct()
    return own.select("source_id", "url", first_match(F.col("url"), LONG_PID).alias("pid"), title_from_url(F.col("url")).alias("title"))


def sitemap_products(sources: DataFrame, documents: DataFrame, size: int = PAGE) -> DataFrame:
    """``source_id, page, place, url, title``: products of shops that list them in sitemaps, in pages of ``size``.

    ``sources``: source_id, home_url, list_url; ``documents``: source_id, url, xml. The shop's index names the sitemap of products (else it is where it usually is); what
    that names, as an index of any depth, is read too, each document once. The list address' currency goes to every product's address.
    """
    read = documents.select("source_id", "url", F.from_xml("xml", _SITEMAP).alias("x"))
    locs = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<loc:string>>")), lambda s: F.trim(s["loc"])), lambda u: u.isNotNull())
    read = cut(read.select("source_id", "url", locs("x.sitemap").alias("indexes"), locs("x.url").alias("urls")))
    home = sources.select("source_id", origin(F.col("home_url")).alias("origin"), "list_url")
    index = read.withColumnRenamed("url", "at").withColumn("all", F.concat("indexes", "urls")).select("source_id", "at", F.filter("all", lambda u: u.rlike(PRODUCT_SITEMAP)).alias("some"))
    start = home.withColumn("at", F.concat("origin", F.lit("/sitemap.xml"))).join(index.hint("merge"), ["source_id", "at"], "left")
    begin = start.select("source_id", F.coalesce(F.get("some", F.lit(0)), F.concat("origin", F.lit("/store-products-sitemap.xml"))).alias("url"), F.array(F.lit(0)).alias("way"))
    known = fresh = cut(begin)
    while not fresh.isEmpty():
        children = fresh.join(read.hint("merge"), ["source_id", "url"]).select("source_id", "way", F.posexplode("indexes").alias("k", "to"))
        children = children.groupBy("source_id", F.col("to").alias("url")).agg(F.min(F.concat("way", F.array("k"))).alias("way"))
        fresh = cut(children.join(known.select("source_id", "url").hint("merge"), ["source_id", "url"], "left_anti"))
        known = cut(known.unionByName(fresh.select(*known.columns)))
    items = known.join(read.hint("merge"), ["source_id", "url"]).select("source_id", F.size("way").alias("depth"), "way", F.posexplode("urls").alias("k", "loc")).filter(F.col("loc").rlike(PRODUCT_PAGE + "."))
    once = items.withColumn("bare", F.substring_index("loc", "?", 1)).groupBy("source_id", "bare").agg(F.min(F.struct("depth", "way", "k")).alias("first"))
    # numbered over all sources, so that a large shop needs no task of its own
    numbered = cut(dense_ids(once, ["source_id", "first"], name="number"))
    offset = numbered.groupBy("source_id").agg(F.min("number").alias("least"))
    placed = numbered.join(offset, "source_id").withColumn("place", F.col("number") - F.col("least")).join(home, "source_id")
    currency = _part(F.col("list_url"), "QUERY")
    currency = F.regexp_extract(F.coalesce(currency, F.lit("")), r"(?:^|&)currency=([^&]*)", 1)
    address = F.concat("bare", F.when(currency != "", F.concat(F.lit("?currency="), currency)).otherwise(""))
    return placed.select("source_id", F.floor(F.col("place") / size).alias("page"), F.col("place").cast("int").alias("place"), canonical_url(address).alias("url"), title_from_url(F.col("bare")).alias("title"))
