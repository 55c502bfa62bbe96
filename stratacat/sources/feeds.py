"""Seller feeds and pages that have landed as JSON, HTML or XML text, parsed to product records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.functions.text import canonical_url, decode_entities, first_match, html_to_text, round_half_up

# Patterns of shop markup that results depend on.
LD_JSON = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
CART_MARKS = [r"(?i)<[a-z][^>]*\sdata-zs-add-to-cart[\s>]", r'(?i)<[a-z][^>]*class="[^"]*theme-cart-button[^"]*"']
CART_PRICE = r'(?i)class="[^"]*theme-product-price[^"]*"[^>]*>\s*(?:₹|Rs\.?)\s*([\d,]+)'
PLATFORM_MARKS = [
    ("shopify", r"(?i)cdn\.shopify\.com|Shopify\.theme"), ("woo", "(?i)woocommerce|wp-content"), ("zoho", "(?i)data-zs-|zohostratus|zohocommerce"),
    ("magento", "(?i)Magento|mage/"), ("wix", r"(?i)wixstatic|wix\.com"),
]
# End of fixed values.

_WOO = "array<struct<id:string,permalink:string,name:string,is_in_stock:boolean,prices:struct<price:string,currency_minor_unit:int>,images:array<struct<src:string>>>>"
_SHOPIFY = "struct<products:array<struct<id:string,handle:string,title:string,body_html:string,product_type:string,images:array<struct<src:string>>,variants:array<struct<id:string,title:string,price:string,available:boolean>>>>>"
_NODE = "struct<`@type`:string,offers:string,Offers:string,name:string>"


def woocommerce(pages: DataFrame, column: str = "json") -> DataFrame:
    """One row per product of store API pages. Prices are in minor units; 0 is no price."""
    p = pages.select("source_id", F.explode(F.from_json(column, _WOO)).alias("p"))
    amount = round_half_up(F.col("p.prices.price").try_cast("double") / F.pow(F.lit(10.0), F.coalesce("p.prices.currency_minor_unit", F.lit(2))))
    return p.select(
        "source_id", F.col("p.id").alias("pid"), canonical_url(F.col("p.permalink")).alias("url"), F.regexp_replace(decode_entities(F.col("p.name")), "<[^>]+>", "").alias("title"),
        F.when(amount > 0, amount).cast("long").alias("price"), F.coalesce("p.is_in_stock", F.lit(True)).cast("int").alias("stock"), F.get(F.col("p.images"), F.lit(0))["src"].alias("image"),
    )


def shopify(pages: DataFrame, column: str = "json") -> DataFrame:
    """One row per product: the first variant's price, stock if any variant has it, at most twelve variants."""
    p = pages.select("source_id", "origin", F.explode(F.from_json(column, _SHOPIFY)["products"]).alias("p"))
    price = round_half_up(F.get(F.col("p.variants"), F.lit(0))["price"].try_cast("double"))
    return p.select(
        "source_id", F.col("p.id").alias("pid"), canonical_url(F.concat("origin", F.lit("/products/"), "p.handle")).alias("url"), F.col("p.title").alias("title"),
        F.when(price > 0, price).cast("long").alias("price"), F.exists("p.variants", lambda v: F.coalesce(v["available"], F.lit(False))).cast("int").alias("stock"),
        F.get(F.col("p.images"), F.lit(0))["src"].alias("image"), html_to_text(F.col("p.body_html")).alias("body"), F.slice("p.variants", 1, 12).alias("variants"),
    )


def sitemap_urls(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Distinct addresses of sitemaps and sitemap indexes."""
    return documents.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("url")).select(decode_entities(F.col("url")).alias("url")).distinct()


def listing(pages: DataFrame, anchor: str, patterns: dict[str, str]) -> DataFrame:
    """Products of listing pages: the text between one anchor and the next is one product, its fields the first matches of their patterns."""
    parts = F.slice(F.split("html", anchor), 2, 100_000)
    cut = pages.select("source_id", F.posexplode(parts).alias("place", "part"))
    return cut.select("source_id", "place", *[first_match(F.col("part"), p).alias(k) for k, p in patterns.items()])


def atom_entries(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """Entries of video feeds; those without id or title are dropped."""
    e = feeds.select(F.explode(F.regexp_extract_all(column, F.lit("(?is)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    get = lambda p: F.trim(decode_entities(first_match(F.col("e"), p)))
    number = lambda p: F.coalesce(first_match(F.col("e"), p).try_cast("long"), F.lit(0))
    return e.select(
        get("(?is)<yt:videoId>(.*?)</yt:videoId>").alias("video_id"), get("(?is)<title>(.*?)</title>").alias("title"), get("(?is)<published>(.*?)</published>").try_cast("timestamp").alias("published"),
        number(r'(?is)<media:statistics[^>]*views="(\d+)"').alias("views"), number(r'(?is)<media:starRating[^>]*count="(\d+)"').alias("likes"),
    ).filter("video_id IS NOT NULL AND title IS NOT NULL")


def jsonld_product(html: Column) -> Column:
    """Price and stock of the first product node with a price in rupees (or no currency) in the page's ld+json blocks."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LD_JSON), F.lit(1))

    def nodes(text: Column) -> Column:
        graph = F.get_json_object(text, "$.@graph")
        rows = F.coalesce(F.from_json(graph, "array<string>"), F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>"), F.array(text))
        return rows

    def read(node: Column) -> Column:
        kind = F.get_json_object(node, "$.@type")
        raw = F.coalesce(F.get_json_object(node, "$.offers"), F.get_json_object(node, "$.Offers"))
        offer = F.when(raw.startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)
        get = lambda *keys: F.coalesce(*[F.get_json_object(offer, f"$.{k}") for k in keys])
        price = get("price", "lowPrice").try_cast("double")
        fits = ((kind == "Product") | kind.contains('"Product"')) & (price != 0) & (F.upper(F.coalesce(get("priceCurrency"), F.lit("INR"))) == "INR")
        return F.when(fits, F.struct(round_half_up(price).cast("long").alias("price"), F.coalesce(get("availability", "Availability"), F.lit("")).rlike("(?i)InStock").cast("int").alias("stock")))

    return F.get(F.filter(F.transform(F.flatten(F.transform(blocks, nodes)), read), lambda x: x.isNotNull()), F.lit(0))


def cart_signals(html: Column) -> Column:
    """Stock and price where an element (not a script's text) offers to put the item into a cart."""
    cart = html.rlike(CART_MARKS[0]) | html.rlike(CART_MARKS[1])
    price = F.replace(first_match(html, CART_PRICE), F.lit(","), F.lit("")).try_cast("long")
    return F.when(cart, F.struct(F.lit(1).alias("stock"), F.when(price > 0, price).alias("price")))


def platform_of(html: Column) -> Column:
    """The shop system that a page's markup shows; the first that fits."""
    return F.coalesce(*[F.when(html.rlike(pattern), name) for name, pattern in PLATFORM_MARKS])
