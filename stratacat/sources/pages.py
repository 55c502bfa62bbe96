"""Product pages and makers' feeds that have landed: what a page says of price and stock, listings, makers' products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.functions.classify import is_challenge, span_maker
from stratacat.functions.text import canonical_url, decode_entities, first_match, host_of, html_to_text, let, meta_content, round_half_up
from stratacat.sources import feeds

# Patterns of shop markup that results depend on.
TITLE, TITLE_TAIL = r"(?i)<title[^>]*>([^<]+)</title>", r"\s*[|–—-]\s*[^|–—-]*$"
OG_IMAGE = [
    r"(?i)<meta[^>]+property=[\"']og:image[\"'][^>]+content=[\"']([^\"']+)[\"']",
    r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+property=[\"']og:image[\"']",
    r"(?i)data-large_image=[\"']([^\"']+)[\"']",
]
SHOP_PRICE, IN_CART, SOLD_OUT = r"(?i)class=\"price\"[^>]*>\s*(?:₹|Rs\.?)\s*([\d,]+)", r"(?i)add to cart|btn-cart", r"(?i)out of stock"
VARIATIONS = r"(?s)data-product_variations=([\"'])(.*?)\1"
LIST_ANCHOR, LIST_LINK, LIST_PID = r"(?=<a\s[^>]*class=\"product-image\"[^>]*>)", r"href=\"([^\"]+\.html)\"", r"product-(?:price|collection-image)-(\d+)"
LIST_NAME, LIST_IMAGE = r"product-name[^>]*>\s*<a[^>]*>([^<]+)", [r"defaultImage\"\s+src=\"([^\"]+)\"", r"<img[^>]+src=\"([^\"]+)\""]
# End of fixed values.

_VARIANT = "array<struct<variation_id:string,attributes:map<string,string>,display_price:double,is_in_stock:boolean>>"
_MAKER = "struct<products:array<struct<id:string,handle:string,title:string,body_html:string,product_type:string,images:array<struct<src:string>>>>>"


def page_title(html: Column) -> Column:
    """The page's title without the site's name after the last dash or bar, at most 140 characters."""
    bare = F.regexp_replace(first_match(html, TITLE), TITLE_TAIL, "")
    return F.left(F.trim(F.regexp_replace(bare, r"\s+", " ")), F.lit(140))


def page_image(html: Column) -> Column:
    return F.coalesce(*[first_match(html, p) for p in OG_IMAGE])


def _rupees(text: Column) -> Column:
    return F.replace(first_match(text, SHOP_PRICE), F.lit(","), F.lit("")).try_cast("long")


def _cart_stock(text: Column) -> Column:
    return (text.rlike(IN_CART) & ~text.rlike(SOLD_OUT)).cast("int")


def woo_variants(html: Column) -> Column:
    """An array of ``vkey, label, price, stock`` from the page's variation attribute; null if there is none or it is no list."""
    raw = F.regexp_extract(html, VARIATIONS, 2)
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&#039;", "'")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    rows = F.from_json(F.when(F.trim(raw).startswith("["), raw), _VARIANT)

    def one(v):
        values = F.map_values(F.coalesce(v["attributes"], F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")))
        names = F.filter(values, lambda x: x != "")
        label = F.coalesce(F.nullif(F.array_join(names, " / "), F.lit("")), F.lit("Standard"))
        return F.struct(F.coalesce(v["variation_id"], F.array_join(values, "/", "")).alias("vkey"), label.alias("label"), round_half_up(v["display_price"]).cast("long").alias("price"), F.coalesce(v["is_in_stock"], F.lit(False)).cast("int").alias("stock"))

    return F.when(F.size(rows) > 0, F.transform(rows, one))


def read_state(status: Column, html: Column) -> Column:
    """gone: the page says so; blocked: any other failure or a bot wall, which tells nothing of the product; else ok. A null status is a failed request."""
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    return F.when(status.isin(404, 410), "gone").when(~ok | is_challenge(html), "blocked").otherwise("ok")


_ITEM = "array<struct<id:string,name:string,images:array<struct<src:string>>,prices:struct<price:string,currency_minor_unit:int>,is_in_stock:boolean>>"


def store_read(status: Column, payload: Column, pid: Column, page_status: Column, page: Column) -> Column:
    """``state, title, image, price, stock`` of a sku that the shop's store API was asked for.

    A failed request or what is no list tells nothing (blocked). A product that the list lacks is told by its page: gone if the page is, blocked if that can't be read, else missing from the
    feed. ``page_status`` -1 stands for a sku without a page's address, which is missing.
    """
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    rows = F.from_json(F.when(F.trim(payload).startswith("["), payload), _ITEM)

    def told(found: Column) -> Column:
        amount = round_half_up(F.coalesce(found["prices"]["price"].try_cast("double"), F.lit(0.0)) / F.pow(F.lit(10.0), F.coalesce(found["prices"]["currency_minor_unit"], F.lit(2))))
        name = F.regexp_replace(F.coalesce(found["name"], F.lit("")), "<[^>]+>", "")
        title = F.replace(F.replace(name, F.lit("&amp;"), F.lit("&")), F.lit("&#8211;"), F.lit("–"))
        absent = F.when(page_status == -1, "missing").otherwise(F.replace(read_state(page_status, F.coalesce(page, F.lit(""))), F.lit("ok"), F.lit("missing")))
        state = F.when(~ok | rows.isNull(), "blocked").when(found.isNull(), absent).otherwise("ok")
        got = state == "ok"
        return F.struct(
            state.alias("state"), F.when(got, title).alias("title"), F.when(got, F.get(found["images"], F.lit(0))["src"]).alias("image"), F.when(got & (amount > 0), amount.cast("long")).alias("price"),
            F.when(got, F.coalesce(found["is_in_stock"], F.lit(True)).cast("int")).alias("stock"),
        )

    return let(F.get(F.filter(rows, lambda x: x["id"] == pid), F.lit(0)), told)


def sitemap_targets(urls: DataFrame, includes: str | None = None, brand: str | None = None, skip: str | None = None, prefer: str | None = None, most: int = 120, offset: int = 0, limit: int | None = None) -> DataFrame:
    """``url, place``: which addresses of a maker's sitemaps (``url``) are read, and in which order: those that hold ``includes`` and the brand's name, without those that ``skip`` fits, those that ``prefer`` fits first, then by address; ``most`` in all, of which a page is given."""
    rows = urls.select("url").distinct()
    if includes:
        rows = rows.filter(F.contains("url", F.lit(includes)))
    if brand:
        rows = rows.filter(F.contains(F.lower("url"), F.lit("-".join(brand.lower().split()))))
    if skip:
        rows = rows.filter(~F.col("url").rlike(skip))
    first = F.col("url").rlike(prefer).cast("int") if prefer else F.lit(0)
    top = rows.withColumn("first", first).orderBy(F.desc("first"), "url").limit(most)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("first"), "url")) - 1)  # of `most` rows
    return placed.filter((F.col("place") >= offset) & (F.col("place") < offset + (limit or most))).select("url", "place")


def of_brand(products: DataFrame, brand: str) -> DataFrame:
    """Products without a brand of their own, or whose brand holds the maker's name."""
    return products.filter((F.coalesce("brand", F.lit("")) == "") | F.contains(F.lower("brand"), F.lit(brand.lower())))


def registry(files: DataFrame, column: str = "json") -> DataFrame:
    """Makers to follow of registry files (JSON lists, or lists in ``results`` as a database dumps them): ``brand, domain, platform``."""
    entry = "array<struct<brand:string,domain:string,probed_platform:string,pursue:boolean>>"
    text = F.col(column)
    inner = F.coalesce(F.get_json_object(text, "$[0].results"), F.get_json_object(text, "$.results"), text)
    rows = files.select(F.explode(F.from_json(inner, entry)).alias("m")).select("m.*")
    return rows.filter("pursue AND coalesce(domain, '') <> ''").select("brand", "domain", F.col("probed_platform").alias("platform"))


def parse_page(html: Column, platform: Column) -> Column:
    """``title, image, price, stock, quote_only, variants, via``: the first of Magento markup, shop variants, a JSON-LD product, a cart element; else only a quote is offered."""
    variants = F.when(platform == "woocommerce", woo_variants(html))
    live = F.filter(variants, lambda v: v["stock"] == 1)
    node, cart = feeds.jsonld_product(html), feeds.cart_signals(html)
    none = F.array().cast("array<struct<vkey:string,label:string,price:bigint,stock:int>>")

    def found(price, stock, via, v=none, quote=False):
        return F.struct(page_title(html).alias("title"), page_image(html).alias("image"), price.cast("long").alias("price"), stock.cast("int").alias("stock"), F.lit(quote).alias("quote_only"), v.alias("variants"), F.lit(via).alias("via"))

    return (
        F.when(platform == "magento", found(_rupees(html), _cart_stock(html), "magento"))
        .when(variants.isNotNull(), found(F.array_min(F.transform(live, lambda v: v["price"])), (F.size(live) > 0), "variants", variants))
        .when(node.isNotNull(), found(node["price"], node["stock"], "jsonld"))
        .when(cart.isNotNull(), found(cart["price"], cart["stock"], "cart"))
        .otherwise(found(F.lit(None), F.lit(0), "quote", none, True))
    )


def magento_listing(pages: DataFrame, column: str = "html") -> DataFrame:
    """Products of listing pages (``source_id, home_url, page, html``): each anchor with what follows it up to the next is one; of one pid the first on its page counts.

    Products without pid, without a page address, or of another host are left out.
    """
    parts = pages.select("source_id", "home_url", "page", F.posexplode(F.split(column, LIST_ANCHOR)).alias("place", "part"))
    tag = F.regexp_extract("part", r"^<a\s[^>]*>", 0)
    link = first_match(tag, LIST_LINK)
    image = F.coalesce(*[first_match(F.col("part"), p) for p in LIST_IMAGE])
    title = F.trim(F.regexp_replace(F.replace(F.coalesce(first_match(F.col("part"), LIST_NAME), F.lit("")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))
    rows = parts.filter("part LIKE '<a%'").select(
        "source_id", "page", "place", first_match(F.col("part"), LIST_PID).alias("pid"), canonical_url(link).alias("url"), title.alias("title"), _rupees(F.col("part")).alias("price"), _cart_stock(F.col("part")).alias("stock"), image.alias("image"),
        (host_of(link) == host_of(F.col("home_url"))).alias("own"),
    )
    first = F.row_number().over(Window.partitionBy("source_id", "page", "pid").orderBy("place"))
    return rows.filter("pid IS NOT NULL AND own").withColumn("n", first).filter("n = 1").drop("n", "own")


def until_repeated(products: DataFrame, most: int = 8) -> DataFrame:
    """The pages of a paged listing up to the first that begins like the one before it (the shop serves its last page again), is missing, or passes ``most``."""
    firsts = products.groupBy("source_id", "page").agg(F.min_by("pid", "place").alias("first"))
    order = Window.partitionBy("source_id").orderBy("page")
    stop = (F.col("first") == F.lag("first").over(order)) | (F.col("page") != F.row_number().over(order)) | (F.col("page") > most)
    kept = firsts.withColumn("stop", F.coalesce(stop, F.lit(False)).cast("int")).withColumn("stops", F.sum("stop").over(order)).filter("stops = 0").select("source_id", "page")
    return products.join(kept, ["source_id", "page"], "left_semi")


def maker_shopify(pages: DataFrame, column: str = "json") -> DataFrame:
    """A maker's products of store pages (``domain``, JSON): the span from the title, else from the text."""
    p = pages.select("domain", F.explode(F.from_json(column, _MAKER)["products"]).alias("p"))
    body = html_to_text(F.col("p.body_html"))
    return p.select(
        F.concat(F.lit("sh:"), "p.id").alias("ext_id"), F.col("p.title").alias("title"), F.coalesce("p.product_type", F.lit("")).alias("product_type"), F.concat(F.lit("https://"), "domain", F.lit("/products/"), "p.handle").alias("url"),
        body.alias("body"), F.transform(F.coalesce("p.images", F.array()), lambda i: i["src"]).alias("images"), F.coalesce(span_maker(F.col("p.title")), span_maker(body)).alias("span"),
    )


def maker_jsonld(pages: DataFrame) -> DataFrame:
    """A maker's products of pages (``url, html``): the first node of a product type in the page's ld+json blocks; pages without one are left out."""
    blocks = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))

    def nodes(text):
        graph = F.get_json_object(text, "$.@graph")
        return F.coalesce(F.from_json(graph, "array<string>"), F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>"), F.array(text))

    node = F.get(F.filter(F.flatten(F.transform(blocks, nodes)), lambda n: F.get_json_object(n, "$.@type").rlike("(?i)product")), F.lit(0))
    n = pages.withColumn("node", node).filter("node IS NOT NULL")
    get = lambda k: F.get_json_object("node", f"$.{k}")
    plain = lambda c: F.nullif(html_to_text(c), F.lit(""))
    html = F.col("html")
    body = F.coalesce(plain(get("description")), plain(meta_content(html, "og:description")), plain(meta_content(html, "description")), F.lit(""))
    brand = F.coalesce(get("brand.name"), F.when(~get("brand").startswith("{"), get("brand")), F.lit(""))
    name = F.coalesce(get("name"), F.lit(""))
    return n.select(
        F.concat(F.lit("ld:"), F.coalesce(F.nullif(get("sku"), F.lit("")), F.nullif(get("mpn"), F.lit("")), "url")).alias("ext_id"), decode_entities(F.coalesce(F.nullif(name, F.lit("")), meta_content(html, "og:title"))).alias("title"), "url",
        body.alias("body"), brand.alias("brand"), span_maker(F.concat_ws(" ", name, body)).alias("span"),
    )


def dispatch(pages: DataFrame) -> DataFrame:
    """``source_id, pid, url, title, price, stock, image`` of landed feed pages (``source_id, platform, home_url, page, payload``), each by its platform's parser; others give nothing."""
    columns = ["source_id", "pid", "url", "title", "price", "stock", "image"]
    of = lambda name: pages.filter(F.col("platform") == name)
    parsed = [
        feeds.woocommerce(of("woocommerce").withColumnRenamed("payload", "json")),
        feeds.shopify(of("shopify").select("source_id", F.col("payload").alias("json"), F.col("home_url").alias("origin"))),
        magento_listing(of("magento").withColumnRenamed("payload", "html")),
    ]
    out = parsed[0].select(*columns)
    for more in parsed[1:]:
        out = out.unionByName(more.select(*columns))
    return out
