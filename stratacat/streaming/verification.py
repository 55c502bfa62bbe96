"""A full check of listed skus: one decision for each, and all rows that follow from it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.durable import cut
from stratacat.functions.text import first_match, meta_content

DAY_MS = 86_400_000
VARIANT = "array<struct<vkey:string,label:string,price:bigint,stock:int>>"
# Limits and patterns of the part of a page that is kept.
_BLOCK, _PRODUCT = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>", r"(?i)\"@type\"\s*:\s*\"Product\""
_TOLD = r"(?i)\"description\"\s*:\s*\"((?:[^\"\\]|\\.)*)\""
LEAST_HTML, LEAST_TEXT, MOST_JSON, MOST_TEXT = 200, 50, 12_000, 6_000
# End of fixed values.


def queue(skus: DataFrame, n: int) -> DataFrame:
    """The ``n`` approved skus alive that have waited longest for a check, those never checked first."""
    return skus.filter("review_status = 'approved' AND dead = 0").orderBy(F.coalesce("last_checked", F.lit(0)), "sku_key").limit(n)


def core_of(html: Column) -> Column:
    """``jsonld, description, hash`` of a page: its first product block, and what titles, descriptions and that block say."""
    block = F.left(F.trim(F.coalesce(F.get(F.filter(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(1)), lambda b: b.rlike(_PRODUCT)), F.lit(0)), F.lit(""))), F.lit(MOST_JSON))
    told = F.replace(F.replace(F.regexp_replace(first_match(block, _TOLD), r"\\u003c[^>]*\\u003e|<[^>]+>", " "), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" "))
    parts = F.filter(F.array(meta_content(html, "og:title"), meta_content(html, "og:description"), meta_content(html, "description"), told), lambda p: p.isNotNull() & (p != ""))
    text = F.left(F.trim(F.regexp_replace(F.regexp_replace(F.array_join(parts, " · "), r"(?i)&(amp|nbsp|#\d+);", " "), r"\s+", " ")), F.lit(MOST_TEXT))
    return F.struct(block.alias("jsonld"), text.alias("description"), F.sha2(F.concat(block, F.lit("|"), text), 256).alias("hash"))


def snapshots(stored: DataFrame, pages: DataFrame, now_ms: int) -> DataFrame:
    """``sku_key, hash, jsonld, description, fetched_at``: the pages (``sku_key, html``) whose core is new or has changed. Short pages, and those without a product block and with little text, are junk."""
    rows = pages.filter(F.length("html") >= LEAST_HTML).select("sku_key", F.explode(F.array(core_of(F.col("html")))).alias("c"))
    good = rows.filter((F.col("c.jsonld") != "") | (F.length("c.description") >= LEAST_TEXT)).select("sku_key", "c.*")
    return good.join(stored.select("sku_key", "hash"), ["sku_key", "hash"], "left_anti").withColumn("fetched_at", F.lit(now_ms))


class Verified(NamedTuple):
    """The next values of the checked skus, the variants that were read, changes of price or stock, and log rows."""

    skus: DataFrame
    variants: DataFrame
    observations: DataFrame
    audit: DataFrame


def verify_all(skus: DataFrame, reads: DataFrame, now_ms: int, actor: str = "verify") -> Verified:
    """What a check of its page does to each sku, by the first rule that fits.

    ``skus``: sku_key, price, stock, quote_only, image, variants (JSON), flag, flag_detail, misses, dead, last_seen, last_checked. ``reads``: sku_key, state (ok, blocked, gone, missing), quote_only, price, stock, image, variants.
    Blocked: only the time of the check. Gone, and no feed has shown it for a day: a miss; the third makes it dead, with a row in the log. A page that has lost its price, is missing, or is
    gone while a feed shows the sku: flagged missing, unless it is so already. A price that moved by more than a quarter: flagged, the price kept. Else price, stock and quote are
    as read (unknown ones too), the image if there was none, the variants if any were read; misses and a missing flag are cleared; a change is observed, an unknown stock counting as none.
    """
    r = reads.select("sku_key", "state", *[F.col(c).alias(f"r_{c}") for c in ("quote_only", "price", "stock", "image", "variants")])
    return verify_read(cut(skus.join(r, "sku_key")), now_ms, actor)


def verify_read(rows: DataFrame, now_ms: int, actor: str = "verify") -> Verified:
    """:func:`verify_all` of skus that stand beside what their check has read (``r_...``), so that nothing has to meet. Each result works out the decisions for itself; who wants several writes ``rows`` first."""
    recent = F.coalesce(F.lit(now_ms) - F.col("last_seen") < DAY_MS, F.lit(False))
    quoted = F.coalesce("r_quote_only", F.lit(False)) & F.col("r_price").isNull() & F.col("price").isNotNull()
    jump = F.coalesce((F.col("price") != 0) & (F.col("r_price") != 0) & (F.abs(F.col("r_price") - F.col("price")) / F.when(F.col("price") != 0, F.col("price")) > 0.25), F.lit(False))
    action = (
        F.when(F.col("state") == "blocked", "checked").when((F.col("state") == "gone") & ~recent, F.when(F.col("misses") + 1 >= 3, "dead").otherwise("miss"))
        .when(quoted | F.col("state").isin("missing", "gone"), F.when(F.col("flag").eqNullSafe("missing"), "checked").otherwise("missing")).when(jump, "price-jump").otherwise("write")
    )
    why = F.when(quoted, "the page has lost its price").when(F.col("state") == "gone", "gone, though a feed shows it").otherwise("no feed shows it any more")
    a = rows.withColumns({"action": action, "why": why})
    is_ = lambda *x: F.col("action").isin(*x)
    write = is_("write")
    many = F.coalesce(F.trim("r_variants"), F.lit("[]"))
    clears = write & F.col("flag").eqNullSafe("missing")
    detail = F.when(is_("missing"), F.col("why")).when(is_("price-jump"), F.concat(F.col("price").cast("string"), F.lit(" -> "), F.col("r_price").cast("string")))
    changed = write & (~F.col("price").eqNullSafe(F.col("r_price")) | (F.coalesce("stock", F.lit(0)) != F.coalesce("r_stock", F.lit(0))))
    after = a.select(
        "sku_key", "action", F.when(write, F.col("r_price")).otherwise(F.col("price")).alias("price"), F.when(write, F.col("r_stock")).otherwise(F.col("stock")).alias("stock"),
        F.when(write, F.coalesce("r_quote_only", F.lit(False))).otherwise(F.col("quote_only")).alias("quote_only"), F.when(write, F.coalesce("image", "r_image")).otherwise(F.col("image")).alias("image"),
        F.when(write & (many != "[]"), F.col("r_variants")).otherwise(F.col("variants")).alias("variants"), F.when(is_("missing", "price-jump"), F.col("action")).when(~clears, F.col("flag")).alias("flag"),
        F.when(is_("missing", "price-jump"), detail).when(~clears, F.col("flag_detail")).alias("flag_detail"), F.when(is_("miss", "dead"), F.col("misses") + 1).when(write, 0).otherwise(F.col("misses")).alias("misses"),
        F.when(is_("dead"), 1).when(write, 0).otherwise(F.col("dead")).alias("dead"), F.lit(now_ms).alias("last_checked"),
    )
    variants = a.filter(write & (many != "[]")).select("sku_key", F.explode(F.from_json("r_variants", VARIANT)).alias("v")).select("sku_key", "v.*")
    seen = a.filter(changed).select("sku_key", F.lit(now_ms).alias("at"), F.col("r_price").alias("price"), F.col("r_stock").alias("stock"))
    audit = a.filter(is_("dead")).select(F.lit(now_ms).alias("at"), F.lit(actor).alias("actor"), F.lit("auto-removed-404").alias("action"), F.lit("sku").alias("entity"), F.col("sku_key").alias("entity_id"))
    return Verified(after, variants, seen, audit)
