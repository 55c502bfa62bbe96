"""First guesses for a listing: brand, clean name, slug, span."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import config, span_title
from .text import first_match, slugify

# What is cut from a listing's title.
TAIL = r"\s+[|–—-]\s+[^|]*$"
FILLER = r"(?i)\b(rc\s+(plane|aircraft|airplane)|for\s+beginners?|india|fpv\s+flight)\b"
# End of fixed values.


def _loose(brand: str, gap: str) -> str:
    """A brand as a pattern: its separators may be written otherwise or left out."""
    return gap.join(re.escape(part) for part in re.split(r"[-\s]", brand))


def known_brand(text: Column, brands: list[str]) -> Column:
    """The first brand of the list that the text names; null if none."""
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(t.rlike("(?i)" + _loose(b, ".?")), F.lit(b)) for b in brands], F.lit(None).cast("string"))


def house_brand(source: Column, brands: list[str]) -> Column:
    """The brand whose own shop the source is: its slug is the source's name."""
    return F.coalesce(*[F.when(source == re.sub(r"^-|-$", "", re.sub("[^a-z0-9]+", "-", b.lower()))[:60], F.lit(b)) for b in brands], F.lit(None).cast("string"))


def own_shop(source: Column, brands: list[str]) -> Column:
    """The brand whose own shop the source is, separators left out on both sides; capital letters of a source's name too."""
    name = F.regexp_replace(F.coalesce(source, F.lit("")), "[^a-z0-9]", "")
    return F.coalesce(*[F.when(name == re.sub("[^a-z0-9]", "", b.lower()), F.lit(b)) for b in brands], F.lit(None).cast("string"))


def clean_name(title: Column, brand: Column, brands: list[str], filler: bool = False) -> Column:
    """The title without a tail after a spaced separator and without the brand in front (unless nothing is left); with ``filler`` also without selling words; 60 characters."""
    name = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), TAIL, ""))
    bare = reduce(lambda c, b: c.when(brand == b, F.trim(F.regexp_replace(name, "(?i)^" + _loose(b, r"[-\s]?") + r"[\s:–—-]*", ""))), brands[1:], F.when(brand == brands[0], F.trim(F.regexp_replace(name, "(?i)^" + _loose(brands[0], r"[-\s]?") + r"[\s:–—-]*", "")))) if brands else F.lit(None)
    name = F.coalesce(F.nullif(bare, F.lit("")), name)
    if filler:
        name = F.trim(F.regexp_replace(F.regexp_replace(name, FILLER, " "), r"\s+", " "))
    return F.left(name, F.lit(60))


def guess(title: Column, source: Column, stored: Column, brands: list[str]) -> Column:
    """``brand, name, slug, span``: what was stored (JSON) wins; else a brand that the title names, or the shop's own, and the rest of the title."""
    get = lambda k: F.nullif(F.get_json_object(stored, f"$.{k}"), F.lit(""))
    brand = F.coalesce(get("brand"), known_brand(title, brands), house_brand(source, brands), F.lit(""))
    name = F.coalesce(get("name"), clean_name(title, brand, brands))
    slug = slugify(F.concat(F.when(brand != "", F.concat(brand, F.lit(" "))).otherwise(""), name))
    return F.struct(brand.alias("brand"), F.left(name, F.lit(60)).alias("name"), slug.alias("slug"), F.coalesce(get("spanMM"), first_match(title, r"(?i)(\d{3,4})\s*mm"), F.lit("")).alias("span"))


def enrich(title: Column, page: Column, source: Column, brands: list[str]) -> Column:
    """``brand, name, span, via, config`` of a listing whose page's text was read: the title is believed before the page, of which a brand counts in the first 3,000 letters, a span in 20,000, a configuration in 2,000."""
    brand = F.coalesce(known_brand(title, brands), known_brand(F.left(page, F.lit(3000)), brands), own_shop(source, brands), F.lit(""))
    by_title, by_page = span_title(title), span_title(F.left(page, F.lit(20000)))
    via = F.when(by_title.isNotNull(), "title").when(by_page.isNotNull(), "page").otherwise("none")
    text = F.concat_ws(" ", title, F.left(page, F.lit(2000)))
    return F.struct(brand.alias("brand"), clean_name(title, brand, brands, filler=True).alias("name"), F.coalesce(by_title, by_page).alias("span"), via.alias("via"), config(text).alias("config"))
