"""Names, URLs, HTML and numbers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slugify(s: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 60)


def norm_name(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))


def brand_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", "")


def host_of(url: Column) -> Column:
    """The host in lower case without a leading www.; null for what is no URL."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


#: Query parameters that don't change a page.
TRACKING = r"(?i)^(utm_|fbclid|gclid|srsltid|ref$|ref_|mc_|igsh)"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no usual port, no fragment, no tracking parameters, the others sorted by name, no collection path before a product, no slash at the end; null for what is no URL."""
    part = lambda x: F.try_parse_url(url, F.lit(x))
    path = F.regexp_replace(F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/collections/[^/]+/products/", "/products/"), "/+$", "")
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~name(p).rlike(TRACKING))
    # sorted by name, in the order of appearance within a name
    order = F.transform(F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("k"), i.alias("i"), p.alias("p")))), lambda s: s["p"])
    query = F.when(F.size(order) > 0, F.concat(F.lit("?"), F.array_join(order, "&"))).otherwise("")
    bare = F.when(path == "", F.lit("/")).otherwise(path)
    scheme, port = F.lower(part("PROTOCOL")), F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    host = F.concat(F.lower(part("HOST")), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
    return F.when(part("HOST").isNotNull(), F.concat(scheme, F.lit("://"), host, bare, query))


#: Entities that titles and pages use.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")]


def decode_entities(s: Column) -> Column:
    """Named entities, the ampersand last, so that nothing is decoded twice."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, s)


def decode_numeric(s: Column) -> Column:
    """Decimal and hexadecimal entities become their characters; what names no character stays away."""
    pattern = "(?i)&#(x[0-9a-f]{1,6}|[0-9]{1,7});"

    def character(code: Column) -> Column:
        digits = F.when(F.lower(code).startswith("x"), F.substr(code, F.lit(2))).otherwise(F.hex(code.try_cast("bigint")))
        padded = F.lpad(digits, 8, "0")
        return F.when((padded <= "0010FFFF") & ~F.upper(padded).between("0000D800", "0000DFFF"), F.decode(F.unhex(padded), "UTF-32")).otherwise("")

    pieces, codes = F.split(s, pattern), F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(character(F.get(codes, i)), F.lit("")))), "")
    return F.when(s.contains("&#"), joined).otherwise(s)


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, tags become spaces, entities are decoded, spaces collapse."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(bare, "<[^>]*>", " ")), r"\s+", " "))


def page_title(html: Column) -> Column:
    return F.trim(decode_entities(first_match(html, "(?is)<title[^>]*>(.*?)</title>")))


def meta_content(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, its attributes in either order."""
    tag = rf"(?:name|property)=[\"']{name}[\"']"
    return F.coalesce(first_match(html, rf"(?is)<meta[^>]*{tag}[^>]*content=[\"']([^\"']*)"), first_match(html, rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*{tag}"))


def links(html: Column) -> Column:
    """All href values, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']*)"), F.lit(1))


def fnv1a(s: Column) -> Column:
    """The 32-bit FNV-1a hash of the characters, as a number. The product is split, since it passes 64 bits."""
    prime, mask = 16777619, 0xFFFFFFFF

    def step(h, c):
        x = h.bitwiseXOR(F.ascii(c).cast("long"))
        return (x * (prime & 0xFFFF) + F.shiftleft((x * (prime >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)

    return F.when(s.isNotNull(), F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0x811C9DC5).cast("long"), step))


def fnv1a_units(s: Column) -> Column:
    """The same hash over UTF-16 units: a character beyond the first plane counts as its two halves."""
    prime, mask = 16777619, 0xFFFFFFFF

    def units(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        beyond = code - 0x10000
        pair = F.array(F.lit(0xD800) + F.shiftright(beyond, 10), F.lit(0xDC00) + beyond.bitwiseAND(0x3FF))
        return F.when(code > 0xFFFF, pair).otherwise(F.array(code))

    def step(h: Column, unit: Column) -> Column:
        x = h.bitwiseXOR(unit)
        return (x * (prime & 0xFFFF) + F.shiftleft((x * (prime >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(mask)

    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.when(s.isNotNull(), F.aggregate(F.flatten(F.transform(chars, units)), F.lit(0x811C9DC5).cast("long"), step))


def image_key(url: Column) -> Column:
    """The key of a cached image: the hash of its address, without leading zeros."""
    return F.concat(F.lit("i/"), F.lower(F.hex(fnv1a_units(url))))


def padded_hash(s: Column) -> Column:
    """The hash in eight hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fnv1a_units(s))), 8, "0")


def iso_day(ms: Column) -> Column:
    """The UTC day of a time in milliseconds as text; null for none or 0."""
    return F.when(ms != 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"))


def day_start(ms: Column) -> Column:
    """The first millisecond of the UTC day."""
    return ms - F.pmod(ms, F.lit(86_400_000))


def report_day(text: Column) -> Column:
    """Eight digits of a report as an ISO day."""
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substr(text, F.lit(7)))


def ago(ms: Column, now_ms: int) -> Column:
    """How long ago in words: never, under an hour, hours up to two days, then days."""
    hours = F.floor((F.lit(now_ms) - ms) / 3.6e6 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    return F.when(F.coalesce(ms, F.lit(0)) == 0, "never").when(hours < 1, "<1h ago").when(hours < 48, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| over the larger; null if either is null or 0."""
    return F.try_divide(F.abs(a - b).cast("double"), F.when((a != 0) & (b != 0), F.greatest(a, b)))
