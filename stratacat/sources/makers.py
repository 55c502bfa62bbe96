"""Makers' own pages: one segmenter, driven by declared rules, for layouts of any shop.

A :class:`Layout` says which addresses are products, where title, text, pictures and id stand, in which order places are tried, and what is
cut from titles. Listings in a JSON envelope, posts of a content system and pages that link to each other are brought to rows of
``url, html`` first, so that all go through :func:`read_pages`.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.durable import cut, is_small
from stratacat.functions.classify import is_challenge
from stratacat.functions.text import decode_entities, decode_numeric, first_match, let, meta_content
from stratacat.sources.crawl import _hrefs, path_of, resolve

_LD = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
_POSTS = "array<struct<id:bigint,slug:string,link:string,title:struct<rendered:string>,content:struct<rendered:string>,categories:array<bigint>,yoast_head_json:struct<og_image:array<struct<url:string>>>>>"


class Layout(NamedTuple):
    """Places are tuples: ``("match", pattern)`` (first group), ``("block", start, end)`` (from behind the start's tag to the end, or 8,000 characters), ``("meta", name)``, ``("ld", key)`` of
    the page's product node, ``("url", pattern)``, ``("given", column)``. ``images`` is a list of groups of patterns (or ``("meta", ..)``, ``("ld", ..)``, ``("gallery", pattern)``); the first group that finds any counts.
    """

    wanted: str
    title: list[tuple]
    body: list[tuple]
    images: list[list[tuple]]
    ext_id: list[tuple]
    unwanted: str | None = None
    marker: str | None = None
    prefix: str = ""
    url: list[tuple] = []
    title_cuts: list[str] = []
    tag: str = " "
    item: str = "\n"
    lines: bool = True
    least_body: int = 1


def lines_of(html: Column, tag: str = " ", item: str = "\n") -> Column:
    """Text with line breaks: scripts, styles and comments go, breaks and ends of blocks become lines, list items begin with ``item``, other tags become ``tag``, entities are decoded, at most one line stays empty."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    broken = F.regexp_replace(F.regexp_replace(bare, r"\r\n?", "\n"), r"(?i)<\s*(br|hr)\s*/?\s*>|</\s*(p|div|li|tr|h[1-6]|ul|ol|table|article)\s*>", "\n")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(broken, r"(?i)<li[^>]*>", item), r"<[^>]+>", tag), r"<[^>]*$", " ")
    text = decode_numeric(decode_entities(plain))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \\t\\f\\x0b 　]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def block(html: Column, start: str, end: str | None, most: int = 8000) -> Column:
    """What stands between the tag that ``start`` begins in and the first ``end`` behind it; ``most`` characters without an end."""
    at = F.regexp_instr(html, F.lit(start))
    behind = F.regexp_replace(F.substr(html, at), r"^[^>]*>", "")
    stop = F.regexp_instr(behind, F.lit(end)) if end else F.lit(0)
    return F.when(at > 0, F.when(stop > 0, F.left(behind, stop - 1)).otherwise(F.left(behind, F.lit(most)) if end else behind))


def product_node(html: Column) -> Column:
    """The first product in the page's ld+json blocks, as JSON text."""

    def nodes(text):
        graph = F.get_json_object(text, "$.@graph")
        return F.coalesce(F.from_json(graph, "array<string>"), F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>"), F.array(text))

    def fits(n):
        kind = F.get_json_object(n, "$.@type")
        return (kind == "Product") | kind.contains('"Product"')

    return F.get(F.filter(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_LD), F.lit(1)), nodes)), fits), F.lit(0))


def _place(rule: tuple, html: Column) -> Column:
    kind = rule[0]
    if kind == "match":
        return first_match(html, rule[1])
    if kind == "block":
        return block(html, rule[1], rule[2])
    if kind == "meta":
        return meta_content(html, rule[1])
    if kind == "ld":
        return F.get_json_object("node", f"$.{rule[1]}")
    if kind == "url":
        return first_match(F.col("url"), rule[1])
    return F.col(rule[1])


def _pictures(rule: tuple, html: Column) -> Column:
    if rule[0] == "match":
        return F.regexp_extract_all(html, F.lit(rule[1]), F.lit(1))
    if rule[0] == "gallery":
        rows = F.from_json(first_match(html, rule[1]), "array<struct<full:string,img:string,thumb:string>>")
        return F.coalesce(F.transform(rows, lambda r: F.coalesce(r["full"], r["img"], r["thumb"])), F.array().cast("array<string>"))
    if rule[0] == "ld":
        raw = _place(rule, html)
        return F.coalesce(F.from_json(F.when(raw.startswith("["), raw), "array<string>"), F.when(raw.isNotNull(), F.array(raw)), F.array().cast("array<string>"))
    return F.array_compact(F.array(_place(rule, html)))


def read_pages(pages: DataFrame, layout: Layout) -> DataFrame:
    """``ext_id, title, url, body, images`` of the products among the pages (``url, html``, and what ``given`` places name). Pages without a title, walls against robots and pages without the marker are none."""
    path = path_of(F.col("url"))
    rows = pages.filter(path.rlike(layout.wanted) & ~is_challenge(F.coalesce("html", F.lit(""))))
    if layout.unwanted:
        rows = rows.filter(~path.rlike(layout.unwanted))
    if layout.marker:
        rows = rows.filter(F.col("html").rlike(layout.marker))
    rows = rows.withColumn("node", F.get(F.transform(F.array("html"), product_node), F.lit(0)))
    html = F.coalesce("html", F.lit(""))
    flat = lambda c: F.trim(F.regexp_replace(lines_of(c, "" if layout.tag == "" else " "), r"\s+", " "))
    filled = lambda c: F.when(F.length(c) > 0, c)
    title = F.coalesce(*[filled(let(_place(r, html), flat)) for r in layout.title], F.lit(""))
    title = F.trim(reduce(lambda c, p: F.regexp_replace(c, p, ""), layout.title_cuts, title))
    shape = (lambda c: lines_of(c, layout.tag, layout.item)) if layout.lines else flat
    bodies = [let(_place(r, html), shape) for r in layout.body]
    body = F.coalesce(*[F.when(F.length(b) >= layout.least_body, b) for b in bodies], F.coalesce(bodies[-1], F.lit("")))
    groups = [F.flatten(F.array(*[_pictures(r, html) for r in g])) for g in layout.images]
    some = F.coalesce(*[F.when(F.size(g) > 0, g) for g in groups], F.array().cast("array<string>")) if groups else F.array().cast("array<string>")
    pictures = F.array_distinct(F.array_compact(F.transform(some, lambda x: resolve(F.col("url"), decode_entities(x)))))
    ident = F.coalesce(*[filled(F.trim(let(_place(r, html), flat))) for r in layout.ext_id], F.col("url"))
    address = F.coalesce(*[filled(F.trim(_place(r, html))) for r in layout.url], F.col("url"))
    made = rows.select(F.concat(F.lit(layout.prefix), ident).alias("ext_id"), title.alias("title"), address.alias("url"), body.alias("body"), pictures.alias("images"))
    return made.filter("title <> ''")


def envelope_rows(envelopes: DataFrame, anchor: str, href: str, title: str, picture: str, base: str, unwanted: str | None = None) -> DataFrame:
    """Listing rows ``url, listed, thumb, turn`` of JSON envelopes (``page, json`` with the markup in ``Data``): the parts between anchors, each address once, categories (the first part of the address) taking turns."""
    parts = F.slice(F.split(F.get_json_object("json", "$.Data"), anchor), 2, 1_000_000)
    rows = envelopes.select("page", F.posexplode(parts).alias("place", "part")).select("page", "place", first_match(F.col("part"), href).alias("href"), first_match(F.col("part"), title).alias("listed"), first_match(F.col("part"), picture).alias("thumb"))
    once = rows.filter("href IS NOT NULL").groupBy("href").agg(F.min(F.struct("page", "place", "listed", "thumb")).alias("x"))
    kept = once if unwanted is None else once.filter(~F.col("href").rlike(unwanted))
    kind = F.substring_index("href", "/", 1)
    in_kind = F.row_number().over(Window.partitionBy(kind).orderBy("x.page", "x.place"))
    return kept.select(resolve(F.lit(base), F.col("href")).alias("url"), decode_entities(F.col("x.listed")).alias("listed"), F.col("x.thumb").alias("thumb"), in_kind.alias("turn"))


def subtree(categories: DataFrame, roots: list[int]) -> DataFrame:
    """``id`` of the roots and all categories below them (``id, parent``), however deep; cycles end."""
    known = fresh = cut(categories.filter(F.col("id").isin(roots)).select("id"))
    while not fresh.isEmpty():
        fresh = cut(categories.join(fresh.select(F.col("id").alias("parent")), "parent").select("id").distinct().join(known, "id", "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def posts(pages: DataFrame, categories: DataFrame, roots: list[int], discontinued: int, part: str) -> DataFrame:
    """Rows ``url, html, slug, named, pictured`` of a content system's posts (``json``, a list per page): those of a category below the roots, or discontinued ones of no such category, whose slug names no part."""
    p = pages.select(F.explode(F.from_json("json", _POSTS)).alias("p")).select("p.*")
    slug = F.coalesce(F.nullif("slug", F.lit("")), F.regexp_replace(F.regexp_replace("link", r"^https?://[^/]+/", ""), "/$", ""))
    rows = p.withColumn("slug", slug).filter(~F.coalesce(F.col("slug"), F.lit("")).rlike(part))
    good = rows.select("id", F.explode("categories").alias("category")).join(subtree(categories, roots).select(F.col("id").alias("category")), "category", "left_semi").select("id").distinct().withColumn("good", F.lit(True))
    kept = rows.join(good, "id", "left").filter(F.col("good") | F.array_contains("categories", discontinued))
    return kept.select(F.col("link").alias("url"), F.col("content.rendered").alias("html"), "slug", F.col("title.rendered").alias("named"), F.transform("yoast_head_json.og_image", lambda i: i["url"]).alias("pictured"))


def reached(seeds: DataFrame, pages: DataFrame, wanted: str, base: str) -> DataFrame:
    """``url``: addresses of products that the seeds (``html``) or pages reached so far link to, in lower case, on one host; cycles end."""

    def linked(rows: DataFrame, at: Column, *more: Column) -> DataFrame:
        links = F.concat(_hrefs(F.col("html")), F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
        found = rows.select(*more, F.explode(F.transform(links, lambda x: let(resolve(at, x), lambda u: F.struct(F.lower(path_of(u)).alias("path"), F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("HOST"))), r"^www\.", "").alias("host"))))).alias("l"))
        own = F.regexp_replace(F.lower(F.try_parse_url(F.lit(base), F.lit("HOST"))), r"^www\.", "")
        return found.filter(F.col("l.path").rlike(wanted) & (F.col("l.host") == own)).select(*(["at"] if more else []), F.concat(F.lit(base), F.col("l.path")).alias("url")).distinct()

    # each page is read once; the rounds meet addresses only, since pages are much larger than Spark takes them to be
    can = pages.filter(F.col("url").startswith(base) & F.substr("url", F.lit(len(base) + 1)).rlike(wanted))
    links = cut(linked(can, F.col("url"), F.col("url").alias("at")))
    known = fresh = cut(linked(seeds, F.lit(base + "/")))
    while not fresh.isEmpty():
        at = fresh.select(F.col("url").alias("at"))
        ahead = links.join(F.broadcast(at) if is_small(at, 20_000, 4 << 20) else at.hint("merge"), "at", "left_semi").select("url").distinct()
        fresh = cut(ahead.join(known.hint("merge"), "url", "left_anti"))
        known = known.unionByName(fresh)
    return known
