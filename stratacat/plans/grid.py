"""Grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.operators import grid as G
from stratacat.views import master, sku, with_views

_USED = "(" + " OR ".join(f"lower(k.title) LIKE '%{p}%'" for p in G.USED_PHRASES) + ")"
_LIVE = "coalesce(k.in_stock, 0) = 1 AND k.dead = 0"
_STAR = f"""
, live AS (
  SELECT m.id, m.category_id, m.brand, m.name, m.status, m.power, m.role_tags, m.pop_score, m.span_mm,
    count(DISTINCT k.source_id) AS sellers,
    min(CASE WHEN {_LIVE} AND k.pack_qty = 1 THEN k.price_inr END) AS min_price,
    max(CASE WHEN {_LIVE} AND {_USED} THEN 1 ELSE 0 END) AS preowned_stock,
    max(CASE WHEN {_LIVE} AND NOT {_USED} THEN 1 ELSE 0 END) AS new_stock,
    max(k.last_seen) AS last_seen
  FROM v_master m JOIN v_sku k ON k.master_id = m.id AND k.review_status = 'approved'
  WHERE m.status = 'ready'
  GROUP BY ALL HAVING max(CASE WHEN {_LIVE} THEN 1 ELSE 0 END) = 1
)
"""
_GRID = ["id", "brand", "name", "power", "role_tags", "pop_score", "sellers", "min_price", "span_mm", "preowned_stock", "new_stock"]
_PAGED = ["id", "min_price", "span_mm", "sellers"]
_TAGS = "coalesce(from_json(role_tags, '[\"VARCHAR\"]'), [])"
_SIZE = "CASE WHEN coalesce(span_mm, 0) = 0 THEN '' WHEN span_mm < 1000 THEN 'small' WHEN span_mm <= 1500 THEN 'medium' ELSE 'large' END"


def _sql(select: str) -> str:
    return with_views(_STAR.strip() + select)


def live(spark, sf_dir):
    return G.live_masters(master(spark, sf_dir), sku(spark, sf_dir))


def _page(order: str, number: int):
    return lambda s, d: G.page(live(s, d).filter(G.power_of() == "electric"), order, number, 24).select(*_PAGED)


def _page_sql(order: str, number: int) -> str:
    return _sql(f"SELECT {', '.join(_PAGED)} FROM live WHERE coalesce(power, 'electric') = 'electric' ORDER BY {order}, id LIMIT 24 OFFSET {(number - 1) * 24}")


def _offers(spark, sf_dir):
    """All offers of the masters, best first within each: in stock, alive, cheapest, with their place."""
    from pyspark.sql import Window

    k = sku(spark, sf_dir).filter("review_status = 'approved'").join(master(spark, sf_dir).filter("status = 'ready'").select(F.col("id").alias("master_id")), "master_id")
    order = Window.partitionBy("master_id").orderBy("dead", F.desc_nulls_last("in_stock"), F.asc_nulls_last("price_inr"), "sku_key", "source_id")
    return k.withColumn("place", F.row_number().over(order)).select("master_id", "sku_key", "price_inr", "dead", "in_stock", "place")


def _facets(roles, sizes, cond):
    return lambda s, d: G.facet_counts(live(s, d), roles, sizes, cond)


def _facet_sql(role: str, size: str, cond: str) -> str:
    return _sql(f"""
, f AS (SELECT *, {_TAGS} AS t, {_SIZE} AS s, ({role}) AS r_ok, ({size}) AS s_ok, ({cond}) AS c_ok FROM (SELECT *, {_TAGS} AS tg, {_SIZE} AS sz FROM live))
SELECT 'role' AS facet, value, count(*) AS n FROM (SELECT unnest(list_distinct(t)) AS value FROM f WHERE s_ok AND c_ok) GROUP BY value
UNION ALL SELECT 'size', s, count(*) FROM f WHERE r_ok AND c_ok AND s <> '' GROUP BY s
UNION ALL SELECT 'condition', 'new', count(*) FROM f WHERE r_ok AND s_ok AND new_stock = 1 HAVING count(*) > 0
UNION ALL SELECT 'condition', 'preowned', count(*) FROM f WHERE r_ok AND s_ok AND preowned_stock = 1 HAVING count(*) > 0""")


def _landing_sql() -> str:
    roles = "CASE t " + " ".join(f"WHEN '{r}' THEN '{s}'" for s, r in G.ROLE_PAGES.items()) + " END"
    return _sql(f"""
, n AS (SELECT id, CASE coalesce(power, 'electric') WHEN 'gas' THEN 'nitro' ELSE 'electric' END AS p, list_distinct({_TAGS}) AS ts FROM live)
, r AS (SELECT id, p, {roles} AS slug FROM (SELECT id, p, unnest(ts) AS t FROM n))
, a AS (SELECT slug FROM r WHERE slug IS NOT NULL UNION ALL SELECT p FROM n UNION ALL SELECT concat(p, '-', slug) FROM r WHERE slug IS NOT NULL)
SELECT slug, count(*) AS n FROM a GROUP BY slug HAVING count(*) >= 3""")


QUERIES = {
    "k_grid_facet": lambda s, d: live(s, d).select(*_GRID),
    "q18_grid_price_desc": _page("price-desc", 1),
    "q18_grid_price_asc_page2": _page("price-asc", 2),
    "q18_grid_span_desc": _page("span-desc", 1),
    "q18_grid_span_asc": _page("span-asc", 1),
    "o_grid_popular": _page("popular", 1),
    "q20_power_counts": lambda s, d: G.power_counts(live(s, d)),
    "k_facets_all": _facets([], [], "all"),
    "k_facets_selected": _facets(["Warbird", "Trainer"], ["medium", "large"], "new"),
    "k_landing_valid": lambda s, d: G.landings(live(s, d)),
    "k_similar": lambda s, d: G.similar(live(s, d), master(s, d).filter("status = 'ready'")).select("seed_id", "other_id", "shared", "dspan", "rank"),
    "k_browse": lambda s, d: G.browse(live(s, d)),
    "q44_browse_list": lambda s, d: live(s, d).select("id", "brand", "name", "role_tags", G.power_of().alias("power")),
    "q46_home_top4": lambda s, d: live(s, d).filter("min_price IS NOT NULL").orderBy(F.desc("min_price"), "id").limit(4).select("id", "brand", "name", "min_price"),
    "k_product_offer_summary": lambda s, d: G.offer_summary(master(s, d), sku(s, d)),
    "k_offer_list": _offers,
    "k_sitemap": lambda s, d: live(s, d).select("id", F.to_date("last_seen").cast("string").alias("lastmod")),
    "q23_changed_export": lambda s, d: live(s, d).filter(F.col("last_seen") > F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "last_seen"),
}
_NOPRICE = "(min_price IS NULL), min_price"
_NOSPAN = "(span_mm IS NULL OR span_mm = 0), span_mm"
ORACLE = {
    "k_grid_facet": _sql(f"SELECT {', '.join(_GRID)} FROM live"),
    "q18_grid_price_desc": _page_sql(f"{_NOPRICE} DESC", 1),
    "q18_grid_price_asc_page2": _page_sql(f"{_NOPRICE} ASC", 2),
    "q18_grid_span_desc": _page_sql(f"{_NOSPAN} DESC, {_NOPRICE} ASC", 1),
    "q18_grid_span_asc": _page_sql(f"{_NOSPAN} ASC, {_NOPRICE} ASC", 1),
    "o_grid_popular": _page_sql("coalesce(pop_score, -1) DESC, coalesce(min_price, -1) DESC", 1),
    "q20_power_counts": _sql("SELECT coalesce(power, 'electric') AS power, count(*) AS n FROM live GROUP BY 1"),
    "k_facets_all": _facet_sql("true", "true", "true"),
    "k_facets_selected": _facet_sql("list_has_any(tg, ['Warbird', 'Trainer'])", "sz IN ('medium', 'large')", "new_stock = 1"),
    "k_landing_valid": _landing_sql(),
    "k_similar": _sql(f"""
, a AS (SELECT category_id, id, coalesce(span_mm, 0) AS span, unnest(list_distinct({_TAGS})) AS tag FROM v_master WHERE status = 'ready')
, b AS (SELECT category_id, id, coalesce(span_mm, 0) AS span, unnest(list_distinct({_TAGS})) AS tag FROM live)
, p AS (SELECT a.id AS seed_id, b.id AS other_id, count(*) AS shared, abs(min(a.span) - min(b.span)) AS dspan FROM a JOIN b USING (category_id, tag) WHERE a.id <> b.id GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed_id ORDER BY shared DESC, dspan, other_id) AS INT) AS rank FROM p) WHERE rank <= 8"""),
    "k_browse": _sql(f"SELECT * FROM (SELECT coalesce({_TAGS}[1], 'Other') AS role, count(*) AS n, list_position([{', '.join(repr(r) for r in [*G.ROLES, 'Other'])}], coalesce({_TAGS}[1], 'Other')) AS place FROM live GROUP BY ALL) WHERE place IS NOT NULL"),
    "q44_browse_list": _sql("SELECT id, brand, name, role_tags, coalesce(power, 'electric') AS power FROM live"),
    "q46_home_top4": _sql("SELECT id, brand, name, min_price FROM live WHERE min_price IS NOT NULL ORDER BY min_price DESC, id LIMIT 4"),
    "k_product_offer_summary": with_views(f"""
, s AS (SELECT master_id, string_agg(DISTINCT config, ',' ORDER BY config) AS configs,
  min(CASE WHEN {_LIVE} AND pack_qty = 1 AND NOT {_USED} THEN nullif(price_inr, 0) END) AS head, min(CASE WHEN {_LIVE} THEN nullif(price_inr, 0) END) AS live_low,
  min(nullif(price_inr, 0)) AS seen_low, max(CASE WHEN {_LIVE} THEN nullif(price_inr, 0) END) AS live_high, max(nullif(price_inr, 0)) AS seen_high,
  count(*) FILTER (WHERE {_LIVE}) AS n_live, count(*) AS n_all FROM v_sku k WHERE review_status = 'approved' GROUP BY master_id)
SELECT id, configs, coalesce(head, live_low, seen_low) AS low_price,
  coalesce(CASE WHEN n_live > 0 THEN live_high ELSE seen_high END, head, live_low, seen_low) AS high_price,
  CASE WHEN n_live > 0 THEN n_live ELSE n_all END AS offer_count, CASE WHEN n_live > 0 THEN 'InStock' ELSE 'OutOfStock' END AS availability
FROM v_master JOIN s ON id = master_id WHERE status = 'ready'"""),
    "k_offer_list": with_views("""
SELECT master_id, sku_key, price_inr, dead, in_stock, place FROM (
  SELECT k.*, CAST(row_number() OVER (PARTITION BY master_id ORDER BY dead, in_stock DESC NULLS LAST, price_inr ASC NULLS LAST, sku_key, source_id) AS INT) AS place
  FROM v_sku k JOIN v_master m ON m.id = k.master_id AND m.status = 'ready' WHERE review_status = 'approved')"""),
    "k_sitemap": _sql("SELECT id, CAST(CAST(last_seen AS DATE) AS VARCHAR) AS lastmod FROM live"),
    "q23_changed_export": _sql("SELECT id, last_seen FROM live WHERE last_seen > TIMESTAMP '1998-01-01'"),
}
