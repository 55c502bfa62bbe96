"""Queues, admin lists, JSON objects and project statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.functions import objects as J
from stratacat.functions.text import canonical_url, decode_entities, decode_numeric
from stratacat.operators import queues as Q
from stratacat.operators import stats as S
from stratacat.operators import upsert as U
from stratacat.plans.transitions import MATCH, RANKED
from stratacat.views import derived, master, sku, with_views

NOW, DAY = 1_735_689_600_000, 86_400_000
SCORED = f"SELECT id, status, CAST(CASE WHEN id % 40 = 7 THEN NULL ELSE pop_score END AS DOUBLE) AS pop_score, CAST(CASE WHEN id % 9 = 0 THEN NULL ELSE {NOW} - id * 3600000 END AS BIGINT) AS pop_updated_at FROM v_master"
REFRESHED = f"SELECT id, status, CAST(coalesce(pop_score, 0) AS DOUBLE) AS pop_score, CAST({NOW} - id * 3600000 AS BIGINT) AS pop_updated_at FROM v_master"
CHECKED = "SELECT sku_key, review_status, dead, CAST(CASE WHEN master_id % 3 = 0 THEN NULL ELSE master_id * 1000 + source_id END AS BIGINT) AS last_checked FROM v_sku"
LEDGER = f"SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'ok' ELSE 'failed' END AS status, CAST({NOW} - p_partkey * 36000000 AS BIGINT) AS last_at FROM part"
NEW_SKU = "SELECT sku_key, source_id, review_status, dead, CAST(CASE WHEN master_id % 4 = 0 THEN 1 END AS BIGINT) AS enriched_at, CAST(master_id * 10 + source_id AS BIGINT) AS first_seen FROM v_sku"
MAPPED = "SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'planes' ELSE 'jets' END AS category_id FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'boats' FROM supplier WHERE s_suppkey % 3 = 0"
CATEGORY = "SELECT 'planes' AS category_id, 'p' AS triage UNION ALL SELECT 'jets', 'j'"
OFFERED = "SELECT sku_key, source_id, title, last_seen, CASE WHEN review_status = 'approved' THEN config END AS offer_config, CASE WHEN review_status = 'approved' AND master_id % 5 <> 0 THEN master_id END AS master_id FROM v_sku"
SLUGGED = "SELECT id, name, concat('m-', id) AS slug FROM v_master"
PICTURED = "SELECT sku_key, master_id, dead, in_stock, CASE WHEN source_id % 3 <> 0 THEN concat('https://img.example.com/', sku_key) END AS image_url FROM v_sku"
HERO = "SELECT id, CASE WHEN id % 7 = 0 THEN concat('https://hero.example.com/', id) END AS hero_image FROM v_master"
PAIR = "SELECT id AS a_id, id + 1 AS b_id, CAST(round(0.6 + (id % 7) / 20.0, 2) AS DOUBLE) AS score, CASE WHEN id % 9 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM v_master WHERE id % 3 <> 0"
PRODUCT = "SELECT id * 10 AS product_id, concat(name, ' kit') AS title, span_mm AS span, id % 25 AS maker_id FROM v_master UNION ALL SELECT id * 10 + 1, concat(name, ' pnp'), span_mm, id % 25 FROM v_master"
MAKER = "SELECT DISTINCT id % 25 AS maker_id, concat('Maker ', id % 25) AS maker FROM v_master WHERE id % 25 <> 3"
PROFILE = """SELECT id AS master_id, id * 10 AS product_id, CASE id % 4 WHEN 0 THEN '{"channels":4,"difficulty":null}' WHEN 1 THEN '{"channels":"4","launchMethods":["hand_launch","water"]}' WHEN 2 THEN 'broken' ELSE '{"difficulty":"beginner","on":true}' END AS overrides FROM v_master WHERE id % 3 <> 0"""
SHARED = "SELECT master_id AS old_id, master_id - master_id % 3 AS master_id, product_id % 40 AS product_id, overrides FROM (SELECT * FROM profile)"
IMAGES = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('["a', p_partkey, '","b"]') WHEN 1 THEN 'none' WHEN 2 THEN '[]' ELSE concat('["c', p_partkey, '"]') END AS images, CAST(p_partkey % 2 AS INT) AS i FROM part"""
SPECS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '{"spanMM":1200}' WHEN 1 THEN '{"spanMM":"900"}' WHEN 2 THEN '{"spanMM":null}' WHEN 3 THEN '[1]' WHEN 4 THEN '{"a"' ELSE concat('{"spanMM":', p_size, '.7}') END AS specs FROM part"""
SIDES = """SELECT p_partkey AS id, 0 AS side, CASE p_partkey % 3 WHEN 0 THEN '{"a":1,"b":null}' WHEN 1 THEN '{"b":2}' ELSE 'broken' END AS specs FROM part UNION ALL SELECT p_partkey, 1, '{"b":9,"c":"x"}' FROM part"""
FLAGGED = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '{"kind":"missing"}' WHEN 1 THEN '{"kind":"price-jump"}' WHEN 2 THEN '{}' END AS flagged FROM part"""
ENTITY = """SELECT p_partkey AS id, concat(CASE p_partkey % 6 WHEN 0 THEN '&#233;' WHEN 1 THEN '&#x2019;' WHEN 2 THEN '&#127881;x' WHEN 3 THEN '&amp;' WHEN 4 THEN '&amp;#39;' ELSE '&lt;&#xE9;' END, p_size, '&ndash;') AS text FROM part"""
PORTED = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'HTTP://A.com:80/p/' WHEN 1 THEN 'https://a.com:443/p#x' WHEN 2 THEN 'http://a.com:443/p' WHEN 3 THEN 'https://a.com:8080/collections/y/products/x?utm_a=1' ELSE 'https://a.com/collections/y-z/products/x/' END AS url FROM part"""
HOST = "CASE user_id % 9 WHEN 0 THEN 'localhost' WHEN 1 THEN 'x.pages.dev' WHEN 2 THEN NULL ELSE concat('p', user_id % 9, '.example.com') END"
TRAFFIC = f"SELECT CAST(ts AS DATE) AS d, {HOST} AS host, CAST(1 AS BIGINT) AS sessions, CAST(user_id % 3 AS BIGINT) AS users, CAST(event_id % 5 AS BIGINT) AS views FROM events"
CHANNEL = f"SELECT {HOST} AS host, CASE event_type WHEN 'error' THEN 'Unassigned' ELSE event_type END AS channel, count(*) AS sessions FROM events GROUP BY 1, 2"
EDGE = "SELECT concat('p', user_id % 9, '.example.com') AS host, CAST(event_id % 7 AS BIGINT) AS views FROM events WHERE user_id % 9 > 4"
FEED = f"SELECT event_id AS video_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS views, CAST(event_id % 50 AS BIGINT) AS likes, CAST({NOW} - event_id * 600000 AS BIGINT) AS published_ms FROM events"
PART_URL = "SELECT concat('https://x.example.com/', replace(p_type, ' ', '-'), '/', p_size) AS url FROM part"


def _profiles(s, d):
    return derived(s, d, SHARED, profile=derived(s, d, PROFILE))


def _overlay(s, d):
    m = lambda q: F.from_json(F.col(q), "map<string,string>")
    rows = derived(s, d, f"""SELECT master_id, '{{"channels":"5","difficulty":"advanced","maxAuwG":"900"}}' AS a, overrides AS b FROM profile WHERE master_id % 4 <> 1""", profile=derived(s, d, PROFILE))
    merged = J.overlay(m("a"), m("b"), ["channels", "difficulty", "maxAuwG"])
    return rows.select("master_id", *[F.map_contains_key(merged, k).alias(f"has_{k}") for k in ("channels", "difficulty")], *[F.try_element_at(merged, F.lit(k)).alias(k) for k in ("channels", "difficulty", "maxAuwG")])


def _review(status):
    return lambda s, d: Q.match_review(derived(s, d, MATCH), derived(s, d, RANKED).withColumn("rank", F.lit(1)), master(s, d), derived(s, d, PRODUCT), derived(s, d, MAKER), derived(s, d, PROFILE), status)


def _preserve(s, d):
    """Fetched pictures of masters again: an archive key once written stays, flags of people stay."""
    old = derived(s, d, "SELECT id, CASE WHEN id % 2 = 0 THEN concat('k', id) ELSE '' END AS archive, CAST(CASE WHEN id % 3 = 0 THEN id END AS BIGINT) AS size, id % 5 = 0 AS pinned FROM v_master")
    new = derived(s, d, "SELECT id + 100 AS id, concat('n', id) AS archive, CAST(id * 2 AS BIGINT) AS size, false AS pinned FROM v_master")
    return U.upsert(old, new, ["id"], {"archive": "keep", "size": "keep", "pinned": "old"})


def _occ(s, d):
    rows = derived(s, d, "SELECT id, name, CAST(CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS BIGINT) AS updated_at, power FROM v_master")
    patches = derived(s, d, "SELECT id, CAST(CASE WHEN id % 4 = 0 THEN NULL WHEN id % 5 = 0 THEN -1 ELSE id END AS BIGINT) AS expected, concat(name, '!') AS name, CAST(NULL AS STRING) AS power FROM v_master WHERE id % 2 = 0")
    return U.update_if_unchanged(rows, patches, "id", "updated_at")[0]


def _stamp(s, d):
    """Masters with the power class of all their offers' titles."""
    from stratacat.functions.classify import power

    gas = sku(s, d).groupBy("master_id").agg(F.max((power(F.col("title")) == "gas").cast("int")).alias("gas"))
    return master(s, d).drop("power").join(gas, F.col("id") == F.col("master_id")).select("id", F.when(F.col("gas") == 1, "gas").otherwise("electric").alias("power"))


QUERIES = {
    "k_pop_queue": lambda s, d: Q.popularity_queue(derived(s, d, SCORED), sku(s, d), NOW),
    "t_backfill_then_refresh": lambda s, d: Q.popularity_queue(derived(s, d, REFRESHED), sku(s, d), NOW, many=40),
    "t_ttl_retry": lambda s, d: derived(s, d, LEDGER).filter((F.col("status") != "ok") & Q.retry_due(F.col("last_at"), NOW, 3 * DAY)).select("id"),
    "o_oldest_first": lambda s, d: Q.oldest_first(derived(s, d, CHECKED).filter("review_status = 'approved' AND dead = 0"), "last_checked", "sku_key", 6).select("sku_key", "last_checked"),
    "q05_enrich_queue": lambda s, d: Q.enrich_queue(derived(s, d, NEW_SKU), derived(s, d, MAPPED), derived(s, d, CATEGORY)),
    "q06_classify_backlog": lambda s, d: Q.classify_backlog(master(s, d), sku(s, d)),
    "j_left_chain": lambda s, d: Q.review_page(derived(s, d, OFFERED), derived(s, d, SLUGGED), 2),
    "w_first_image": lambda s, d: Q.first_images(derived(s, d, HERO), derived(s, d, PICTURED)),
    "w_round_robin": lambda s, d: Q.round_robin(derived(s, d, "SELECT p_partkey AS id, p_type AS category FROM part"), "category", ["id"]),
    "w_url_prefer_rank": lambda s, d: Q.preferred(derived(s, d, PART_URL), "TIN", "STEEL|BRASS", 120),
    "j_self_pair": lambda s, d: Q.duplicate_pairs(derived(s, d, PAIR), master(s, d), sku(s, d)),
    "k_mfr_review": _review("accepted"),
    "k_mfr_review_pending": _review("pending"),
    "a_json_group_object": lambda s, d: J.merge(_profiles(s, d), ["master_id", "product_id"], "overrides", [(F.col("old_id") != F.col("master_id")).cast("int"), F.col("old_id")]),
    "src_json_each_correlated": lambda s, d: J.members(derived(s, d, PROFILE), "overrides", "master_id").select("master_id", "key", F.is_variant_null("value").alias("empty")),
    "f_overlay_null": _overlay,
    "src_json_array_index": lambda s, d: derived(s, d, IMAGES).select("id", J.element_at(F.col("images"), F.col("i")).alias("image")),
    "f_json_extract": lambda s, d: derived(s, d, SPECS).select("id", J.integer_at(F.col("specs"), "spanMM").alias("span"), J.safe_object(F.col("specs")).alias("safe")),
    "f_json_merge": lambda s, d: J.merge(derived(s, d, SIDES), ["id"], "specs", [F.col("side")]),
    "p_json_predicate": lambda s, d: derived(s, d, FLAGGED).filter(F.get_json_object("flagged", "$.kind") != "missing").select("id"),
    "f_decode_entities": lambda s, d: derived(s, d, ENTITY).select("id", decode_entities(decode_numeric(F.col("text"))).alias("text")),
    "f_canonical_ports": lambda s, d: derived(s, d, PORTED).select("id", canonical_url(F.col("url")).alias("canonical")),
    "a_host_totals": lambda s, d: S.host_totals(S.real_hosts(derived(s, d, TRAFFIC))),
    "a_top1_channel": lambda s, d: S.top_channel(S.real_hosts(derived(s, d, CHANNEL))),
    "k_stats_projects": lambda s, d: S.projects(S.real_hosts(derived(s, d, TRAFFIC)), S.real_hosts(derived(s, d, CHANNEL)), derived(s, d, EDGE)),
    "a_feed_rollup": lambda s, d: S.feed_rollup(derived(s, d, FEED), NOW),
    "sink_upsert_preserve": _preserve,
    "sink_upsert_occ": _occ,
    "sink_delete_in": lambda s, d: U.delete_keys(sku(s, d).select("sku_key", "master_id"), master(s, d).filter("status = 'retired'").select(F.col("id").alias("master_id")), ["master_id"]),
    "sink_update_from_agg": _stamp,
    "j_semi": lambda s, d: sku(s, d).filter("review_status = 'new'").join(sku(s, d).filter("review_status = 'approved'").select("master_id"), "master_id", "left_semi").select("sku_key", "master_id"),
    "q30_source_categories": lambda s, d: derived(s, d, MAPPED).groupBy("source_id").agg(F.array_join(F.sort_array(F.collect_set("category_id")), ",").alias("cats")),
    "o_nocase": lambda s, d: master(s, d).select("id", "brand", "name").orderBy(F.collate("brand", "UTF8_LCASE"), F.collate("name", "UTF8_LCASE"), "id").limit(60),
}
_LIVE = "coalesce(in_stock, 0) = 1 AND dead = 0"
_STOCKED = f", o AS (SELECT master_id, count(DISTINCT source_id) AS sellers FROM v_sku WHERE review_status = 'approved' GROUP BY 1 HAVING max(CASE WHEN {_LIVE} THEN 1 ELSE 0 END) = 1)"
_MEMBERS = "SELECT *, unnest(json_keys(ok)) AS key FROM (SELECT *, CASE WHEN json_valid(overrides) AND json_type(CAST(CASE WHEN json_valid(overrides) THEN overrides END AS JSON)) = 'OBJECT' THEN CAST(overrides AS JSON) ELSE CAST('{}' AS JSON) END AS ok FROM %s)"
_REAL = "host IS NOT NULL AND NOT regexp_matches(host, '(?i)(^|\\.)localhost$|^127\\.0\\.0\\.1$|\\.pages\\.dev$|\\.workers\\.dev$')"


def _review_sql(status: str) -> str:
    return with_views(f""", m AS (SELECT * FROM ({MATCH}) WHERE status = '{status}' ORDER BY CASE tier WHEN 'review' THEN 0 WHEN 'accept' THEN 1 ELSE 2 END, score DESC, master_id LIMIT 500), c AS ({RANKED})
, r AS (SELECT master_id, product_id, 1 AS rank, score, tier, reason FROM c WHERE master_id IN (SELECT master_id FROM m)
  UNION ALL SELECT master_id, product_id, 0, score, tier, 'currently saved mapping' FROM m WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM c WHERE c.master_id = m.master_id AND c.product_id = m.product_id))
SELECT r.master_id, v.name, r.product_id, rank, score, tier, reason, title, maker, overrides FROM r JOIN v_master v ON v.id = r.master_id LEFT JOIN ({PRODUCT}) p ON p.product_id = r.product_id LEFT JOIN ({MAKER}) k ON k.maker_id = p.maker_id
LEFT JOIN ({PROFILE}) f ON f.master_id = r.master_id AND f.product_id = r.product_id""")


ORACLE = {
    "k_pop_queue": with_views(f"""{_STOCKED}, r AS (SELECT m.*, sellers FROM ({SCORED}) m JOIN o ON master_id = id WHERE status = 'ready')
SELECT id, sellers, 'backfill' AS mode FROM r WHERE pop_score IS NULL AND (pop_updated_at IS NULL OR pop_updated_at < {NOW - DAY}) ORDER BY pop_updated_at NULLS FIRST, id LIMIT 12"""),
    "t_backfill_then_refresh": with_views(f"""{_STOCKED}, r AS (SELECT m.*, sellers FROM ({REFRESHED}) m JOIN o ON master_id = id WHERE status = 'ready')
SELECT id, sellers, 'refresh' AS mode FROM r WHERE pop_updated_at < {NOW - 7 * DAY} ORDER BY pop_updated_at NULLS FIRST, id LIMIT 40"""),
    "t_ttl_retry": f"SELECT id FROM ({LEDGER}) WHERE status <> 'ok' AND last_at < {NOW - 3 * DAY}",
    "o_oldest_first": with_views(f"SELECT sku_key, last_checked FROM ({CHECKED}) WHERE review_status = 'approved' AND dead = 0 ORDER BY last_checked NULLS FIRST, sku_key LIMIT 6"),
    "q05_enrich_queue": with_views(f""", f AS (SELECT source_id, min(m.category_id) AS category_id, arg_min_null(triage, m.category_id) AS triage FROM ({MAPPED}) m LEFT JOIN ({CATEGORY}) c ON c.category_id = m.category_id GROUP BY 1)
SELECT sku_key, category_id, triage FROM ({NEW_SKU}) k LEFT JOIN f ON f.source_id = k.source_id WHERE review_status = 'new' AND enriched_at IS NULL AND dead = 0 ORDER BY first_seen DESC, sku_key LIMIT 5"""),
    "q06_classify_backlog": with_views(""", c AS (SELECT id FROM v_master WHERE role_tags IS NULL AND status IN ('ready', 'draft') ORDER BY id LIMIT 12)
SELECT id, string_agg(DISTINCT title, ' | ' ORDER BY title) AS titles FROM c LEFT JOIN v_sku ON master_id = id GROUP BY id"""),
    "j_left_chain": with_views(f"""SELECT sku_key, title, offer_config, name AS master_name, slug AS master_slug FROM (SELECT * FROM ({OFFERED}) ORDER BY last_seen DESC, sku_key, source_id LIMIT 50 OFFSET 50) k LEFT JOIN ({SLUGGED}) m ON m.id = k.master_id"""),
    "w_first_image": with_views(f"""SELECT id, coalesce(hero_image, image_url) AS image FROM ({HERO}) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY master_id ORDER BY dead, coalesce(in_stock, -1) DESC, sku_key) AS n FROM ({PICTURED}) WHERE image_url IS NOT NULL) ON master_id = id AND n = 1"""),
    "w_round_robin": "SELECT p_partkey AS id, p_type AS category, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS turn FROM part",
    "w_url_prefer_rank": f"SELECT url FROM (SELECT DISTINCT url FROM ({PART_URL})) WHERE NOT regexp_matches(url, 'TIN') ORDER BY CASE WHEN regexp_matches(url, 'STEEL|BRASS') THEN 0 ELSE 1 END, url LIMIT 120",
    "j_self_pair": with_views(f""", t AS (SELECT master_id, count(*) AS offers, max(CASE WHEN {_LIVE} THEN 1 ELSE 0 END) AS stock FROM v_sku GROUP BY 1)
, m AS (SELECT id, name, CASE WHEN status = 'ready' THEN 0 ELSE 1 END AS st, coalesce(offers, 0) AS offers, coalesce(stock, 0) AS stock, CASE WHEN span_mm > 0 THEN 0 ELSE 1 END AS sp FROM v_master LEFT JOIN t ON master_id = id)
SELECT a_id, b_id, a.name AS a_name, b.name AS b_name, score, a.stock = 1 AND b.stock = 1 AS both_in_stock, CASE WHEN (a.st, -a.offers, a.sp, a.id) < (b.st, -b.offers, b.sp, b.id) THEN a_id ELSE b_id END AS keep_id
FROM ({PAIR}) p JOIN m a ON a.id = a_id JOIN m b ON b.id = b_id WHERE p.status = 'pending'"""),
    "k_mfr_review": _review_sql("accepted"),
    "k_mfr_review_pending": _review_sql("pending"),
    "a_json_group_object": with_views(f""", profile AS ({PROFILE}), s AS ({SHARED}), e AS ({_MEMBERS % 's'})
, f AS (SELECT master_id, product_id, key, arg_min(CAST(json_extract(ok, '$.' || key) AS VARCHAR), (CASE WHEN old_id <> master_id THEN 1 ELSE 0 END, old_id)) AS v FROM e GROUP BY 1, 2, 3)
, g AS (SELECT master_id, product_id, concat('{{', string_agg(concat('"', key, '":', v), ',' ORDER BY key), '}}') AS o FROM f GROUP BY 1, 2)
SELECT DISTINCT s.master_id, s.product_id, coalesce(o, '{{}}') AS overrides FROM s LEFT JOIN g ON g.master_id = s.master_id AND g.product_id = s.product_id"""),
    "src_json_each_correlated": with_views(f", p AS ({PROFILE}), e AS ({_MEMBERS % 'p'}) SELECT master_id, key, json_type(json_extract(ok, '$.' || key)) = 'NULL' AS empty FROM e"),
    "f_overlay_null": with_views(f""", p AS (SELECT master_id, CASE WHEN overrides = 'broken' THEN NULL ELSE CAST(overrides AS JSON) END AS o FROM ({PROFILE}) WHERE master_id % 4 <> 1)
SELECT master_id, true AS has_channels, true AS has_difficulty, coalesce(json_extract_string(o, '$.channels'), '5') AS channels, CASE WHEN json_exists(o, '$.difficulty') THEN json_extract_string(o, '$.difficulty') ELSE 'advanced' END AS difficulty, '900' AS "maxAuwG" FROM p"""),
    "src_json_array_index": f"SELECT id, CASE WHEN images LIKE '[%' THEN json_extract_string(images, '$[' || i || ']') END AS image FROM ({IMAGES})",
    "f_json_extract": f"""SELECT id, CAST(trunc(TRY_CAST(CASE WHEN json_valid(specs) THEN json_extract_string(specs, '$.spanMM') END AS DOUBLE)) AS INT) AS span, CASE WHEN json_valid(specs) AND specs LIKE '{{%' THEN specs ELSE '{{}}' END AS safe FROM ({SPECS})""",
    "f_json_merge": """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{"a":1,"b":null,"c":"x"}' WHEN 1 THEN '{"b":2,"c":"x"}' ELSE '{"b":9,"c":"x"}' END AS specs FROM part""",
    "p_json_predicate": "SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 1",
    "f_decode_entities": """SELECT p_partkey AS id, concat(CASE p_partkey % 6 WHEN 0 THEN 'é' WHEN 1 THEN '’' WHEN 2 THEN '🎉x' WHEN 3 THEN '&' WHEN 4 THEN '&#39;' ELSE '<é' END, p_size, '–') AS text FROM part""",
    "f_canonical_ports": """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'http://a.com/p' WHEN 1 THEN 'https://a.com/p' WHEN 2 THEN 'http://a.com:443/p' WHEN 3 THEN 'https://a.com:8080/products/x' ELSE 'https://a.com/products/x' END AS canonical FROM part""",
    "a_host_totals": f"SELECT host, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(users) AS BIGINT) AS users, CAST(sum(views) AS BIGINT) AS views FROM ({TRAFFIC}) WHERE {_REAL} GROUP BY 1",
    "a_top1_channel": f"SELECT host, channel, sessions FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY sessions DESC, channel DESC) AS n FROM ({CHANNEL}) WHERE channel <> 'Unassigned' AND {_REAL}) WHERE n = 1",
    "k_stats_projects": f"""WITH t AS (SELECT * FROM ({TRAFFIC}) WHERE {_REAL}), e AS (SELECT host, max(d) AS last FROM t GROUP BY 1)
, g AS (SELECT t.host, CAST(coalesce(sum(sessions) FILTER (WHERE d < last AND d >= last - 7), 0) AS BIGINT) AS last7, CAST(coalesce(sum(sessions) FILTER (WHERE d < last - 7 AND d >= last - 14), 0) AS BIGINT) AS prev7, CAST(sum(views) AS BIGINT) AS views FROM t JOIN e ON e.host = t.host GROUP BY 1)
, c AS (SELECT host, channel FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY sessions DESC, channel DESC) AS n FROM ({CHANNEL}) WHERE channel <> 'Unassigned') WHERE n = 1)
SELECT g.host, last7, prev7, CASE WHEN prev7 = 0 AND last7 = 0 THEN 'none' WHEN prev7 = 0 OR (last7 - prev7) * 100.0 / prev7 > 500 THEN 'new' WHEN (last7 - prev7) * 100.0 / prev7 > 3 THEN 'up' WHEN (last7 - prev7) * 100.0 / prev7 < -3 THEN 'down' ELSE 'flat' END AS label,
views, edge_views, channel FROM g LEFT JOIN (SELECT host, CAST(sum(views) AS BIGINT) AS edge_views FROM ({EDGE}) GROUP BY 1) x ON x.host = g.host LEFT JOIN c ON c.host = g.host""",
    "a_feed_rollup": f"""WITH f AS ({FEED}) SELECT count(*) AS in_feed, CAST(sum(coalesce(views, 0)) AS BIGINT) AS views, CAST(sum(likes) AS BIGINT) AS likes, count(*) FILTER (WHERE published_ms > {NOW - 28 * DAY}) AS recent,
(SELECT string_agg(video_id, ',' ORDER BY coalesce(views, 0) DESC, video_id) FROM (SELECT * FROM f ORDER BY coalesce(views, 0) DESC, video_id LIMIT 10)) AS top FROM f""",
    "sink_upsert_preserve": with_views("""SELECT coalesce(o.id, n.id + 100) AS id, CASE WHEN o.id IS NULL THEN concat('n', n.id) WHEN n.id IS NULL THEN CASE WHEN o.id % 2 = 0 THEN concat('k', o.id) ELSE '' END WHEN o.id % 2 = 0 THEN concat('k', o.id) ELSE concat('n', n.id) END AS archive,
CASE WHEN o.id IS NOT NULL AND o.id % 3 = 0 THEN o.id WHEN n.id IS NULL THEN NULL ELSE n.id * 2 END AS size, coalesce(o.id % 5 = 0, false) AS pinned FROM v_master o FULL JOIN v_master n ON n.id + 100 = o.id"""),
    "sink_upsert_occ": with_views("""SELECT id, CASE WHEN id % 2 = 0 AND (id % 4 = 0 OR id % 5 <> 0) THEN concat(name, '!') ELSE name END AS name, CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS updated_at, CASE WHEN id % 2 = 0 AND (id % 4 = 0 OR id % 5 <> 0) THEN NULL ELSE power END AS power FROM v_master"""),
    "sink_delete_in": with_views("SELECT sku_key, master_id FROM v_sku WHERE master_id NOT IN (SELECT id FROM v_master WHERE status = 'retired')"),
    "sink_update_from_agg": with_views(r"""SELECT master_id AS id, CASE WHEN max(CASE WHEN regexp_matches(lower(title), '\b\d{2,3}\s*cc\b|(^|[\s(/])\.\d{2}\b|\b(nitro|glow|petrol|gasoline|gasser|engine|2[\s-]?stroke|4[\s-]?stroke)\b|\b(dle|dla|saito|zenoah|ngh|moki|3w|da[\s-]?\d{2})\b') THEN 1 ELSE 0 END) = 1 THEN 'gas' ELSE 'electric' END AS power FROM v_sku JOIN v_master ON id = master_id GROUP BY 1"""),
    "j_semi": with_views("SELECT sku_key, master_id FROM v_sku WHERE review_status = 'new' AND master_id IN (SELECT master_id FROM v_sku WHERE review_status = 'approved')"),
    "q30_source_categories": f"SELECT source_id, string_agg(DISTINCT category_id, ',' ORDER BY category_id) AS cats FROM ({MAPPED}) GROUP BY 1",
    "o_nocase": with_views("SELECT id, brand, name FROM v_master ORDER BY lower(brand), lower(name), id LIMIT 60"),
}
