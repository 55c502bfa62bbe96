"""Reads, keys, times and curation that other queries leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.functions import text as X
from stratacat.operators import transitions as T
from stratacat.plans import transitions as PT
from stratacat.plans.facts import _GAS_SQL
from stratacat.plans.identity import NOW_MS
from stratacat.sources import crawl, pages
from stratacat.views import derived, sku, table, with_views

NOW = 1_735_689_600_000
#: What a store's API and the product's page say of parts.
ASKED = """SELECT p_partkey AS id, p_size, CAST(CASE p_partkey % 9 WHEN 0 THEN 503 WHEN 1 THEN NULL ELSE 200 END AS INT) AS status, CAST(p_partkey AS STRING) AS pid,
CASE p_partkey % 7 WHEN 0 THEN 'oops' WHEN 1 THEN '[]' WHEN 2 THEN '{"code":"x"}' ELSE concat('[{"id":1000000,"name":"other"},{"id":', p_partkey, ',"name":"<b>', p_name, '</b> &amp; co &#8211; x","is_in_stock":', CASE WHEN p_size % 3 = 0 THEN 'false' WHEN p_size % 3 = 1 THEN 'true' ELSE 'null' END,
',"prices":{"price":"', CASE WHEN p_size % 5 = 0 THEN '0' ELSE concat(p_size, '50') END, '"', CASE WHEN p_size % 2 = 0 THEN ',"currency_minor_unit":0' ELSE '' END, '},"images":[', CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('{"src":"i', p_partkey, '"}') END, ']}]') END AS payload,
CAST(CASE p_partkey % 5 WHEN 0 THEN 404 WHEN 1 THEN -1 WHEN 2 THEN 500 ELSE 200 END AS INT) AS page_status, CASE WHEN p_partkey % 10 = 3 THEN 'Just a moment...' ELSE 'fine' END AS page FROM part"""
REGISTRY = """SELECT p_brand AS brand, concat(lower(replace(p_brand, '#', '-')), '.example.com') AS domain, CASE WHEN p_brand LIKE '%3' THEN 'shopify' ELSE 'html' END AS probed_platform, p_brand NOT LIKE '%5' AS pursue, p_brand LIKE '%1%' AS dumped FROM part GROUP BY p_brand"""
VIDEO = "SELECT master_id, v.video_id, pinned, excluded, CAST(floor(value * 1000) AS BIGINT) AS views FROM ({0}) v JOIN events ON event_id = v.video_id"


def _store(s, d):
    rows = derived(s, d, ASKED)
    read = pages.store_read(*[F.col(c) for c in ("status", "payload", "pid", "page_status", "page")])
    return rows.select("id", F.explode(F.array(read)).alias("r")).select("id", "r.*")


def _targets(s, d):
    urls = table(s, d, "part").select(F.concat(F.lit("https://m.example.com/products/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_partkey") % 400).cast("string")).alias("url"))
    return pages.sitemap_targets(urls, includes="/products/", brand="widget", skip=r"-\d*7$", prefer="red|blue", most=60, offset=5, limit=40)


def _registry(s, d):
    rows = derived(s, d, REGISTRY)
    lists = rows.groupBy("dumped").agg(F.to_json(F.collect_list(F.struct("brand", "domain", "probed_platform", "pursue"))).alias("list"))  # one row per brand
    return pages.registry(lists.select(F.when(F.col("dumped"), F.concat(F.lit('[{"results":'), "list", F.lit("}]"))).otherwise(F.col("list")).alias("json")))


def _power(s, d):
    masters = derived(s, d, "SELECT id, power FROM v_master")
    asked = derived(s, d, PT.ATTACH)
    _, offers, _ = T.attach(derived(s, d, PT.STATE), derived(s, d, PT.OFFER), asked, masters)
    touched = asked.join(masters.select(F.col("id").alias("master_id")), "master_id", "left_semi").select(F.col("master_id").alias("id"))
    titles = sku(s, d).groupBy("sku_key").agg(F.min("title").alias("title")).withColumn("title", F.concat("title", F.when(F.crc32("sku_key") % 50 == 0, " nitro").otherwise("")))
    return T.rederive_power(masters, touched, offers, titles)


def _rescored(s, d):
    flags = derived(s, d, PT.VIDEO_FLAG)
    flagged = T.flag_videos(derived(s, d, PT.VIDEO), flags)
    facts = table(s, d, "events").select(F.col("event_id").alias("video_id"), F.floor(F.col("value") * 1000).cast("long").alias("views"), F.unix_millis(F.col("ts").cast("timestamp")).alias("published_ms"))
    masters = T.boost(derived(s, d, PT.BOOSTED), derived(s, d, PT.BOOST))
    touched = flags.select(F.col("master_id").alias("id")).union(derived(s, d, PT.BOOST).select("id"))
    return T.rescored(masters, touched, sku(s, d), flagged.join(facts, "video_id"), NOW_MS)


def _times(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms"), F.date_format("ts", "yyyyMMdd").alias("report"))
    return e.select("event_id", X.iso_day(F.col("ms")).alias("day"), X.day_start(F.col("ms")).alias("start"), X.report_day(F.col("report")).alias("reported"), X.ago(F.col("ms"), 1_706_700_000_000).alias("ago"))


QUERIES = {
    "src_store_check": _store,
    "src_mfr_sitemap_targets": _targets,
    "src_seed_json": _registry,
    "m_attach_power": _power,
    "m_pop_rescore": _rescored,
    "f_fnv1a_keys": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", X.image_key(F.col("text")).alias("key"), X.padded_hash(F.concat(F.col("text"), F.lit("\U0001f6e9"))).alias("padded")),
    "f_epoch_ms": _times,
    "f_title_from_url": lambda s, d: table(s, d, "pages").select("page_id", crawl.title_from_url(X.canonical_url(F.concat(F.lit("https://x.example.com/products/"), F.col("page_id").cast("string"), F.lit("/Sky_Ranger--"), F.col("page_id").cast("string"), F.lit("%20V2/12345678901234")))).alias("title")),
}
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), flatten(list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [CAST(55296 + ((unicode(c) - 65536) >> 10) AS BIGINT), CAST(56320 + ((unicode(c) - 65536) & 1023) AS BIGINT)] ELSE [CAST(unicode(c) AS BIGINT)] END))), lambda h, u: (xor(h, u) * 16777619) & 4294967295)"
_PAGE = "CASE WHEN page_status = -1 THEN 'missing' WHEN page_status = 404 THEN 'gone' WHEN page_status <> 200 OR page LIKE 'Just%' THEN 'blocked' ELSE 'missing' END"
ORACLE = {
    "src_store_check": f"""WITH a AS (SELECT *, CASE WHEN coalesce(status, 0) <> 200 OR id % 7 IN (0, 2) THEN 'blocked' WHEN id % 7 = 1 THEN {_PAGE} ELSE 'ok' END AS state, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 2 = 0 THEN p_size * 100 + 50 ELSE floor((p_size * 100 + 50) / 100 + 0.5) END AS amount FROM ({ASKED}))
SELECT id, state, CASE WHEN state = 'ok' THEN concat(p_name, ' & co – x') END AS title, CASE WHEN state = 'ok' AND a.p_size % 4 <> 0 THEN concat('i', id) END AS image, CASE WHEN state = 'ok' AND amount > 0 THEN CAST(amount AS BIGINT) END AS price,
CASE WHEN state = 'ok' THEN CASE WHEN a.p_size % 3 = 0 THEN 0 ELSE 1 END END AS stock FROM a JOIN part ON p_partkey = id""",
    "src_mfr_sitemap_targets": """WITH u AS (SELECT DISTINCT concat('https://m.example.com/products/', replace(p_name, ' ', '-'), '-', p_partkey % 400) AS url FROM part), f AS (SELECT *, regexp_matches(url, 'red|blue') AS first FROM u WHERE contains(lower(url), 'widget') AND NOT regexp_matches(url, '-\\d*7$'))
SELECT url, CAST(place AS INT) AS place FROM (SELECT url, row_number() OVER (ORDER BY first DESC, url) - 1 AS place FROM f) WHERE place BETWEEN 5 AND 44""",
    "src_seed_json": f"SELECT brand, domain, probed_platform AS platform FROM ({REGISTRY}) WHERE pursue",
    "m_pop_rescore": with_views(f"""
, v AS ({PT.VIDEO}), f AS ({PT.VIDEO_FLAG}), x AS (SELECT v.master_id, v.video_id, CASE WHEN field = 'excluded' THEN value ELSE excluded END AS excluded FROM v LEFT JOIN f ON f.master_id = v.master_id AND f.video_id = v.video_id)
, b AS (SELECT m.id, CASE WHEN b.id IS NULL OR boost NOT BETWEEN 0.5 AND 2 THEN pop_boost WHEN boost <> 1 THEN boost END AS boost FROM ({PT.BOOSTED}) m LEFT JOIN ({PT.BOOST}) b ON b.id = m.id WHERE m.id IN (SELECT master_id FROM f) OR m.id IN (SELECT id FROM ({PT.BOOST})))
, k AS (SELECT master_id AS id, count(DISTINCT source_id) AS sellers, max(CASE WHEN coalesce(in_stock, 0) = 1 AND dead = 0 THEN 1 ELSE 0 END) AS any_stock FROM v_sku WHERE review_status = 'approved' GROUP BY 1)
, r AS (SELECT master_id, CAST(floor(value * 1000) AS BIGINT) AS views, epoch_ms(ts) AS pub, row_number() OVER (PARTITION BY master_id ORDER BY CAST(floor(value * 1000) AS BIGINT) DESC, video_id) AS rk FROM x JOIN events ON event_id = video_id WHERE excluded <> 1)
, g AS (SELECT master_id AS id, CAST(sum(CASE WHEN rk <= 10 THEN views ELSE 0 END) AS BIGINT) AS view_sum, count(*) AS video_count, max(pub) AS newest FROM r GROUP BY 1)
, w AS (SELECT b.id, boost, coalesce(sellers, 0) AS sellers, coalesce(any_stock, 0) AS any_stock, coalesce(view_sum, 0) AS view_sum, coalesce(video_count, 0) AS video_count, coalesce(newest, 0) AS newest FROM b LEFT JOIN k ON k.id = b.id LEFT JOIN g ON g.id = b.id)
, y AS (SELECT *, floor((log10(1 + view_sum) * 12 + log10(1 + video_count) * 8 + CASE WHEN newest <> 0 THEN 10 * pow(0.5, greatest(0, {NOW_MS} - newest) / {180 * 86_400_000}) ELSE 0 END) * 100 + 0.5) / 100 AS raw FROM w)
SELECT id, view_sum, video_count, raw, floor(raw * (CASE WHEN any_stock = 1 THEN 1.0 ELSE 0.35 END * (1 + least(sellers, 5) * 0.05)) * coalesce(boost, 1.0) * 100 + 0.5) / 100 AS score FROM y"""),
    "f_fnv1a_keys": f"""SELECT conv_id, turn, concat('i/', lower(to_hex({_FNV.format('text')}))) AS key, lpad(lower(to_hex({_FNV.format("concat(text, chr(128745))")})), 8, '0') AS padded FROM conversations""",
    "f_epoch_ms": """WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 10 <> 0 THEN epoch_ms(ts) END AS ms FROM events), h AS (SELECT *, CAST(floor((1706700000000 - ms) / 3.6e6 + 0.5) AS BIGINT) AS hours FROM e)
SELECT event_id, CASE WHEN ms IS NOT NULL THEN strftime(ts, '%Y-%m-%d') END AS day, ms // 86400000 * 86400000 AS start, strftime(ts, '%Y-%m-%d') AS reported, CASE WHEN ms IS NULL THEN 'never' WHEN hours < 1 THEN '<1h ago' WHEN hours < 48 THEN concat(hours, 'h ago') ELSE concat(CAST(floor(hours / 24 + 0.5) AS BIGINT), 'd ago') END AS ago FROM h""",
    "f_title_from_url": "SELECT page_id, concat('Sky Ranger ', page_id, ' V2') AS title FROM pages",
    "m_attach_power": with_views(f"""
, a AS (SELECT sku_key, master_id FROM ({PT.ATTACH}) WHERE master_id IN (SELECT id FROM v_master)), o AS (SELECT sku_key, master_id FROM ({PT.OFFER}) UNION SELECT sku_key, master_id FROM a)
, bits AS (SELECT sku_key, min(title) AS title, list_transform(range(8 * length(sku_key)), lambda i: (ascii(sku_key[i // 8 + 1]) >> (i % 8)::INTEGER) & 1) AS x FROM v_sku GROUP BY sku_key)
, t AS (SELECT sku_key, concat(title, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, x::BIGINT[]), lambda s, b: xor(s >> 1, xor(s & 1, b) * 3988292384)), 4294967295) % 50 = 0 THEN ' nitro' ELSE '' END) AS text FROM bits)
, g AS (SELECT master_id AS id, max(CASE WHEN {_GAS_SQL} THEN 1 ELSE 0 END) AS gas FROM o JOIN t ON t.sku_key = o.sku_key WHERE master_id IN (SELECT master_id FROM a) GROUP BY 1)
SELECT m.id, CASE WHEN g.id IS NULL THEN power WHEN gas = 1 THEN 'gas' ELSE 'electric' END AS power FROM v_master m LEFT JOIN g ON g.id = m.id"""),
}
