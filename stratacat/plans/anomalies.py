"""Guesses for listings, doubtful brands and power classes, child tables of merged masters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.functions import guess as G
from stratacat.operators import dedup as D
from stratacat.operators import transitions as T
from stratacat.operators import upsert as U
from stratacat.functions import classify as K
from stratacat.plans.facts import _GAS_SQL, SUFFIXES, _case, _span_sql
from stratacat.plans.identity import _CLUSTER, _DD, _clusters
from stratacat.plans.transitions import MATCH, VIDEO
from stratacat.views import derived, sku, with_views

BRANDS = ["X-UAV", "Dark Maker", "almond", "Blue"]
_SUFFIX = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(SUFFIXES)) + " END"
LISTING = f"""SELECT p_partkey AS id, concat(CASE p_partkey % 5 WHEN 0 THEN 'xuav ' WHEN 1 THEN 'Dark-Maker: ' WHEN 2 THEN '' ELSE 'RC Plane ' END, p_name, {_SUFFIX}, CASE WHEN p_partkey % 3 = 0 THEN ' - Best Shop India' ELSE '' END) AS title,
CASE p_partkey % 7 WHEN 0 THEN 'x-uav' WHEN 1 THEN 'dark-maker' WHEN 2 THEN 'xuav' ELSE 'shop' END AS source_id, CASE p_partkey % 4 WHEN 0 THEN '{{"brand":"Stored","name":"Kept name","spanMM":777}}' WHEN 1 THEN '{{"brand":""}}' END AS stored,
CASE WHEN p_partkey % 2 = 0 THEN 'by X UAV with wingspan 1400 mm, plug and play' ELSE 'plain text' END AS page FROM part"""
#: Masters under brands that their titles confirm, contradict or don't mention.
BRANDED = """SELECT id, category_id, name, name_norm, span_mm, status, power, CASE id % 4 WHEN 0 THEN 'Acme Hobby' WHEN 1 THEN split_part(name, ' ', 1) WHEN 2 THEN 'Wings RC' ELSE concat(split_part(name, ' ', 2), ' Kits') END AS brand,
lower(CASE id % 4 WHEN 0 THEN 'Acme Hobby' WHEN 1 THEN split_part(name, ' ', 1) WHEN 2 THEN 'Wings RC' ELSE concat(split_part(name, ' ', 2), ' Kits') END) AS brand_norm FROM v_master"""
TITLE = "SELECT DISTINCT master_id AS id, concat(title, CASE source_id % 40 WHEN 1 THEN ' 35cc' WHEN 2 THEN ' 1/4 scale' ELSE '' END) AS title FROM v_sku WHERE master_id % 9 <> 0"
DESCRIBED = "SELECT DISTINCT master_id AS id, CASE WHEN source_id % 6 = 0 THEN concat(title, ' nitro engine') WHEN source_id % 5 <> 0 THEN title END AS description FROM v_sku"
CLIP = "SELECT user_id % 500 + 1 AS master_id, event_id % 700 AS video_id, max(CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('t', event_id) END) AS title, max(CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END) AS views, min(CASE WHEN event_id % 5 <> 0 THEN event_id % 90 END) AS rank, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS pinned, max(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 1 ELSE 0 END) AS excluded, max(event_id) AS fetched_at FROM events GROUP BY 1, 2"


def _guess(s, d):
    rows = derived(s, d, LISTING).select("id", G.guess(F.col("title"), F.col("source_id"), F.col("stored"), BRANDS).alias("g"))
    return rows.select("id", "g.*")


def _anomalies(s, d):
    m, t = derived(s, d, BRANDED), derived(s, d, TITLE)
    brands = D.brand_anomalies(m, t)
    return m, brands.unionByName(D.power_anomalies(m, t, brands))


def _refresh(s, d):
    m, found = _anomalies(s, d)
    return T.restamp(m.select("id", F.lit("old").alias("anomaly")), found)


def _cross(s, d):
    m = derived(s, d, BRANDED)
    return D.expanded(*D.cross_brand(m, D.confirmations(m, derived(s, d, TITLE)).filter("NOT confirmed").select("id")))


def _videos(s, d):
    """Videos of merged masters: the survivor's texts, the most views, the best rank; excluded by one is excluded, pinned by one is pinned unless excluded."""
    return U.merge_children(derived(s, d, CLIP), _clusters(s, d), "master_id", ["video_id"], {"title": "filled", "views": "max", "rank": "min", "pinned": "any", "excluded": "any", "fetched_at": "max"}).withColumn("pinned", F.when(F.col("excluded") == 1, 0).otherwise(F.col("pinned")))


def _matches(s, d):
    """Maker matches of merged masters: an accepted one first, the survivor's before others."""
    moved = U.rehomed(derived(s, d, MATCH), _clusters(s, d), "master_id")
    rank = F.struct((F.col("status") != "accepted").cast("int"), (F.col("old_id") != F.col("master_id")).cast("int"), F.col("old_id"))
    best = moved.groupBy("master_id").agg(F.min_by(F.struct("product_id", "score", "status", "note"), rank).alias("x"))
    return best.select("master_id", "x.*")


def _gone(s, d):
    """Offers that leave merged masters; those of all others stay and need not move."""
    merged = _clusters(s, d).filter("id <> survivor").select(F.col("id").alias("old_id"), F.col("survivor"))
    rows = sku(s, d).select(F.col("master_id").alias("old_id"), "sku_key")
    return rows.join(merged, "old_id").select("old_id", F.col("survivor").alias("master_id"), "sku_key").distinct()


QUERIES = {
    "k_guess": _guess,
    "k_guess_enrich": lambda s, d: derived(s, d, LISTING).select("id", G.enrich(F.col("title"), F.col("page"), F.col("source_id"), BRANDS).alias("g")).select("id", "g.*"),
    "j_brand_dictionary": lambda s, d: derived(s, d, LISTING).select("id", G.known_brand(F.col("title"), BRANDS).alias("brand")),
    "f_clean_name": lambda s, d: derived(s, d, LISTING).select("id", G.clean_name(F.col("title"), G.known_brand(F.col("title"), BRANDS), BRANDS, filler=True).alias("name")),
    "k_brand_anomaly": lambda s, d: D.brand_anomalies(derived(s, d, BRANDED), derived(s, d, TITLE)),
    "k_power_anomaly": lambda s, d: _anomalies(s, d)[1].filter("kind LIKE 'power%'").select("id", "kind"),
    "k_brand_confirmations": lambda s, d: D.confirmations(derived(s, d, BRANDED), derived(s, d, TITLE)).select("id", "confirmed"),
    "m_anomaly_refresh": _refresh,
    "k_rederive_power": lambda s, d: D.rederived_power(derived(s, d, BRANDED), derived(s, d, DESCRIBED)),
    "k_dedup_cross_unconfirmed": _cross,
    "k_merge_videos": _videos,
    "k_merge_matches": _matches,
    "k_merge_offers_gone": _gone,
}
_KNOWN = "CASE WHEN regexp_matches(title, '(?i)X.?UAV') THEN 'X-UAV' WHEN regexp_matches(title, '(?i)Dark.?Maker') THEN 'Dark Maker' WHEN regexp_matches(title, '(?i)almond') THEN 'almond' WHEN regexp_matches(title, '(?i)Blue') THEN 'Blue' END"
_HOUSE = "CASE source_id WHEN 'x-uav' THEN 'X-UAV' WHEN 'dark-maker' THEN 'Dark Maker' END"
_OWN = "CASE regexp_replace(source_id, '[^a-z0-9]', '', 'g') WHEN 'xuav' THEN 'X-UAV' WHEN 'darkmaker' THEN 'Dark Maker' END"
_CUT = r"trim(regexp_replace(title, '\s+[|–—-]\s+[^|]*$', ''))"
_FRONT = {"X-UAV": r"X[-\s]?UAV", "Dark Maker": r"Dark[-\s]?Maker", "almond": "almond", "Blue": "Blue"}
_BARE = "coalesce(nullif(CASE brand " + " ".join(rf"WHEN '{b}' THEN trim(regexp_replace({_CUT}, '(?i)^{p}[\s:–—-]*', ''))" for b, p in _FRONT.items()) + f" END, ''), {_CUT})"
_FILL = rf"trim(regexp_replace(regexp_replace({_BARE}, '{G.FILLER}', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = "list_distinct(list_filter(string_split(brand_norm, ' '), lambda w: length(w) >= 4 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in D.GENERIC_BRAND) + "], w)))"
_CONF = rf""", b AS MATERIALIZED (SELECT *, {_WORDS} AS own FROM ({BRANDED})), t AS MATERIALIZED ({TITLE})
, w AS MATERIALIZED (SELECT DISTINCT id, word FROM (SELECT id, unnest(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM t))
, c AS MATERIALIZED (SELECT *, len(own) = 0 OR id NOT IN (SELECT id FROM t) OR EXISTS (SELECT 1 FROM w WHERE w.id = b.id AND len(list_filter(own, lambda x: starts_with(w.word, x))) > 0) AS confirmed FROM b)"""
_ANOM = (
    _CONF
    + """, v AS (SELECT word, arg_min(brand, (id, place)) AS canon, min((id, place)) AS first FROM (SELECT id, brand, unnest(own) AS word, unnest(range(len(own))) AS place FROM c WHERE confirmed) GROUP BY 1)
, n AS (SELECT c.id, canon, min(v.first) AS first FROM c JOIN w ON w.id = c.id JOIN v ON starts_with(w.word, v.word) AND NOT list_contains(c.own, v.word) WHERE NOT confirmed GROUP BY 1, 2)
, a AS (SELECT n.id, 'brand-mismatch' AS kind, concat('listing titles say ', string_agg(canon, ' / ' ORDER BY first), ', tagged "', any_value(brand), '"') AS detail FROM n JOIN c ON c.id = n.id GROUP BY n.id)
, x AS (SELECT id, name AS text FROM c WHERE power = 'electric' AND id NOT IN (SELECT id FROM a) UNION ALL SELECT t.id, title FROM t JOIN c ON c.id = t.id WHERE power = 'electric' AND t.id NOT IN (SELECT id FROM a))
, p AS (SELECT id, max(CASE WHEN """
    + _GAS_SQL
    + r""" THEN 1 ELSE 0 END) AS gas, max(CASE WHEN regexp_matches(text, '\b1\s*[/:]\s*[3-6]\b') THEN 1 ELSE 0 END) AS scale FROM x GROUP BY 1)
, q AS (SELECT id, CASE WHEN gas = 1 THEN 'power-mismatch' ELSE 'power-review' END AS kind, CASE WHEN gas = 1 THEN 'gas/nitro marker in the title but tagged electric' ELSE 'scale model — likely gas, tagged electric' END AS detail FROM p WHERE gas = 1 OR scale = 1)"""
)
_MOVED = lambda rows: f", r AS (SELECT z.*, z.master_id AS old_id, coalesce(survivor, z.master_id) AS target FROM ({rows}) z LEFT JOIN cl ON cl.id = z.master_id)"
_REC = lambda sql: with_views(sql).replace("WITH v_master", "WITH RECURSIVE v_master", 1)
ORACLE = {
    "k_guess": f"""WITH l AS ({LISTING}), b AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'Stored' ELSE coalesce({_KNOWN}, {_HOUSE}, '') END AS brand FROM l)
, n AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'Kept name' ELSE left({_BARE}, 60) END AS nm FROM b)
SELECT id, brand, nm AS name, substr(regexp_replace(regexp_replace(lower(concat(CASE WHEN brand <> '' THEN concat(brand, ' ') ELSE '' END, nm)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug,
CASE WHEN id % 4 = 0 THEN '777' ELSE regexp_extract(title, '(?i)(\\d{{3,4}})\\s*mm', 1) END AS span FROM n""",
    "k_guess_enrich": f"""WITH l AS (SELECT *, {_KNOWN} AS said FROM ({LISTING})), b AS (SELECT *, coalesce(said, {_KNOWN.replace("(title,", "(left(page, 3000),")}, {_OWN}, '') AS brand FROM l)
, t AS (SELECT id, {_span_sql(K.TITLE_SPANS)} AS span FROM (SELECT id, title AS text FROM b)), p AS (SELECT id, {_span_sql(K.TITLE_SPANS)} AS span FROM (SELECT id, left(page, 20000) AS text FROM b))
, c AS (SELECT id, {_case(K.CONFIGS, 'kit')} AS config FROM (SELECT id, concat(title, ' ', left(page, 2000)) AS text FROM b))
SELECT b.id, brand, left({_FILL}, 60) AS name, coalesce(t.span, p.span) AS span, CASE WHEN t.span IS NOT NULL THEN 'title' WHEN p.span IS NOT NULL THEN 'page' ELSE 'none' END AS via, config FROM b JOIN t ON t.id = b.id JOIN p ON p.id = b.id JOIN c ON c.id = b.id""",
    "j_brand_dictionary": f"SELECT id, {_KNOWN} AS brand FROM ({LISTING})",
    "f_clean_name": f"SELECT id, left({_FILL}, 60) AS name FROM (SELECT *, {_KNOWN} AS brand FROM ({LISTING}))",
    "k_brand_anomaly": with_views(_ANOM + " SELECT * FROM a"),
    "k_power_anomaly": with_views(_ANOM + " SELECT id, kind FROM q"),
    "k_dedup_cross_unconfirmed": with_views(_CONF + _DD.replace("FROM v_master", f"FROM ({BRANDED})") + """ SELECT a_id, b_id, common / least_n AS score FROM ok WHERE cat AND NOT same AND common / least_n >= 0.6 AND (coalesce(gap, 1) <= 0.05 OR shared OR least_n >= 2)
AND (a_id IN (SELECT id FROM c WHERE NOT confirmed) OR b_id IN (SELECT id FROM c WHERE NOT confirmed))"""),
    "k_brand_confirmations": with_views(_CONF + " SELECT id, confirmed FROM c"),
    "m_anomaly_refresh": with_views(_ANOM + """, u AS (SELECT * FROM a UNION ALL SELECT * FROM q) SELECT c.id, CASE WHEN u.id IS NOT NULL THEN concat('{"kind":"', kind, '","detail":"', replace(detail, '"', '\\"'), '"}') END AS anomaly FROM c LEFT JOIN u ON u.id = c.id"""),
    "k_rederive_power": with_views(f"""SELECT m.id, name FROM ({BRANDED}) m JOIN (SELECT id, max(CASE WHEN {_GAS_SQL} THEN 1 ELSE 0 END) AS gas FROM (SELECT id, description AS text FROM ({DESCRIBED}) WHERE description IS NOT NULL) GROUP BY 1) g ON g.id = m.id
WHERE status IN ('ready', 'draft') AND power = 'electric' AND (gas = 1 OR (SELECT {_GAS_SQL} FROM (SELECT name AS text)))"""),
    "k_merge_videos": _REC(_CLUSTER + _MOVED(CLIP) + """, o AS (SELECT *, CASE WHEN old_id = target THEN 0 ELSE 1 END AS far FROM r)
, g AS (SELECT target AS master_id, video_id, coalesce(arg_min(title, (far, old_id)) FILTER (WHERE title <> ''), '') AS title, max(views) AS views, min(rank) AS rank, max(pinned) AS pinned, max(excluded) AS excluded, max(fetched_at) AS fetched_at FROM o GROUP BY 1, 2)
SELECT master_id, video_id, title, views, rank, CASE WHEN excluded = 1 THEN 0 ELSE pinned END AS pinned, excluded, fetched_at FROM g"""),
    "k_merge_matches": _REC(_CLUSTER + _MOVED(MATCH) + """SELECT target AS master_id, product_id, score, status, note FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN status = 'accepted' THEN 0 ELSE 1 END, CASE WHEN old_id = target THEN 0 ELSE 1 END, old_id) AS n FROM r) WHERE n = 1"""),
    "k_merge_offers_gone": _REC(_CLUSTER + _MOVED("SELECT master_id, sku_key FROM v_sku") + "SELECT DISTINCT old_id, target AS master_id, sku_key FROM r WHERE old_id <> target"),
}
