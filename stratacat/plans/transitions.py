"""Decisions over the derived catalog, with oracles written as plain updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.operators import transitions as T
from stratacat.views import derived, master, with_views

ACTOR = "owner"
#: Derived entities, in SQL that Spark and the oracle share.
STATE = """SELECT sku_key, source_id, master_id, review_status, CASE WHEN review_status = 'rejected' THEN 'old' END AS reject_reason,
CAST(CASE WHEN review_status <> 'new' THEN 1000 END AS BIGINT) AS reviewed_at, flag_kind, dead, CASE WHEN dead = 1 THEN 3 ELSE 0 END AS misses,
CAST(CASE WHEN pack_qty = 2 THEN 900 END AS BIGINT) AS last_checked, price_inr, in_stock FROM v_sku"""
DECISION = """SELECT DISTINCT sku_key, CASE (master_id + source_id) % 9 WHEN 0 THEN 'reject' WHEN 1 THEN 'restore' WHEN 2 THEN 'unflag' WHEN 3 THEN 'confirm-gone' WHEN 4 THEN 'restore-live' WHEN 5 THEN 'unapprove' WHEN 6 THEN 'attach' ELSE 'none' END AS action,
CASE WHEN source_id % 2 = 0 THEN 'duplicate' END AS reason, CAST(5000 + master_id AS BIGINT) AS done_at, master_id FROM v_sku WHERE (master_id + source_id) % 9 < 8"""
OFFER = """SELECT DISTINCT sku_key, master_id, config, pack_qty, CAST(100 AS BIGINT) AS created_at FROM v_sku WHERE review_status = 'approved'"""
ATTACH = """SELECT DISTINCT sku_key, master_id + CASE WHEN source_id % 3 = 0 THEN 1 ELSE 0 END AS master_id, CASE WHEN source_id % 2 = 0 THEN 'rtf' END AS config, CAST(NULL AS INT) AS pack_qty, CAST(5000 + master_id AS BIGINT) AS done_at
FROM v_sku WHERE (master_id + source_id) % 9 = 6"""
NEW_MASTER = """SELECT concat('k', p_partkey) AS sku_key, CASE WHEN p_partkey % 13 = 0 THEN 'nothing' ELSE p_type END AS category_id,
CASE p_partkey % 6 WHEN 0 THEN 'browse' WHEN 1 THEN 'x!' WHEN 2 THEN 'warbirds' WHEN 3 THEN concat('part-', p_partkey) ELSE concat('new-', p_size) END AS slug,
CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('Maker ', p_size) END AS brand, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE concat(p_name, ' mk', p_size) END AS name, CAST(p_partkey % 97 AS BIGINT) AS done_at FROM part"""
HELD = "SELECT category_id, concat('part-', id) AS slug, CASE WHEN id % 2 = 0 THEN concat('maker ', span_mm) ELSE brand_norm END AS brand_norm, name_norm FROM v_master"
PATCHED = """SELECT id, category_id, brand, name, brand_norm, name_norm, status, CASE id % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{"spanMM":1200}' ELSE '{"spanMM":"","weight":5}' END AS specs,
CASE WHEN id % 4 = 0 THEN 'brand-mismatch' END AS anomaly, CAST(1 AS BIGINT) AS updated_at FROM v_master"""
PATCH = """SELECT id, CASE WHEN id % 7 = 0 THEN concat(brand, ' Co.') END AS brand, CASE WHEN id % 5 = 0 THEN concat(name, ' II') END AS name, CASE WHEN id % 8 = 0 THEN '{"spanMM":"900"}' END AS specs,
CASE id % 2 WHEN 0 THEN 'ready' ELSE 'retired' END AS status, CAST(9000 + id AS BIGINT) AS done_at FROM v_master WHERE id % 3 <> 2 OR id % 4 = 0"""
REQUIRED = "SELECT DISTINCT category_id FROM v_master"
SOURCE = "SELECT concat('s', s_suppkey) AS source_id, s_name AS name, 'html' AS platform, CAST(1 AS BIGINT) AS created_at, CAST(1 AS BIGINT) AS updated_at FROM supplier"
SOURCE_URL = "SELECT concat('https://s', s_suppkey, '.example.com/shop') AS url, concat('s', s_suppkey) AS source_id, 'active' AS status, CAST(1 AS BIGINT) AS created_at FROM supplier"
MAPPING = "SELECT concat('https://s', s_suppkey, '.example.com/shop') AS url, 'STEEL' AS category_id FROM supplier WHERE s_suppkey % 2 = 0"
VIDEO = "SELECT user_id % 500 + 1 AS master_id, event_id AS video_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS pinned, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS excluded FROM events"
VIDEO_FLAG = """SELECT user_id % 500 + 1 AS master_id, event_id AS video_id, CASE event_id % 3 WHEN 0 THEN 'pinned' WHEN 1 THEN 'excluded' ELSE 'title' END AS field, CAST(event_id % 2 AS INT) AS value FROM events WHERE event_id % 5 < 3"""
BOOSTED = "SELECT id, CAST(CASE WHEN id % 6 = 0 THEN 1.5 END AS DOUBLE) AS pop_boost FROM v_master"
BOOST = "SELECT id, CAST(CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 2.5 ELSE 1.25 END AS DOUBLE) AS boost FROM v_master WHERE id % 3 <> 0 OR id % 2 = 0"
CANDIDATE = "SELECT id AS a_id, id + 1 AS b_id, CAST(0.8 AS DOUBLE) AS score, 'doubtful' AS reason, 'pending' AS status, CAST(NULL AS BIGINT) AS decided_at FROM v_master WHERE id % 3 = 0"
REJECTED = "SELECT CASE WHEN id % 2 = 0 THEN id ELSE id + 1 END AS a_id, CASE WHEN id % 2 = 0 THEN id + 1 ELSE id END AS b_id FROM v_master WHERE id % 2 = 0 OR id % 5 = 0"
MATCH = """SELECT id AS master_id, id * 10 AS product_id, CAST(0.5 AS DOUBLE) AS score, CAST(1 AS INT) AS span_agree, 'review' AS tier, CASE WHEN id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status, 'first' AS note,
CASE WHEN id % 3 = 0 THEN 'someone' END AS decided_by, CAST(CASE WHEN id % 6 = 0 THEN 77 END AS BIGINT) AS decided_at FROM v_master"""
RANKED = """SELECT id AS master_id, id * 10 + 1 AS product_id, CAST(0.9 AS DOUBLE) AS score, CAST(0 AS INT) AS span_agree, 'accept' AS tier, 'name and span' AS reason FROM v_master WHERE id % 4 <> 0"""
MATCH_DECISION = """SELECT id AS master_id, CASE id % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'reopen' ELSE 'accept' END AS decision, id * 10 + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS product_id, CAST(8000 + id AS BIGINT) AS done_at FROM v_master WHERE id % 7 <> 0"""


def _effects(*actions):
    def run(s, d):
        wanted = derived(s, d, DECISION).filter(F.col("action").isin(*actions))
        return T.decide(derived(s, d, STATE), wanted)

    return run


def _unapprove(s, d):
    return T.unapprove(derived(s, d, STATE), derived(s, d, OFFER), derived(s, d, DECISION).filter("action = 'unapprove'"))[1]


def _attach(part: int):
    return lambda s, d: T.attach(derived(s, d, STATE), derived(s, d, OFFER), derived(s, d, ATTACH), master(s, d))[part]


def _masters(s, d):
    required = derived(s, d, REQUIRED).withColumn("keys", F.array(F.lit("spanMM")))
    return T.update_masters(derived(s, d, PATCHED), derived(s, d, PATCH), required)


def _sources(part: int):
    def run(s, d):
        asked = derived(s, d, f"SELECT * FROM ({_ASKED})").withColumn("categories", F.array(F.when(F.col("n") % 4 == 0, "nothing").otherwise("STEEL"), F.lit("BRASS")))
        known = s.createDataFrame([("STEEL",), ("TIN",)], "category_id string")
        asked = asked.withColumn("categories", F.when(F.col("n") % 4 == 0, F.array(F.lit("nothing"))).otherwise(F.col("categories")))
        return T.add_sources(derived(s, d, SOURCE), derived(s, d, SOURCE_URL), derived(s, d, MAPPING), asked, known)[part]

    return run


_ASKED = """SELECT c_custkey AS n, CASE WHEN c_custkey % 7 = 0 THEN 'no url' ELSE concat('https://S', c_custkey % 211, '.Example.com/shop', CASE WHEN c_custkey % 3 = 0 THEN '/?utm_source=a' WHEN c_custkey % 3 = 1 THEN '/new' ELSE '' END) END AS raw,
CASE WHEN c_custkey % 2 = 0 THEN 'shopify' ELSE 'woocommerce' END AS platform, CAST(100 + c_custkey AS BIGINT) AS done_at FROM customer"""
QUERIES = {
    "m_reject_restore": _effects("reject", "restore"),
    "m_unflag_gone_live": _effects("unflag", "confirm-gone", "restore-live"),
    "m_unapprove": _effects("unapprove"),
    "m_unapprove_offers": _unapprove,
    "m_attach": _attach(0),
    "m_attach_offers": _attach(1),
    "m_attach_observations": _attach(2),
    "m_approve_new": lambda s, d: T.approve_new(derived(s, d, NEW_MASTER), derived(s, d, HELD), derived(s, d, REQUIRED)),
    "m_master_update": _masters,
    "m_source_add": _sources(0),
    "m_source_add_urls": _sources(1),
    "m_source_add_categories": _sources(2),
    "m_source_url_status": lambda s, d: T.set_status(derived(s, d, SOURCE_URL), derived(s, d, "SELECT concat('https://s', s_suppkey, '.example.com/shop') AS url, 'paused' AS value FROM supplier WHERE s_suppkey % 3 = 0"), "url"),
    "m_video_flag": lambda s, d: T.flag_videos(derived(s, d, VIDEO), derived(s, d, VIDEO_FLAG)),
    "m_pop_boost": lambda s, d: T.boost(derived(s, d, BOOSTED), derived(s, d, BOOST)),
    "m_merge_reject": lambda s, d: T.reject_merges(derived(s, d, CANDIDATE), derived(s, d, REJECTED), 12345),
    "m_mfr_decide": lambda s, d: T.decide_matches(derived(s, d, MATCH), derived(s, d, RANKED), derived(s, d, MATCH_DECISION), ACTOR),
    "sink_audit": lambda s, d: T.audit_rows(derived(s, d, DECISION).filter("action <> 'none'"), "sku", "sku_key", ACTOR, "reason", "master_id"),
}


def _case(column: str, cases: dict[str, str], actions: tuple[str, ...]) -> str:
    hits = " ".join(f"WHEN action = '{a}' THEN {v}" for a, v in cases.items() if a in actions)
    return f"CASE {hits} ELSE {column} END AS {column}" if hits else column


_SETS = {
    "review_status": {"reject": "'rejected'", "restore": "'new'", "unapprove": "'new'", "attach": "'approved'"},
    "reject_reason": {"reject": "coalesce(reason, 'junk')", "restore": "NULL"},
    "reviewed_at": {"reject": "done_at", "restore": "NULL", "confirm-gone": "done_at", "unapprove": "NULL", "attach": "done_at"},
    "flag_kind": {"unflag": "NULL", "confirm-gone": "NULL", "restore-live": "NULL", "unapprove": "NULL"},
    "dead": {"confirm-gone": "1", "restore-live": "0"}, "misses": {"restore-live": "0"}, "last_checked": {"unflag": "NULL", "restore-live": "NULL"},
}


def _decided(actions: tuple[str, ...], decisions: str = "SELECT * FROM dec") -> str:
    columns = ["st.sku_key", "source_id", "st.master_id", *[_case(c, v, actions) for c, v in _SETS.items()], "price_inr", "in_stock"]
    return with_views(f", st AS ({STATE}), dec AS ({DECISION}), x AS ({decisions}) SELECT {', '.join(columns)} FROM st LEFT JOIN (SELECT sku_key, action, reason, done_at FROM x) x ON x.sku_key = st.sku_key")


_NAMES = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_WANTED = f"(SELECT * FROM ({ATTACH}) WHERE master_id IN (SELECT id FROM v_master))"
_ASK = f""", asked AS (SELECT *, concat('https://s', n % 211, '.example.com/shop', CASE WHEN n % 3 = 1 THEN '/new' ELSE '' END) AS url, concat('s', n % 211) AS source_id, concat('s', n % 211, '.example.com') AS host FROM ({_ASKED}) WHERE raw <> 'no url' AND n % 4 <> 0)"""
ORACLE = {
    "m_reject_restore": _decided(("reject", "restore")),
    "m_unflag_gone_live": _decided(("unflag", "confirm-gone", "restore-live")),
    "m_unapprove": _decided(("unapprove",)),
    "m_unapprove_offers": with_views(f"SELECT * FROM ({OFFER}) WHERE sku_key NOT IN (SELECT sku_key FROM ({DECISION}) WHERE action = 'unapprove')"),
    "m_attach": _decided(("attach",), f"SELECT sku_key, 'attach' AS action, NULL AS reason, max(done_at) AS done_at FROM {_WANTED} GROUP BY 1"),
    "m_attach_offers": with_views(f""", o AS ({OFFER}), a AS (SELECT sku_key, master_id, coalesce(config, 'kit') AS config, coalesce(pack_qty, 1) AS pack_qty, done_at AS created_at FROM {_WANTED})
SELECT * FROM o UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.sku_key = a.sku_key AND o.master_id = a.master_id)"""),
    "m_attach_observations": with_views(f"SELECT s.sku_key, done_at, price_inr, in_stock FROM (SELECT sku_key, max(done_at) AS done_at FROM {_WANTED} GROUP BY 1) a JOIN ({STATE}) s ON s.sku_key = a.sku_key"),
    "m_approve_new": with_views(f"""
, r AS (SELECT *, {_NAMES.format('brand')} AS brand_norm, {_NAMES.format('name')} AS name_norm FROM ({NEW_MASTER}))
, h AS ({HELD})
, s AS (SELECT *, CASE WHEN brand = '' OR NOT regexp_full_match(slug, '[a-z0-9-]{{3,60}}') THEN 'invalid' WHEN slug IN ('browse', 'warbirds') THEN 'reserved' WHEN category_id NOT IN (SELECT category_id FROM v_master) THEN 'category' END AS state,
  EXISTS (SELECT 1 FROM h WHERE h.category_id = r.category_id AND (h.slug = r.slug OR (h.brand_norm = r.brand_norm AND h.name_norm = r.name_norm))) AS held FROM r)
, f AS (SELECT *, state IS NULL AND NOT held AS free FROM s)
, w AS (SELECT *, free AND row_number() OVER (PARTITION BY category_id, slug, free ORDER BY done_at, sku_key) = 1 AND row_number() OVER (PARTITION BY category_id, brand_norm, name_norm, free ORDER BY done_at, sku_key) = 1 AS wins FROM f)
SELECT sku_key, category_id, slug, brand_norm, name_norm, coalesce(state, CASE WHEN wins THEN 'created' ELSE 'conflict' END) AS verdict FROM w"""),
    "m_master_update": with_views(f"""
, j AS (SELECT m.*, p.brand AS pb, p.name AS pn, p.specs AS ps, p.status AS pst, p.done_at AS pat, coalesce(json_extract_string(coalesce(p.specs, m.specs), '$.spanMM'), '') AS span FROM ({PATCHED}) m LEFT JOIN ({PATCH}) p ON p.id = m.id)
, k AS (SELECT *, coalesce(pst = 'ready', false) AND span = '' AS blocked FROM j), t AS (SELECT *, pat IS NOT NULL AND NOT blocked AS takes FROM k)
SELECT id, category_id, CASE WHEN takes THEN coalesce(pb, brand) ELSE brand END AS brand, CASE WHEN takes THEN coalesce(pn, name) ELSE name END AS name,
CASE WHEN takes AND pb IS NOT NULL THEN {_NAMES.format('pb')} ELSE brand_norm END AS brand_norm, CASE WHEN takes AND pn IS NOT NULL THEN {_NAMES.format('pn')} ELSE name_norm END AS name_norm,
CASE WHEN takes THEN coalesce(pst, status) ELSE status END AS status, CASE WHEN takes THEN coalesce(ps, specs) ELSE specs END AS specs, CASE WHEN takes AND pb IS NOT NULL THEN NULL ELSE anomaly END AS anomaly,
CASE WHEN takes THEN pat ELSE updated_at END AS updated_at, CASE WHEN blocked THEN 'spanMM' END AS missing FROM t"""),
    "m_source_add": f"""WITH one AS (SELECT 1) {_ASK}, l AS (SELECT source_id, arg_max((host, platform, done_at), (done_at, url)) AS x FROM asked GROUP BY 1), o AS ({SOURCE})
SELECT coalesce(o.source_id, l.source_id) AS source_id, coalesce(o.name, l.x[1]) AS name, coalesce(l.x[2], o.platform) AS platform, coalesce(o.created_at, l.x[3]) AS created_at, coalesce(l.x[3], o.updated_at) AS updated_at FROM o FULL JOIN l ON l.source_id = o.source_id""",
    "m_source_add_urls": f"""WITH one AS (SELECT 1) {_ASK}, o AS ({SOURCE_URL}) SELECT * FROM o UNION ALL SELECT url, source_id, 'active', min(done_at) FROM asked WHERE url NOT IN (SELECT url FROM o) GROUP BY 1, 2""",
    "m_source_add_categories": f"""WITH one AS (SELECT 1) {_ASK}, o AS ({MAPPING}) SELECT url, category_id FROM o UNION SELECT url, 'STEEL' FROM asked""",
    "m_source_url_status": f"SELECT url, source_id, CASE WHEN CAST(substr(source_id, 2) AS INT) % 3 = 0 THEN 'paused' ELSE status END AS status, created_at FROM ({SOURCE_URL})",
    "m_video_flag": f"""WITH v AS ({VIDEO}), f AS ({VIDEO_FLAG}) SELECT v.master_id, v.video_id, CASE WHEN field = 'pinned' THEN value ELSE pinned END AS pinned, CASE WHEN field = 'excluded' THEN value ELSE excluded END AS excluded
FROM v LEFT JOIN f ON f.master_id = v.master_id AND f.video_id = v.video_id""",
    "m_pop_boost": with_views(f"SELECT m.id, CASE WHEN b.id IS NULL OR boost NOT BETWEEN 0.5 AND 2 THEN pop_boost WHEN boost <> 1 THEN boost END AS pop_boost FROM ({BOOSTED}) m LEFT JOIN ({BOOST}) b ON b.id = m.id"),
    "m_merge_reject": with_views(f""", o AS ({CANDIDATE}), n AS (SELECT DISTINCT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id FROM ({REJECTED}))
SELECT coalesce(o.a_id, n.a_id) AS a_id, coalesce(o.b_id, n.b_id) AS b_id, coalesce(score, 0) AS score, coalesce(reason, 'owner: not duplicates') AS reason, CASE WHEN n.a_id IS NULL THEN status ELSE 'rejected' END AS status, CASE WHEN n.a_id IS NULL THEN decided_at ELSE 12345 END AS decided_at
FROM o FULL JOIN n ON n.a_id = o.a_id AND n.b_id = o.b_id"""),
    "m_mfr_decide": with_views(f""", j AS (SELECT m.*, d.decision, d.product_id AS dp, d.done_at, c.score AS cs, c.span_agree AS ca, c.tier AS ct, c.reason AS cr, c.master_id IS NOT NULL AS hit
  FROM ({MATCH}) m LEFT JOIN ({MATCH_DECISION}) d ON d.master_id = m.master_id LEFT JOIN ({RANKED}) c ON c.master_id = m.master_id AND c.product_id = d.product_id)
, k AS (SELECT *, coalesce(decision = 'accept' AND (hit OR (dp = product_id AND status = 'accepted' AND decided_at IS NOT NULL)), false) AS acc FROM j)
SELECT master_id, CASE WHEN acc THEN dp ELSE product_id END AS product_id, CASE WHEN acc AND hit THEN cs ELSE score END AS score, CASE WHEN acc AND hit THEN ca ELSE span_agree END AS span_agree, CASE WHEN acc AND hit THEN ct ELSE tier END AS tier,
CASE WHEN acc THEN 'accepted' WHEN decision = 'reject' THEN 'rejected' WHEN decision = 'reopen' THEN 'pending' ELSE status END AS status, CASE WHEN acc AND hit THEN cr ELSE note END AS note,
CASE WHEN acc OR decision = 'reject' THEN '{ACTOR}' WHEN decision = 'reopen' THEN NULL ELSE decided_by END AS decided_by, CASE WHEN acc OR decision = 'reject' THEN done_at WHEN decision = 'reopen' THEN NULL ELSE decided_at END AS decided_at,
acc OR coalesce(decision IN ('reject', 'reopen'), false) AS applied FROM k"""),
    "sink_audit": with_views(f"""SELECT done_at, '{ACTOR}' AS actor, action, 'sku' AS entity, sku_key AS entity_id, CASE WHEN reason IS NULL THEN concat('{{"master_id":', master_id, '}}') ELSE concat('{{"reason":"', reason, '","master_id":', master_id, '}}') END AS detail
FROM ({DECISION}) WHERE action <> 'none'"""),
}
