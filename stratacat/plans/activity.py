"""Review, coverage, health and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.operators import review as R
from stratacat.operators import stats as S
from stratacat.plans.grid import _STAR, live
from stratacat.views import master, sku, table, with_views

_STATE = "CASE WHEN dead = 1 THEN 'removed' WHEN flag_kind = 'missing' THEN 'missing' WHEN flag_kind IS NOT NULL THEN 'flagged' ELSE review_status END"


def _events(s, d):
    return table(s, d, "events")


def _starts(s, d):
    return _events(s, d).filter("event_type = 'signup'").select("ts", F.col("user_id").alias("client"), (F.col("event_id") % 4).alias("map"))


def _runs(s, d):
    return _events(s, d).filter("event_type = 'purchase'").select("ts", F.col("user_id").alias("client"), (F.col("event_id") % 4).alias("map"), (F.col("value") >= 100).alias("win"))


def _scans(s, d):
    """The latest ship date of any of its skus stands for a source's last scan."""
    return sku(s, d).groupBy("source_id").agg(F.max("last_seen").alias("last_scan"))


def observations(s, d):
    rows = _events(s, d).filter("event_type in ('view', 'click')")
    return rows.select("event_id", "ts", F.col("user_id").alias("sku"), (F.floor(F.col("value") / 50).cast("bigint") * 50).alias("price"))


def _series(s, d):
    return _events(s, d).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))


def _health(s, d):
    return R.source_health(sku(s, d), _scans(s, d))


def _page(s, d):
    out = R.view(sku(s, d), "new", "in").join(master(s, d).select(F.col("id").alias("master_id"), F.concat_ws(" ", "brand", "name").alias("master")), "master_id", "left")
    return out.orderBy(F.desc("last_seen"), "sku_key").limit(40).select("sku_key", "master", "last_seen")


def _suggest(s, d):
    return R.attach_suggestions(sku(s, d).filter("review_status = 'new'").dropDuplicates(["sku_key"]), master(s, d))


def _backlog(s, d):
    names = table(s, d, "part").select(F.col("p_name").alias("u"))
    titles = sku(s, d).filter("dead = 0").select(F.col("title").alias("u"))
    done = sku(s, d).filter("source_id % 50 = 0 AND in_stock = 1").select(F.col("title").alias("u")).distinct()
    return R.backlog([names, titles], done)


def _budget(s, d):
    queue = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.ceil(F.col("o_totalprice") / 1000).alias("cost"))
    return R.within_budget(queue, F.col("cost"), 900, [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_custkey").select("o_custkey", "o_orderkey", "spent")


_EV = """, st AS (SELECT ts, user_id AS client, event_id % 4 AS map FROM events WHERE event_type = 'signup')
, ru AS (SELECT ts, user_id AS client, event_id % 4 AS map, value >= 100 AS win FROM events WHERE event_type = 'purchase')"""
_CAL = """
, n AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)
, c AS (SELECT event_type, CAST(unnest(generate_series(e - INTERVAL 27 DAY, e, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT event_type, max(d) AS e FROM n GROUP BY 1))
, z AS (SELECT event_type, d, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (event_type, d))"""

QUERIES = {
    "q26_review_state_counts": lambda s, d: R.state_counts(sku(s, d)),
    "q27_review_source_counts": lambda s, d: R.view(sku(s, d), "new", "in").groupBy("source_id").agg(F.count("*").alias("n")),
    "q27_review_stock_counts": lambda s, d: R.view(sku(s, d), "new", "all").groupBy(R.stock_bucket().alias("stock")).agg(F.count("*").alias("n")),
    "q28_review_page": _page,
    "k_attach_suggest": _suggest,
    "q32_pop_coverage": lambda s, d: R.coverage(live(s, d)),
    "q33_catalog_page": lambda s, d: R.catalog_page(master(s, d), sku(s, d)).select("id", "offers", "live_offers"),
    "k_source_health": _health,
    "k_image_backlog": _backlog,
    "t_rolling_quota": _budget,
    "k_stats_daily": lambda s, d: S.daily(_starts(s, d), _runs(s, d)),
    "k_stats_totals": lambda s, d: S.totals(_starts(s, d), _runs(s, d), _events(s, d).filter("event_type = 'error'")),
    "k_stats_by_map": lambda s, d: S.by_map(_starts(s, d), _runs(s, d)),
    "w_calendar_fill": lambda s, d: S.calendar(_series(s, d), 28, ["event_type"], "n"),
    "k_stats_tiles": lambda s, d: S.trailing(_series(s, d), 28, ["event_type"], "n"),
    "t_change_log": lambda s, d: S.change_log(observations(s, d), "sku", ["ts", "event_id"], ["price"]).select("event_id", "sku", "price"),
    "a_top1_channel": lambda s, d: S.top_share(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", "o_custkey"),
}
ORACLE = {
    "q26_review_state_counts": with_views(f"SELECT {_STATE} AS state, count(*) AS n FROM v_sku GROUP BY 1"),
    "q27_review_source_counts": with_views(f"SELECT source_id, count(*) AS n FROM v_sku WHERE {_STATE} = 'new' AND in_stock = 1 GROUP BY 1"),
    "q27_review_stock_counts": with_views(f"SELECT CASE WHEN in_stock = 1 THEN 'in' ELSE 'out' END AS stock, count(*) AS n FROM v_sku WHERE {_STATE} = 'new' GROUP BY 1"),
    "q28_review_page": with_views(f"SELECT sku_key, concat_ws(' ', brand, name) AS master, last_seen FROM v_sku LEFT JOIN v_master ON id = master_id WHERE {_STATE} = 'new' AND in_stock = 1 ORDER BY last_seen DESC, sku_key LIMIT 40"),
    "k_attach_suggest": with_views(r"""
, k AS (SELECT DISTINCT sku_key, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM v_sku WHERE review_status = 'new')
, h AS (SELECT t, id AS master_id, CASE WHEN contains(t, name_norm) THEN 2 ELSE len(list_filter(string_split(name_norm, ' '), lambda w: length(w) > 2 AND contains(t, w))) END AS score FROM (SELECT DISTINCT t FROM k) x, v_master)
, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY t ORDER BY score DESC, master_id DESC) AS INT) AS rank FROM h WHERE score >= 2)
SELECT sku_key, master_id, CAST(score AS BIGINT) AS score, rank FROM k JOIN r ON r.t = k.t WHERE rank <= 3"""),
    "q32_pop_coverage": lambda s, d: R.coverage(live(s, d)),
    "q33_catalog_page": lambda s, d: R.catalog_page(master(s, d), sku(s, d)).select("id", "offers", "live_offers"),
    "k_source_health": _health,
    "k_image_backlog": _backlog,
    "t_rolling_quota": _budget,
    "k_stats_daily": lambda s, d: S.daily(_starts(s, d), _runs(s, d)),
    "k_stats_totals": lambda s, d: S.totals(_starts(s, d), _runs(s, d), _events(s, d).filter("event_type = 'error'")),
    "k_stats_by_map": lambda s, d: S.by_map(_starts(s, d), _runs(s, d)),
    "w_calendar_fill": lambda s, d: S.calendar(_series(s, d), 28, ["event_type"], "n"),
    "k_stats_tiles": lambda s, d: S.trailing(_series(s, d), 28, ["event_type"], "n"),
    "t_change_log": lambda s, d: S.change_log(observations(s, d), "sku", ["ts", "event_id"], ["price"]).select("event_id", "sku", "price"),
    "a_top1_channel": lambda s, d: S.top_share(table(s, d, "orders"), "o_orderstatus", "o_orderpriority", "o_custkey"),
}
ORACLE = {
    "q26_review_state_counts": with_views(f"SELECT {_STATE} AS state, count(*) AS n FROM v_sku GROUP BY 1"),
    "q27_review_source_counts": with_views(f"SELECT source_id, count(*) AS n FROM v_sku WHERE {_STATE} = 'new' AND in_stock = 1 GROUP BY 1"),
    "q27_review_stock_counts": with_views(f"SELECT CASE WHEN in_stock = 1 THEN 'in' ELSE 'out' END AS stock, count(*) AS n FROM v_sku WHERE {_STATE} = 'new' GROUP BY 1"),
    "q28_review_page": with_views(f"SELECT sku_key, concat_ws(' ', brand, name) AS master, last_seen FROM v_sku LEFT JOIN v_master ON id = master_id WHERE {_STATE} = 'new' AND in_stock = 1 ORDER BY last_seen DESC, sku_key LIMIT 40"),
    "k_attach_suggest": with_views(r"""
, s AS (SELECT DISTINCT sku_key, lower(title) AS t FROM v_sku WHERE review_status = 'new')
, sw AS (SELECT sku_key, t, unnest(list_distinct(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda w: length(w) > 2))) AS word FROM s)
, mw AS (SELECT id, name_norm, unnest(list_distinct(list_filter(regexp_split_to_array(name_norm, '[^a-z0-9]+'), lambda w: length(w) > 2))) AS word FROM v_master)
, h AS (SELECT sku_key, id AS master_id, CASE WHEN contains(min(t), min(name_norm)) THEN 2 ELSE count(*) END AS score FROM sw JOIN mw USING (word) GROUP BY 1, 2)
SELECT sku_key, master_id, CAST(score AS BIGINT) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sku_key ORDER BY score DESC, master_id DESC) AS INT) AS rank FROM h WHERE score >= 2) WHERE rank <= 3"""),
    "q32_pop_coverage": with_views(_STAR.strip() + """ SELECT count(*) AS total, count(pop_score) AS scored, count(*) FILTER (WHERE pop_score > 0) AS nonzero,
count(*) FILTER (WHERE pop_score = 0) AS zero, count(*) FILTER (WHERE pop_score IS NULL) AS unscored FROM live"""),
    "q33_catalog_page": with_views("""SELECT m.id, count(k.sku_key) AS offers,
count(*) FILTER (WHERE k.review_status = 'approved' AND coalesce(k.in_stock, 0) = 1 AND k.dead = 0) AS live_offers FROM v_master m LEFT JOIN v_sku k ON k.master_id = m.id GROUP BY m.id"""),
    "k_source_health": with_views("""SELECT source_id, max(last_seen) AS last_scan, count(*) FILTER (WHERE review_status = 'approved' AND dead = 0) AS live,
count(*) FILTER (WHERE flag_kind IS NOT NULL) AS flagged, count(*) FILTER (WHERE dead = 1) AS removed, min(CASE WHEN review_status = 'approved' AND dead = 0 THEN last_seen END) AS oldest_verify
FROM v_sku GROUP BY source_id"""),
    "k_image_backlog": with_views("""SELECT u FROM (SELECT p_name AS u FROM part UNION SELECT title FROM v_sku WHERE dead = 0)
WHERE u NOT IN (SELECT title FROM v_sku WHERE source_id % 50 = 0 AND in_stock = 1)"""),
    "t_rolling_quota": """SELECT o_custkey, o_orderkey, spent FROM (SELECT o_custkey, o_orderkey, CAST(sum(CAST(ceil(o_totalprice / 1000) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM orders) WHERE spent <= 900""",
    "k_stats_daily": with_views(_EV + """ SELECT coalesce(a.d, b.d) AS d, coalesce(starts, 0) AS starts, coalesce(players, 0) AS players, coalesce(runs, 0) AS runs, coalesce(wins, 0) AS wins
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS starts, count(DISTINCT client) AS players FROM st GROUP BY 1) a
FULL JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS runs, count(*) FILTER (WHERE win) AS wins FROM ru GROUP BY 1) b ON a.d = b.d"""),
    "k_stats_totals": with_views(_EV + """ SELECT (SELECT count(*) FROM st) AS starts, (SELECT count(DISTINCT client) FROM st) AS players, (SELECT count(*) FROM ru) AS runs,
(SELECT count(*) FROM ru WHERE win) AS wins, (SELECT count(*) FROM events WHERE event_type = 'error') AS board_rows"""),
    "k_stats_by_map": with_views(_EV + """ SELECT map, starts, players, coalesce(runs, 0) AS runs, coalesce(wins, 0) AS wins
FROM (SELECT map, count(*) AS starts, count(DISTINCT client) AS players FROM st GROUP BY 1) LEFT JOIN (SELECT map, count(*) AS runs, count(*) FILTER (WHERE win) AS wins FROM ru GROUP BY 1) USING (map)"""),
    "w_calendar_fill": with_views(_CAL + " SELECT event_type, d, n FROM z"),
    "k_stats_tiles": with_views(_CAL + """, w AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY d DESC) AS r, n FROM z)
, x AS (SELECT event_type, CAST(sum(n) FILTER (WHERE r BETWEEN 2 AND 8) AS BIGINT) AS last7, CAST(sum(n) FILTER (WHERE r BETWEEN 9 AND 15) AS BIGINT) AS prev7 FROM w GROUP BY 1)
SELECT *, CASE WHEN prev7 = 0 AND last7 = 0 THEN 'none' WHEN prev7 = 0 OR (last7 - prev7) * 100.0 / prev7 > 500 THEN 'new' WHEN (last7 - prev7) * 100.0 / prev7 > 3 THEN 'up' WHEN (last7 - prev7) * 100.0 / prev7 < -3 THEN 'down' ELSE 'flat' END AS label FROM x"""),
    "t_change_log": """SELECT event_id, sku, price FROM (SELECT *, lag(price) OVER w AS p, row_number() OVER w AS r FROM (SELECT event_id, ts, user_id AS sku, CAST(floor(value / 50) AS BIGINT) * 50 AS price FROM events WHERE event_type IN ('view', 'click'))
WINDOW w AS (PARTITION BY sku ORDER BY ts, event_id)) WHERE r = 1 OR p IS DISTINCT FROM price""",
    "a_top1_channel": """SELECT o_orderstatus, max_by(o_orderpriority, (total, o_orderpriority)) AS top, CAST(max(total) AS BIGINT) AS top_total FROM (SELECT o_orderstatus, o_orderpriority, sum(o_custkey) AS total FROM orders GROUP BY 1, 2) GROUP BY 1""",
}
