"""Streams with state, drained from files that the given tables are dealt into at random."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.plans import incremental as I
from stratacat.plans.activity import observations
from stratacat.streaming import keyed as K
from stratacat.views import table

#: The watermark's delay: rows are dealt to files at random, so any of them may be as late as the table is long.
LATE = "400 days"
#: A hundredth of that: the rows of a key wait in few lists.
SPAN = "4 days"
WAIT_MS = 404 * 86_400_000

#: What feeds and page checks say of skus.
SIGNALS = """SELECT user_id AS key, event_id AS id, ts, CASE event_id % 13 WHEN 0 THEN 'seen' WHEN 1 THEN 'ok' WHEN 2 THEN 'blocked' WHEN 3 THEN 'missing' WHEN 4 THEN 'blocked' ELSE 'gone' END AS kind FROM events"""


def _scan(s, d):
    """Rows and observations of a scan that comes as a stream of files, after a restart with half of them."""
    skus, products = I.stored(s, d), I.scanned(s, d)
    folder = K.landed(products.filter("hash(url, pid) % 2 = 0"), 3)
    plan = lambda stream: K.sightings(skus, stream)
    K.drained(s, folder, products.schema, plan, f"{folder}-out", f"{folder}-state")
    K.landed(products.filter("hash(url, pid) % 2 <> 0"), 3, folder=folder)
    return K.settled(skus, K.drained(s, folder, products.schema, plan, f"{folder}-out", f"{folder}-state"), I.NOW)


def _log(s, d):
    rows = observations(s, d).select(F.col("sku").cast("long").alias("key"), F.col("event_id").cast("long").alias("id"), "ts", F.col("price").cast("long").alias("value"))
    return K.replayed(rows, lambda stream: K.change_log(stream, LATE, SPAN), WAIT_MS).select(F.col("id").alias("event_id"), F.col("key").alias("sku"), F.col("value").alias("price"))


def signals(s, d):
    k = F.col("event_id") % 13
    kind = F.when(k == 0, "seen").when(k == 1, "ok").when(k.isin(2, 4), "blocked").when(k == 3, "missing").otherwise("gone")
    return table(s, d, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("id"), "ts", kind.alias("kind"))


def _misses(s, d):
    return K.replayed(signals(s, d), lambda stream: K.misses(stream, LATE, SPAN), WAIT_MS).select(F.col("key").alias("sku"), F.col("id").alias("event_id"), "action", "misses")


QUERIES = {
    "t_stateful_upsert": lambda s, d: _scan(s, d)[0],
    "t_stateful_observations": lambda s, d: _scan(s, d)[1],
    "t_change_log_stream": _log,
    "t_miss_counter": _misses,
}
ORACLE = {
    "t_stateful_upsert": I.ORACLE["k_scan_upsert"],
    "t_stateful_observations": I.ORACLE["k_scan_observations"],
    "t_change_log_stream": """SELECT event_id, sku, price FROM (SELECT *, lag(price) OVER w AS p, row_number() OVER w AS r FROM (SELECT event_id, ts, user_id AS sku, CAST(floor(value / 50) AS BIGINT) * 50 AS price FROM events WHERE event_type IN ('view', 'click'))
WINDOW w AS (PARTITION BY sku ORDER BY ts, event_id)) WHERE r = 1 OR p IS DISTINCT FROM price""",
    "t_miss_counter": f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM ({SIGNALS}))
, life(key, n, id, seen, misses, dead, action) AS (SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, 0, 0, NULL::VARCHAR FROM s
  UNION ALL SELECT s.key, s.n, s.id, CASE WHEN kind = 'seen' THEN s.ts ELSE seen END,
  CASE WHEN kind = 'seen' THEN 0 WHEN dead = 1 THEN misses WHEN kind = 'gone' AND (seen IS NULL OR s.ts - seen >= INTERVAL 24 HOUR) THEN misses + 1 WHEN kind = 'ok' THEN 0 ELSE misses END,
  CASE WHEN kind = 'seen' THEN 0 WHEN dead = 1 THEN 1 WHEN kind = 'gone' AND (seen IS NULL OR s.ts - seen >= INTERVAL 24 HOUR) AND misses = 2 THEN 1 ELSE 0 END,
  CASE WHEN kind = 'seen' THEN CASE WHEN dead = 1 THEN 'revived' END WHEN dead = 1 OR kind IN ('blocked', 'ok') THEN NULL WHEN kind = 'missing' OR (seen IS NOT NULL AND s.ts - seen < INTERVAL 24 HOUR) THEN 'flagged' WHEN misses = 2 THEN 'dead' ELSE 'missed' END
  FROM life JOIN s ON s.key = life.key AND s.n = life.n + 1)
SELECT key AS sku, id AS event_id, action, misses FROM life WHERE action IS NOT NULL""",
}
