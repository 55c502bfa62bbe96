"""Scans, verification, components, and streams that end at what the batch gives."""

import random

from pyspark.sql import functions as F

from stratacat.operators.components import components
from stratacat.operators.upsert import insert_ignore, update_if_unchanged
from stratacat.plans.incremental import QUERIES
from stratacat.sources import feeds
from stratacat.streaming import catalog as ST

SKU = "source_id long, pid string, url string, title string, price long, stock int, review_status string, flag string, first_seen long, last_seen long, misses int, dead int"
PRODUCT = "source_id long, pid string, url string, title string, price long, stock int"


def test_scan_rules(spark):
    base = ("approved", None, 1, 1, 2, 1)
    skus = spark.createDataFrame([(1, "a", "u1", "t", 10, 1, *base), (1, "b", "u2", "t", 10, 1, *base), (1, None, "u3", "t", None, None, "new", None, 1, 1, 0, 0), (1, "d", "u4", "t", 5, 0, *base)], SKU)
    seen = spark.createDataFrame(
        [(1, "a", "u1", "new title", 12, None), (1, "b", "u4", "t", None, None), (1, "c", "u3", "named", 7, 1), (1, "e", "u5", "t", 3, 1), (1, "f", None, "t", 3, 1), (2, "a", "u1", "t", 1, 1)], PRODUCT
    )
    rows, notes = ST.scan_upsert(skus, seen, 100)
    got = {(r.source_id, r.url): r for r in rows.collect()}
    assert got[1, "u1"].price == 12 and got[1, "u1"].stock == 1 and got[1, "u1"].title == "t" and got[1, "u1"].dead == 0 and got[1, "u1"].last_seen == 100
    assert got[1, "u2"].flag == "url-collision" and got[1, "u2"].price == 10  # keeps its url
    assert got[1, "u3"].pid == "c" and got[1, "u3"].title == "named" and got[1, "u3"].price == 7
    assert got[1, "u5"].review_status == "new" and got[2, "u1"].review_status == "new" and len(got) == 6
    assert {(r.source_id, r.url, r.price) for r in notes.collect()} == {(1, "u1", 12), (1, "u3", 7), (1, "u5", 3), (2, "u1", 1)}


def test_reused_url_only_flags(spark):
    skus = spark.createDataFrame([(1, "a", "u1", "t", 10, 1, "approved", None, 1, 1, 0, 0)], SKU)
    rows, notes = ST.scan_upsert(skus, spark.createDataFrame([(1, "z", "u1", "t", 9, 0)], PRODUCT), 100)
    (row,) = rows.collect()
    assert (row.flag, row.pid, row.price, row.last_seen) == ("missing", "a", 10, 1) and not notes.collect()


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, v string, updated int")
    out, done = update_if_unchanged(old, spark.createDataFrame([(1, 4, "x", 6), (2, None, "y", 7)], "id int, expected int, v string, updated int"), "id", "updated")
    assert {(r.id, r.v, r.updated) for r in out.collect()} == {(1, "a", 5), (2, "y", 7)} and [r.id for r in done.collect()] == [2]
    more = insert_ignore(old, spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "e", 1)], old.schema), ["id"], [F.col("updated")])
    assert {(r.id, r.v) for r in more.collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_stream_ends_at_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    ST.latest_by_key(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id"], "event_id").awaitTermination()
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(str(last)).collect()}
    assert got == {(r.user_id, r.e) for r in events.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}


def test_windowed_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    spark.read.parquet(path).write.parquet(str(tmp_path / "in"))
    stream = ST.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="1000 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type, r.n) for r in spark.table("counts").collect()}
    assert got == {(r.start, r.event_type, r.n) for r in ST.windowed_counts(spark.read.parquet(path)).collect()}


def test_feed_pages_stay_small(spark, tmp_path, monkeypatch):
    """Ten times the rows of one supplier, or of pages, make more feed pages, not longer ones."""
    wide = {}
    for name, parser, column in (("src_woo_feed", "woocommerce", "json"), ("src_sitemap_urls", "sitemap_urls", "xml")):
        seen, parse = [], getattr(feeds, parser)
        monkeypatch.setattr(feeds, parser, lambda df, parse=parse, seen=seen: seen.append(df) or parse(df))
        for n in (2_000, 20_000):
            d = f"{tmp_path}/{n}"
            k = F.col("id")
            spark.range(n).select(k.alias("page_id"), F.concat(F.lit("https://a.example/?x=1&p="), F.lpad(k.cast("string"), 6, "0")).alias("url")).write.mode("overwrite").parquet(f"{d}/pages.parquet")
            spark.range(n).select((k + 1).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (k % 90 + 10).alias("l_partkey"), F.lit(7).cast("long").alias("l_suppkey"), F.lit(12.5).alias("l_extendedprice")).write.mode("overwrite").parquet(f"{d}/lineitem.parquet")
            assert QUERIES[name](spark, d).count() == n
            wide[name, n] = seen[-1].agg(F.max(F.length(column))).first()[0]
        assert wide[name, 20_000] < 1.1 * wide[name, 2_000]
