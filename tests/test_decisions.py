import random
import re

from pyspark.sql import functions as F

from stratacat.operators import dedup as D
from stratacat.operators import detail as P
from stratacat.operators import review as R
from stratacat.operators.components import components
from stratacat.streaming import verification as V


def names(spark, n=120, seed=4):
    rng = random.Random(seed)
    rows = [(k, f"brand {rng.randrange(3)}", " ".join(rng.sample(["alpha", "beta", "gamma", "delta", "1200", "900"], rng.randrange(1, 4))), rng.choice([None, 900, 1000, 1020]), "ready" if k % 3 else "draft") for k in range(n)]
    return spark.createDataFrame(rows, "id long, brand_norm string, name_norm string, span_mm int, status string").withColumn("name", F.col("name_norm"))


def test_classes_give_the_pairs_of_names(spark):
    """Pairs by classes equal those of all names, and so do clusters."""
    m = names(spark)
    want = D._scored(D._facts(D._joined(D._named(m), ["brand_norm"])))
    key = lambda r: (r.a_id, r.b_id, round(r.score, 9), r.obvious)
    assert sorted(map(key, D.same_brand(m).collect())) == sorted(map(key, want.collect()))
    offers = spark.createDataFrame([(k, k % 4) for k in range(120)], "master_id long, offers long")
    assert sorted(map(tuple, D.class_clusters(m, offers).collect())) == sorted(map(tuple, D.clusters(m, want, offers).collect()))


def test_very_many_equal_names_give_few_links(spark):
    m = spark.range(100_000).select("id", F.lit("acme").alias("brand_norm"), F.lit("sky ranger").alias("name_norm"), F.lit(900).alias("span_mm"), F.lit("ready").alias("status"), F.lit("Sky Ranger").alias("name"))
    members, pairs = D.brand_classes(m)
    assert members.count() == 100_000
    assert [tuple(r) for r in pairs.collect()] == [(0, 0, 1.0, True, 100_000 * 99_999 // 2)]
    found = D.class_clusters(m, spark.createDataFrame([(7, 1)], "master_id long, offers long"))
    assert found.count() == 100_000 and [tuple(r) for r in found.select("cluster", "survivor").distinct().collect()] == [(0, 7)]


def test_links_inside_of_a_class_that_another_class_joins(spark):
    """Equal names without span or size are no link by themselves, but all link to a name with which they are obvious."""
    rows = [(1, "b", "alpha beta", None, "ready"), (2, "b", "beta alpha", None, "ready"), (3, "b", "alpha beta 900", 900, "ready"), (4, "b", "alpha beta 900", 900, "ready")]
    m = spark.createDataFrame(rows, "id long, brand_norm string, name_norm string, span_mm int, status string").withColumn("name", F.col("name_norm"))
    links = D._scored(D._facts(D._joined(D._named(m), ["brand_norm"]))).filter("obvious").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    want = sorted(map(tuple, components(links).collect()))
    got = D.class_clusters(m, spark.createDataFrame([], "master_id long, offers long")).select("id", "cluster")
    assert sorted(map(tuple, got.collect())) == want


def test_a_title_word_of_50000_letters(spark):
    long = "x" * 25_000 + "ranger" + "y" * 25_000
    skus = spark.createDataFrame([("k1", long), ("k2", "the sky ranger"), ("k3", "ab cd"), ("k4", None)], "sku_key string, title string")
    masters = spark.createDataFrame([(1, "ranger"), (2, "sky ranger"), (3, "ab"), (4, "sky ran ger"), (5, "zzz")], "id long, name_norm string")
    got = sorted((r.sku_key, r.master_id, r.score) for r in R.attach_suggestions(skus, masters).collect())
    assert got == [("k1", 1, 2), ("k1", 4, 2), ("k2", 1, 2), ("k2", 2, 2), ("k2", 4, 3), ("k3", 3, 2)]


def test_brand_words_begin_very_long_title_words(spark):
    masters = spark.createDataFrame([(1, "skymaker"), (2, "skymaker"), (3, "wing"), (4, "skymaker")], "id long, brand_norm string")
    titles = spark.createDataFrame([(1, "Skymaker" + "s" * 50_000), (2, "a skymake x"), (3, "other"), (4, None)], "id long, title string")
    assert {r.id: r.confirmed for r in D.confirmations(masters, titles).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_each_rule_of_a_check(spark):
    skus = "sku_key string, price long, stock int, quote_only boolean, image string, variants string, flag string, flag_detail string, misses int, dead int, last_seen long, last_checked long"
    now = 10 * V.DAY_MS
    row = lambda k, **x: tuple({"sku_key": k, "price": 100, "stock": 1, "quote_only": False, "image": None, "variants": "[]", "flag": None, "flag_detail": None, "misses": 2, "dead": 0, "last_seen": now - 2 * V.DAY_MS, "last_checked": None, **x}.values())
    read = lambda k, state, **x: tuple({"sku_key": k, "state": state, "quote_only": False, "price": 100, "stock": 1, "image": "i", "variants": None, **x}.values())
    stored = [row("blocked"), row("dead"), row("miss", misses=1), row("recent", last_seen=now - 5), row("again", flag="missing", flag_detail="old", last_seen=now), row("unpriced"), row("jump"), row("edge"), row("back", flag="missing", image="own"), row("unknown", stock=None), row("wiped"), row("other", flag="url-collision"), row("zero", price=0)]
    reads = [read("blocked", "blocked"), read("dead", "gone"), read("miss", "gone"), read("recent", "gone"), read("again", "missing"), read("unpriced", "ok", quote_only=True, price=None), read("jump", "ok", price=126), read("edge", "ok", price=125)]
    reads += [read("back", "ok", variants='[{"vkey":"v","label":"L","price":1,"stock":0}]'), read("unknown", "ok", stock=0), read("wiped", "ok", price=None), read("other", "ok"), read("zero", "ok", price=900)]
    out = V.verify_all(spark.createDataFrame(stored, skus), spark.createDataFrame(reads, "sku_key string, state string, quote_only boolean, price long, stock int, image string, variants string"), now)
    got = {r.sku_key: r for r in out.skus.collect()}
    assert {k: r.action for k, r in got.items()} == {"blocked": "checked", "dead": "dead", "miss": "miss", "recent": "missing", "again": "checked", "unpriced": "missing", "jump": "price-jump", "edge": "write", "back": "write", "unknown": "write", "wiped": "write", "other": "write", "zero": "write"}
    assert (got["dead"].misses, got["dead"].dead, got["miss"].misses, got["recent"].misses, got["edge"].misses) == (3, 1, 2, 2, 0)
    assert (got["again"].flag_detail, got["back"].flag, got["back"].image, got["edge"].image, got["other"].flag, got["jump"].flag_detail, got["jump"].price) == ("old", None, "own", "i", "url-collision", "100 -> 126", 100)
    assert sorted(r.sku_key for r in out.observations.collect()) == ["edge", "wiped", "zero"]  # no stock and unknown stock are alike
    assert [tuple(r) for r in out.variants.collect()] == [("back", "v", "L", 1, 0)]
    assert [r.entity_id for r in out.audit.collect()] == ["dead"]
    assert {r.last_checked for r in got.values()} == {now}


def test_snapshots_keep_good_ones(spark):
    block = '<script type="application/ld+json">{"@type": "Product", "description":"a \\"b\\" <i>c</i>\\nd"}</script>'
    pad = "<p>" + "x" * 250 + "</p>"
    pages = spark.createDataFrame([("a", block + pad), ("b", pad), ("c", block), ("d", None), ("e", '<meta name="description" content="' + "t " * 30 + '">' + pad)], "sku_key string, html string")
    none = spark.createDataFrame([], "sku_key string, hash string")
    first = V.snapshots(none, pages, 1).collect()
    assert sorted((r.sku_key, r.description) for r in first) == [("a", 'a "b" c d'), ("e", " ".join("t" * 30))]
    stored = spark.createDataFrame([(r.sku_key, r.hash) for r in first], "sku_key string, hash string")
    assert V.snapshots(stored, pages, 2).count() == 0


def test_top_lists(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(50)], "k long, v long")
    got = P.top_lists(rows, "k", [F.desc("v")], 2, F.col("v"), "best").collect()
    assert {r.k: r.best for r in got} == {0: [48, 45], 1: [49, 46], 2: [47, 44]}


def test_a_checked_sku_meets_its_read_without_a_join(spark):
    """Lines hold both sides: they are shuffled once, not joined to themselves and not written between."""
    from stratacat.plans.decisions import QUERIES

    plan = QUERIES["k_verify_skus"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "Scan parquet" in plan


def test_titles_are_read_for_power_without_being_sorted(spark):
    """A title's marks are taken where it lies: joins move ids and marks, not texts."""
    masters = [(1, "Sky", "electric"), (2, "Nitro Sky", "electric"), (3, "Sky 1:4", "electric"), (4, "Sky", "gas"), (5, "Sky", "electric"), (6, None, "electric"), (7, "Sky", None), (8, "Sky 1/5", "electric"), (9, "glow", "electric"), (10, None, "electric")]
    titles = [(1, None), (1, "sky"), (3, "sky 35cc"), (4, "sky 35cc"), (5, "sky"), (5, "sky 1/4 scale"), (5, "sky 1/7"), (6, "gasser"), (7, "35cc"), (9, "sky"), (11, "35cc")]
    m = spark.createDataFrame(masters, "id long, name string, power string")
    t = spark.createDataFrame(titles, "id long, title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = D.power_anomalies(m, t, spark.createDataFrame([(9,)], "id long"))
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert {(r.id, r.kind) for r in found.collect()} == {(2, "power-mismatch"), (3, "power-mismatch"), (5, "power-review"), (6, "power-mismatch"), (8, "power-review")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sorts = re.findall(r"\) Sort\nInput \[\d+\]: (.*)", plan)
    assert sorts and not [x for x in sorts if "title#" in x or "text#" in x or "name#" in x]
