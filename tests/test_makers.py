from pyspark.sql import functions as F

from stratacat.functions import text as X
from stratacat.sources import makers as M
from stratacat.sources import pages as P


def test_lines_and_blocks(spark):
    html = "<style>x</style><p>One&nbsp;&amp;  two</p><ul><li>a<li>b</li></ul><script>no</script><br><br><br><br>end &#233;<b>!</b><a href='cut"
    row = spark.createDataFrame([(html,)], "h string").select(M.lines_of(F.col("h")).alias("t"), M.lines_of(F.col("h"), "", "\n- ").alias("d"), M.lines_of(F.lit(None).cast("string")).alias("n")).first()
    assert row.t == "One & two\n\na\nb\n\nend é !" and row.d == "One & two\n\n- a\n- b\n\nend é!" and row.n == ""
    frame = spark.createDataFrame([('x<div id="d" y>body<hr>after',), ("none",), ('<div id="d">' + "z" * 9000,)], "h string")
    got = [r.b for r in frame.select(M.block(F.col("h"), 'id="d"', "<hr").alias("b")).collect()]
    assert got == ["body", None, "z" * 8000]


def test_hashes_of_units(spark):
    def plain(s):
        h = 0x811C9DC5
        for unit in memoryview(s.encode("utf-16-le")).cast("H"):
            h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
        return h

    texts = ["", "abc", "é", "🛩 plane", "a" * 300, "https://x/y?z=1"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", X.fnv1a_units(F.col("t")).alias("h"), X.padded_hash(F.col("t")).alias("p"), X.image_key(F.col("t")).alias("k")).collect()
    for r in rows[:-1]:
        assert r.h == plain(r.t) and r.p == f"{plain(r.t):08x}" and r.k == f"i/{plain(r.t):x}"
    assert rows[-1].h is None


def test_store_reads(spark):
    item = '[{"id":7,"name":"A <b>B</b> &amp; C","is_in_stock":false,"prices":{"price":"125050","currency_minor_unit":2},"images":[{"src":"i"}]}]'
    rows = [(200, item, "7", 200, ""), (200, item, "8", 404, ""), (200, item, "8", 200, "shop"), (200, item, "8", 200, "Checking your browser"), (200, item, "8", -1, None), (403, item, "7", 200, ""), (200, "{}", "7", 200, ""), (None, None, "7", 200, ""), (200, "[]", "7", None, None)]
    frame = spark.createDataFrame(rows, "status int, payload string, pid string, page_status int, page string")
    got = [r.r for r in frame.select(P.store_read(*[F.col(c) for c in frame.columns]).alias("r")).collect()]
    assert [r.state for r in got] == ["ok", "gone", "missing", "blocked", "missing", "blocked", "blocked", "blocked", "blocked"]
    assert tuple(got[0]) == ("ok", "A B & C", "i", 1251, 0) and tuple(got[1])[1:] == (None,) * 4


def test_categories_below_roots_end_in_cycles(spark):
    tree = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 5), (5, 4), (6, 6)], "id long, parent long")
    assert sorted(r.id for r in M.subtree(tree, [1]).collect()) == [1, 2, 3]
    assert sorted(r.id for r in M.subtree(tree, [4, 9]).collect()) == [4, 5]


def test_brands_and_registries(spark):
    frame = spark.createDataFrame([("a", "Big Maker Inc"), ("b", ""), ("c", None), ("d", "other")], "ext_id string, brand string")
    assert [r.ext_id for r in P.of_brand(frame, "big maker").collect()] == ["a", "b", "c"]
    files = spark.createDataFrame([('[{"brand":"A","domain":"a.example.com","probed_platform":"html","pursue":true},{"brand":"B","domain":"","pursue":true},{"brand":"C","domain":"c","pursue":false}]',), ('{"results":[{"brand":"D","domain":"d","pursue":true}]}',), ("no json",), (None,)], "json string")
    assert sorted(map(tuple, P.registry(files).collect())) == [("A", "a.example.com", "html"), ("D", "d", None)]


def test_words_for_times(spark):
    hour, now = 3_600_000, 10**12
    rows = {None: "never", 0: "never", now - 60_000: "<1h ago", now - 29 * hour // 10: "3h ago", now - 47 * hour: "47h ago", now - 60 * hour: "3d ago"}
    frame = spark.createDataFrame([(k,) for k in rows], "ms long")
    assert {r.ms: r.a for r in frame.select("ms", X.ago(F.col("ms"), now).alias("a")).collect()} == rows


def test_pages_of_a_small_file_are_read_on_all_cores(spark, tmp_path):
    """One file of parts is one split; its pages are dealt out before they are read."""
    from stratacat.plans import makers as plans

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("src_mfr_sitemap_depth", "src_mfr_title_meta", "src_mfr_shop_jsonld"):
        assert plans.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_linked_pages_are_read_once(spark, monkeypatch):
    """A chain of pages: its links are taken from the pages once, not again in each round."""
    page = lambda k: (f"https://a.example/xf-{k}-rc-jet.html", f'<a href="xf-{k + 1}-rc-jet.html">next</a>')
    pages = spark.createDataFrame([page(k) for k in range(1, 6)] + [page(9)], "url string, html string")
    seeds = spark.createDataFrame([("<loc>https://a.example/xf-1-rc-jet.html</loc>",)], "html string")
    taken, hrefs = [], M._hrefs
    monkeypatch.setattr(M, "_hrefs", lambda html: taken.append(1) or hrefs(html))
    got = sorted(r.url for r in M.reached(seeds, pages, r"^/xf-.*rc-(airplane|jet)\.html?$", "https://a.example").collect())
    assert got == [f"https://a.example/xf-{k}-rc-jet.html" for k in range(1, 7)]
    assert len(taken) == 2
