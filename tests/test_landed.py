from pyspark.sql import functions as F

from stratacat.operators import queues as Q
from stratacat.sources import pages

LD = '<script type="application/ld+json">{"@type":"Product","offers":{"price":"4999","priceCurrency":"INR","availability":"InStock"}}</script>'
CART = '<div class="theme-product-price">₹ 1,200</div><a class="theme-cart-button">x</a>'
WOO = '<form data-product_variations="[{&quot;variation_id&quot;:7,&quot;attributes&quot;:{&quot;a&quot;:&quot;PNP&quot;,&quot;b&quot;:&quot;&quot;},&quot;display_price&quot;:99.6,&quot;is_in_stock&quot;:true},{&quot;attributes&quot;:{},&quot;display_price&quot;:50,&quot;is_in_stock&quot;:false}]">'


def test_page_precedence(spark):
    magento = '<span class="price">₹13,500</span> Add to Cart'
    rows = [
        ("magento", magento + LD), ("magento", magento + " OUT OF STOCK"), ("woocommerce", WOO + LD), ("woocommerce", '<form data-product_variations="false">' + LD), ("zoho", LD + CART), ("zoho", CART), ("zoho", "<script>theme-cart-button</script>"), ("zoho", None),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, platform string, html string")
    got = [r.p for r in frame.orderBy("i").select(pages.parse_page(F.col("html"), F.col("platform")).alias("p")).collect()]
    assert [(p.via, p.price, p.stock, p.quote_only) for p in got] == [
        ("magento", 13500, 1, False), ("magento", 13500, 0, False), ("variants", 100, 1, False), ("jsonld", 4999, 1, False), ("jsonld", 4999, 1, False), ("cart", 1200, 1, False), ("quote", None, 0, True), ("quote", None, 0, True),
    ]
    assert [(v.vkey, v.label, v.price, v.stock) for v in got[2].variants] == [("7", "PNP", 100, 1), ("", "Standard", 50, 0)]


def test_read_states(spark):
    rows = [(200, "<p>fine</p>"), (404, ""), (410, None), (403, "x"), (500, "x"), (None, None), (200, "Just a moment...")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, h string").orderBy("i")
    assert [r.x for r in frame.select(pages.read_state(F.col("s"), F.col("h")).alias("x")).collect()] == ["ok", "gone", "gone", "blocked", "blocked", "blocked", "blocked"]


def test_listing_stops_where_it_repeats(spark):
    item = lambda pid, host="shop.in": f'<a class="product-image" href="https://{host}/p{pid}.html"></a><i id="product-price-{pid}"></i><p class="product-name"><a>Plane &amp; {pid}</a></p><b class="price">Rs. 1,000</b>btn-cart'
    html = {1: item(1) + item(2) + item(2) + item(9, "else.in"), 2: item(3), 3: item(3) + item(4), 4: item(5)}
    frame = spark.createDataFrame([(1, "https://shop.in", k, "<html>" + h) for k, h in html.items()], "source_id int, home_url string, page int, html string")
    found = pages.magento_listing(frame)
    assert sorted((r.page, r.pid) for r in found.collect()) == [(1, "1"), (1, "2"), (2, "3"), (3, "3"), (3, "4"), (4, "5")]
    first = found.filter("page = 1 AND pid = '1'").first()
    assert (first.title, first.price, first.stock, first.url) == ("Plane & 1", 1000, 1, "https://shop.in/p1.html")
    assert sorted((r.page, r.pid) for r in pages.until_repeated(found).collect()) == [(1, "1"), (1, "2"), (2, "3")]


def test_popularity_queue_backfills_first(spark):
    skus = spark.createDataFrame([(i, 1, "approved", 1, 0) for i in range(6)], "master_id long, source_id long, review_status string, in_stock int, dead int")
    now, day = 100 * Q.DAY_MS, Q.DAY_MS
    rows = [(0, "ready", None, None), (1, "ready", None, now - day // 2), (2, "ready", 1.0, now - 9 * day), (3, "ready", None, now - 2 * day), (4, "draft", None, None)]
    schema = "id long, status string, pop_score double, pop_updated_at long"
    assert [(r.id, r.mode) for r in Q.popularity_queue(spark.createDataFrame(rows, schema), skus, now).collect()] == [(0, "backfill"), (3, "backfill")]
    scored = [(i, s, 0.0, u) for i, s, _, u in rows]
    assert [(r.id, r.mode) for r in Q.popularity_queue(spark.createDataFrame(scored, schema), skus, now).collect()] == [(2, "refresh")]


def test_pages_are_dealt_before_they_are_parsed(spark):
    """A small file of parts is one split; its pages are parsed on all cores."""
    from stratacat.plans.landed import QUERIES

    assert QUERIES["k_page_parse"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
