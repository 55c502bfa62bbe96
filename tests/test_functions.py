"""Functions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from stratacat.functions import classify as K
from stratacat.functions import text as T
from stratacat.operators import linkage as L
from stratacat.sources import feeds


def one(spark, make, *values):
    frame = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return frame.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("Ranger 800mm Wingspan PNP", 800), ("Wingspan: 1,200 mm", 1200), ("wing span 98 cm", 980), ("Wingspan 1.2m", 1200),
    ("wingspan 39.4 inches", 1001), ("3.5mm gold connector", None), ("20mm x 50", None), ("", None), (None, None),
])
def test_span_title(spark, text, want):
    assert one(spark, K.span_title, text) == want


@pytest.mark.parametrize(("text", "want"), [("Dolphin PNP", "pnp"), ("Ready To Fly set", "rtf"), ("combo with motor", "combo"), ("balsa", "kit"), (None, "kit")])
def test_config(spark, text, want):
    assert one(spark, K.config, text) == want


@pytest.mark.parametrize(("text", "want"), [("Almost Ready-to-Fly (ARF)", ["arf"]), ("Plug-N-Play combo", ["pnp", "combo"]), ("nothing", [])])
def test_config_types(spark, text, want):
    assert one(spark, K.config_types, text) == want


@pytest.mark.parametrize(("ours", "theirs", "want"), [("kit", "arf", 1), ("pnp", "bnf", None), ("pnp", "rtf", 0)])
def test_config_agree(spark, ours, theirs, want):
    assert one(spark, lambda a, b: K.config_agree(K.config_types(a), K.config_types(b)), ours, theirs) == want


@pytest.mark.parametrize(("text", "want"), [("35cc Cub", "gas"), ("Pulse .46 size", "gas"), ("with DLE 30", "gas"), ("64mm EDF brushless", "electric"), (None, "electric")])
def test_power(spark, text, want):
    assert one(spark, K.power, text) == want


@pytest.mark.parametrize(("text", "want"), [("(Pre-owned) Cub", "used"), ("Quality Pre Owned", "used"), ("Sparingly used", "used"), ("unused", "new")])
def test_condition(spark, text, want):
    assert one(spark, K.condition, text) == want


@pytest.mark.parametrize(("text", "tags", "sure"), [("MiG-29 jet", ["Jet / EDF", "Warbird"], True), ("warbird trainer Mustang", ["Warbird"], True), ("mystery", ["Sport / Park Flyer"], False)])
def test_role_tags(spark, text, tags, sure):
    found = one(spark, K.role_tags, text)
    assert (found.tags, found.confident) == (tags, sure)


@pytest.mark.parametrize(("title", "want"), [("Dolphin PNP fixed wing", True), ("replacement fuselage", False), ('EDGE 540N 68.2" WING SPAN', True)])
def test_is_aircraft(spark, title, want):
    assert one(spark, lambda t: K.is_aircraft(t, F.lit(None).cast("string")), title) is want


@pytest.mark.parametrize(("ours", "theirs", "want"), [("Ranger 757-4", "Volantex Ranger 2000 75708", 0.5), ("Ranger 600", "Ranger 600S trainer", 1.0), ("", "x", 0.0)])
def test_name_similarity(spark, ours, theirs, want):
    assert one(spark, lambda a, b: L.name_similarity(L.model_tokens(a), b), ours, theirs) == want


def test_urls_and_hash(spark):
    assert one(spark, T.canonical_url, "HTTPS://Shop.X/collections/a/products/b/?utm_x=1&z=2&a=1#f") == "https://shop.x/products/b?a=1&z=2"
    assert one(spark, T.canonical_url, "no url") is None
    assert one(spark, T.host_of, "http://www.Shop.x/p") == "shop.x"
    assert one(spark, lambda c: F.lower(F.hex(T.fnv1a(c))), "abc") == "1A47E90B".lower()


def test_jsonld_and_cart(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":"Product","offers":[{"price":"4999.4","priceCurrency":"INR","availability":"https://schema.org/InStock"}]}]}</script>'
    got = one(spark, feeds.jsonld_product, page)
    assert (got.price, got.stock) == (4999, 1)
    assert one(spark, feeds.jsonld_product, page.replace("INR", "USD")) is None
    assert one(spark, feeds.jsonld_product, "<p>none</p>") is None
    cart = one(spark, feeds.cart_signals, '<a class="x theme-cart-button">Add</a><b class="theme-product-price">Rs. 4,999</b>')
    assert (cart.stock, cart.price) == (1, 4999)
    assert one(spark, feeds.cart_signals, "<script>theme-cart-button</script>") is None


def test_challenge(spark):
    assert one(spark, K.is_challenge, "<title>Just a moment...</title>") is True
    assert one(spark, K.is_challenge, "<h1>Cub</h1>") is False
