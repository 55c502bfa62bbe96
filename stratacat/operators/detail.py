"""A product's page as one document: its offers, videos and similar models, and what search engines read of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.operators.grid import offer_summary, similar

OFFERS, VIDEOS, SIMILAR = 100, 3, 8
_JSON = {"ignoreNullFields": "false"}


def top_lists(rows: DataFrame, key: str, order: list[Column], n: int, item: Column, name: str) -> DataFrame:
    """``key, name``: the first ``n`` items of each key, in order. The rank's limit is applied in each part before rows are shuffled, so a key never brings more than ``n`` rows from a part."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    best = rows.withColumn("rank", rank).filter(F.col("rank") <= n)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias(name))


def product_pages(masters: DataFrame, skus: DataFrame, videos: DataFrame, origin: str, n_offers: int = OFFERS) -> DataFrame:
    """``id, page, ld`` (JSON) of each published or retired master.

    The page lists the first offers (those alive first, then those in stock, then by price, unpriced ones first; their number is always whole), at most three videos that nobody excluded (pinned
    ones first, then by views), and up to eight similar masters. ``ld`` describes the product with its range of prices and its videos; without a price there is no product in it.
    ``videos``: master_id, video_id, title, views, pinned, excluded, published (date).
    """
    shown = masters.filter("status IN ('ready', 'retired')")
    good = skus.filter("review_status = 'approved'").withColumn("id", F.col("master_id"))
    offer = F.struct("sku_key", "config", "pack_qty", F.col("price_inr").alias("price"), F.when(F.col("dead") == 1, "gone").when(F.col("in_stock") == 1, "in").otherwise("out").alias("state"))
    offers = top_lists(good, "id", [F.asc("dead"), F.desc_nulls_last("in_stock"), F.asc_nulls_first("price_inr"), F.asc("sku_key")], n_offers, offer, "offers")
    counted = good.groupBy("id").agg(F.count("*").alias("n_offers"))
    chosen = videos.filter("excluded = 0").withColumn("id", F.col("master_id"))
    clips = top_lists(chosen, "id", [F.desc("pinned"), F.desc_nulls_last("views"), F.asc("video_id")], VIDEOS, F.struct("video_id", "title", "views", F.date_format("published", "yyyy-MM-dd").alias("uploaded")), "videos")
    live = good.filter("in_stock = 1 AND dead = 0").select("id").distinct()
    alike = similar(masters.filter("status = 'ready'").join(live, "id", "left_semi"), shown, SIMILAR)
    alike = top_lists(alike.withColumnRenamed("seed_id", "id"), "id", [F.asc("rank")], SIMILAR, F.col("other_id"), "similar")
    sums = offer_summary(masters.withColumn("status", F.when(F.col("status") == "retired", "ready").otherwise(F.col("status"))), skus)
    joined = shown.select("id", "brand", "name")
    for more in (offers, counted, clips, alike, sums.select("id", "low_price", "high_price", "offer_count", "availability")):
        joined = joined.join(more, "id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kinds = dict(joined.dtypes)
    title = F.concat_ws(" ", "brand", "name")
    page = F.struct("id", title.alias("title"), F.coalesce("n_offers", F.lit(0)).alias("n_offers"), none("offers", kinds["offers"]).alias("offers"), none("videos", kinds["videos"]).alias("videos"), none("similar", kinds["similar"]).alias("similar"))
    price = F.struct(F.lit("AggregateOffer").alias("@type"), F.lit("INR").alias("priceCurrency"), F.col("low_price").alias("lowPrice"), F.col("high_price").alias("highPrice"), F.col("offer_count").alias("offerCount"), F.concat(F.lit("https://schema.org/"), "availability").alias("availability"))
    product = F.to_json(F.struct(F.lit("Product").alias("@type"), title.alias("name"), F.col("brand").alias("brand"), F.concat(F.lit(f"{origin}/img/master/"), "id").alias("image"), price.alias("offers")), _JSON)
    clip = lambda v: F.to_json(F.struct(F.lit("VideoObject").alias("@type"), v["title"].alias("name"), v["uploaded"].alias("uploadDate"), v["video_id"].alias("id")), _JSON)
    graph = F.array_compact(F.concat(F.array(F.when(F.col("low_price").isNotNull(), product)), F.transform(none("videos", kinds["videos"]), clip)))
    return joined.select("id", F.to_json(page, _JSON).alias("page"), F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(graph, ","), F.lit("]}")).alias("ld"))
