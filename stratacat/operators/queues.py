"""Work queues: what is due, in which order, and page reads of the admin lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import LIVE

DAY_MS = 86_400_000


def retry_due(last: Column, now_ms: int, ttl_ms: int) -> Column:
    """Never tried, or last tried before the retry window."""
    return last.isNull() | (last < now_ms - ttl_ms)


def oldest_first(rows: DataFrame, last: str, key: str, many: int) -> DataFrame:
    """The ``many`` rows that have waited longest, those never done before all others."""
    return rows.orderBy(F.asc_nulls_first(last), key).limit(many)


def popularity_queue(masters: DataFrame, skus: DataFrame, now_ms: int, many: int = 12, refresh_ms: int = 7 * DAY_MS) -> DataFrame:
    """``id, sellers, mode``: ready masters in stock whose popularity is due, longest waiting first.

    As long as any of them has no score the queue backfills: only masters without a score, those tried within a day excepted. Then scores older than ``refresh_ms``
    are renewed. ``masters``: id, status, pop_score, pop_updated_at.
    """
    offers = skus.filter("review_status = 'approved'").groupBy("master_id").agg(F.countDistinct("source_id").alias("sellers"), F.max(LIVE().cast("int")).alias("any_stock")).filter("any_stock = 1")
    stocked = masters.filter("status = 'ready'").join(offers, F.col("id") == F.col("master_id"))
    mode = stocked.agg(F.coalesce(F.max(F.col("pop_score").isNull()), F.lit(False)).alias("backfill"))  # one row
    rows = stocked.crossJoin(F.broadcast(mode))
    due = F.when(F.col("backfill"), F.col("pop_score").isNull() & retry_due(F.col("pop_updated_at"), now_ms, DAY_MS)).otherwise(F.col("pop_updated_at") < now_ms - refresh_ms)
    return oldest_first(rows.filter(due), "pop_updated_at", "id", many).select("id", "sellers", F.when(F.col("backfill"), "backfill").otherwise("refresh").alias("mode"))


def enrich_queue(skus: DataFrame, mappings: DataFrame, categories: DataFrame, many: int = 5) -> DataFrame:
    """The newest unreviewed, live skus that nothing was read for, with a category of their address (the first by name) or none."""
    rows = skus.filter("review_status = 'new' AND enriched_at IS NULL AND dead = 0")
    first = mappings.join(categories, "category_id", "left").groupBy("source_id").agg(F.min("category_id").alias("category_id"), F.min_by("triage", "category_id").alias("triage"))
    return rows.join(first, "source_id", "left").orderBy(F.desc("first_seen"), "sku_key").limit(many).select("sku_key", "category_id", "triage")


def classify_backlog(masters: DataFrame, skus: DataFrame, many: int = 12) -> DataFrame:
    """Ready or draft masters without role tags, with all titles of their offers in order, first ids first. Titles are gathered for the chosen masters only."""
    chosen = masters.filter(F.col("role_tags").isNull() & F.col("status").isin("ready", "draft")).orderBy("id").limit(many).select("id")
    titles = skus.join(F.broadcast(chosen), F.col("master_id") == F.col("id")).groupBy("id").agg(F.concat_ws(" | ", F.sort_array(F.collect_set("title"))).alias("titles"))
    return chosen.join(titles, "id", "left")


def review_page(skus: DataFrame, masters: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page of skus with the master of their offer, if they have one: newest first."""
    m = masters.select(F.col("id").alias("master_id"), F.col("name").alias("master_name"), F.col("slug").alias("master_slug"))
    page = skus.orderBy(F.desc("last_seen"), "sku_key", "source_id").offset((number - 1) * size).limit(size)
    return page.join(m, "master_id", "left").select("sku_key", "title", "offer_config", "master_name", "master_slug")


def first_images(masters: DataFrame, skus: DataFrame) -> DataFrame:
    """``id, image``: the master's own picture, else that of its best sku with one: alive, in stock, by key."""
    best = skus.filter("image_url IS NOT NULL").groupBy("master_id").agg(F.min_by("image_url", F.struct("dead", (-F.coalesce("in_stock", F.lit(-1))).alias("s"), "sku_key")).alias("found"))
    return masters.join(best, F.col("id") == F.col("master_id"), "left").select("id", F.coalesce("hero_image", "found").alias("image"))


def round_robin(rows: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """Adds ``turn``: the first row of every bucket, then the second of every bucket and so on; ``bucket`` orders within a turn."""
    from pyspark.sql import Window

    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))


def preferred(urls: DataFrame, skip: str, prefer: str, many: int, column: str = "url") -> DataFrame:
    """The first ``many`` distinct addresses: without skipped ones, preferred ones first, then by name."""
    return urls.select(column).distinct().filter(~F.col(column).rlike(skip)).orderBy(F.col(column).rlike(prefer).cast("int").desc(), column).limit(many)


def duplicate_pairs(candidates: DataFrame, masters: DataFrame, skus: DataFrame) -> DataFrame:
    """Pending pairs with both masters, whose side to keep, and the order of review: both in stock first, then score.

    To keep: ready, then more offers, then a known span, then the smaller id.
    """
    stock = skus.groupBy("master_id").agg(F.count("*").alias("offers"), F.max(LIVE().cast("int")).alias("in_stock"))
    m = masters.join(stock, F.col("id") == F.col("master_id"), "left").select("id", "name", "status", "span_mm", F.coalesce("offers", F.lit(0)).alias("offers"), F.coalesce("in_stock", F.lit(0)).alias("in_stock"))
    side = lambda p: m.select(*[F.col(c).alias(f"{p}_{c}") for c in m.columns])
    rank = lambda p: F.struct(F.when(F.col(f"{p}_status") == "ready", 0).otherwise(1), -F.col(f"{p}_offers"), F.when(F.col(f"{p}_span_mm") > 0, 0).otherwise(1), F.col(f"{p}_id"))
    pairs = candidates.filter("status = 'pending'").select("a_id", "b_id", "score").join(side("a"), "a_id").join(side("b"), "b_id")
    both = (F.col("a_in_stock") == 1) & (F.col("b_in_stock") == 1)
    return pairs.select("a_id", "b_id", "a_name", "b_name", "score", both.alias("both_in_stock"), F.when(rank("a") < rank("b"), F.col("a_id")).otherwise(F.col("b_id")).alias("keep_id")).orderBy(F.desc("both_in_stock"), F.desc("score"), "a_id", "b_id")


def match_review(matches: DataFrame, candidates: DataFrame, masters: DataFrame, products: DataFrame, makers: DataFrame, profiles: DataFrame, status: str, many: int = 500) -> DataFrame:
    """Candidates of the first ``many`` matches of a status, by tier (review, accept, others) and score, with maker facts and the stored profile of exactly that product.

    An accepted product that is no candidate any more comes back at rank 0.
    """
    tier = F.when(F.col("tier") == "review", 0).when(F.col("tier") == "accept", 1).otherwise(2)
    chosen = matches.filter(F.col("status") == status).orderBy(tier, F.desc("score"), "master_id").limit(many)
    names = masters.select(F.col("id").alias("master_id"), "brand", "name")
    ranked = candidates.join(chosen.select("master_id"), "master_id", "left_semi").select("master_id", "product_id", "rank", "score", "tier", "reason")
    saved = chosen.filter("status = 'accepted' AND product_id IS NOT NULL").join(candidates.select("master_id", "product_id"), ["master_id", "product_id"], "left_anti")
    saved = saved.select("master_id", "product_id", F.lit(0).alias("rank"), "score", "tier", F.lit("currently saved mapping").alias("reason"))
    facts = products.select("product_id", "title", "span", "maker_id").join(makers, "maker_id", "left")
    rows = ranked.unionByName(saved).join(names, "master_id").join(facts, "product_id", "left")
    return rows.join(profiles.select("master_id", "product_id", "overrides"), ["master_id", "product_id"], "left").select("master_id", "name", "product_id", "rank", "score", "tier", "reason", "title", "maker", "overrides")
