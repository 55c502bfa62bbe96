"""Sightings of skus over time: identity, change log, verification; in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HOUR_MS = 3_600_000


def scan_upsert(skus: DataFrame, products: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """One scan of one or more sources: the next skus and the new observations.

    ``skus``: source_id, pid, url, title, price, stock, review_status, flag, first_seen, last_seen, misses, dead. ``products``: source_id, pid, url, title, price, stock.
    A product is its source's sku by pid, else by url. A pid hit whose new url another sku holds keeps its url and is flagged
    ``url-collision``. A url hit whose sku has another pid is only flagged ``missing``: the product can't take that url. Without a hit the
    product becomes a new sku. Unknown prices and stocks never overwrite, titles only change while a sku is new, and any sighting
    revives. An observation is written when a known price or stock differs from the stored one, and for every new sku.
    Products without url are skipped; of products for one sku the first by (pid, url) counts.
    """
    hit = identified(skus, products)
    first = Window.partitionBy("k").orderBy("reused", F.asc_nulls_last("pid"), "url")
    seen = hit.filter("k IS NOT NULL").withColumn("turn", F.row_number().over(first)).filter("turn = 1")
    fresh_order = Window.partitionBy("source_id", "url").orderBy(F.asc_nulls_last("pid"), "title")
    fresh = hit.filter("k IS NULL").withColumn("turn", F.row_number().over(fresh_order)).filter("turn = 1")
    return applied(skus, seen.select("k", *[F.col(c).alias(f"p_{c}") for c in ("pid", "url", "title", "price", "stock")], "reused", "collides"), fresh, now_ms)


def identified(skus: DataFrame, products: DataFrame) -> DataFrame:
    """Products (a table or a stream) with ``k``, what identifies their stored sku, if any, whether it has another pid (``reused``), and whether another sku holds their url (``collides``)."""
    p = products.filter("url IS NOT NULL")
    held = skus.withColumn("k", F.struct("source_id", "url"))
    by_pid = held.filter("pid IS NOT NULL").select("source_id", "pid", F.col("k").alias("k_pid"), F.col("url").alias("url_pid"))
    by_url = held.select("source_id", "url", F.col("k").alias("k_url"), F.col("pid").alias("pid_url"))
    hit = p.join(by_pid, ["source_id", "pid"], "left").join(by_url, ["source_id", "url"], "left")
    reused = F.col("k_pid").isNull() & F.col("k_url").isNotNull() & F.col("pid").isNotNull() & F.col("pid_url").isNotNull() & (F.col("pid") != F.col("pid_url"))
    return hit.withColumns({"k": F.coalesce("k_pid", "k_url"), "reused": reused, "collides": F.col("k_pid").isNotNull() & F.col("k_url").isNotNull() & (F.col("k_url") != F.col("k_pid"))})


def applied(skus: DataFrame, s: DataFrame, fresh: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The next skus and the observations: ``s`` has the product that counts for each stored sku that was met (``k``, ``p_...``), ``fresh`` the products without one, one per url."""
    held = skus.withColumn("k", F.struct("source_id", "url"))
    joined = held.join(s, "k", "left")
    met, taken = F.col("p_url").isNotNull(), F.coalesce(F.col("reused"), F.lit(False))
    use = met & ~taken
    changed = use & ((F.col("p_price").isNotNull() & ~F.col("p_price").eqNullSafe(F.col("price"))) | (F.col("p_stock").isNotNull() & ~F.col("p_stock").eqNullSafe(F.coalesce("stock", F.lit(0)))))
    updated = joined.select(
        "source_id",
        F.when(use, F.coalesce("pid", "p_pid")).otherwise(F.col("pid")).alias("pid"),
        F.when(use & ~F.col("collides"), F.col("p_url")).otherwise(F.col("url")).alias("url"),
        F.when(use & (F.col("review_status") == "new"), F.coalesce("p_title", "title")).otherwise(F.col("title")).alias("title"),
        F.when(use, F.coalesce("p_price", "price")).otherwise(F.col("price")).alias("price"),
        F.when(use, F.coalesce("p_stock", "stock")).otherwise(F.col("stock")).alias("stock"),
        "review_status",
        F.when(taken, F.lit("missing")).when(use & F.col("collides"), F.lit("url-collision")).otherwise(F.col("flag")).alias("flag"),
        "first_seen",
        F.when(use, F.lit(now_ms)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(use, F.lit(0)).otherwise(F.col("misses")).alias("misses"),
        F.when(use, F.lit(0)).otherwise(F.col("dead")).alias("dead"),
    )
    same_pid = Window.partitionBy("source_id", F.coalesce("pid", "url")).orderBy("url")
    fresh = fresh.withColumn("turn", F.row_number().over(same_pid)).filter("turn = 1")
    added = fresh.select(
        "source_id", "pid", "url", "title", "price", "stock", F.lit("new").alias("review_status"), F.lit(None).cast("string").alias("flag"),
        F.lit(now_ms).alias("first_seen"), F.lit(now_ms).alias("last_seen"), F.lit(0).alias("misses"), F.lit(0).alias("dead"),
    )
    notes = joined.filter(changed).select("source_id", "url", F.col("p_price").alias("price"), F.col("p_stock").alias("stock"))
    return updated.unionByName(added), notes.unionByName(added.select("source_id", "url", "price", "stock")).withColumn("at", F.lit(now_ms))


def verify(skus: DataFrame, reads: DataFrame, now_ms: int) -> DataFrame:
    """What one check of its page does to a sku, by the first rule that fits: adds ``action`` and the next values.

    ``reads``: sku_key, state (ok, blocked, gone, missing), quote_only, price, stock. Gone pages count misses unless the feed showed the sku within a day; three make it dead.
    A price that moves by more than a quarter is flagged and kept.
    """
    j = skus.join(reads.select("sku_key", "state", "quote_only", F.col("price").alias("r_price"), F.col("stock").alias("r_stock")), "sku_key")
    recent = F.col("last_seen_ms") > now_ms - 24 * HOUR_MS
    jump = (F.coalesce("price", F.lit(0)) != 0) & (F.coalesce("r_price", F.lit(0)) != 0) & (F.abs(F.col("r_price") - F.col("price")) / F.col("price") > 0.25)
    action = (
        F.when(F.col("state") == "blocked", "checked")
        .when((F.col("state") == "gone") & ~recent, F.when(F.col("misses") + 1 >= 3, "dead").otherwise("miss"))
        .when(F.col("quote_only") & F.col("r_price").isNull() & F.col("price").isNotNull(), "missing")
        .when(F.col("state").isin("missing", "gone"), "missing")
        .when(jump, "price-jump")
        .otherwise("write")
    )
    a = j.withColumn("action", action)
    is_ = lambda *x: F.col("action").isin(*x)
    return a.select(
        "sku_key", "action",
        F.when(is_("write"), F.coalesce("r_price", "price")).otherwise(F.col("price")).alias("price"),
        F.when(is_("write"), F.coalesce("r_stock", "stock")).otherwise(F.col("stock")).alias("stock"),
        F.when(is_("missing", "price-jump"), F.col("action")).when(is_("write") & (F.col("flag") == "missing"), F.lit(None)).otherwise(F.col("flag")).alias("flag"),
        F.when(is_("miss", "dead"), F.col("misses") + 1).when(is_("write"), F.lit(0)).otherwise(F.col("misses")).alias("misses"),
        F.when(is_("dead"), F.lit(1)).when(is_("write"), F.lit(0)).otherwise(F.col("dead")).alias("dead"),
    )


def hash_gate(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose content hash is new for their key; pages under 200 bytes are junk."""
    good = incoming.filter(F.octet_length("html") >= 200).withColumn("hash", F.sha2("html", 256))
    return good.join(stored.select(key, "hash"), [key, "hash"], "left_anti")


def latest_by_key(spark: SparkSession, source: str, schema, out: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keeps the latest row of each key from a folder of files, as many files a batch as there are; each batch writes a new version of the table.

    A version is written whole and named by the batch, so a batch that runs again overwrites its own version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_rank = 1").drop("_rank")
        if number > 0:
            old = batch.sparkSession.read.parquet(f"{out}/version={number - 1}")
            both = rows.unionByName(old)
            rows = both.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_rank = 1").drop("_rank")
        rows.write.mode("overwrite").parquet(f"{out}/version={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts per window and type with a watermark; the same for a stream and a table. NTZ times become UTC times first."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
