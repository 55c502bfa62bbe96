"""Approval of skus as new masters, with all rows that depend on the verdicts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacat.durable import cut
from stratacat.functions.classify import power
from stratacat.functions.text import norm_name
from stratacat.operators.ranks import dense_ids
from stratacat.operators.transitions import approve_new, audit_rows, decide


class Approved(NamedTuple):
    """What a batch of approvals writes: draft masters, their offers, the price at approval, log rows, and the next skus."""

    masters: DataFrame
    offers: DataFrame
    observations: DataFrame
    audit: DataFrame
    skus: DataFrame
    verdicts: DataFrame


def approve_as_new(requests: DataFrame, skus: DataFrame, masters: DataFrame, categories: DataFrame, actor: str) -> Approved:
    """Creates a draft master for each request that :func:`approve_new` lets pass, in the order of the requests' times, with ids from the largest known one on.

    ``requests`` also has ``specs`` (JSON), ``config`` and ``pack_qty``; ``skus``: sku_key, title, image_url, price_inr, in_stock and what :func:`decide` sets. The master's image and power come from its sku.
    Ids are given out part by part behind a count of each part, so no task sees all new masters.
    """
    verdicts = cut(approve_new(requests, masters, categories))
    last = masters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first().id
    won = verdicts.filter("verdict = 'created'").select("sku_key", "category_id", "slug")
    asked = requests.select("sku_key", F.col("slug"), "category_id", "brand", "name", "specs", "config", "pack_qty", "done_at")
    made = won.join(asked, ["sku_key", "category_id", "slug"]).join(skus.select("sku_key", "title", "image_url", "price_inr", "in_stock"), "sku_key", "left")
    made = cut(dense_ids(made, ["done_at", "sku_key"], last))
    rows = made.select(
        "id", "category_id", "slug", "brand", "name", norm_name(F.col("brand")).alias("brand_norm"), norm_name(F.col("name")).alias("name_norm"), F.coalesce("specs", F.lit("{}")).alias("specs"),
        F.col("image_url").alias("hero_image"), F.lit("draft").alias("status"), power(F.col("title")).alias("power"), F.col("done_at").alias("created_at"), F.col("done_at").alias("updated_at"),
    )
    offers = made.select("sku_key", F.col("id").alias("master_id"), F.coalesce("config", F.lit("kit")).alias("config"), F.coalesce("pack_qty", F.lit(1)).alias("pack_qty"), F.col("done_at").alias("created_at"))
    seen = made.select("sku_key", F.col("done_at").alias("at"), "price_inr", "in_stock")
    audit = audit_rows(made.withColumn("action", F.lit("approve-new-master")), "sku", "sku_key", actor, "slug")
    decisions = made.select("sku_key", F.lit("attach").alias("action"), F.lit(None).cast("string").alias("reason"), "done_at")
    return Approved(rows, offers, seen, audit, decide(skus, decisions), verdicts)
