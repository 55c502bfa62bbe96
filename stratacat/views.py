"""Catalog entities derived from the given star schema: masters (models), skus with their offers, events as activity.

``with_views`` puts the same definitions before an oracle's SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASTER = """
SELECT p_partkey AS id, p_type AS category_id, p_brand AS brand, p_name AS name,
       replace(lower(p_brand), '#', ' ') AS brand_norm, lower(p_name) AS name_norm,
       CASE WHEN p_size * 40 >= 200 THEN p_size * 40 END AS span_mm,
       CASE p_partkey % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'retired' ELSE 'ready' END AS status,
       CASE WHEN p_size >= 40 THEN 'gas' WHEN p_size < 5 THEN NULL ELSE 'electric' END AS power,
       CASE p_partkey % 5 WHEN 0 THEN '["Jet / EDF","Warbird"]' WHEN 1 THEN '["Trainer"]'
            WHEN 2 THEN '["Glider / Sailplane","Trainer"]' WHEN 3 THEN '[]' END AS role_tags,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS pop_score
FROM part
"""
SKU = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING)) AS sku_key,
       l_suppkey AS source_id, l_partkey AS master_id,
       CASE WHEN l_linenumber = 7 THEN 'rejected' WHEN l_linenumber = 6 THEN 'new' ELSE 'approved' END AS review_status,
       CASE WHEN l_tax = 0.0 THEN NULL WHEN l_linestatus = 'O' AND l_quantity <= 5 THEN 1 ELSE 0 END AS in_stock,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS dead,
       CASE WHEN l_discount = 0.0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS price_inr,
       CASE WHEN l_quantity >= 5 THEN 2 ELSE 1 END AS pack_qty,
       CASE l_linenumber % 4 WHEN 0 THEN 'kit' WHEN 1 THEN 'pnp' WHEN 2 THEN 'rtf' ELSE 'combo' END AS config,
       concat(p_name, CASE WHEN l_linenumber % 4 = 1 THEN ' PNP' ELSE '' END, CASE WHEN l_quantity <= 2 THEN ' (Pre-owned)' ELSE '' END) AS title,
       CASE WHEN l_discount >= 0.1 THEN 'price-jump' WHEN l_discount >= 0.09 THEN 'missing' END AS flag_kind,
       l_shipdate AS last_seen
FROM lineitem JOIN part ON p_partkey = l_partkey
"""


def with_views(sql: str) -> str:
    return f"WITH v_master AS ({MASTER}), v_sku AS ({SKU}) {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores. A small file of many narrow rows is one or two splits, too few for work that costs much more a row than moving it.

    The count is given, since Spark would join small partitions again.
    """
    s = rows.sparkSession
    return rows.repartition(max(4 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions"))), *keys)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_type").alias("category_id"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")).alias("brand_norm"),
        F.lower("p_name").alias("name_norm"),
        F.when(size * 40 >= 200, size * 40).alias("span_mm"),
        F.when(key % 10 == 0, "draft").when(key % 10 == 1, "retired").otherwise("ready").alias("status"),
        F.when(size >= 40, "gas").when(size >= 5, "electric").alias("power"),
        F.when(key % 5 == 0, '["Jet / EDF","Warbird"]').when(key % 5 == 1, '["Trainer"]').when(key % 5 == 2, '["Glider / Sailplane","Trainer"]').when(key % 5 == 3, "[]").alias("role_tags"),
        F.when(key % 7 != 0, F.col("p_retailprice")).alias("pop_score"),
    )


def sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skus with the offer that ties each to a master."""
    line, qty = F.col("l_linenumber"), F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("sku_key"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_partkey").alias("master_id"),
        F.when(line == 7, "rejected").when(line == 6, "new").otherwise("approved").alias("review_status"),
        F.when(F.col("l_tax") != 0.0, F.when((F.col("l_linestatus") == "O") & (qty <= 5), 1).otherwise(0)).alias("in_stock"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("dead"),
        F.when(F.col("l_discount") != 0.0, F.floor("l_extendedprice").cast("bigint")).alias("price_inr"),
        F.when(qty >= 5, 2).otherwise(1).alias("pack_qty"),
        F.when(line % 4 == 0, "kit").when(line % 4 == 1, "pnp").when(line % 4 == 2, "rtf").otherwise("combo").alias("config"),
        F.concat("p_name", F.when(line % 4 == 1, " PNP").otherwise(""), F.when(qty <= 2, " (Pre-owned)").otherwise("")).alias("title"),
        F.when(F.col("l_discount") >= 0.1, "price-jump").when(F.col("l_discount") >= 0.09, "missing").alias("flag_kind"),
        F.col("l_shipdate").alias("last_seen"),
    )


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "v_master", "v_sku")


def derived(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL over the given tables, the catalog views and ``frames``. Its text serves as a derived entity of an oracle too."""
    made = {"v_master": master, "v_sku": sku}
    known = {}

    def named(match: re.Match) -> str:
        name = match[2]
        if name not in frames and name in _TABLES:
            known[name] = made[name](spark, sf_dir) if name in made else table(spark, sf_dir, name)
        return f"{match[1]} {{{name}}}" if name in frames or name in _TABLES else match[0]

    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)", named, plain), **known, **frames)
