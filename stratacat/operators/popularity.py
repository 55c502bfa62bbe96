"""Popularity of models from videos, sellers and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.functions.text import round2

# Weights of views and breadth, the most a recent video adds, its half-life in ms, videos that count, sellers that count.
VIEWS, BREADTH, RECENT, HALF_LIFE, TOP, SELLERS = 12, 8, 10, 180 * 86_400_000, 10, 5
# Words that identify no model, words that show a hobby video.
VIDEO_NOISE = (
    r"\b(rc|plane|airplane|aircraft|model|models|wing|kit|pnp|rtf|arf|bnf|fpv|vtol|edf|jet|scale|sport|park|flyer|trainer|glider|warbird|classic|low|mid|high|mini|micro|big|giant|super|ultra|pro|plus|new|version|edition|combo|set|only|yellow|red|blue|green|white|black|silver|gold|orange|grey|gray|camo|scheme|v\d+)\b"
)
HOBBY = r"(?i)\b(rc|fpv|vtol|edf|maiden|aeromodel\w*|foam\w*|glider|flite|pnp|rtf|arf|hobby|drone|model|aero)\b"
# End of fixed values.


def video_relevant(brand: Column, name: Column, title: Column, channel: Column) -> Column:
    """Whether a video's title is about the model: its own words (or the whole name written together) with the brand beside them or a hobby word."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.char_length(w) >= 2)
    own, raw, said = words(F.regexp_replace(plain(name), VIDEO_NOISE, " ")), words(plain(name)), F.split(plain(title), " ")
    together = (F.size(raw) > 1) & F.contains(flat(title), F.array_join(raw, ""))
    share = F.when(together, 1.0).otherwise(F.size(F.filter(own, lambda w: F.array_contains(said, w))) / F.size(own))
    named = (flat(brand) != "") & (F.contains(flat(title), flat(brand)) | F.contains(flat(channel), flat(brand)))
    context = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(channel, F.lit(""))).rlike(HOBBY)
    return F.when(F.size(own) == 0, False).otherwise((named & (share >= 0.3)) | ((share >= 0.6) & context))


def availability(sellers: Column, any_stock: Column) -> Column:
    return F.when(any_stock == 1, 1.0).otherwise(0.35) * (1 + F.least(sellers, F.lit(SELLERS)) * 0.05)


def scores(masters: DataFrame, videos: DataFrame, now_ms: int) -> DataFrame:
    """``id, view_sum, video_count, raw, score``.

    ``masters``: id, sellers, any_stock, boost. ``videos``: master_id, video_id, views, published_ms, excluded. A master without
    videos has raw 0. The ten most seen videos of each master are found before anything is summed.
    """
    rank = F.row_number().over(Window.partitionBy("master_id").orderBy(F.desc(F.coalesce("views", F.lit(0))), "video_id"))
    sums = (
        videos.filter(~F.coalesce("excluded", F.lit(False)))
        .withColumn("rank", rank)
        .groupBy("master_id")
        .agg(
            F.sum(F.when(F.col("rank") <= TOP, F.coalesce("views", F.lit(0))).otherwise(0)).alias("view_sum"),
            F.count("*").alias("video_count"),
            F.max(F.coalesce("published_ms", F.lit(0))).alias("newest"),
        )
    )
    joined = masters.join(sums, F.col("id") == F.col("master_id"), "left").na.fill(0, ["view_sum", "video_count", "newest"])
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.col("newest"))
    recent = F.when(F.col("newest") != 0, RECENT * F.pow(F.lit(0.5), age / HALF_LIFE)).otherwise(0.0)
    raw = round2(F.log10(1 + F.col("view_sum")) * VIEWS + F.log10(1 + F.col("video_count")) * BREADTH + recent)
    boost = F.when(F.coalesce("boost", F.lit(0.0)) > 0, F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("boost")))).otherwise(1.0)
    return joined.withColumn("raw", raw).select("id", "view_sum", "video_count", "raw", round2(F.col("raw") * availability(F.col("sellers"), F.col("any_stock")) * boost).alias("score"))
