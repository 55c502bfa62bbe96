"""Activity statistics: daily series, totals, trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily(starts: DataFrame, runs: DataFrame) -> DataFrame:
    """``d, starts, players, runs, wins``: both series on the date, 0 where one has no row."""
    a = starts.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("starts"), F.countDistinct("client").alias("players"))
    b = runs.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("runs"), F.count_if("win").alias("wins"))
    return a.join(b, "d", "full_outer").na.fill(0)


def totals(starts: DataFrame, runs: DataFrame, board: DataFrame) -> DataFrame:
    """One row of totals; each input is read once and only its one-row sum is joined."""
    a = starts.agg(F.count("*").alias("starts"), F.countDistinct("client").alias("players"))
    b = runs.agg(F.count("*").alias("runs"), F.count_if("win").alias("wins"))
    return a.crossJoin(b).crossJoin(board.agg(F.count("*").alias("board_rows")))


def by_map(starts: DataFrame, runs: DataFrame) -> DataFrame:
    a = starts.groupBy("map").agg(F.count("*").alias("starts"), F.countDistinct("client").alias("players"))
    b = runs.groupBy("map").agg(F.count("*").alias("runs"), F.count_if("win").alias("wins"))
    return a.join(b, "map", "left").na.fill(0, ["runs", "wins"])


def calendar(series: DataFrame, days: int, keys: list[str], value: str) -> DataFrame:
    """Zero-filled ``days`` days of each key's series that end at its own last date."""
    ends = series.groupBy(*keys).agg(F.max("d").alias("end"))
    grid = ends.select(*keys, F.explode(F.sequence(F.date_sub("end", days - 1), F.col("end"))).alias("d"))
    return grid.join(series, [*keys, "d"], "left").na.fill(0, [value])


def trailing(series: DataFrame, days: int, keys: list[str], value: str) -> DataFrame:
    """Sums of the last seven complete days (the last day is partial) and of the seven before, with a label of the change."""
    w = Window.partitionBy(*keys).orderBy("d")
    sums = calendar(series, days, keys, value).withColumns(
        {"last7": F.sum(value).over(w.rowsBetween(-7, -1)), "prev7": F.sum(value).over(w.rowsBetween(-14, -8)), "n": F.row_number().over(w)}
    )
    return sums.filter(F.col("n") == days).select(*keys, F.coalesce("last7", F.lit(0)).alias("last7"), F.coalesce("prev7", F.lit(0)).alias("prev7")).withColumn("label", delta_label(F.col("last7"), F.col("prev7")))


def delta_label(last, prev):
    """new: from nothing, or more than six times; else flat within 3 %, up or down."""
    pct = F.try_divide((last - prev) * 100.0, prev)
    return F.when((prev == 0) & (last == 0), "none").when((prev == 0) | (pct > 500), "new").when(pct > 3, "up").when(pct < -3, "down").otherwise("flat")


def change_log(observations: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The first row of each key and every row with a value that differs from the row before (nulls are equal)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.row_number().over(w) == 1
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    return observations.withColumn("changed", changed).filter("changed").drop("changed")


def top_share(rows: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Each group's item with the largest sum; ties by name."""
    sums = rows.groupBy(group, item).agg(F.sum(value).alias("total"))
    return sums.groupBy(group).agg(F.max_by(item, F.struct("total", item)).alias("top"), F.max("total").alias("top_total"))


# Hosts that are no projects.
PREVIEW_HOSTS = r"(?i)(^|\.)localhost$|^127\.0\.0\.1$|\.pages\.dev$|\.workers\.dev$"
# End of fixed values.


def real_hosts(rows: DataFrame, host: str = "host") -> DataFrame:
    """Without rows of development and preview hosts, or of none."""
    return rows.filter(F.col(host).isNotNull() & ~F.col(host).rlike(PREVIEW_HOSTS))


def host_totals(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("sessions", "users", "views")])


def top_channel(channels: DataFrame) -> DataFrame:
    """Each host's channel with most sessions (ties by name), unassigned traffic left out."""
    return channels.filter("channel <> 'Unassigned'").groupBy("host").agg(F.max_by("channel", F.struct("sessions", "channel")).alias("channel"), F.max("sessions").alias("sessions"))


def projects(traffic: DataFrame, channels: DataFrame, edge: DataFrame, days: int = 28) -> DataFrame:
    """One card per host, the busiest week first: trailing sums with their label, views, edge views and top channel."""
    series = traffic.groupBy("host", "d").agg(F.sum("sessions").alias("sessions"))
    cards = trailing(series, days, ["host"], "sessions").join(host_totals(traffic).select("host", "views"), "host")
    cards = cards.join(edge.groupBy("host").agg(F.sum("views").alias("edge_views")), "host", "left").join(top_channel(channels).select("host", "channel"), "host", "left")
    return cards.orderBy(F.desc("last7"), "host")


def feed_rollup(videos: DataFrame, now_ms: int, days: int = 28, top: int = 10) -> DataFrame:
    """One row: uploads in the feed, views, likes, uploads of the last ``days`` days, and the ids of the ``top`` by views."""
    best = videos.orderBy(F.desc(F.coalesce("views", F.lit(0))), "video_id").limit(top)
    ids = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("views", F.lit(0))).alias("v"), "video_id"))), lambda x: x["video_id"].cast("string")), ",").alias("top"))
    sums = videos.agg(F.count("*").alias("in_feed"), F.sum(F.coalesce("views", F.lit(0))).alias("views"), F.sum(F.coalesce("likes", F.lit(0))).alias("likes"), F.count_if(F.col("published_ms") > now_ms - days * 86_400_000).alias("recent"))
    return sums.crossJoin(ids)
