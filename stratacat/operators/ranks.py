"""Ranks, running sums and windows in time that don't need a key, or all rows, in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.durable import cut


def dense_ids(rows: DataFrame, order: list[str], after: int = 0, name: str = "id") -> DataFrame:
    """``rows`` with a number each, without gaps, from ``after`` + 1 on in the given (unique) order: rows are dealt out by range, counted in each part, and each part starts behind the ones before it."""
    part = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per part
    begins = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn("_local", local).join(F.broadcast(begins), "_part").withColumn(name, (F.col("_local") + F.col("_before") + after).cast("long")).drop("_part", "_local", "_before")


def _chain(steps: DataFrame) -> DataFrame:
    """``key, at`` of all that is reached from each key's first place by ``steps`` (``key, at, to``; ``to`` is later), by jumps of doubling length."""
    reached = steps.groupBy("key").agg(F.min("at").alias("at"))
    jumps = [cut(steps.filter("to IS NOT NULL"))]
    while not jumps[-1].isEmpty():
        now = jumps[-1]
        jumps.append(cut(now.join(now.select("key", F.col("at").alias("to"), F.col("to").alias("further")), ["key", "to"]).select("key", "at", F.col("further").alias("to"))))
    for jump in reversed(jumps[:-1]):
        reached = cut(reached.unionByName(reached.join(jump, ["key", "at"]).select("key", F.col("to").alias("at"))))
    return reached


def anchored_windows(uses: DataFrame, length: int) -> DataFrame:
    """``uses`` (``key``, ``at`` a long) with ``start``: windows of ``length`` that begin at a key's first use, and then at its first use at or after the end of the one before.

    Each use points to the first one at or after its own window's end, were it a start; jumps of doubling length along these pointers reach
    all true starts in as many rounds as the logarithm of the number of windows.
    """
    places = uses.select("key", "at").distinct()
    asks = places.select("key", (F.col("at") + length).alias("place"), F.col("at").alias("asked"), F.lit(0).alias("use"))
    both = asks.unionByName(places.select("key", F.col("at").alias("place"), F.lit(None).cast("long").alias("asked"), F.lit(1).alias("use")))
    # read backwards, the last use seen is the first at or after a place
    back = Window.partitionBy("key").orderBy(F.desc("place"), F.desc("use")).rowsBetween(Window.unboundedPreceding, 0)
    steps = both.withColumn("to", F.last(F.when(F.col("use") == 1, F.col("place")), ignorenulls=True).over(back)).filter("use = 0").select("key", F.col("asked").alias("at"), "to")
    starts = _chain(cut(steps)).select("key", "at", F.col("at").alias("start"))
    on = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = places.join(starts, ["key", "at"], "left").withColumn("start", F.last("start", ignorenulls=True).over(on))
    return uses.join(placed, ["key", "at"])


def within_anchored_budget(uses: DataFrame, cost: Column, budget: int, length: int, order: list[str]) -> DataFrame:
    """The uses that fit: of each anchored window the prefix whose running cost stays within the budget. A use that costs more than a whole budget never fits, and opens no window."""
    placed = anchored_windows(uses.withColumn("cost", cost).filter(F.col("cost") <= budget), length)
    w = Window.partitionBy("key", "start").orderBy("at", *order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("spent", F.sum("cost").over(w)).filter(F.col("spent") <= budget)
