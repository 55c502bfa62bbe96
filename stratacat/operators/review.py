"""Review queue, coverage, source health, image backlog and work queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacat.durable import cut
from stratacat.functions.text import norm_name

from .grid import LIVE


def review_state() -> Column:
    """The view that a sku belongs to; null for a flag without a kind, which no view selects."""
    return (
        F.when(F.col("dead") == 1, "removed")
        .when(F.col("flag_kind") == "missing", "missing")
        .when(F.col("flag_kind").isNotNull(), "flagged")
        .otherwise(F.col("review_status"))
    )


def state_counts(skus: DataFrame) -> DataFrame:
    return skus.groupBy(review_state().alias("state")).agg(F.count("*").alias("n"))


def stock_bucket() -> Column:
    return F.when(F.col("in_stock") == 1, "in").otherwise("out")


def view(skus: DataFrame, state: str, stock: str = "in", source: int | None = None) -> DataFrame:
    """The skus of one view; the stock choice (in, out, all) only applies to new ones."""
    rows = skus.filter(review_state() == state)
    if state == "new" and stock != "all":
        rows = rows.filter(stock_bucket() == stock)
    return rows if source is None else rows.filter(F.col("source_id") == source)


def source_health(skus: DataFrame, scans: DataFrame) -> DataFrame:
    """Per source: last scan beside live, flagged and removed skus and the oldest check of a live one."""
    live = (F.col("review_status") == "approved") & (F.col("dead") == 0)
    counts = skus.groupBy("source_id").agg(
        F.count_if(live).alias("live"), F.count_if(F.col("flag_kind").isNotNull()).alias("flagged"), F.count_if(F.col("dead") == 1).alias("removed"), F.min(F.when(live, F.col("last_seen"))).alias("oldest_verify")
    )
    return scans.join(counts, "source_id", "full_outer")


def coverage(live: DataFrame) -> DataFrame:
    """How many live masters have a popularity score; scored + unscored = total, nonzero + zero = scored."""
    p = F.col("pop_score")
    return live.agg(F.count("*").alias("total"), F.count_if(p.isNotNull()).alias("scored"), F.count_if(p > 0).alias("nonzero"), F.count_if(p == 0).alias("zero"), F.count_if(p.isNull()).alias("unscored"))


def catalog_page(masters: DataFrame, skus: DataFrame) -> DataFrame:
    """All masters with their number of offers and of approved live offers; masters without offers stay."""
    approved = F.col("review_status") == "approved"
    sums = skus.groupBy("master_id").agg(F.count("*").alias("offers"), F.count_if(approved & LIVE()).alias("live_offers"))
    return masters.join(sums, F.col("id") == F.col("master_id"), "left").withColumns({"offers": F.coalesce("offers", F.lit(0)), "live_offers": F.coalesce("live_offers", F.lit(0))})


def backlog(wanted: list[DataFrame], done: DataFrame) -> DataFrame:
    """Distinct keys of several lists that the ledger doesn't have."""
    keys = wanted[0]
    for more in wanted[1:]:
        keys = keys.union(more)
    return keys.distinct().join(done, keys.columns, "left_anti")


def within_budget(queue: DataFrame, cost: Column, budget: int, order: list, group: str) -> DataFrame:
    """The prefix of each group's queue whose running cost stays within the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return queue.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def _grams(text: Column, sizes: list[int], short: bool = False) -> Column:
    """The distinct parts of the text of these lengths; with ``short``, a text that is shorter is its own."""
    start = lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array(text) if short else F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(start, sizes))))


def attach_suggestions(skus: DataFrame, masters: DataFrame, top: int = 3) -> DataFrame:
    """For each sku the best masters by name: 2 if the normed title holds the whole normed name, else how many of its words (over 2 letters) the title holds; at least 2; later ids first.

    Holding means as a part of the text, also inside a word. Equal titles are answered once. Words of names meet distinct words of titles on one gram of up to
    three letters, the one that fewest title words have, so a title word brings three rows a letter at most, however long it is. A name meets titles on all its words but the one that most names have, since any two of them include another.
    """
    n = masters.select(F.col("id").alias("master_id"), F.coalesce("name_norm", F.lit("")).alias("name"))
    named = n.filter("name <> ''").withColumn("all", F.split("name", " "))
    long = F.filter("all", lambda w: F.char_length(w) > 2)
    named = named.withColumn("long", long).withColumn("keys", F.when(F.size("long") > 0, F.array_distinct("long")).otherwise(F.array_distinct("all")))
    flat = named.select("master_id", F.explode("keys").alias("word"))
    often = flat.groupBy("word").agg(F.count("*").alias("names"))
    # the whole name is held if all its words are, and two words if two are: one of the rarer ones is met either way
    place = F.row_number().over(Window.partitionBy("master_id").orderBy(F.desc("names"), "word"))
    count = F.count("*").over(Window.partitionBy("master_id"))
    rare = flat.join(often, "word").withColumns({"place": place, "n": count}).filter("place > 1 OR n = 1").select("master_id", "word")
    titles = skus.select(norm_name(F.col("title")).alias("t")).distinct()
    words = titles.select("t", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    texts = words.select("w").distinct().filter("w <> ''")
    grams = cut(texts.select("w", F.explode(_grams(F.col("w"), [1, 2, 3])).alias("gram")))
    common = grams.groupBy("gram").agg(F.count("*").alias("texts"))
    asked = often.select("word", F.explode(_grams(F.col("word"), [3], True)).alias("gram")).join(common, "gram", "left")
    # a gram that no title has says that no title holds the word
    asked = asked.groupBy("word").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "gram")).alias("gram"))
    parts = asked.join(grams, "gram").filter(F.contains("w", "word")).select("w", "word")
    held = words.join(parts, "w").select("t", "word").distinct()
    pairs = held.join(rare, "word").select("t", "master_id").distinct().join(named.select("master_id", "name", "long"), "master_id")
    score = F.when(F.contains("t", "name"), 2).otherwise(F.size(F.filter("long", lambda w: F.contains(F.col("t"), w))))
    best = pairs.select("t", "master_id", score.cast("long").alias("score")).filter("score >= 2")
    # a master without a name fits everything
    empty = n.filter("name = ''").orderBy(F.desc("master_id")).limit(top).select("master_id")
    best = best.unionByName(titles.crossJoin(F.broadcast(empty)).select("t", "master_id", F.lit(2).cast("long").alias("score")))
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), F.desc("master_id")))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    return skus.select("sku_key", norm_name(F.col("title")).alias("t")).join(ranked, "t").select("sku_key", "master_id", "score", "rank")
