"""Catalog reads over masters and their offers: grid, counts, facets, landing pages, similar models, offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The role vocabulary, in order of display.
ROLES = ["Trainer", "Sport / Park Flyer", "Aerobatic / 3D", "Warbird", "Jet / EDF", "Glider / Sailplane", "FPV / Flying Wing", "Scale Civilian", "Airliner"]
#: Landing page names of roles.
ROLE_PAGES = {
    "warbirds": "Warbird", "jets": "Jet / EDF", "fpv": "FPV / Flying Wing", "trainers": "Trainer", "gliders": "Glider / Sailplane",
    "scale-planes": "Scale Civilian", "aerobatic": "Aerobatic / 3D", "sport-planes": "Sport / Park Flyer", "airliners": "Airliner",
}
POWER_PAGES = {"electric": "electric", "nitro": "gas"}
#: What sellers write in titles of used items.
USED_PHRASES = ["pre-owned", "pre owned", "preowned", "sparingly used", "(used)", "refurbished"]


def LIVE() -> Column:  # noqa: N802
    """In stock and not gone; unknown stock is not in stock."""
    return (F.coalesce(F.col("in_stock"), F.lit(0)) == 1) & (F.col("dead") == 0)



def used_title(title: Column) -> Column:
    low = F.lower(title)
    test = low.contains(USED_PHRASES[0])
    for phrase in USED_PHRASES[1:]:
        test = test | low.contains(phrase)
    return test


def tags(column: str = "role_tags") -> Column:
    """The tags of a JSON array in text; none if it isn't one."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def live_masters(masters: DataFrame, skus: DataFrame) -> DataFrame:
    """Ready masters with an approved offer in stock, with the aggregates of all approved offers.

    The offers are summed per master before the join, so only one row per master meets the master table.
    """
    live = LIVE()
    offers = (
        skus.filter(F.col("review_status") == "approved")
        .groupBy("master_id")
        .agg(
            F.countDistinct("source_id").alias("sellers"),
            F.min(F.when(live & (F.col("pack_qty") == 1), F.col("price_inr"))).alias("min_price"),
            F.max(F.when(live & used_title(F.col("title")), 1).otherwise(0)).alias("preowned_stock"),
            F.max(F.when(live & ~used_title(F.col("title")), 1).otherwise(0)).alias("new_stock"),
            F.max(F.when(live, 1).otherwise(0)).alias("any_stock"),
            F.max("last_seen").alias("last_seen"),
        )
        .filter(F.col("any_stock") == 1)
    )
    return masters.filter(F.col("status") == "ready").join(offers, F.col("id") == F.col("master_id")).drop("master_id")


def size_of(span: Column) -> Column:
    return F.when(F.coalesce(span, F.lit(0)) == 0, "").when(span < 1000, "small").when(span <= 1500, "medium").otherwise("large")


#: Sort orders of the paged grid; each ends in the id, so pages never overlap.
ORDERS = {
    "price-desc": lambda: [F.desc_nulls_last("min_price"), F.asc("id")],
    "price-asc": lambda: [F.asc_nulls_last("min_price"), F.asc("id")],
    "span-desc": lambda: [F.desc_nulls_last(F.nullif("span_mm", F.lit(0))), F.asc_nulls_last("min_price"), F.asc("id")],
    "span-asc": lambda: [F.asc_nulls_last(F.nullif("span_mm", F.lit(0))), F.asc_nulls_last("min_price"), F.asc("id")],
    "popular": lambda: [F.desc(F.coalesce("pop_score", F.lit(-1.0))), F.desc(F.coalesce("min_price", F.lit(-1))), F.asc("id")],
    "name": lambda: [F.asc(F.lower("name")), F.asc("name"), F.asc("id")],
}


def page(rows: DataFrame, order: str, number: int, size: int) -> DataFrame:
    return rows.orderBy(*ORDERS[order]()).offset((number - 1) * size).limit(size)


def power_of() -> Column:
    return F.coalesce(F.col("power"), F.lit("electric"))


def power_counts(live: DataFrame) -> DataFrame:
    return live.groupBy(power_of().alias("power")).agg(F.count("*").alias("n"))


def facet_counts(live: DataFrame, roles: list[str], sizes: list[str], condition: str) -> DataFrame:
    """``facet, value, n``: each facet's counts under the selections of the other facets, from one pass."""
    role = F.lit(True) if not roles else F.arrays_overlap(tags(), F.array(*map(F.lit, roles)))
    size = F.lit(True) if not sizes else size_of(F.col("span_mm")).isin(sizes)
    cond = F.lit(True) if condition == "all" else F.col(f"{'new' if condition == 'new' else 'preowned'}_stock") == 1
    rows = live.select(
        F.array_intersect(tags(), F.array(*map(F.lit, ROLES))).alias("t"), size_of(F.col("span_mm")).alias("s"), F.col("new_stock") == 1, role.alias("r_ok"), size.alias("s_ok"), cond.alias("c_ok"), "new_stock", "preowned_stock"
    )
    hits = F.concat(
        F.when(F.col("s_ok") & F.col("c_ok"), F.transform("t", lambda x: F.struct(F.lit("role").alias("facet"), x.alias("value")))).otherwise(F.array()),
        F.when(F.col("r_ok") & F.col("c_ok") & (F.col("s") != ""), F.array(F.struct(F.lit("size").alias("facet"), F.col("s").alias("value")))).otherwise(F.array()),
        F.when(F.col("r_ok") & F.col("s_ok") & (F.col("new_stock") == 1), F.array(F.struct(F.lit("condition").alias("facet"), F.lit("new").alias("value")))).otherwise(F.array()),
        F.when(F.col("r_ok") & F.col("s_ok") & (F.col("preowned_stock") == 1), F.array(F.struct(F.lit("condition").alias("facet"), F.lit("preowned").alias("value")))).otherwise(F.array()),
    )
    return rows.select(F.explode(hits).alias("h")).groupBy("h.facet", "h.value").agg(F.count("*").alias("n"))


def landings(live: DataFrame, least: int = 3) -> DataFrame:
    """``slug, n``: landing pages with at least ``least`` live masters, for roles, powers and both."""
    power = F.create_map(*[F.lit(x) for slug, p in POWER_PAGES.items() for x in (p, slug)])
    role = F.create_map(*[F.lit(x) for slug, r in ROLE_PAGES.items() for x in (r, slug)])
    named = live.select(F.array_distinct(F.array_compact(F.transform(tags(), lambda t: F.try_element_at(role, t)))).alias("roles"), F.try_element_at(power, power_of()).alias("p"))
    slugs = F.concat("roles", F.array_compact(F.array("p")), F.when(F.col("p").isNotNull(), F.transform("roles", lambda r: F.concat_ws("-", "p", r))).otherwise(F.array()))
    return named.select(F.explode(slugs).alias("slug")).groupBy("slug").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def resolve_landing(slug: Column) -> Column:
    """A struct of power and role for a landing name; null if it names none."""
    known = F.create_map(*[F.lit(x) for s, r in ROLE_PAGES.items() for x in (s, r)])
    first = F.regexp_extract(slug, "^(electric|nitro|gas)-(.+)$", 1)
    rest = F.try_element_at(known, F.regexp_extract(slug, "^(electric|nitro|gas)-(.+)$", 2))
    power = F.when(first == "electric", "electric").otherwise("gas")
    return (
        F.when(F.try_element_at(known, slug).isNotNull(), F.struct(F.lit("all").alias("power"), F.try_element_at(known, slug).alias("role")))
        .when(slug.isin("electric", "nitro", "gas"), F.struct(F.when(slug == "electric", "electric").otherwise("gas").alias("power"), F.lit(None).cast("string").alias("role")))
        .when(rest.isNotNull(), F.struct(power.alias("power"), rest.alias("role")))
    )


def similar(live: DataFrame, seeds: DataFrame, top: int = 8) -> DataFrame:
    """For each seed the ``top`` live masters of its category with a shared tag: most shared, then nearest span, then id.

    Masters of one category, tag set and span differ by id only, so of each such class the first ``top`` + 1 ids are enough; they are cut before any
    shuffle. Seeds of one class share their list. A class of seeds meets, per tag set, the ``top`` + 1 spans next to its own on either side, by their
    places in the order of spans. What is joined grows with classes, not with pairs.
    """
    many = top + 1
    key = F.array_sort(F.array_distinct(tags()))
    classed = lambda df: df.select("category_id", "id", key.alias("tags"), F.coalesce("span_mm", F.lit(0)).alias("span")).filter(F.size("tags") > 0).withColumn("set", F.to_json("tags"))
    per_class = F.row_number().over(Window.partitionBy("category_id", "set", "span").orderBy("id"))
    near = classed(live).withColumn("n", per_class).filter(F.col("n") <= many).drop("n")
    classes = near.select("category_id", "set", "tags", "span").distinct()
    places = classes.withColumn("place", F.row_number().over(Window.partitionBy("category_id", "set").orderBy("span")))
    wanted = classed(seeds)
    asks = wanted.select("category_id", F.col("set").alias("own"), F.col("tags").alias("own_tags"), "span").distinct()
    sets = classes.select("category_id", "set", "tags").distinct()
    shared = asks.select("category_id", "own", "own_tags").distinct().join(sets, "category_id").withColumn("shared", F.size(F.array_intersect("own_tags", "tags"))).filter("shared > 0").select("category_id", "own", "set", "shared")
    asks = asks.drop("own_tags").join(shared, ["category_id", "own"]).withColumn("known", F.lit(0))
    marks = places.select("category_id", "set", "span", F.lit(1).alias("known"))
    below = F.sum("known").over(Window.partitionBy("category_id", "set").orderBy("span").rangeBetween(Window.unboundedPreceding, -1))
    at = asks.unionByName(marks, allowMissingColumns=True).withColumn("below", F.coalesce(below, F.lit(0))).filter("own IS NOT NULL")
    steps = at.select("category_id", "own", F.col("span").alias("own_span"), "set", "shared", F.explode(F.sequence(F.col("below") - top, F.col("below") + many)).alias("place"))
    met = steps.join(places.select("category_id", "set", "place", "span"), ["category_id", "set", "place"]).join(near.select("category_id", "set", "span", F.col("id").alias("other_id")), ["category_id", "set", "span"])
    order = Window.partitionBy("category_id", "own", "own_span").orderBy(F.desc("shared"), "dspan", "other_id")
    lists = met.withColumn("dspan", F.abs(F.col("own_span") - F.col("span"))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= many)
    lists = lists.select("category_id", F.col("own").alias("set"), F.col("own_span").alias("span"), "other_id", F.col("shared").cast("long").alias("shared"), "dspan")
    found = wanted.select("category_id", "set", "span", F.col("id").alias("seed_id")).join(lists, ["category_id", "set", "span"]).filter("seed_id <> other_id")
    rank = F.row_number().over(Window.partitionBy("seed_id").orderBy(F.desc("shared"), "dspan", "other_id"))
    return found.select("seed_id", "other_id", "shared", "dspan").withColumn("rank", rank).filter(F.col("rank") <= top)


def browse(live: DataFrame) -> DataFrame:
    """``role, n, place``: live masters by their first tag in the order of the vocabulary, those without a tag last under Other; other first tags have no heading."""
    first = F.coalesce(F.nullif(F.get(tags(), F.lit(0)), F.lit("")), F.lit("Other"))
    headings = [*ROLES, "Other"]
    counts = live.groupBy(first.alias("role")).agg(F.count("*").alias("n"))
    return counts.filter(F.col("role").isin(headings)).withColumn("place", F.array_position(F.array(*map(F.lit, headings)), F.col("role")))


def offer_summary(masters: DataFrame, skus: DataFrame) -> DataFrame:
    """Per ready master: configs, lowest prices, highest price, offers and availability over its approved offers.

    The lowest live price is that of single new items, else of any live offer; without one, the lowest ever seen.
    """
    live, priced = LIVE(), F.nullif("price_inr", F.lit(0))
    headline = live & (F.col("pack_qty") == 1) & ~used_title(F.col("title"))
    sums = (
        skus.filter(F.col("review_status") == "approved")
        .groupBy("master_id")
        .agg(
            F.array_join(F.sort_array(F.collect_set("config")), ",").alias("configs"),
            F.min(F.when(headline, priced)).alias("head"),
            F.min(F.when(live, priced)).alias("live_low"),
            F.min(priced).alias("seen_low"),
            F.max(F.when(live, priced)).alias("live_high"),
            F.max(priced).alias("seen_high"),
            F.count_if(live).alias("n_live"),
            F.count("*").alias("n_all"),
        )
    )
    low = F.coalesce("head", "live_low", "seen_low")
    high = F.coalesce(F.when(F.col("n_live") > 0, F.col("live_high")).otherwise(F.col("seen_high")), low)
    return masters.filter("status = 'ready'").join(sums, F.col("id") == F.col("master_id")).select(
        "id", "configs", low.alias("low_price"), high.alias("high_price"),
        F.when(F.col("n_live") > 0, F.col("n_live")).otherwise(F.col("n_all")).alias("offer_count"),
        F.when(F.col("n_live") > 0, "InStock").otherwise("OutOfStock").alias("availability"),
    )
