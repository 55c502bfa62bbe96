"""Decisions on catalog rows: each is a keyed update that gives the next version of a table, with rows for the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacat.functions.classify import power
from stratacat.functions.text import canonical_url, host_of, norm_name
from stratacat.operators.grid import resolve_landing
from stratacat.operators.popularity import scores
from stratacat.operators.upsert import delete_keys, insert_ignore, upsert

#: What each decision sets; a column that is not named stays. ``done_at`` stands for the time of the decision, ``reason`` for its text.
_NONE = None
EFFECTS: dict[str, dict[str, object]] = {
    "reject": {"review_status": "rejected", "reject_reason": "reason", "reviewed_at": "done_at"},
    "restore": {"review_status": "new", "reject_reason": _NONE, "reviewed_at": _NONE},
    "unflag": {"flag_kind": _NONE, "last_checked": _NONE},
    "confirm-gone": {"dead": 1, "flag_kind": _NONE, "reviewed_at": "done_at"},
    "restore-live": {"dead": 0, "misses": 0, "flag_kind": _NONE, "last_checked": _NONE},
    "unapprove": {"review_status": "new", "reviewed_at": _NONE, "flag_kind": _NONE},
    "attach": {"review_status": "approved", "reviewed_at": "done_at"},
}


def _value(column: str, value: object, kind: str) -> Column:
    if column == "reviewed_at" and value == "done_at":
        return F.col("d_done_at").cast(kind)
    if column == "reject_reason" and value == "reason":
        return F.coalesce("d_reason", F.lit("junk"))
    return F.lit(value).cast(kind)


def decide(skus: DataFrame, decisions: DataFrame, effects: dict[str, dict[str, object]] = EFFECTS) -> DataFrame:
    """The skus after at most one decision each (``sku_key, action, reason, done_at``); an unknown action changes nothing."""
    d = decisions.select("sku_key", *[F.col(c).alias(f"d_{c}") for c in ("action", "reason", "done_at")])
    joined = skus.join(d, "sku_key", "left")

    def following(c: str, kind: str) -> Column:
        cases = [F.when(F.col("d_action") == action, _value(c, sets[c], kind)) for action, sets in effects.items() if c in sets]
        touched = F.coalesce(F.col("d_action").isin([a for a, sets in effects.items() if c in sets]), F.lit(False))
        return F.when(touched, F.coalesce(*cases)).otherwise(F.col(c)).alias(c) if cases else F.col(c)

    return joined.select(*[following(c, kind) for c, kind in skus.dtypes])


def audit_rows(decisions: DataFrame, entity: str, key: str, actor: str, *details: str) -> DataFrame:
    """``done_at, actor, action, entity, entity_id, detail`` (JSON; nulls left out): what a log appends."""
    detail = F.to_json(F.struct(*details)) if details else F.lit("{}")
    return decisions.select("done_at", F.lit(actor).alias("actor"), "action", F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), detail.alias("detail"))


def attach(skus: DataFrame, offers: DataFrame, requests: DataFrame, masters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approves skus onto existing masters: the next skus, the next offers, and one observation of the price at approval each.

    ``requests``: sku_key, master_id, config, pack_qty, done_at. Requests for unknown masters do nothing; an offer that a sku has already stays.
    """
    known = requests.join(masters.select(F.col("id").alias("master_id")), "master_id", "left_semi")
    made = known.select("sku_key", "master_id", F.coalesce("config", F.lit("kit")).alias("config"), F.coalesce("pack_qty", F.lit(1)).alias("pack_qty"), F.col("done_at").alias("created_at"))
    decisions = known.groupBy("sku_key").agg(F.max("done_at").alias("done_at")).select("sku_key", F.lit("attach").alias("action"), F.lit(None).cast("string").alias("reason"), "done_at")
    seen = decisions.select("sku_key", "done_at").join(skus.select("sku_key", "price_inr", "in_stock"), "sku_key")
    return decide(skus, decisions), insert_ignore(offers, made, ["sku_key", "master_id"], [F.col("created_at"), F.col("config")]), seen


def unapprove(skus: DataFrame, offers: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back to new: the next skus, and the offers without those of the skus."""
    return decide(skus, decisions), delete_keys(offers, decisions, ["sku_key"])


def approve_new(requests: DataFrame, masters: DataFrame, categories: DataFrame) -> DataFrame:
    """Requests (``sku_key, category_id, slug, brand, name, done_at``) with a ``verdict``: created, or why not.

    invalid: no brand, name or proper slug. reserved: the slug names a landing page or the browse page. category: unknown or none. conflict: the slug, or brand and name,
    exist in the category, or an earlier request of the batch has taken them.
    """
    slug = F.coalesce(F.col("slug"), F.lit(""))
    proper = (F.coalesce("brand", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "") & slug.rlike("^[a-z0-9-]{3,60}$")
    r = requests.withColumns({"brand_norm": norm_name(F.col("brand")), "name_norm": norm_name(F.col("name"))})
    r = r.join(categories.select("category_id").distinct().withColumn("known", F.lit(True)), "category_id", "left")
    state = F.when(~proper, "invalid").when((slug == "browse") | resolve_landing(slug).isNotNull(), "reserved").when(F.col("known").isNull(), "category")
    r = r.withColumn("state", state)
    by_slug = masters.select("category_id", "slug").distinct().withColumn("slug_held", F.lit(True))
    by_name = masters.select("category_id", "brand_norm", "name_norm").distinct().withColumn("name_held", F.lit(True))
    r = r.join(by_slug, ["category_id", "slug"], "left").join(by_name, ["category_id", "brand_norm", "name_norm"], "left")
    free = F.col("state").isNull() & F.col("slug_held").isNull() & F.col("name_held").isNull()
    order = F.when(free, F.struct("done_at", "sku_key"))
    first = lambda *keys: r.groupBy(*keys).agg(F.min(order).alias("first_" + keys[-1]))
    r = r.join(first("category_id", "slug"), ["category_id", "slug"]).join(first("category_id", "brand_norm", "name_norm"), ["category_id", "brand_norm", "name_norm"])
    own = F.struct("done_at", "sku_key")
    wins = free & (own == F.col("first_slug")) & (own == F.col("first_name_norm"))
    return r.select("sku_key", "category_id", "slug", "brand_norm", "name_norm", F.coalesce("state", F.when(wins, "created").otherwise("conflict")).alias("verdict"))


def update_masters(masters: DataFrame, patches: DataFrame, required: DataFrame) -> DataFrame:
    """Masters after partial patches: given values replace, names are normed again, a new brand clears the anomaly.

    ``patches``: id, brand, name, specs (JSON), status, done_at. ``required``: category_id and ``keys`` that a published master's specs need. A patch to ``ready`` without them
    does nothing; the column ``missing`` names the keys.
    """
    p = patches.select("id", *[F.col(c).alias(f"p_{c}") for c in ("brand", "name", "specs", "status", "done_at")])
    joined = masters.join(p, "id", "left").join(required, "category_id", "left")
    specs = F.coalesce("p_specs", "specs", F.lit("{}"))
    gaps = F.filter(F.coalesce("keys", F.array().cast("array<string>")), lambda k: F.coalesce(F.try_element_at(F.from_json(specs, "map<string,string>"), k), F.lit("")) == "")
    blocked = F.coalesce(F.col("p_status") == "ready", F.lit(False)) & (F.size(gaps) > 0)
    takes = F.col("p_done_at").isNotNull() & ~blocked
    new = lambda c, v=None: F.when(takes, F.coalesce(v if v is not None else F.col(f"p_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    normed = lambda c: F.when(F.coalesce(F.col(f"p_{c}"), F.lit("")) != "", norm_name(F.col(f"p_{c}")))
    made = {
        "brand": new("brand"), "name": new("name"), "brand_norm": new("brand_norm", normed("brand")), "name_norm": new("name_norm", normed("name")), "specs": new("specs"), "status": new("status"),
        "anomaly": F.when(takes & F.col("p_brand").isNotNull(), F.lit(None)).otherwise(F.col("anomaly")).alias("anomaly"), "updated_at": new("updated_at", F.col("p_done_at")),
    }
    return joined.select(*[made.get(c, F.col(c)) for c in masters.columns], F.when(blocked, F.array_join(gaps, ",")).alias("missing"))


def add_sources(sources: DataFrame, urls: DataFrame, mappings: DataFrame, requests: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registers feed addresses: the next sources (platform and time renewed), addresses and category mappings (what exists stays).

    ``requests``: raw, platform, categories (array), done_at. An address that is no URL, or without a known category, does nothing. A source's id is its host's first label.
    """
    known = categories.select("category_id").distinct()
    canon = canonical_url(F.col("raw"))
    r = requests.withColumns({"url": canon, "host": host_of(canon)}).filter("url IS NOT NULL")
    r = r.withColumn("source_id", F.regexp_replace(F.substring_index("host", ".", 1), "[^a-z0-9-]", ""))
    pairs = r.select("source_id", "host", "url", "raw", "platform", "done_at", F.explode("categories").alias("category_id")).join(known, "category_id", "left_semi").distinct()
    latest = pairs.groupBy("source_id").agg(F.max_by(F.struct("host", "platform", "done_at"), F.struct("done_at", "url")).alias("x"))
    fresh = latest.select("source_id", F.col("x.host").alias("name"), F.col("x.platform").alias("platform"), F.col("x.done_at").alias("created_at"), F.col("x.done_at").alias("updated_at"))
    next_sources = upsert(sources, fresh, ["source_id"], {"name": "old", "platform": "new", "created_at": "old", "updated_at": "new"})
    next_urls = insert_ignore(urls, pairs.select("url", "source_id", F.lit("active").alias("status"), F.col("done_at").alias("created_at")), ["url"], [F.col("created_at"), F.col("source_id")])
    next_mappings = insert_ignore(mappings, pairs.select("url", "category_id"), ["url", "category_id"], [F.col("url")])
    return next_sources, next_urls, next_mappings


def set_status(rows: DataFrame, changes: DataFrame, key: str, column: str = "status") -> DataFrame:
    """``column`` renewed where a change (``key``, ``value``) names the row."""
    c = changes.select(key, F.col("value").alias("n_value"), F.lit(True).alias("n_hit"))
    return rows.join(c, key, "left").withColumn(column, F.when(F.col("n_hit"), F.col("n_value")).otherwise(F.col(column))).drop("n_value", "n_hit")


def flag_videos(videos: DataFrame, flags: DataFrame) -> DataFrame:
    """Videos with ``pinned`` or ``excluded`` set. ``flags``: master_id, video_id, field, value; other fields do nothing."""
    wide = flags.groupBy("master_id", "video_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value").cast("int"))).alias(f"n_{f}") for f in ("pinned", "excluded")])
    out = videos.join(wide, ["master_id", "video_id"], "left")
    return out.withColumns({f: F.coalesce(f"n_{f}", f) for f in ("pinned", "excluded")}).drop("n_pinned", "n_excluded")


def boost(masters: DataFrame, boosts: DataFrame) -> DataFrame:
    """Masters with the owner's factor from 0.5 to 2 (1 clears it); values outside do nothing."""
    b = boosts.filter(F.col("boost").between(0.5, 2.0)).select("id", F.col("boost").alias("n_boost"))
    return masters.join(b, "id", "left").withColumn("pop_boost", F.when(F.col("n_boost").isNull(), F.col("pop_boost")).when(F.col("n_boost") != 1.0, F.col("n_boost"))).drop("n_boost")


def rederive_power(masters: DataFrame, touched: DataFrame, offers: DataFrame, titles: DataFrame) -> DataFrame:
    """Masters with the power of those ``touched`` (``id``) worked out again from the titles of all their offers: gas if one names an engine."""
    sold = offers.join(touched.select(F.col("id").alias("master_id")).distinct(), "master_id", "left_semi").join(titles.select("sku_key", "title"), "sku_key")
    gas = sold.groupBy(F.col("master_id").alias("id")).agg(F.max((power(F.col("title")) == "gas").cast("int")).alias("gas"))
    named = touched.select("id").distinct().join(gas, "id", "left").select("id", F.when(F.col("gas") == 1, "gas").otherwise("electric").alias("n_power"))
    return masters.join(named, "id", "left").withColumn("power", F.coalesce("n_power", "power")).drop("n_power")


def rescored(masters: DataFrame, touched: DataFrame, skus: DataFrame, videos: DataFrame, now_ms: int) -> DataFrame:
    """``id, view_sum, video_count, raw, score`` of the masters that a curation has touched (``id``), from their videos, sellers, stock and boost as they are now. ``masters``: id, pop_boost."""
    wanted = masters.join(touched.select("id").distinct(), "id", "left_semi")
    live = ((F.col("in_stock") == 1) & (F.col("dead") == 0)).cast("int")
    sold = skus.filter("review_status = 'approved'").groupBy(F.col("master_id").alias("id")).agg(F.countDistinct("source_id").alias("sellers"), F.max(F.coalesce(live, F.lit(0))).alias("any_stock"))
    rows = wanted.join(sold, "id", "left").select("id", F.coalesce("sellers", F.lit(0)).alias("sellers"), F.coalesce("any_stock", F.lit(0)).alias("any_stock"), F.col("pop_boost").alias("boost"))
    return scores(rows, videos.withColumn("excluded", F.col("excluded") == 1), now_ms)


def reject_merges(candidates: DataFrame, pairs: DataFrame, at: int) -> DataFrame:
    """Merge candidates with the pairs rejected; unknown pairs are added with score 0. A pair has its smaller id first."""
    new = pairs.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    rows = new.withColumns({"score": F.lit(0.0), "reason": F.lit("owner: not duplicates"), "status": F.lit("rejected"), "decided_at": F.lit(at).cast("bigint")})
    return upsert(candidates, rows, ["a_id", "b_id"], {"score": "old", "reason": "old", "status": "new", "decided_at": "new"})


def decide_matches(matches: DataFrame, candidates: DataFrame, decisions: DataFrame, actor: str) -> DataFrame:
    """Maker matches after decisions (``master_id, decision, product_id, done_at``), with ``applied``.

    accept takes the score, agreement, tier and reason of a candidate, or keeps those of the saved accepted mapping to the same product; any other product is
    not applied. reject and reopen set the status and who decided when.
    """
    d = decisions.select("master_id", F.col("decision").alias("d"), F.col("product_id").alias("d_product"), F.col("done_at").alias("d_at"))
    c = candidates.select("master_id", F.col("product_id").alias("d_product"), *[F.col(x).alias(f"c_{x}") for x in ("score", "span_agree", "tier", "reason")], F.lit(True).alias("c_hit"))
    j = matches.join(d, "master_id", "left").join(c, ["master_id", "d_product"], "left")
    saved = (F.col("d_product") == F.col("product_id")) & (F.col("status") == "accepted") & F.col("decided_at").isNotNull()
    accept = F.coalesce((F.col("d") == "accept") & (F.col("c_hit") | saved), F.lit(False))
    reject, reopen = F.coalesce(F.col("d") == "reject", F.lit(False)), F.coalesce(F.col("d") == "reopen", F.lit(False))
    hit = accept & F.coalesce("c_hit", F.lit(False))
    take = lambda c, v: F.when(hit, F.col(v)).otherwise(F.col(c)).alias(c)
    made = {
        "product_id": F.when(accept, F.col("d_product")).otherwise(F.col("product_id")).alias("product_id"), "score": take("score", "c_score"), "span_agree": take("span_agree", "c_span_agree"), "tier": take("tier", "c_tier"), "note": take("note", "c_reason"),
        "status": F.when(accept, "accepted").when(reject, "rejected").when(reopen, "pending").otherwise(F.col("status")).alias("status"),
        "decided_by": F.when(accept | reject, actor).when(reopen, F.lit(None)).otherwise(F.col("decided_by")).alias("decided_by"),
        "decided_at": F.when(accept | reject, F.col("d_at")).when(reopen, F.lit(None)).otherwise(F.col("decided_at")).alias("decided_at"),
    }
    return j.select(*[made.get(c, F.col(c)) for c in matches.columns], (accept | reject | reopen).alias("applied"))


def restamp(masters: DataFrame, anomalies: DataFrame) -> DataFrame:
    """All anomalies cleared, then the current set (``id, kind, detail``) stamped as JSON."""
    a = anomalies.select("id", F.to_json(F.struct("kind", "detail")).alias("n_anomaly"))
    return masters.join(a, "id", "left").withColumn("anomaly", F.col("n_anomaly")).drop("n_anomaly")
