"""Keyed changes without row-level writes: each takes the current rows and the new ones, and gives the next version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _new(c: str) -> Column:
    return F.col(f"n_{c}")


#: What becomes of a column of a row that both sides have (old, new).
POLICIES = {
    "new": lambda c: _new(c),
    "old": lambda c: F.col(c),
    "coalesce": lambda c: F.coalesce(_new(c), F.col(c)),
    # the old value unless it is null or an empty text; the type stays
    "keep": lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), _new(c)).otherwise(F.col(c)),
    "max": lambda c: F.greatest(F.col(c), _new(c)),
    "min": lambda c: F.least(F.col(c), _new(c)),
    "sum": lambda c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(_new(c), F.lit(0)),
}


def _sides(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    renamed = new.select(*keys, *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in keys], F.lit(True).alias("has_new"))
    return old.withColumn("has_old", F.lit(True)).join(renamed, keys, "full_outer")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str], frozen: Column | None = None) -> DataFrame:
    """Rows of both by key. Where both have one, each column follows its policy, or stays if ``frozen`` (a test of the old row) holds. Keys are unique on each side."""
    joined = _sides(old, new, keys)
    both = F.col("has_old").isNotNull() & F.col("has_new").isNotNull()
    changes = both if frozen is None else both & ~F.coalesce(frozen, F.lit(False))
    pick = lambda c: F.when(changes, POLICIES[policy.get(c, "new")](c)).when(F.col("has_old").isNull(), _new(c)).otherwise(F.col(c))
    return joined.select(*keys, *[pick(c).alias(c) for c in old.columns if c not in keys])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The old rows, and the first new row of each key that they lack."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("row")).select("row.*")
    return old.unionByName(first.join(old, keys, "left_anti"))


def update_if_unchanged(old: DataFrame, patches: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Applies each patch whose ``expected`` version is the row's (null equals null): the next rows, and the keys that were applied.

    A patch's columns are written as they are, explicit nulls included; columns that it lacks stay, the version too.
    """
    changed = [c for c in patches.columns if c not in (key, "expected")]
    p = patches.select(key, "expected", *[F.col(c).alias(f"n_{c}") for c in changed], F.lit(True).alias("has_patch"))
    joined = old.join(p, key, "left").withColumn("hit", F.coalesce("has_patch", F.lit(False)) & F.col("expected").eqNullSafe(F.col(version)))
    out = joined.select(*[F.when(F.col("hit"), _new(c)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns])
    return out, joined.filter("hit").select(key)


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def merge_rows(rows: DataFrame, survivors: DataFrame, id_col: str, policy: dict[str, str]) -> DataFrame:
    """One row per survivor: its own values by policy (own: its own; fill: its own, else the first merged one's; max, min, sum, any), merged rows in the order of their ids."""
    moved = rows.join(survivors.select(F.col("id").alias(id_col), "survivor"), id_col, "left").withColumn("target", F.coalesce("survivor", id_col))
    own = F.col(id_col) == F.col("target")
    order = F.struct((~own).cast("int"), F.col(id_col))
    made = {
        "own": lambda c: F.max(F.when(own, F.col(c))),
        "fill": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)),
        "max": lambda c: F.max(c),
        "min": lambda c: F.min(c),
        "sum": lambda c: F.sum(c),
        "any": lambda c: F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))),
    }
    return moved.groupBy(F.col("target").alias(id_col)).agg(*[made[p](c).alias(c) for c, p in policy.items()])


def rehomed(rows: DataFrame, survivors: DataFrame, id_col: str) -> DataFrame:
    """Rows under the survivor of their master; ``old_id`` keeps whose they were."""
    moved = rows.join(survivors.select(F.col("id").alias(id_col), "survivor"), id_col, "left")
    return moved.withColumns({"old_id": F.col(id_col), id_col: F.coalesce("survivor", id_col)}).drop("survivor")


def merge_children(rows: DataFrame, survivors: DataFrame, id_col: str, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Child rows of merged masters, one per survivor and key, each column by its policy (max, min, any; filled: the first that is neither null nor empty, the survivor's own before others, else an empty text)."""
    moved = rehomed(rows, survivors, id_col)
    order = F.struct((F.col("old_id") != F.col(id_col)).cast("int"), F.col("old_id"))
    made = {
        "max": lambda c: F.max(c), "min": lambda c: F.min(c), "any": lambda c: F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))),
        "filled": lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", order)), F.lit("")),
    }
    return moved.groupBy(id_col, *keys).agg(*[made[p](c).alias(c) for c, p in policy.items()])
