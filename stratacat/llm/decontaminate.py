"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is a few words of a window, kept by a fixed mask; two windows with the same hash of kept words may differ at the
others. Windows of benchmark items are hashed under each mask and joined with the windows of all
documents. A hit fixes how item and document line up; around it the words are compared, and the overlap counts
if at least ``need`` of ``around`` aligned words (all of a shorter item) are the same in any window with the hit.
No such overlap is without a hit (see ``MASKS``), so the seeds lose nothing that the rule accepts.

Items of fewer than ``SPAN`` words have seeds of their own: with c changes allowed, one of c + 1 pieces is unchanged, so their
seeds are all runs of a piece's length. The rule is the same down to ``WHOLE`` words; shorter items are looked for as whole,
unchanged runs, and items of fewer than ``MIN_WORDS`` words, which any text may hold by chance, as texts that consist of just them.

Words are runs without white space, lower-cased. Defined cases: null and empty texts are clean, and items without words match nothing; an
empty benchmark makes everything clean; an empty table gives an empty result; a null doc_id stays null; repeated rows each give a row, repeated items of
one id count once; a place that ties between items counts for each; extra columns are ignored. Texts have no length limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPAN, WHOLE, MIN_WORDS = 13, 8, 5
#: Kept positions of each mask: two blocks of three words at each distance that two of five blocks in a row can have.
#: The rule accepts at most three changes in 16 or 15 words and two in 14 or 13. Three changes leave at least two of the five
#: blocks in 15 words whole, two leave two of the four in 12, and the mask of their distance fits there; masks are looked for at every place.
MASKS = [[0, 1, 2, 3, 4, 5], [3, 4, 5, 9, 10, 11], [0, 1, 2, 9, 10, 11], [0, 1, 2, 12, 13, 14]]
AROUND, NEED = 16, 0.8
#: At most so many benchmark windows, and bytes of them as counted, are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
BROADCAST_BYTES = 32 << 20


def piece(n: int) -> int:
    """The length of the seeds of an item of ``n`` < SPAN words."""
    changes = n - math.ceil(n * NEED - 1e-9)
    return n // (changes + 1) if n >= WHOLE else n


def _hashes(text: Column) -> Column:
    return F.transform(C.words(F.lower(text)), lambda x: F.xxhash64(x))


def _at(words: Column, p: Column, offsets: list[int]) -> Column:
    return F.xxhash64(*[F.get(words, p + o) for o in offsets])


def _seeds(rows: DataFrame, lengths: list[int], *keep: str, masks: bool = True) -> DataFrame:
    """One row per position and mask that fits: ``p`` (of the first kept word), ``seed``. ``w`` has the word hashes."""
    w, p = F.col("w"), F.col("p")
    shifted = [[o - mask[0] for o in mask] for mask in MASKS] if masks else []
    long = [F.when(p + m[-1] < F.size(w), F.xxhash64(F.lit(i), _at(w, p, m))) for i, m in enumerate(shifted)]
    short = [F.when(p + n <= F.size(w), F.xxhash64(F.lit(-n), _at(w, p, list(range(n))))) for n in lengths]
    least = min([*lengths, *[m[-1] + 1 for m in shifted]])
    spread = rows.filter(F.size("w") >= least).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("p"))
    return spread.select(*keep, "w", "p", F.explode(F.array(*long, *short)).alias("seed")).filter(F.col("seed").isNotNull())


def _same() -> Column:
    """A bit for each word of ``around`` that the document has in the same place, the words of the text ``w`` lined up at ``p``."""
    here = lambda k: F.get("w", F.col("p") + (k - AROUND + 1)) == F.get("around", F.lit(k))
    bits = [F.when(here(k), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(2 * AROUND - 1)]
    return sum(bits[1:], bits[0])


def _agrees() -> Column:
    """Whether any window of ``wide`` words that has the hit's first word agrees well enough. Places outside either text never do, so the best window is inside both where one can be."""
    ones = F.call_function("shiftleft", F.lit(1), F.col("wide")) - 1
    best = F.greatest(*[F.bit_count(F.shiftright("same", k).bitwiseAND(ones)) for k in range(AROUND)])
    return best >= F.col("wide") * NEED


def _windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    """``seed, item_id, wide, around``: a row for each seed of each place, all of one fixed size, however long an item is and however many share a seed.

    ``around`` has the words from AROUND - 1 before the place to AROUND - 1 after it, null outside the item.
    """
    parts = [_seeds(items.filter(F.size("w") >= SPAN), [], "item_id"), *[_seeds(items.filter(F.size("w") == n), [piece(n)], "item_id", masks=False) for n in sizes]]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    around = F.array(*[F.get("w", F.col("p") + o) for o in range(1 - AROUND, AROUND)])
    return rows.select("seed", "item_id", F.least(F.size("w"), F.lit(AROUND)).alias("wide"), around.alias("around")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Verified pairs ``doc_id, text_hash, item_id`` (distinct); rows of ``docs`` are told apart by id and text hash."""
    every = benchmark.select("item_id", _hashes(F.col("text")).alias("w"))
    found = sorted(r.n for r in every.filter(F.size("w").between(1, SPAN - 1)).select(F.size("w").alias("n")).distinct().collect())  # fewer than SPAN values
    items, sizes = every.filter(F.size("w") >= MIN_WORDS), [n for n in found if n >= MIN_WORDS]
    lengths = sorted({piece(n) for n in sizes})
    known = C.cut(_windows(items, sizes))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), _hashes(F.col("text")).alias("w"))
    seeds = _seeds(rows, lengths, "doc_id", "text_hash")
    size = known.limit(broadcast_windows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(56 + 8 * F.size("around")), F.lit(0)).alias("bytes")).first()
    if size.n <= broadcast_windows and size.bytes <= BROADCAST_BYTES:
        hits = seeds.join(F.broadcast(known), "seed")
    else:  # only ids travel; the words are fetched again for rows with a hit
        places = seeds.select("doc_id", "text_hash", "p", "seed").join(known, "seed")
        r = rows.withColumnsRenamed({"doc_id": "d2", "text_hash": "h2"}).dropDuplicates(["d2", "h2"])
        hits = places.join(r, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_hash") == F.col("h2")))
    # behind an explode, so that the filter does not repeat the comparison
    compared = hits.select("doc_id", "text_hash", "item_id", "wide", F.explode(F.array(_same())).alias("same"))
    agreed = compared.filter(_agrees()).select("doc_id", "text_hash", "item_id")
    if found and found[0] < MIN_WORDS:
        tiny = C.cut(every.filter(F.size("w").between(1, MIN_WORDS - 1)).distinct())
        agreed = agreed.unionByName(C.join_sized(rows.filter(F.size("w") < MIN_WORDS), tiny, "w", "inner").select("doc_id", "text_hash", "item_id"))
    return agreed.distinct()


def mark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Adds ``dc_items`` (sorted item ids; null or empty: clean) to every row."""
    pairs = overlaps(docs, benchmark, **options)
    found = pairs.groupBy(F.col("doc_id").alias("dc_id"), F.col("text_hash").alias("dc_hash")).agg(F.array_sort(F.collect_set("item_id")).alias("dc_items"))
    same = F.col("doc_id").eqNullSafe(F.col("dc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("dc_hash"))
    return docs.join(found, same, "left").drop("dc_id", "dc_hash")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a verified overlap."""
    pairs = C.cut(overlaps(docs, benchmark, **options).select(F.col("doc_id").alias("dc_id"), F.col("text_hash").alias("dc_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("dc_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("dc_hash"))
    return C.join_sized(docs, pairs, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = overlaps(docs, C.table(spark, sf_dir, "benchmark"))
    found = C.cut(pairs.groupBy(F.col("doc_id").alias("dc_id"), F.col("text_hash").alias("dc_hash")).agg(F.array_sort(F.collect_set("item_id")).alias("dc_items")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("dc_id")) & (F.col("text_hash") == F.col("dc_hash"))
    items = F.coalesce("dc_items", F.array().cast("array<bigint>"))
    return C.join_sized(rows, found, same, "left").select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_join(items, ",").alias("item_ids"))
