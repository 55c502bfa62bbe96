"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule compares a text statistic with a cutoff. The cutoff is chosen per stratum (language) from a fixed ladder. A cutoff
is safe if labelled good documents show, by an exact binomial tail, that at most ``risk`` of good documents would be
rejected. A ladder is tested from its laxest cutoff on and left at the first that is not shown safe, which needs no
correction; over strata and rules the tail must stay under ``delta`` divided by their number (Bonferroni), so all safe cutoffs
hold together with probability 1 - ``delta``. Of the safe ones that is taken which rejects most labelled bad documents, a rejected good one
weighing as ``PRICE`` bad ones (of equals the laxest). A rule without a gain or without a safe cutoff is off in that stratum.

Trials are different labelled documents: rows that repeat a document count once, with the largest statistics of those
that pass the base test.

Defined cases: null and empty texts have zero words and fail the base test; a null lang is a stratum of its
own; rows of documents that repeat each give a row; null and repeated label rows: null ids and null labels are ignored, and a
document with any label 0 is bad; without labels every rule is off; an empty table gives an empty result; a statistic equal to its
cutoff passes; extra columns are ignored. Texts have no length limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Rule: ladder of cutoffs (a document is rejected above the cutoff), strictest first.
LADDERS = {
    "symbols": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],  # symbols per word
    "dup_lines": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],  # repeated lines per line with a word
    "repeat_words": [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5],  # words in repeated 3-word windows
    "long_words": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],  # mean word length
    "upper": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9],  # capitals per word character
}
RISK, DELTA, PRICE = 0.03, 0.05, 5
TAG = "qr_"


def _repeats(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: windows sort by a 64-bit hash, equal neighbours repeat."""

    def covered(ordered):
        twin = F.filter(
            ordered,
            lambda s, k: F.coalesce(s["h"] == F.get(ordered, k - 1)["h"], F.lit(False)) | F.coalesce(s["h"] == F.get(ordered, k + 1)["h"], F.lit(False)),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twin, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))

    def count(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(C.let(ordered, covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(C.let(windows, count))


def with_features(docs: DataFrame) -> DataFrame:
    """Adds the base counts, all named ``qr_...``.

    They pass through an explode of one row, below which no later filter or projection is pushed: each is worked out once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    made = F.struct(
        C.let(C.words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("repeats"))).alias("w"),
        C.let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        F.char_length(text).alias("chars"), without(C.SPACE).alias("word_chars"), without(r"[#*$%&|<>]+").alias("plain"), without(r"[A-Z]+").alias("low"),
    )
    out = docs.select("*", F.explode_outer(F.array(made)).alias(f"{TAG}made"))
    made = lambda name: F.col(f"{TAG}made.{name}")
    counts = {
        "n_words": made("w.n"), "n_repeat_words": made("w.repeats"), "n_lines": made("lines.n"), "n_dup_lines": made("lines.dup"),
        "word_chars": made("word_chars"), "n_symbols": made("chars") - made("plain"), "n_upper": made("chars") - made("low"),
    }
    return out.withColumns({TAG + k: v.cast("long") for k, v in counts.items()}).drop(f"{TAG}made")


def _per(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def with_statistics(featured: DataFrame) -> DataFrame:
    """Adds the rule statistics and ``qr_base_failed``."""
    words, chars = f"{TAG}n_words", f"{TAG}word_chars"
    return featured.withColumns(
        {
            f"{TAG}symbols": _per(f"{TAG}n_symbols", words),
            f"{TAG}dup_lines": _per(f"{TAG}n_dup_lines", f"{TAG}n_lines"),
            f"{TAG}repeat_words": _per(f"{TAG}n_repeat_words", words),
            f"{TAG}long_words": _per(chars, words),
            f"{TAG}upper": _per(f"{TAG}n_upper", chars),
            f"{TAG}base_failed": (F.col(words) < 50) | (100 * F.col(f"{TAG}n_repeat_words") > 50 * F.col(words)),
        }
    )


def _log_tail(n: Column, k: Column, p: float) -> Column:
    """log P(Binomial(n, p) <= k), by adding the exact terms in logarithms."""
    import math

    odds, none = math.log(p) - math.log1p(-p), n * F.lit(math.log1p(-p))

    def step(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), k))
    return F.aggregate(steps, F.struct(none.alias("term"), none.alias("sum")), step, lambda acc: acc["sum"])


def trials(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """``lang, doc_id, good`` and the rule statistics: one row per labelled document (and language) that passes the base test."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    passing = statistics.filter(~F.col(f"{TAG}base_failed")).select("doc_id", "lang", *[f"{TAG}{rule}" for rule in LADDERS])
    return passing.join(known, "doc_id").groupBy("lang", "doc_id", "good").agg(*[F.max(f"{TAG}{rule}").alias(f"{TAG}{rule}") for rule in LADDERS])


def cutoffs(statistics: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, price: float = PRICE) -> DataFrame:
    """``qr_lang`` and one cutoff per rule (null: off)."""
    import math

    tests = {f"{rule}__{i}": F.col(f"{TAG}{rule}") > c for rule, ladder in LADDERS.items() for i, c in enumerate(ladder)}
    good = [F.count_if(F.col("good") & t).alias(name) for name, t in tests.items()]
    bad = [F.count_if(~F.col("good") & t).alias(f"{name}__bad") for name, t in tests.items()]
    counts = C.cut(trials(statistics, labels).groupBy("lang").agg(F.count_if("good").alias("n"), *good, *bad))
    level = counts.select((F.lit(math.log(delta / len(LADDERS))) - F.log(F.count("*").cast("double"))).alias("level")).where("level is not null")

    def best(rule):
        ladder = LADDERS[rule]
        # more false rejections than n * risk can never be safe, which keeps the sums short; a laxer cutoff than a safe one is safe
        lost = lambda i: F.col(f"{rule}__{i}")
        safe = lambda i: F.when(lost(i) > F.col("n") * risk, F.lit(False)).otherwise(_log_tail(F.col("n"), lost(i), risk) <= F.col("level"))
        gains = F.array(*[F.when(safe(i), F.struct((F.col(f"{rule}__{i}__bad") - price * lost(i)).alias("gain"), F.lit(c).alias("cutoff"))) for i, c in enumerate(ladder)])
        top = F.array_max(gains)
        return F.when(top["gain"] > 0, top["cutoff"]).alias(f"{TAG}cut_{rule}")

    return counts.crossJoin(F.broadcast(level)).select(F.col("lang").alias(f"{TAG}lang"), *[best(r) for r in LADDERS])


def judge(statistics: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``qr_rejected_by`` (array of rules) and ``qr_kept``."""
    joined = C.join_sized(statistics, cuts, F.col("lang").eqNullSafe(F.col(f"{TAG}lang")), "left")
    hits = F.array_compact(F.array(*[F.when(F.col(f"{TAG}{r}") > F.col(f"{TAG}cut_{r}"), F.lit(r)) for r in LADDERS]))
    return joined.withColumn(f"{TAG}rejected_by", hits).withColumn(f"{TAG}kept", ~F.col(f"{TAG}base_failed") & (F.size(f"{TAG}rejected_by") == 0))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. The statistics are made twice rather than stored beside the texts."""
    narrow = with_statistics(with_features(docs.select("doc_id", "lang", "text"))).drop("text")
    cuts = C.cut(cutoffs(narrow, labels, **options))
    return judge(with_statistics(with_features(docs)), cuts).filter(f"{TAG}kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = C.cut(with_statistics(with_features(docs)).drop("text"))
    cuts = C.cut(cutoffs(found, C.table(spark, sf_dir, "labels")))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judge(found, cuts).select("doc_id", *[F.col(TAG + c).alias(c) for c in base], F.array_join(f"{TAG}rejected_by", ",").alias("rejected_by"))


def _oracle() -> str:
    import math

    space = r"[\x20\x09-\x0D]+"
    rules = list(LADDERS)
    level = f"{math.log(DELTA / len(LADDERS))!r} - ln((SELECT count(*) FROM c))"
    tests = " UNION ALL ".join(f"SELECT lang, n, '{r}' AS rule, {c} AS cutoff, {r}__{i} AS lost, {r}__{i}__bad AS caught FROM c" for r in rules for i, c in enumerate(LADDERS[r]))
    tail = f"ln(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * {math.log(RISK)!r} + (n - i) * {math.log1p(-RISK)!r})))"
    counts = ", ".join(f"count(*) FILTER (WHERE {'' if good else 'NOT '}good AND {r} > {c}) AS {r}__{i}{'' if good else '__bad'}" for r in rules for i, c in enumerate(LADDERS[r]) for good in (True, False))
    by = "concat_ws(',', " + ", ".join(f"CASE WHEN {r} > cut_{r} THEN '{r}' END" for r in rules) + ")"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents)
, w AS (SELECT *, list_filter(regexp_split_to_array(text, '{space}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d)
, g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM (SELECT rid, i, concat_ws(chr(31), w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)))
, rep AS (SELECT rid, count(DISTINCT k) AS n_rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE times > 1) GROUP BY rid)
, f AS (SELECT w.rid, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{space}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN rep USING (rid))
, s AS (SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_lines, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_words, coalesce(word_chars / nullif(n_words, 0), 0) AS long_words,
  coalesce(n_upper / nullif(word_chars, 0), 0) AS upper, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
, known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1)
, t AS (SELECT lang, doc_id, good, {", ".join(f"max({r}) AS {r}" for r in rules)} FROM s JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY ALL)
, c AS MATERIALIZED (SELECT lang, count(*) FILTER (WHERE good) AS n, {counts} FROM t GROUP BY lang)
, u AS ({tests})
, e AS (SELECT lang, rule, cutoff, any_value(caught) - {PRICE} * any_value(lost) AS gain FROM (SELECT *, unnest(range(0, lost + 1)) AS i FROM u WHERE lost <= n * {RISK}) GROUP BY lang, rule, cutoff HAVING {tail} <= {level})
, best AS (SELECT lang, rule, arg_max(cutoff, (gain, cutoff)) AS cutoff FROM e WHERE gain > 0 GROUP BY lang, rule)
, cuts AS (SELECT c.lang AS cut_lang, {", ".join(f"max(CASE WHEN rule = '{r}' THEN cutoff END) AS cut_{r}" for r in rules)} FROM c LEFT JOIN best ON best.lang IS NOT DISTINCT FROM c.lang GROUP BY c.lang)
, j AS (SELECT *, {by} AS rejected_by FROM s LEFT JOIN cuts ON lang IS NOT DISTINCT FROM cut_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM j"""


ORACLE = _oracle()
