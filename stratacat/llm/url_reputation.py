"""URL filtering by empirical-Bayes host reputation, in DataFrame functions only.

Labelled pages are counted per host; a page is bad if a label calls it of low quality (0) or toxic (1). The bad rate of each level
gets a beta prior from the level above: everything -> suffix -> registered domain -> host. The strength of a prior is
fitted by moments: the more the children of a level differ beyond chance, the weaker it is. A host is blocked when
the lower bound of its posterior bad rate (``z`` standard deviations below the mean, so that the rate lies above it with about the
probability of ``SURE``) passes ``times`` the bad rate of all labelled pages: that sure it is that the host is
worse than the web at large. Hosts, domains and suffixes without labels inherit the posterior of the level above.

Fixed path rules come first; of those that fit, the longest wins (two rules of one length that fit one url are the same rule).

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed;
pages without labels still get a verdict; repeated page rows each give a row, and count once in the reputations;
a page with several labels is bad if any calls it so; null labels and ids are ignored; without labels no host is blocked; an empty table
gives an empty result; extra columns are ignored. Urls have no length limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Second-level labels under which names are registered as if under a suffix.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Blocked above so many times the overall bad rate, with probability SURE (of the normal distribution: Z deviations).
TIMES, SURE, Z = 1.0, 0.8, 0.8416


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(C.lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), h + p, v) for h, p, v in ordered]
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r, _ in fits]), F.coalesce(*[F.when(c, F.lit(v)) for c, _, v in fits])


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``suffix`` to rows with ``host``; ports and user names don't count."""
    bare = F.regexp_replace(F.regexp_replace(F.col("host"), r"^.*@", ""), r":[0-9]*$", "")
    parts = F.split(bare, r"\.")
    deep = (F.size(parts) >= 3) & (F.char_length(F.element_at(parts, -1)) == 2) & F.get(parts, F.size(parts) - 2).isin(SECOND_LEVEL)
    wide = F.when(deep, 3).otherwise(2)
    domain = F.array_join(F.slice(parts, F.greatest(F.size(parts) - wide + 1, F.lit(1)), wide), ".")
    suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - wide + 2, F.lit(1)), wide - 1), ".")
    address = bare.rlike(r"^[0-9.]+$|^\[")
    return hosts.withColumn("domain", F.when(address, bare).otherwise(domain)).withColumn("suffix", F.when(address, F.lit("")).otherwise(suffix))


def _prior(counts: DataFrame, parents: DataFrame, parent: list[str]) -> DataFrame:
    """Posterior of each ``level``: ``alpha`` and ``beta`` from its own counts and its parent's posterior mean.

    Strength by moments, pooled over the level: with s = sum n, the spread of rates beyond chance is
    rho = (sum (bad - n m)^2 / (m (1 - m)) - s) / sum n (n - 1), and the prior weighs as 1 / rho - 1 pages, from 2 to 1000.
    """
    joined = counts.join(parents, parent, "left") if parent else counts.crossJoin(F.broadcast(parents))
    m = F.greatest(F.least(F.col("mean"), F.lit(0.999)), F.lit(0.001))
    extra = F.sum(F.pow(F.col("bad") - F.col("n") * m, 2) / (m * (1 - m))) - F.sum("n")
    rho = F.greatest(F.least(extra / F.sum(F.col("n") * (F.col("n") - 1)), F.lit(1 / 3)), F.lit(1 / 1001))
    strength = joined.filter("n > 1").agg(F.coalesce(rho, F.lit(1 / 3)).alias("rho")).select((1 / F.col("rho") - 1).alias("weight"))
    scored = joined.crossJoin(F.broadcast(strength)).withColumns({"alpha": m * F.col("weight") + F.col("bad"), "beta": (1 - m) * F.col("weight") + F.col("n") - F.col("bad")})
    return scored.drop("mean", "weight").withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def reputation(pages: DataFrame, labels: DataFrame, z: float = Z) -> DataFrame:
    """``host, n_labelled, n_bad, bad_rate, bad_low, overall`` for every host of ``pages`` (``page_id, host``). Each level is worked out once and written."""
    toxic = F.coalesce(F.max("toxic") == 1, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    outcome = known.groupBy(F.col("doc_id").alias("page_id")).agg(((F.min("quality") == 0) | toxic).cast("long").alias("is_bad"))
    seen = pages.groupBy("page_id", "host").agg(F.lit(1).alias("one")).join(outcome, "page_id", "left")
    hosts = C.cut(with_levels(seen.groupBy("host").agg(F.count("is_bad").alias("n"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))))
    domains = C.cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = C.cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    everything = C.cut(suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1)).alias("mean")))
    by_suffix = C.cut(_prior(suffixes, everything, []).select("suffix", "mean"))
    by_domain = C.cut(_prior(domains, by_suffix, ["suffix"]).select("domain", "mean"))
    by_host = _prior(hosts, by_domain, ["domain"])
    a, b = F.col("alpha"), F.col("beta")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    low = F.greatest(F.col("mean") - z * deviation, F.lit(0.0))
    found = by_host.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.col("mean").alias("bad_rate"), low.alias("bad_low"))
    return C.cut(found.crossJoin(F.broadcast(everything.select(F.col("mean").alias("overall")))))  # one row


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, times: float = TIMES, z: float = Z) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_low`` for every row of ``pages``."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = reputation(parsed, labels, z)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_host = F.when((F.col("host") != "") & (F.col("n_labelled") > 0) & (F.col("bad_low") > times * F.col("overall")), F.lit("block")).otherwise(F.lit("allow"))
    return C.join_sized(parsed, found, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_rate", "bad_low"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(C.table(spark, sf_dir, "pages").select("page_id", "url"), C.table(spark, sf_dir, "labels"))
    return found.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_low")})


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in ordered]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"

    def prior(name: str, counts: str, parent: str) -> str:
        return f"""
, {name}0 AS (SELECT c.*, greatest(least(q.mean, 0.999), 0.001) AS m FROM {counts} c {parent})
, {name}1 AS (SELECT 1 / coalesce(greatest(least((sum((bad - n * m) ** 2 / (m * (1 - m))) - sum(n)) / sum(n * (n - 1)), CAST(1 AS DOUBLE) / 3), CAST(1 AS DOUBLE) / 1001), CAST(1 AS DOUBLE) / 3) - 1 AS weight FROM {name}0 WHERE n > 1)
, {name} AS (SELECT *, alpha / (alpha + beta) AS mean FROM (SELECT {name}0.*, m * weight + bad AS alpha, (1 - m) * weight + n - bad AS beta FROM {name}0, {name}1))"""

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
, o AS (SELECT doc_id AS page_id, CASE WHEN min(quality) = 0 OR max(toxic) = 1 THEN 1 ELSE 0 END AS is_bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1)
, h0 AS (SELECT host, count(is_bad) AS n, CAST(coalesce(sum(is_bad), 0) AS BIGINT) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN o USING (page_id) GROUP BY host)
, h1 AS (SELECT *, string_split(bare, '.') AS parts, regexp_matches(bare, '^[0-9.]+$|^\\[') AS address FROM h0)
, h2 AS (SELECT *, CASE WHEN len(parts) >= 3 AND length(parts[-1]) = 2 AND parts[-2] IN ({', '.join(f"'{x}'" for x in SECOND_LEVEL)}) THEN 3 ELSE 2 END AS wide FROM h1)
, hosts AS (SELECT host, n, bad, CASE WHEN address THEN bare ELSE array_to_string(parts[greatest(len(parts) - wide + 1, 1):], '.') END AS domain, CASE WHEN address THEN '' ELSE array_to_string(parts[greatest(len(parts) - wide + 2, 1):], '.') END AS suffix FROM h2)
, domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL)
, suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL)
, everything AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS mean FROM suffixes){prior("ps", "suffixes", ", everything q")}{prior("pd", "domains", "LEFT JOIN ps q USING (suffix)")}{prior("ph", "hosts", "LEFT JOIN pd q USING (domain)")}
, r AS (SELECT host, mean, greatest(mean - {Z} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))), 0) AS low, n FROM ph)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN host <> '' AND n > 0 AND low > {TIMES} * (SELECT mean FROM everything) THEN 'block' ELSE 'allow' END) AS verdict, round(mean, 6) AS bad_rate, round(low, 6) AS bad_low FROM p LEFT JOIN r USING (host)"""


ORACLE = _oracle()
