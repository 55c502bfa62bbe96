"""Text, URL and classification functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratacat.functions import classify as K
from stratacat.functions import text as T
from stratacat.views import table, with_views

#: Suffixes that give part names the forms that sellers write.
SUFFIXES = [" 800mm Wingspan PNP", " Wingspan: 1,200 mm RTF", " 98 cm wing span 98 cm kit", " wingspan 1.2m ARF", " wingspan 39.4 inches combo", " 35cc gas Mustang", " EDF jet F-16 (Pre-owned)", " trainer glider", " replacement servo 20mm x 50", ""]
_TEXT_SQL = ", t AS (SELECT p_partkey AS id, concat(p_name, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES)) + " END) AS text FROM part)"


def texts(s, d):
    pick = F.get(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % 10).cast("int"))
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", pick).alias("text"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _span_sql(spans, low=None) -> str:
    value = lambda p, u: f"CAST(floor(TRY_CAST(regexp_extract(replace(regexp_extract(text, '{_re2(p)}', 1), ',', ''), '^(\\d*\\.?\\d*)', 1) AS DOUBLE) * {u} + 0.5) AS INT)"
    return "coalesce(" + ", ".join(f"CASE WHEN {value(p, u)} BETWEEN 200 AND 4000 THEN {value(p, u)} END" for p, u in spans) + ")"


def maker_span_sql(text: str) -> str:
    """The maker's span rule in SQL, for a text expression."""
    t = rf"regexp_replace(concat(' ', {text}, ' '), '(\d),(\d{{3}})(\D|$)', '\1\2\3', 'g')"
    value = lambda p, u: f"CAST(floor(TRY_CAST(regexp_extract(replace(regexp_extract({t}, '{_re2(p)}', 1), ',', ''), '^(\\d*\\.?\\d*)', 1) AS DOUBLE) * {u} + 0.5) AS INT)"
    bare = [f"CASE WHEN length({t}) <= 90 THEN {value(p, u)} END" for p, u in K.MAKER_SHORT_SPANS]
    return "coalesce(" + ", ".join([*[value(p, u) for p, u in K.MAKER_SPANS], *bare]) + ")"


def labels_sql(text: str) -> str:
    """All build labels of a text expression, as a list."""
    hits = [f"CASE WHEN regexp_matches({text}, '{_re2(p)}')" + (f" AND NOT regexp_matches({text}, '{_re2(K.ALMOST_READY)}')" if c == "rtf" else "") + f" THEN '{c}' END" for c, p in [("arf", K.ALMOST_READY), *K.CONFIG_TYPES]]
    return "list_filter([" + ", ".join(hits) + "], lambda x: x IS NOT NULL)"


def _case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{_re2(p)}') THEN '{c}'" for c, p in rules) + f" ELSE '{default}' END"


def _tags_sql() -> str:
    hits = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_re2(p)}') THEN '{t}' END" for t, p in K.ROLE_RULES) + "], lambda x: x IS NOT NULL)"
    return f"""SELECT id, CASE WHEN len(h) = 0 THEN 'Sport / Park Flyer' ELSE array_to_string(CASE WHEN list_has_any(h, ['Warbird', 'Scale Civilian']) THEN list_filter(h, lambda x: x <> 'Trainer') ELSE h END, ',') END AS tags,
len(h) > 0 AS confident FROM (SELECT id, {hits} AS h FROM t)"""


def _roles(s, d):
    tagged = texts(s, d).select("id", K.role_tags(F.col("text")).alias("r"))
    return tagged.select("id", F.array_join("r.tags", ",").alias("tags"), F.col("r.confident").alias("confident"))


_GAS_SQL = " OR ".join(f"regexp_matches(lower(text), '{_re2(p)}')" for p in K.GAS)
_TRACK = r"(?i)^(utm_|fbclid|gclid|srsltid|ref$|ref_|mc_|igsh)"

QUERIES = {
    "k_span_title": lambda s, d: texts(s, d).select("id", K.span_title(F.col("text")).alias("span")),
    "k_span_mfr": lambda s, d: texts(s, d).select("id", K.span_maker(F.col("text")).alias("span")),
    "k_config": lambda s, d: texts(s, d).select("id", K.config(F.col("text")).alias("config")),
    "k_config_types": lambda s, d: texts(s, d).select("id", F.array_join(K.config_types(F.col("text")), ",").alias("types")),
    "k_power": lambda s, d: texts(s, d).select("id", K.power(F.col("text")).alias("power")),
    "k_condition": lambda s, d: texts(s, d).select("id", K.condition(F.col("text")).alias("condition")),
    "k_role_tags": _roles,
    "k_is_aircraft": lambda s, d: texts(s, d).select("id", K.is_aircraft(F.col("text"), F.when(F.col("id") % 3 == 0, "Spare parts").when(F.col("id") % 3 == 1, "RC Airplanes")).alias("aircraft")),
    "k_triage_score": lambda s, d: texts(s, d).select("id", K.triage_score(F.col("text"), ["glider", "jet"], ["servo", "kit"]).alias("score")),
    "f_names": lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), T.slugify(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), T.norm_name(F.col("p_brand")).alias("norm"), T.brand_key(F.col("p_brand")).alias("key")),
    "f_host_of": lambda s, d: table(s, d, "pages").select("page_id", T.host_of(F.col("url")).alias("host")),
    "f_canonical_url": lambda s, d: table(s, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical")),
    "f_fnv1a": lambda s, d: table(s, d, "pages").select("page_id", F.lower(F.hex(T.fnv1a(F.col("url")))).alias("h")),
    "f_page_title": lambda s, d: table(s, d, "pages").select("page_id", T.page_title(F.col("html")).alias("title")),
    "f_html_to_text": lambda s, d: table(s, d, "pages").select("page_id", F.md5(T.html_to_text(F.col("html"))).alias("text_md5")),
    "f_links": lambda s, d: table(s, d, "pages").select("page_id", F.explode(T.links(F.col("html"))).alias("href")).groupBy("href").agg(F.count("*").alias("n")),
}
_ENT = "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
for _a, _b in T.ENTITIES:
    _ENT = f"replace({_ENT}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _a, _b in T.ENTITIES:
    _TITLE = f"replace({_TITLE}, '{_a.replace(chr(39), chr(39) * 2)}', '{_b.replace(chr(39), chr(39) * 2)}')"
ORACLE = {
    "k_span_title": with_views(_TEXT_SQL + f" SELECT id, {_span_sql(K.TITLE_SPANS)} AS span FROM t"),
    "k_span_mfr": with_views(_TEXT_SQL + f" SELECT id, {maker_span_sql('text')} AS span FROM t"),
    "k_config": with_views(_TEXT_SQL + f" SELECT id, {_case(K.CONFIGS, 'kit')} AS config FROM t"),
    "k_config_types": with_views(
        _TEXT_SQL
        + " SELECT id, concat_ws(',', "
        + ", ".join(
            f"CASE WHEN regexp_matches(text, '{_re2(p)}')" + (f" AND NOT regexp_matches(text, '{_re2(K.ALMOST_READY)}')" if c == "rtf" else "") + f" THEN '{c}' END" for c, p in [("arf", K.ALMOST_READY), *K.CONFIG_TYPES]
        )
        + ") AS types FROM t"
    ),
    "k_power": with_views(_TEXT_SQL + f" SELECT id, CASE WHEN {_GAS_SQL} THEN 'gas' ELSE 'electric' END AS power FROM t"),
    "k_condition": with_views(_TEXT_SQL + f" SELECT id, CASE WHEN regexp_matches(text, '{_re2(K.USED)}') THEN 'used' ELSE 'new' END AS condition FROM t"),
    "k_role_tags": with_views(_TEXT_SQL + " " + _tags_sql()),
    "k_is_aircraft": with_views(_TEXT_SQL + f" SELECT id, CASE WHEN regexp_matches(text, '{_re2(K.BUILD_WORDS)}') THEN true WHEN regexp_matches(kind, '{_re2(K.TYPE_PART)}') THEN false WHEN regexp_matches(kind, '{_re2(K.TYPE_AIRCRAFT)}') THEN true WHEN regexp_matches(text, '{_re2(K.PART_WORDS)}') THEN false ELSE " + " OR ".join(f"regexp_matches(text, '{_re2(p)}')" for p in K.PLANE_WORDS) + " END AS aircraft FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'Spare parts' WHEN 1 THEN 'RC Airplanes' ELSE '' END AS kind FROM t)"),
    "k_triage_score": with_views(_TEXT_SQL + " SELECT id, CASE WHEN contains(lower(text), 'glider') OR contains(lower(text), 'jet') THEN 2 ELSE 0 END - CASE WHEN contains(lower(text), 'servo') OR contains(lower(text), 'kit') THEN 3 ELSE 0 END AS score FROM t"),
    "f_names": "SELECT p_partkey AS id, substr(regexp_replace(regexp_replace(lower(concat_ws(' ', p_brand, p_name)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 60) AS slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS norm, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part",
    "f_host_of": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages",
    "f_canonical_url": rf"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) AS base, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
  list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '{_TRACK}')) AS q FROM pages)
SELECT page_id, concat(base, CASE WHEN path = '' THEN '/' ELSE path END, CASE WHEN len(q) > 0 THEN concat('?', array_to_string(list_sort(q), '&')) ELSE '' END) AS canonical FROM u""",
    "f_fnv1a": "SELECT page_id, lower(to_hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295))) AS h FROM pages",
    "f_page_title": f"SELECT page_id, trim({_TITLE}) AS title FROM pages",
    "f_html_to_text": f"SELECT page_id, md5(trim(regexp_replace({_ENT}, '\\s+', ' ', 'g'))) AS text_md5 FROM pages",
    "f_links": "SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']*)', 1)) AS href FROM pages) GROUP BY href",
}
