"""Facts from titles and descriptions: wingspan, configuration, power, condition, roles, aircraft or part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, round_half_up

# Patterns and words that results depend on. Spans: pattern and millimetres per unit, in order of trust.
TITLE_SPANS = [
    (r"(?i)wing\s*span[^0-9<>]{0,24}([\d,.]{2,7})\s*mm\b", 1.0),
    (r"(?i)([\d]{3,4})\s*mm\b[^.]{0,24}wing\s*span", 1.0),
    (r"(?i)wing\s*span[^0-9<>]{0,24}([\d,.]{1,6})\s*cm\b", 10.0),
    (r"(?i)wing\s*span[^0-9<>]{0,24}([\d.]{1,5})\s*m\b", 1000.0),
    (r"(?i)wing\s*span[^0-9<>]{0,24}([\d.]{1,5})\s*(?:in|inch|inches|\")", 25.4),
    (r"\b([\d]{3,4})\s*mm\b", 1.0),
]
MAKER_SPANS = [
    (r"(?i)wing\s*span[^0-9]{0,14}(\d{3,4})\s*mm", 1.0),
    (r"(?i)wing\s*span[^0-9]{0,14}(\d{2,3}(?:\.\d)?)\s*(?:\"|''|″|in(?:ch(?:es)?)?\b)", 25.4),
    (r"(?i)(\d{2,3}(?:\.\d)?)\s*(?:\"|''|″|in(?:ch(?:es)?)?\b)[^a-z0-9]{0,6}wing\s*span", 25.4),
    (r"(?i)wing\s*span[^0-9]{0,14}(\d(?:\.\d{1,2})?)\s*m\b", 1000.0),
]
MAKER_SHORT_SPANS = [
    (r"(?i)\b(\d{3,4})\s*mm\b", 1.0),
    (r"(?i)\b(\d{2,3}(?:\.\d)?)\s*(?:\"|''|″|in(?:ch(?:es)?)?\b)", 25.4),
    (r"(?i)\b(\d(?:\.\d)?)\s*m\b", 1000.0),
]
CONFIGS = [
    ("rtf", r"(?i)\b(rtf|ready[\s-]?to[\s-]?fly)\b"),
    ("pnp", r"(?i)\b(pnp|pnf|plug[\s-]?(?:and|n|&)[\s-]?(?:play|fly))\b"),
    ("combo", r"(?i)\b(combo|bundle|with\s+(?:motor|electronics|fc|flight\s*controller))\b"),
]
ALMOST_READY = r"(?i)\b(?:arf|almost[\s-]*ready[\s-]*to[\s-]*fly)\b"
CONFIG_TYPES = [
    ("rtf", r"(?i)\b(?:rtf|ready[\s-]*to[\s-]*fly)\b"),
    ("bnf", r"(?i)\b(?:bnf|bind[\s-]*(?:and|n)[\s-]*fly)\b"),
    ("pnp", r"(?i)\b(?:pnp|pnf|plug[\s-]*(?:and|n)?[\s-]*(?:play|fly))\b"),
    ("rxr", r"(?i)\b(?:rxr|receiver[\s-]*ready)\b"),
    ("combo", r"(?i)\b(?:combo|bundle)\b"),
    ("kit", r"(?i)\bkit\b"),
]
GAS = [
    r"\b\d{2,3}\s*cc\b",
    r"(^|[\s(/])\.\d{2}\b",
    r"\b(nitro|glow|petrol|gasoline|gasser|engine|2[\s-]?stroke|4[\s-]?stroke)\b",
    r"\b(dle|dla|saito|zenoah|ngh|moki|3w|da[\s-]?\d{2})\b",
]
USED = r"(?i)\b(pre[\s-]?owned|second[\s-]?hand|sparingly\s+used|gently\s+used|quality\s+pre\b|refurbished|\(used\))"
ROLE_RULES = [
    ("Jet / EDF", r"\bedf\b|ducted[\s-]?fan|\bturbine\b|\bjet\b|\bf-?1[45678]\b|\bf-?22\b|\bf-?35\b|\bmig-?\d|\bsu-?\d\d|\bj-?20\b|\bj-?11\b|rafale|typhoon|viggen|mirage|tornado|\bl-?39\b|\ba-?10\b|\bt-?45\b|mb-?339|\bviper\b|goshawk|funjet|albatross"),
    ("Warbird", r"mustang|\bp-?51\b|spitfire|corsair|f4u|\bzero\b|a6m|bf-?109|fw-?190|messerschmitt|\bp-?47\b|\bp-?40\b|\bp-?39\b|\bp-?38\b|\bt-?28\b|trojan|\bstuka\b|hurricane|mosquito|lancaster|\bb-?17\b|\bb-?25\b|texan|\bat-?6\b|warbird|\bmig-?\d|\bsu-?\d\d|\bf-?1[45678]\b|\bf-?22\b|rafale|viggen|mirage|tornado|\bl-?39\b|\ba-?10\b|\bt-?45\b|goshawk|mb-?339|\bj-?20\b|hansa|\bpc-?9\b"),
    ("Airliner", r"airbus|\ba3\d0\b|boeing|\b7[0-9]7\b|\b747\b|\b737\b|airliner|globemaster|emirates"),
    ("Glider / Sailplane", r"glider|sailplane|\bsoar|\bdlg\b|hand[\s-]?launch|radian|discus|\bsalto\b|motor[\s-]?glider|thermal|\bbixler\b"),
    ("FPV / Flying Wing", r"\bfpv\b|flying[\s-]?wing|\btalon\b|sky[\s-]?surfer|\branger\b|\bzohd\b|atomrc|heewing|skywalker|x-?uav|mapbird|believer|striver|\bdart\b|swordfish|\bdolphin\b|\bpenguin\b|\bmobula\b|vortex-?rc|batman|\bplank\b|caipirinha|reptile|makeflyeasy"),
    ("Aerobatic / 3D", r"\b3d\b|aerobatic|extra[\s-]?\d|edge[\s-]?540|edge[\s-]?\d|yak-?\d|\bmxs\b|slick|pitts|sbach|\blaser[\s-]?\d|acromaster|katana|addiction|revolto|\bcrack\b|\b260\b|\b330\b|dirty[\s-]?birdy|vanquish|gee[\s-]?bee"),
    ("Scale Civilian", r"cessna|piper|\bcub\b|decathlon|beaver|otter|\bwaco\b|pilatus|kingfisher|telemaster|tiger[\s-]?moth|skylane|\bsr22\b|carbon[\s-]?cub|space[\s-]?walker|stinson|\bj-?3\b|maule|\bchamp\b|bird[\s-]?dog|\bdraco\b|columbia"),
    ("Trainer", r"trainer|beginner|apprentice|easy[\s-]?trainer|first[\s-]?step|\bcadet\b|\bkadet\b|challenger|allrounder|boomerang|arising[\s-]?star|school[\s-]?marm"),
    ("Sport / Park Flyer", r"sport|park[\s-]?flyer|fun[\s-]?cub|foam[\s-]?board|depron|gyro[\s-]?rtf|allrounder|wingnetic"),
]
BUILD_WORDS = r"(?i)\b(pnp|rtf|bnf|arf|rxr|receiver[\s-]*ready)\b"
TYPE_PART = r"(?i)\b(accessor|part|spare|hardware|electronic|covering|adhesive|engine|motor|servo|radio|batter|charger|prop|wheel|tool|field|pilot(s| figure)?|decal|apparel|gift)\b"
TYPE_AIRCRAFT = r"(?i)\b(aircraft|air\s*plane|airplane|plane|glider|sailplane|warbird|edf|jet|biplane|3d|aerobatic|trainer|delta|fpv)\b"
PART_WORDS = (
    r"(?i)(conversion kit|tail boom|fuselage|hatch|canopy|servo|\besc\b|\bvtx\b|\bvrx\b|\bmotor\b|propeller|\bprop\b|landing gear|\bcover\b|protector|\bmount\b|spare|replacement|\bcable\b|antenna|sticker|decal|foam set|foam case|carrying|storage|\bstand\b|charger|\bbattery\b|receiver|goggle|\blens\b|\bscrew\b|\bblock\b|\bpart\b|\bparts\b|set of|\bpack\b|\bbag\b|kit foam|nose \d|main wing|wing set|for rc (airplane|plane)|\d set\b)"
)
PLANE_WORDS = [r"(?i)\b(plane|glider|trainer|warbird|edf|jet|delta)\b", r"(?i)(fixed|flying)[\s-]*wing", r"(?i)wing\s*span", r"(?i)\b\d{2,3}(?:\.\d)?\s*(?:\"|″|in(?:ch(?:es)?)?\b)"]
BOT_WALL = r"(?i)Just a moment\.\.\.|Checking your browser|Enable JavaScript and cookies|challenges\.cloudflare\.com|cf-browser-verification|Attention Required|Access denied|error code:\s*1020"
# End of fixed values.


def _millimetres(text: Column, pattern: str, unit: float) -> Column:
    """Digits after commas go, and what follows a second point, as number readers do."""
    number = F.regexp_extract(F.replace(first_match(text, pattern), F.lit(","), F.lit("")), r"^(\d*\.?\d*)", 1)
    return round_half_up(number.try_cast("double") * unit).cast("int")


def span_title(text: Column) -> Column:
    """Wingspan in mm from a listing: the first pattern whose value lies in 200 to 4000."""
    found = [_millimetres(text, p, u) for p, u in TITLE_SPANS]
    return F.coalesce(*[F.when(v.between(200, 4000), v) for v in found])


def span_maker(text: Column) -> Column:
    """Wingspan in mm from a maker's text: labelled figures, and bare ones only in texts of up to 88 characters."""
    t = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), r"(\d),(\d{3})(?!\d)", "$1$2")

    def first(t):
        return F.coalesce(*[_millimetres(t, p, u) for p, u in MAKER_SPANS], *[F.when(F.char_length(t) <= 90, _millimetres(t, p, u)) for p, u in MAKER_SHORT_SPANS])

    return F.get(F.transform(F.array(t), first), F.lit(0))  # a lambda, so that the text is worked out once


def config(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(t.rlike(p), F.lit(c)) for c, p in CONFIGS], F.lit("kit"))


def config_types(text: Column) -> Column:
    """All build labels; "almost ready" is not "ready"."""
    t = F.coalesce(text, F.lit(""))
    labels = [F.when(t.rlike(ALMOST_READY), F.lit("arf"))]
    labels += [F.when(t.rlike(p) & ~t.rlike(ALMOST_READY) if c == "rtf" else t.rlike(p), F.lit(c)) for c, p in CONFIG_TYPES]
    return F.array_compact(F.array(*labels))


def config_agree(ours: Column, theirs: Column) -> Column:
    """1 if two label lists share a comparable label (theirs: arf counts as kit), 0 if not, null if either has none."""
    known = F.array(*map(F.lit, ["kit", "pnp", "rtf", "combo"]))
    a = F.array_intersect(ours, known)
    b = F.array_intersect(F.transform(theirs, lambda x: F.when(x == "arf", "kit").otherwise(x)), known)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b).cast("int"))


def power(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    gas = F.lit(False)
    for p in GAS:
        gas = gas | t.rlike(p)
    return F.when(gas, "gas").otherwise("electric")


def condition(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")).rlike(USED), "used").otherwise("new")


def role_tags(text: Column) -> Column:
    """A struct of tags, the primary first, and whether any rule fired. The rules stand in order of precedence."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(tag)) for tag, p in ROLE_RULES]))
    # a trainer that is also a warbird or scale model is no trainer: both outrank it
    special = F.array_contains(hits, "Warbird") | F.array_contains(hits, "Scale Civilian")
    tags = F.when(special, F.array_remove(hits, "Trainer")).otherwise(hits)
    return F.struct(F.when(F.size(hits) > 0, tags).otherwise(F.array(F.lit("Sport / Park Flyer"))).alias("tags"), (F.size(hits) > 0).alias("confident"))


def is_aircraft(title: Column, product_type: Column) -> Column:
    t, kind = F.coalesce(title, F.lit("")), F.coalesce(product_type, F.lit(""))
    plane = F.lit(False)
    for p in PLANE_WORDS:
        plane = plane | t.rlike(p)
    return F.when(t.rlike(BUILD_WORDS), True).when(kind.rlike(TYPE_PART), False).when(kind.rlike(TYPE_AIRCRAFT), True).when(t.rlike(PART_WORDS), False).otherwise(plane)


def triage_score(text: Column, include: list[str], exclude: list[str]) -> Column:
    """+2 with any wanted term, -3 with any unwanted one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(low, x))
    return F.when(has(include), 2).otherwise(0) - F.when(has(exclude), 3).otherwise(0)


def is_challenge(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(BOT_WALL)
