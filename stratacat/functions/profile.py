"""Structured facts of a model from its maker's text, checked patches of them, overlays and completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .objects import members
from .text import round_half_up

# Fields with their types and bounds, and the patterns that results depend on, in order of precedence.
INTEGERS = {"channels": (1, 32), "motorCount": (0, 16), "recommendedAuwMinG": (1, 200000), "recommendedAuwMaxG": (1, 200000), "maxAuwG": (1, 250000), "payloadG": (0, 200000)}
TEXTS = {"difficultyNotes": 1200, "fpvFcNotes": 1200, "lowSpeedNotes": 1200, "fieldNotes": 1200}
ENUMS = {
    "controlLayout": ["conventional", "v_tail", "elevon", "rudder_elevator", "differential_thrust", "mixed_vtol", "other"],
    "propulsionType": ["propeller", "edf", "turbine", "unpowered", "mixed", "other"],
    "propulsionPosition": ["tractor", "pusher", "mixed", "not_applicable", "other"],
    "difficulty": ["beginner", "intermediate", "intermediate_advanced", "advanced"],
    "stabilization": ["included", "optional", "none"],
    "fpvReadiness": ["purpose_built", "easy_fit", "modification_needed", "not_recommended"],
    "fcReadiness": ["purpose_built", "easy_fit", "modification_needed", "not_recommended"],
    "lowSpeedBehavior": ["excellent", "good", "average", "demanding"],
    "stallBehavior": ["gentle", "moderate", "sharp"],
    "fieldRequirement": ["rough_grass_ok", "mown_grass_ok", "smooth_runway_recommended", "paved_runway_required", "no_runway_needed", "water_only"],
}
MULTIS = {
    "controlSurfaces": ["aileron", "elevator", "rudder", "elevon", "flaps", "spoilers", "differential_thrust"],
    "launchMethods": ["hand_launch", "ground_roll", "bungee", "vtol", "water"],
    "landingMethods": ["wheels", "belly", "skid", "vtol", "water", "hand_catch"],
}
FIELDS = [
    "controlLayout", "channels", "controlSurfaces", "motorCount", "propulsionType", "propulsionPosition", "difficulty", "stabilization", "difficultyNotes", "recommendedAuwMinG", "recommendedAuwMaxG",
    "maxAuwG", "payloadG", "fpvReadiness", "fcReadiness", "fpvFcNotes", "lowSpeedBehavior", "stallBehavior", "lowSpeedNotes", "launchMethods", "landingMethods", "fieldRequirement", "fieldNotes",
]
LISTS = {
    "controlSurfaces": [
        ("aileron", [r"\bailerons?\b"]), ("elevator", [r"\belevators?\b", r"\bfull[- ]flying stab(?:ilizer)?\b"]), ("rudder", [r"\brudders?\b"]), ("elevon", [r"\belevons?\b", r"\belevens?\b"]),
        ("flaps", [r"\bflaps?\b"]), ("spoilers", [r"\bspoilers?\b"]), ("differential_thrust", [r"\bdifferential[- ]thrust\b"]),
    ],
    "launchMethods": [
        ("hand_launch", [r"\bhand[- ]launch(?:ed|ing)?\b", r"\bhand (?:throw|thrown)\b"]), ("ground_roll", [r"\bground take[- ]?off\b", r"\b(?:runway|rolling) take[- ]?off\b"]),
        ("bungee", [r"\b(?:bungee|catapult) launch(?:ed|ing)?\b"]), ("vtol", [r"\bVTOL\b", r"\bvertical take[- ]?off\b"]), ("water", [r"\bwater take[- ]?off\b", r"\bseaplane\b"]),
    ],
    "landingMethods": [
        ("wheels", [r"\blanding gear\b", r"\bundercarriage\b"]), ("belly", [r"\bbelly[- ]land(?:ed|ing)?\b"]), ("skid", [r"\blanding skid\b"]), ("vtol", [r"\bVTOL\b", r"\bvertical take[- ]?off and landing\b"]),
        ("water", [r"\bwater landing\b", r"\bseaplane\b"]), ("hand_catch", [r"\bhand[- ]catch(?:ing)?\b"]),
    ],
}
_EDF = [r"\bEDF\b", r"\belectric ducted fan\b", r"\bducted[- ]fan\b"]
_PUSHER = [r"\bpusher(?: design| glider| configuration)?\b", r"\brear[- ]mounted prop(?:eller)?\b"]
_TRACTOR = [r"\btractor(?: design| configuration)?\b", r"\bfront[- ]mounted prop(?:eller)?\b"]
NO_BEGINNERS = [r"\b(?:not|unsuitable)\s+for beginners?\b", r"\bnot (?:a )?beginner[- ]friendly\b"]
CHOICES = {
    "controlLayout": [
        ("mixed_vtol", [r"\bVTOL\b", r"\bvertical take[- ]?off and landing\b"]), ("differential_thrust", [r"\bdifferential[- ]thrust\b"]), ("v_tail", [r"\bV[- ]?tail\b"]), ("elevon", [r"\belevons?\b", r"\belevens?\b"]),
    ],
    "propulsionType": [
        ("edf", _EDF), ("turbine", [r"\bturbine(?: powered)?\b"]),
        ("propeller", [r"\bpropellers?\b", r"\bprop\b", r"\b(?:brushless|coreless|electric)\s+motors?\b", r"\bmotors?\b", r"\bengines?\b"]),
    ],
    "propulsionPosition": [("pusher", _PUSHER), ("tractor", _TRACTOR), ("not_applicable", _EDF)],
    "difficulty": [
        ("intermediate_advanced", [r"\bflying skill level\s*:?\s*intermediate\s*[/&-]\s*advanced\b", r"\bfor intermediate\s*[/&-]\s*advanced pilots?\b"]),
        (
            "beginner",
            [
                r"\bflying skill level\s*:?\s*beginner\b", r"\bbeginner[- ]friendly\b", r"\bbeginner (?:RC )?(?:trainer|plane|airplane|glider|warbird|jet)\b",
                r"\b(?:designed|engineered|suitable|ideal|perfect)\b[^.;]{0,65}\bfor (?:absolute )?beginners?\b", r"\b(?:easy|simple)\s+to\s+(?:fly|control)\b", r"\bblessing for beginners?\b",
            ],
        ),
        ("advanced", [r"\bflying skill level\s*:?\s*advanced\b", r"\b(?:requires?|for)\s+(?:an?\s+)?(?:advanced|experienced)\s+pilots?\b"]),
        ("intermediate", [r"\bflying skill level\s*:?\s*intermediate\b", r"\bfor intermediate (?:users?|pilots?)\b"]),
    ],
    "stabilization": [
        ("none", [r"\b(?:no|without)\s+(?:gyro|stabili[sz](?:ation|er))\b"]), ("optional", [r"\boptional\s+(?:gyro|stabili[sz](?:ation|er))\b"]),
        ("included", [r"\bXpilot\b", r"\b(?:built[- ]in|integrated|included|equipped with)\b[^.;]{0,55}\b(?:gyro|stabili[sz](?:ation|er))\b", r"\b(?:gyro|stabili[sz](?:ation|er))\b[^.;]{0,35}\b(?:built[- ]in|integrated|included)\b"]),
    ],
    "fpvReadiness": [
        ("not_recommended", [r"\b(?:not compatible|not recommended|does not support)\b[^.;]{0,45}\b(?:FPV|camera|VTX)\b"]), ("modification_needed", [r"\b(?:FPV|camera)\b[^.;]{0,45}\b(?:requires?|needs?)\s+(?:cutting|modification)\b"]),
        (
            "purpose_built",
            [
                r"\b(?:purpose[- ]built|specially designed|designed)\b[^.;]{0,65}\bfor (?:long[- ]range )?FPV\b", r"\b(?:FPV|camera|VTX)\s+(?:bay|compartment|slot|mount(?:ing)?(?: platform)?)\b", r"\bFPV\s+camera\s+mounts?\b",
                r"\b(?:pre[- ]cut hole|flat bed)\b[^.;]{0,75}\b(?:FPV|camera)\b", r"\bpre[- ]installed camera cable\b", r"\bexclusive installation positions?\b[^.;]{0,90}\b(?:FPV|VTX|camera)\b",
            ],
        ),
        ("easy_fit", [r"\b(?:room|space|capacity)\b[^.;]{0,60}\bfor\b[^.;]{0,45}\b(?:FPV|camera|VTX)\b", r"\bcompatible with\b[^.;]{0,55}\b(?:FPV|video transmission|camera|GoPro)\b", r"\bFPV[- ]capable\b"]),
    ],
    "fcReadiness": [
        ("not_recommended", [r"\b(?:not compatible|not recommended|does not support)\b[^.;]{0,45}\b(?:flight controller|autopilot)\b"]), ("modification_needed", [r"\bflight controller\b[^.;]{0,45}\b(?:requires?|needs?)\s+(?:cutting|modification)\b"]),
        (
            "purpose_built",
            [
                r"\b(?:dedicated|exclusive|reserved)\b[^.;]{0,45}\b(?:position|space|bay|mount|slot)s?\b[^.;]{0,55}\bflight controller\b", r"\bflight controller\s+(?:bay|compartment|slot|mount(?:ing)?(?: position)?)\b",
                r"\bexclusive installation positions?\b[^.;]{0,90}\bflight controller\b",
            ],
        ),
        ("easy_fit", [r"\b(?:room|space)\b[^.;]{0,55}\b(?:flight controllers?|autopilot)\b", r"\b(?:flight controller|flight control equipment)\b[^.;]{0,55}\b(?:easy to (?:install|fit)|installation)\b"]),
    ],
    "lowSpeedBehavior": [
        ("excellent", [r"\bexcellent\b[^.;]{0,35}\blow[- ]speed\b", r"\blow[- ]speed\b[^.;]{0,35}\bexcellent\b"]),
        (
            "good",
            [
                r"\b(?:enhanced|excellent|good)\s+low[- ]speed\b[^.;]{0,30}\b(?:stability|handling|flight)\b", r"\b(?:stable|forgiving|predictable)\b[^.;]{0,35}\b(?:at )?low[- ]speed\b",
                r"\blow[- ]speed\b[^.;]{0,35}\b(?:stable|forgiving|predictable)\b", r"\bcruise slowly\b", r"\bfly stable\b[^.;]{0,45}\blow[- ]speed\b",
            ],
        ),
        ("demanding", [r"\b(?:poor|demanding|unstable)\b[^.;]{0,35}\blow[- ]speed\b", r"\b(?:requires?|needs?)\b[^.;]{0,30}\bhigh landing speed\b"]),
    ],
    "stallBehavior": [
        ("gentle", [r"\b(?:gentle|forgiving|predictable)\s+stall(?:ing)?\b"]), ("sharp", [r"\b(?:sharp|sudden|violent)\s+stall(?:ing)?\b", r"\btip[- ]stall(?:ing)?\b"]), ("moderate", [r"\bmoderate\s+stall(?:ing)?\b"]),
    ],
    "fieldRequirement": [
        ("rough_grass_ok", [r"\brough grass\b", r"\brough[- ]field\b", r"\boff[- ]road landing gear\b"]), ("mown_grass_ok", [r"\b(?:short|mown|cut) grass\b", r"\bgrass (?:field|runway)\b"]),
        ("paved_runway_required", [r"\b(?:paved|asphalt|tarmac) runway (?:is )?required\b"]), ("smooth_runway_recommended", [r"\b(?:smooth|good) runway (?:is )?(?:recommended|required)\b"]),
        ("no_runway_needed", [r"\bno runway (?:is )?(?:needed|required)\b"]), ("water_only", [r"\bwater[- ]only\b"]),
    ],
}
MORE_CHANNELS, CHANNELS = r"\bmore than\s+(\d{1,2})\s*(?:-| )?(?:ch|channels?)\b", r"\b(\d{1,2})\s*(?:-| )?(?:ch|channels?)\b"
TWO_MOTORS = [r"\b(?:twin|dual)[-\s]*(?:engine|motor)s?\b", r"\b(?:twin|dual)\b[^.;]{0,18}\bEDF\b", r"\b(?:engine|motor)s?\b[^.;]{0,12}\b(?:twin|dual)\b"]
COUNTED_MOTORS = [r"\b([2-9])\s*[x×]\s*[^.;]{0,25}\b(?:motors?|engines?|EDF)\b", r"\b(?:motors?|engines?)\s*[:=][^.;]{0,28}[*x×]\s*([2-9])\b"]
ONE_MOTOR = [r"\bsingle[-\s]*(?:engine|motor)\b", r"\bone[-\s]*(?:engine|motor)\b"]
_NUMBER, _UNIT = r"(\d[\d,]*(?:\.\d+)?)", r"(kilograms?|kg|grams?|g|pounds?|lbs?|ounces?|oz)"
_GOOD = r"(?:recommend(?:ed)?\s+)?(?:AUW|all[- ]?up weight|flying weight|flight weight|take[- ]?off weight)"
MAX_WEIGHT = rf"\bmax(?:imum)?\.?\s*(?:recommended\s+)?(?:take[- ]?off|flying|flight|all[- ]?up)?\s*weight\b[^0-9]{{0,20}}{_NUMBER}\s*{_UNIT}"
WEIGHT_RANGE = rf"\b{_GOOD}\b[^0-9]{{0,20}}{_NUMBER}\s*(?:-|to)\s*{_NUMBER}\s*{_UNIT}"
WEIGHT = rf"\b{_GOOD}\b[^0-9]{{0,20}}{_NUMBER}\s*{_UNIT}"
PAYLOAD = [rf"\b(?:maximum|max\.?\s*)?payload(?: capacity)?\b[^0-9]{{0,20}}{_NUMBER}\s*{_UNIT}", rf"\b{_NUMBER}\s*{_UNIT}\s+payload(?: capacity)?\b"]
MAX_BEFORE = r"\bmax(?:imum)?\.?\s*$"
UNITS = [(r"^(?:kg|kilogram)", 1000.0), (r"^(?:lb|pound)", 453.59237), (r"^(?:oz|ounce)", 28.349523125)]
CLAIMS = ["difficulty", "lowSpeedBehavior", "stallBehavior"]
ESSENTIALS = [
    (["controlLayout", "channels", "controlSurfaces"], True), (["motorCount", "propulsionType", "propulsionPosition"], True), (["difficulty"], False), (["recommendedAuwMinG", "recommendedAuwMaxG"], False),
    (["maxAuwG"], False), (["fpvReadiness"], False), (["fcReadiness"], False), (["lowSpeedBehavior"], False), (["landingMethods", "fieldRequirement"], True),
]
# End of fixed values.


def compact(text: Column) -> Column:
    """Dashes of all kinds become hyphens, white space one space."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[‐-―−]", "-"), " ", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _i(pattern: str) -> str:
    return f"(?i){pattern}"


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(_i(p)) for p in patterns])


def grams(number: Column, unit: Column) -> Column:
    """A number with thousands commas in a unit of weight, in grams; grams are the unit of everything unknown."""
    value, u = F.replace(number, F.lit(","), F.lit("")).try_cast("double"), F.lower(unit)
    factor = reduce(lambda c, x: c.when(u.rlike(x[0]), x[1]), UNITS[1:], F.when(u.rlike(UNITS[0][0]), UNITS[0][1])).otherwise(1.0)
    return round_half_up(value * factor).cast("int")


def excerpt(text: Column, pattern: str, longest: int = 190) -> Column:
    """The text around the first match: 55 characters before and 90 after it, with ellipses where it is cut; null without a match."""
    at, size = F.regexp_instr(text, F.lit(_i(pattern))) - 1, F.char_length(F.regexp_extract(text, _i(pattern), 0))
    before, after = F.greatest(F.lit(0), at - 55), F.least(F.char_length(text), at + size + 90)
    cut = F.trim(F.regexp_replace(F.substr(text, before + 1, after - before), r"\s+", " "))
    whole = F.concat(F.when(before > 0, "…").otherwise(""), cut, F.when(after < F.char_length(text), "…").otherwise(""))
    return F.when(text.rlike(_i(pattern)), F.left(whole, F.lit(longest)))


def _first(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[excerpt(text, p) for p in patterns])


def _bare_fact(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("field"), value.cast("string").alias("value"), F.lit("manufacturer_claim" if key in CLAIMS else "explicit").alias("confidence"))


def _told_fact(key: str, value: Column, evidence: Column) -> Column:
    return F.struct(F.lit(key).alias("field"), value.cast("string").alias("value"), evidence.alias("evidence"), F.lit("manufacturer_claim" if key in CLAIMS else "explicit").alias("confidence"))


def facts(title: Column, body: Column, evidence: bool = True) -> Column:
    """An array of ``field, value, evidence, confidence`` for all fields that the text decides; lists as comma-joined values. Without ``evidence`` its excerpts aren't made.

    Silence is unknown: only words that state a fact count, in the order of the patterns.
    """
    text = compact(F.concat_ws(" | ", F.nullif(title, F.lit("")), F.nullif(body, F.lit(""))))
    # inside a lambda the text is worked out once, however many patterns look at it
    return F.get(F.transform(F.array(text), lambda t: _facts_of(t, evidence)), F.lit(0))


def _facts_of(t: Column, evidence: bool) -> Column:
    made: list[Column] = []
    _fact = _told_fact if evidence else lambda key, value, _: _bare_fact(key, value)
    lists = {}
    for key, options in LISTS.items():
        lists[key] = F.array_compact(F.array(*[F.when(_any(t, p), F.lit(v)) for v, p in options]))
        made.append(_fact(key, F.when(F.size(lists[key]) > 0, F.array_join(lists[key], ",")), F.coalesce(*[_first(t, p) for _, p in options])))
    has = lambda x: F.array_contains(lists["controlSurfaces"], x)
    surfaces = F.coalesce(*[_first(t, p) for _, p in LISTS["controlSurfaces"]])
    for key, options in CHOICES.items():
        tests = [(_any(t, p) & ~_any(t, NO_BEGINNERS) if (key, v) == ("difficulty", "beginner") else _any(t, p), F.lit(v), _first(t, p)) for v, p in options]
        if key == "propulsionPosition":
            tests.insert(0, (_any(t, _PUSHER) & _any(t, _TRACTOR), F.lit("mixed"), _first(t, _PUSHER)))
        if key == "controlLayout":
            tests += [(has("aileron") & has("elevator") & has("rudder"), F.lit("conventional"), surfaces), (~has("aileron") & has("elevator") & has("rudder"), F.lit("rudder_elevator"), surfaces)]
        pick = lambda i: reduce(lambda c, x: c.when(x[0], x[i]), tests[1:], F.when(tests[0][0], tests[0][i]))  # noqa: B023, E731
        made.append(_fact(key, pick(1), pick(2)))
    # a number that is said first counts; "more than five" means six
    more, exact = F.regexp_instr(t, F.lit(_i(MORE_CHANNELS))), F.regexp_instr(t, F.lit(_i(CHANNELS)))
    use_more = (more > 0) & (more < exact)
    count = F.when(use_more, F.regexp_extract(t, _i(MORE_CHANNELS), 1).try_cast("int") + 1).when(exact > 0, F.regexp_extract(t, _i(CHANNELS), 1).try_cast("int"))
    made.append(_fact("channels", F.when(count.between(1, 32), count), F.when(use_more, excerpt(t, MORE_CHANNELS)).otherwise(excerpt(t, CHANNELS))))
    counted = F.coalesce(*[F.nullif(F.regexp_extract(t, _i(p), 1), F.lit("")) for p in COUNTED_MOTORS])
    made.append(_fact("motorCount", F.when(_any(t, TWO_MOTORS), F.lit("2")).when(counted.isNotNull(), counted).when(_any(t, ONE_MOTOR), F.lit("1")), F.coalesce(_first(t, TWO_MOTORS), _first(t, COUNTED_MOTORS), _first(t, ONE_MOTOR))))
    g = lambda p, a, b: grams(F.regexp_extract(t, _i(p), a), F.regexp_extract(t, _i(p), b))
    made.append(_fact("maxAuwG", F.when(t.rlike(_i(MAX_WEIGHT)), g(MAX_WEIGHT, 1, 2)), excerpt(t, MAX_WEIGHT)))
    free = lambda p: t.rlike(_i(p)) & ~F.regexp_extract(t, rf"(?is)^(.*?){p}", 1).rlike(_i(MAX_BEFORE))
    a, b = g(WEIGHT_RANGE, 1, 3), g(WEIGHT_RANGE, 2, 3)
    spread, single = t.rlike(_i(WEIGHT_RANGE)), g(WEIGHT, 1, 2)
    for key, low in (("recommendedAuwMinG", F.least(a, b)), ("recommendedAuwMaxG", F.greatest(a, b))):
        made.append(_fact(key, F.when(spread, F.when(free(WEIGHT_RANGE), low)).when(free(WEIGHT), single), F.when(spread, excerpt(t, WEIGHT_RANGE)).otherwise(excerpt(t, WEIGHT))))
    made.append(_fact("payloadG", F.coalesce(*[F.when(t.rlike(_i(p)), g(p, 1, 2)) for p in PAYLOAD]), _first(t, PAYLOAD)))
    return F.filter(F.array(*made), lambda x: x["value"].isNotNull())


def _token(value: Column) -> Column:
    return F.regexp_replace(F.lower(compact(value)), r"[\s-]+", "_")


def normalize_patches(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``key, field, value, error`` for every member of the patches: the checked value as JSON (null clears a suggestion), or what is wrong with it."""
    m = members(rows, column, key)
    kind, v = F.schema_of_variant("value"), F.col("value")
    empty, is_text, is_list = F.is_variant_null("value"), F.schema_of_variant("value") == "STRING", F.schema_of_variant("value").startswith("ARRAY")
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    field = F.col("key")
    low = F.create_map(*[F.lit(x) for f, (a, _) in INTEGERS.items() for x in (f, a)])
    high = F.create_map(*[F.lit(x) for f, (_, b) in INTEGERS.items() for x in (f, b)])
    options = F.create_map(*[x for f, o in [*ENUMS.items(), *MULTIS.items()] for x in (F.lit(f), F.array(*map(F.lit, o)))])
    number = F.when(is_text, F.replace(compact(text), F.lit(","), F.lit("")).try_cast("double")).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    blank = is_text & (F.trim(text) == "")
    whole = number.isNotNull() & (number == F.floor(number)) & number.between(F.try_element_at(low, field), F.try_element_at(high, field))
    parts = F.when(is_list, F.try_variant_get(v, "$", "array<string>")).when(is_text, F.split(text, ","))
    tokens = F.array_distinct(F.filter(F.transform(parts, _token), lambda x: x != ""))
    known = F.try_element_at(options, field)
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    cases = [
        (field.isin(list(INTEGERS)), F.when(blank, F.lit("null")).when(whole, number.cast("bigint").cast("string")), "no whole number in range"),
        (field.isin(list(TEXTS)), F.when(is_text, F.when(blank, F.lit("null")).when(F.char_length(F.trim(text)) <= 1200, quoted(F.trim(text)))), "no text, or too long"),
        (field.isin(list(ENUMS)), F.when(is_text & F.array_contains(known, _token(text)), quoted(_token(text))), "not one of its values"),
        (field.isin(list(MULTIS)), F.when(tokens.isNotNull() & (F.size(F.array_except(tokens, known)) == 0), F.to_json(tokens)), "no list of its values"),
    ]
    unknown = ~field.isin(FIELDS)
    good = reduce(lambda c, x: c.when(x[0], x[1]), cases, F.when(unknown, F.lit(None)).when(empty, F.lit("null")))
    bad = reduce(lambda c, x: c.when(x[0] & x[1].isNull(), F.lit(x[2])), cases, F.when(unknown, F.lit("unknown field")).when(empty, F.lit(None)))
    return m.select(key, field.alias("field"), good.alias("value"), bad.alias("error"))


def relation_error(low: Column, high: Column, most: Column) -> Column:
    """What is wrong among the three weights; null if they are in order or not all known."""
    return (
        F.when(low > high, "lowest good weight above the highest good weight").when(low > most, "lowest good weight above the limit").when(high > most, "highest good weight above the limit")
    )


def completeness(values: Column) -> Column:
    """How many of the nine essential groups a ``map<string,string>`` of values fills: all fields of some groups, any of the others."""
    told = lambda k: F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("unknown")).isin("", "unknown", "[]") == F.lit(False)
    done = [reduce(lambda a, b: (a & b) if every else (a | b), [told(k) for k in keys]) for keys, every in ESSENTIALS]  # noqa: B023
    return reduce(lambda a, b: a + b, [d.cast("int") for d in done])
