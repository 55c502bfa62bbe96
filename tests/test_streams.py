import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stratacat.operators import stats as S
from stratacat.plans import incremental as I
from stratacat.streaming import catalog as ST
from stratacat.streaming import keyed as K

T0 = 1_700_000_000
LATE, LATE_MS = "9 days", 9 * K.DAY_MS


def timed(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_change_log_of_any_split(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), k, T0 + rng.randrange(6 * 86_400), rng.choice([None, 1, 1, 2, 0])) for k in range(300)]
    table = timed(spark, rows, "key long, id long, at long, value long")
    want = {(r.key, r.id, r.value) for r in S.change_log(table, "key", ["ts", "id"], ["value"]).collect()}
    got = [(r.key, r.id, r.value) for r in K.replayed(table, lambda s: K.change_log(s, LATE), LATE_MS, files=5).collect()]
    assert len(got) == len(want) and set(got) == want


def lives(rows):
    """What happens to each sku, one signal after the other."""
    out, state = [], {}
    for key, number, at, kind in sorted(rows, key=lambda r: (r[2], r[1])):
        seen, misses, dead = state.get(key, (None, 0, 0))
        said = None
        if kind == "seen":
            said = "revived" if dead else None
            seen, misses, dead = at, 0, 0
        elif not dead:
            if kind == "gone" and (seen is None or at - seen >= 86_400):
                misses += 1
                dead = int(misses == 3)
                said = "dead" if dead else "missed"
            elif kind in ("gone", "missing"):
                said = "flagged"
            elif kind == "ok":
                misses = 0
        state[key] = (seen, misses, dead)
        if said:
            out.append((key, number, said, misses))
    return sorted(out)


def test_deaths_come_from_timers_in_order(spark):
    hour = 3600
    rows = [(1, 1, T0, "gone"), (1, 2, T0 + hour, "gone"), (1, 3, T0 + 2 * hour, "gone"), (1, 4, T0 + 3 * hour, "gone"), (1, 5, T0 + 4 * hour, "seen"), (1, 6, T0 + 5 * hour, "gone"), (1, 7, T0 + 28 * hour, "gone")]
    rows += [(2, 1, T0, "gone"), (2, 2, T0 + 1, "blocked"), (2, 3, T0 + 2, "missing"), (2, 4, T0 + 3, "gone"), (2, 5, T0 + 4, "ok"), (2, 6, T0 + 5, "gone")]
    rng = random.Random(6)
    rows += [(3 + rng.randrange(4), k, T0 + rng.randrange(7 * 86_400), rng.choice(["gone"] * 6 + ["seen", "ok", "blocked", "missing"])) for k in range(200)]
    got = K.replayed(timed(spark, rows, "key long, id long, at long, kind string"), lambda s: K.misses(s, LATE), LATE_MS, files=6)
    assert sorted((r.key, r.id, r.action, r.misses) for r in got.collect()) == lives(rows)
    assert (1, 3, "dead", 3) in lives(rows) and (1, 6, "flagged", 0) in lives(rows) and (1, 7, "missed", 1) in lives(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_as_a_stream_equals_the_batch(spark, seed):
    """Half of the files, a restart, the other half; whichever product of a sku comes first."""
    rng = random.Random(seed)
    skus = [(s, f"p{k}" if k % 3 else None, f"u{k}", f"t{k}", k, k % 2, "new" if k % 2 else "approved", None, 1, 1, 1, k % 5 == 0 and 1 or 0) for s in range(2) for k in range(12)]
    skus = spark.createDataFrame(skus, "source_id long, pid string, url string, title string, price long, stock int, review_status string, flag string, first_seen long, last_seen long, misses int, dead int")
    products = {(rng.randrange(2), rng.choice([None, f"p{rng.randrange(16)}", f"q{rng.randrange(6)}"]), rng.choice([None, f"u{rng.randrange(16)}", f"v{rng.randrange(5)}"])) for _ in range(90)}
    rows = [(*p, f"title {p[1]}", rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1])) for p in sorted(products, key=str)]
    products = spark.createDataFrame(rows, "source_id long, pid string, url string, title string, price long, stock int")
    want = [sorted(map(repr, f.collect())) for f in ST.scan_upsert(skus, products, I.NOW)]
    half = F.hash("pid", "url", "source_id") % 2 == 0
    folder = K.landed(products.filter(half), 2)
    plan = lambda stream: K.sightings(skus, stream)
    K.drained(spark, folder, products.schema, plan, f"{folder}-out", f"{folder}-state", 1)
    K.landed(products.filter(~half), 2, folder=folder)
    log = K.drained(spark, folder, products.schema, plan, f"{folder}-out", f"{folder}-state", 1)
    assert [sorted(map(repr, f.collect())) for f in K.settled(skus, log, I.NOW)] == want


def test_the_best_sighting_of_a_sku_is_kept_without_python(spark, tmp_path):
    """Sightings are a minimum that Spark keeps, no call to a Python worker for each sku; what came before a restart still counts, also against a later one that is worse."""
    skus = spark.createDataFrame([(1, "p1", "u1"), (1, None, None)], "source_id long, pid string, url string")
    schema = "source_id long, pid string, url string, title string, price long, stock int"
    products = [(1, "p9", "u9", "b", 1, 1), (1, None, "u9", "a", 2, 1), (1, "p1", "u7", "t", 3, 1)], [(1, "p9", "u9", "a", 4, 0), (1, "p9", "u9", None, 5, 0), (1, "p1", "u8", "t", 6, 1)]
    plans, folder = [], f"{tmp_path}/in"

    def plan(stream):
        made = K.sightings(skus, stream)
        plans.append(made.rows._jdf.queryExecution().analyzed().toString())
        return made

    for part in products:
        K.landed(spark.createDataFrame(part, schema), 1, folder=folder)
        log = K.drained(spark, folder, spark.createDataFrame([], schema).schema, plan, f"{tmp_path}/out", f"{tmp_path}/state")
    assert all("Python" not in p and "TransformWithState" not in p for p in plans)
    last = {r.key_url: (r.known, r.p_pid, r.p_url, r.p_title, r.p_price) for r in log.orderBy("number").collect()}
    assert last == {"u9": (False, "p9", "u9", None, 5), "u1": (True, "p1", "u7", "t", 3)}


class Calls:
    """A state that counts what is asked of it."""

    def __init__(self, *_):
        self.value, self.n = None, 0

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n += 1
        self.value = value


def test_a_key_has_two_calls_to_its_state_however_many_rows():
    state, life = Calls(), K.Misses()
    life.init(state)
    day = K.DAY_MS * 1000
    spans = [Row(us=[k * day + 1, k * day + 2], id=[2 * k, 2 * k + 1], kind=["gone", "ok" if k < 50 else "blocked"]) for k in range(60)]
    out = list(life.handleInputRows((7,), iter(spans[::-1]), None))
    assert state.n == 2 and [(r.id, r.action) for r in out[-3:]] == [(100, "missed"), (102, "missed"), (104, "dead")]


def test_a_life_goes_on_over_micro_batches(spark, tmp_path):
    """Spans are handed over in several micro-batches, and after a restart; a row that is late, but not too late, is put in order."""
    day = 86_400
    folder, got = f"{tmp_path}/in", []
    files = [[(1, 1, T0, "gone"), (1, 3, T0 + 2 * day, "gone")], [(1, 2, T0 + day + 7200, "seen"), (1, 4, T0 + 5 * day, "gone")], [(1, 5, T0 + 9 * day, "gone"), (1, 6, T0 + 12 * day, "gone")], [(-1, 0, T0 + 40 * day, "ok")]]
    for part in files:
        rows = timed(spark, part, "key long, id long, at long, kind string")
        K.landed(rows, 1, folder=folder)
        log = K.drained(spark, folder, rows.schema, lambda s: K.misses(s, "2 days", "3 hours"), f"{tmp_path}/out", f"{tmp_path}/state")
        got.append(sorted((r.id, r.action) for r in log.collect()))
    assert got[-1] == [(1, "missed"), (3, "flagged"), (4, "missed"), (5, "missed"), (6, "dead")] and [] in got[:2] and got[2] not in (got[0], got[3])
