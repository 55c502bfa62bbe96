import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratacat.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """All nodes, by a dictionary of all prefixes."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, m in members.items():
        leaves, saved, todo = 0, 0, [p]
        while todo:
            x = todo.pop()
            leaves += x not in children
            saved += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
            todo += children.get(x, [])
        ends = ",".join(str(c) for c in m if paths[c] == p)
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("d"), "a": F.lit("a"), "n": F.lit(1), "owner": F.lit("o")}).repartition(5)
    return sorted((tuple(r) for r in T.trie(frame, **more).collect()), key=str)


def conversations(seed=1, n=160):
    """Conversations that share openings of any length, with ties, repeated rows, null values and missing first conversations."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-150, 900), n):
        if c % 100 == 0 and rng.random() < 0.3:
            continue
        long = rng.random() < 0.1
        for t in range(rng.randrange(30, 60) if long else rng.randrange(1, 12)):
            text = rng.choice(["", None, "é🎉"]) if rng.random() < 0.05 else f"t{t}v{rng.randrange(2) if rng.random() < 0.25 else 0}"
            rows.append((c, rng.choice([None, t, t, t, t, 3]), rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", text))
            if rng.random() < 0.03:
                rows.append(rows[-1])
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(40) for t in range(7)] + [(None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_nodes_match_all_prefixes(spark, block):
    rows = conversations(block)
    assert got(spark, rows, block=block) == brute(rows)


def test_deep_and_turnless(spark):
    """A staircase of prefixes, and conversations that lose all their turns."""
    rows = [(5000 + k, t, "user", f"x{t}") for k in range(30) for t in range(k + 1)] + [(5000, t, "user", f"y{t}") for t in range(90)]
    rows += [(c, 0, "user", "only") for c in range(7001, 7030)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)


def test_many_ends_are_hashed_in_parts(spark, monkeypatch):
    rows = [(9000 + k, 0, "user", "hello") for k in range(700)] + [(9000 + k, t, "user", f"t{t}") for k in range(0, 700, 100) for t in range(1, 9)]
    want = brute(rows)
    assert got(spark, rows) == want
    packs = []
    monkeypatch.setattr(T, "PACK", 7)
    for part in T._pack(iter([__import__("pyarrow").RecordBatch.from_pydict({"depth": [1] * 20, "a": [2] * 20, "b": [3] * 20, "conv_id": list(range(20))})])):
        packs += part.to_pylist()
    assert [p["first"] for p in packs] == [0, 7, 14] and ",".join(p["ids"] for p in packs) == ",".join(map(str, range(20)))
    batch = __import__("pyarrow").RecordBatch.from_pydict({c: [p[c] for p in packs] for c in ("depth", "a", "b", "ids")})
    assert [r["ends_sha256"] for b in T._hash(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()] == [hashlib.sha256(",".join(map(str, range(20))).encode()).hexdigest()]


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


def test_running_sums_split_a_key(spark):
    """One key over all parts."""
    rows = [(1 if k % 9 else k, k, 1) for k in range(3000)]
    frame = spark.createDataFrame(rows, "key long, at long, one long").repartition(6)
    out = T.running(frame, "key", ["at"], ["one"]).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r.key, r["at"])):
        assert r.before_one == seen.get(r.key, 0)
        seen[r.key] = seen.get(r.key, 0) + 1
