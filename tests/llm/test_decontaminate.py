import random
from itertools import combinations

from stratacat.llm import decontaminate as D

from .cases import documents

ITEM = " ".join(f"bench{i}" for i in range(30))
SHORT = "six rare words stand right here"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(text, items):
    """Items with an alignment in which AROUND (or all) words around some window agree well enough."""
    w, out = (text or "").lower().split(), []
    for key, item in items:
        v = (item or "").lower().split()
        if len(v) < D.MIN_WORDS:
            if v and v == w:
                out.append(key)
            continue
        wide = min(len(v), D.AROUND)
        hit = False
        for d in range(-len(v) + 1, len(w)):
            same = [0 <= d + q < len(w) and w[d + q] == v[q] for q in range(len(v))]
            if len(v) < D.WHOLE:
                hit |= all(same)
            else:
                hit |= any(sum(same[q : q + wide]) >= D.NEED * wide for q in range(len(v) - wide + 1))
        if hit:
            out.append(key)
    return out


def test_overlaps(spark):
    words = ITEM.split()
    one_off = [*words[:9], "CHANGED", *words[10:]]
    texts = {
        1: "clean text " * 30, 2: "before " + ITEM.upper() + " after", 3: " ".join(["x", *one_off, "y"]), 4: "a b " + " ".join(words[5:25]) + " c", 5: "tell " + SHORT + " now", 6: SHORT.replace("rare", "common"),
        7: " ".join(words[:8]), 8: None, 9: "", 10: " ".join(words[i] if i % 3 else "z" for i in range(30)),
    }
    docs = documents(spark, [(k, t, "en", "x", 0) for k, t in texts.items()] + [(2, texts[2], "en", "x", 0)])
    items = [(1, ITEM), (2, SHORT), (3, "too few"), (4, None), (5, ITEM)]
    for bound in (D.BROADCAST_WINDOWS, 0):  # both ways to join
        got = {}
        for r in D.overlaps(docs, bench(spark, items), broadcast_windows=bound).collect():
            got.setdefault(r.doc_id, set()).add(r.item_id)
        assert got == {k: set(b) for k, t in texts.items() if (b := brute(t, items))}
    kept = D.clean(docs, bench(spark, items))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 6, 7, 8, 9, 10]
    assert D.clean(docs, bench(spark, [])).count() == docs.count()


def test_every_single_substitution_leaves_a_mask():
    assert all(any(p not in m for m in D.MASKS) for p in range(D.SPAN))


def test_null_ids_stay(spark):
    docs = documents(spark, [(None, ITEM, "en", "x", 0), (None, "fine", "en", "x", 0)])
    assert [r.text for r in D.clean(docs, bench(spark, [(1, ITEM)])).collect()] == ["fine"]


def test_benchmark_rows_stay_small(spark, monkeypatch):
    """Neither long items nor seeds that many items share make a row of the benchmark's windows larger."""
    shared = " ".join(f"say{i}" for i in range(20))
    items = [(k, shared + " " + " ".join(f"i{k}w{j}" for j in range(400))) for k in range(12)]
    seen, cut = [], D.C.cut
    monkeypatch.setattr(D.C, "cut", lambda df: seen.append(df) or cut(df))
    docs = documents(spark, [(1, items[3][1], "en", "x", 0), (2, "fine", "en", "x", 0)])
    got = {(r.doc_id, r.item_id) for r in D.overlaps(docs, bench(spark, items)).collect()}
    assert got == {(1, k) for k in range(12)}
    assert seen and all(df.selectExpr("max(length(to_json(struct(*)))) AS n").first().n < 1_000 for df in seen)


def test_every_change_that_the_rule_accepts_leaves_a_mask():
    shapes = [[o - m[0] for o in m] for m in D.MASKS]
    for n in range(D.SPAN, D.AROUND + 1):
        changes = n - next(k for k in range(n + 1) if k >= D.NEED * n)
        for gone in combinations(range(n), changes):
            assert any(all(p + o < n and p + o not in gone for o in m) for m in shapes for p in range(n))


def test_changed_items_against_brute_force(spark):
    rng = random.Random(5)
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in range(13, 27)] + [(90, "some other words " * 6)]
    texts = {1000: " ".join(f"i20w{j}" if j not in (9, 10) else "new" for j in range(20)), 1001: " ".join(f"i16w{j}" for j in range(4, 16)), 1002: " ".join(f"i16w{j}" for j in range(3, 16))}
    for n, item in items[:-1]:
        for k in range(16):
            words = item.split()
            for place in rng.sample(range(n), 2 + k % 4):
                words[place] = "new"
            texts[n * 20 + k] = " ".join([*["pad"] * (k % 3), *words, *["end"] * (k % 2)])
    want = {(k, i) for k, t in texts.items() for i in brute(t, items)}
    assert (1000, 20) in want and (1002, 16) in want and 100 < len(want) < len(texts)
    docs = documents(spark, [(k, t, "en", "x", 0) for k, t in texts.items()])
    for bound in (D.BROADCAST_WINDOWS, 0):
        assert {(r.doc_id, r.item_id) for r in D.overlaps(docs, bench(spark, items), broadcast_windows=bound).collect()} == want


def test_short_items_against_brute_force(spark):
    """Items of 5 to 12 words with 0 to 3 changed words, and texts that are shorter items."""
    rng = random.Random(8)
    items = [(n, " ".join(f"s{n}w{j}" for j in range(n))) for n in range(1, 13)]
    texts = {}
    for n, item in items:
        for changes in range(4):
            for k in range(6):
                words = item.split()
                for place in rng.sample(range(n), min(n, changes)):
                    words[place] = "new"
                texts[n * 1000 + changes * 100 + k] = " ".join([*["pad"] * (k % 3), *words, *["end"] * (k % 2)])
    want = {(k, i) for k, t in texts.items() for i in brute(t, items)}
    assert {(3000, 3), (8100, 8), (12200, 12)} <= want and (12300, 12) not in want and (3001, 3) not in want
    docs = documents(spark, [(k, t, "en", "x", 0) for k, t in texts.items()])
    for bound in (D.BROADCAST_WINDOWS, 0):
        assert {(r.doc_id, r.item_id) for r in D.overlaps(docs, bench(spark, items), broadcast_windows=bound).collect()} == want


def test_pieces_leave_one_unchanged():
    for n in range(D.WHOLE, D.SPAN):
        changes = n - next(k for k in range(n + 1) if k >= D.NEED * n)
        for gone in combinations(range(n), changes):
            assert any(not set(gone) & set(range(p, p + D.piece(n))) for p in range(n - D.piece(n) + 1))


def test_empty_tables_and_a_very_long_text(spark):
    item = " ".join(f"bench{i}" for i in range(20))
    docs = documents(spark, [(1, "word " * 60_000 + item + " word" * 60_000, "en", "x", 0)])
    assert D.clean(docs, bench(spark, [(1, item)])).count() == 0
    assert D.clean(docs.limit(0), bench(spark, [(1, item)])).count() == 0 == D.mark(docs.limit(0), bench(spark, [])).count()
