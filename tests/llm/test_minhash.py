import random

import numpy as np

from stratacat.llm import minhash as M

from .cases import ROWS, documents


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Components over all pairs; rows of one doc_id are one document."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(d, sets_of(t)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        find(a)
        for b, y in sets[:i]:
            if a != b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in sets}


def near_copies(n=60, seed=5):
    """Copies of one text with ever more changed words, so that many pairs lie just beyond the limit, and a chain of neighbours."""
    rng, base, out = random.Random(seed), [f"b{i}" for i in range(150)], []
    for k in range(n):
        w = list(base)
        for _ in range(k % 12):
            w[rng.randrange(150)] = f"c{rng.randrange(10**6)}"
        out.append((1000 + rng.randrange(10**6), " ".join(w)))
    chain = [f"d{i}" for i in range(200)]
    out += [(500 + k, " ".join(chain[k * 6 : k * 6 + 100])) for k in range(12)]
    return out


def test_components_match_all_pairs(spark, tmp_path):
    rows = [(r[0], r[1]) for r in ROWS] + near_copies() + [(3, "second text of document three " * 3), (900, "second text of document three " * 3)]
    documents(spark, [(d, t, "en", "x", 0) for d, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(rows)
    got = M.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((d, want[d]) for d, _ in rows if d is not None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(r.n_shingles for r in got) == sorted(len(sets_of(t)) for _, t in rows)


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    out = M.deduplicate(docs)
    assert out.columns == docs.columns
    # 2 and 3 are (near) copies of 1, 8 of 7
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, None]))
    assert M.deduplicate(docs.limit(0)).count() == 0


def test_sketch_agreement_estimates_similarity():
    make, rng = M.Sketcher(), np.random.default_rng(1)
    for share in (0.3, 0.75):
        for size in (12, 300):
            agree = []
            for _ in range(60):
                h = np.unique(rng.integers(0, 2**64, 2 * size, np.uint64))
                both = round(2 * size * share / (1 + share))
                rest = (size * 2 - both) // 2
                x, y = np.sort(h[rng.permutation(len(h))][: both + rest]), None
                y = np.sort(np.concatenate([rng.permutation(x)[:both], np.setdiff1d(h, x)[:rest]]))
                true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
                agree.append((make.sketch(x) == make.sketch(y)).mean() - true)
            assert abs(np.mean(agree)) < 0.06


def test_bound_never_excludes_a_link(spark):
    rows = [(d, t, "en", "x", 0) for d, t in near_copies(40, 9)]
    got = {r.doc_id: r.component_id for r in M.linked(documents(spark, rows)).collect()}
    assert got == brute([(r[0], r[1]) for r in rows])


def test_near_copies_of_each_text_of_a_document(spark):
    """The full sets are those of the text that gave the bands, whichever row of a doc_id comes first."""
    texts = [[f"t{t}w{i}" for i in range(150)] for t in range(4)]
    rows = [(1, " ".join(t)) for t in texts] + [(10 + k, " ".join([*t[:70], "changed", *t[71:]])) for k, t in enumerate(texts)]
    rows += [(5, "alone " + " ".join(f"x{i}" for i in range(60)))]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.component_id for r in M.linked(documents(spark, [(d, t, "en", "x", 0) for d, t in order]).coalesce(1)).collect()}
        assert got == brute(rows) == {1: 1, 10: 1, 11: 1, 12: 1, 13: 1, 5: 5}
