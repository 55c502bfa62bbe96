import hashlib
import random

import pytest

from stratacat.llm import common as C
from stratacat.llm import substrings as S

from .cases import ROWS, documents


def brute(rows, width=S.WIDTH):
    """``(doc_id, n_words, n_removed, sha256 of the kept words)`` of each row, by a table of all windows."""
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in texts:
        gone = set()
        if d is not None:
            for i in range(len(w) - width + 1):
                if least[tuple(w[i : i + width])] < d:
                    gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed=3, n=60):
    """Documents that share passages of 40 to 130 words at different places, near copies, and repeated words."""
    rng = random.Random(seed)
    shared = [[f"s{k}w{i}" for i in range(40 + 15 * k)] for k in range(7)]
    rows = []
    for d in range(n):
        w = [f"d{d}w{i}" for i in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            w += rng.choice(shared) + [f"d{d}x{rng.randrange(99)}" for _ in range(rng.randrange(12))]
        if d % 7 == 0:
            w += ["la"] * rng.choice((49, 50, 51, 400))
        rows.append((100 + rng.randrange(10**4), " ".join(w)))
    base = [f"n{i}" for i in range(300)]
    for d in range(25):
        w = list(base)
        w[rng.randrange(300)] = f"c{d}"
        rows.append((20_000 - d, "\n".join(w)))
    return rows


def got(spark, tmp_path, rows):
    documents(spark, [(d, t, "en", "x", 0) for d, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.query(spark, str(tmp_path)).collect()], key=str)


@pytest.mark.parametrize("most, levels", [(S.MOST, S.LEVELS), (3, 2), (0, 0)])
def test_query_matches_all_windows(spark, tmp_path, monkeypatch, most, levels):
    """Also with crowded buckets at once: dealt out again, then counted by digests."""
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "LEVELS", levels)
    rows = [(r[0], r[1]) for r in ROWS] + passages() + [(7, " ".join(f"s6w{i}" for i in range(130))), (7, " ".join(f"s5w{i}" for i in range(100)))]
    assert got(spark, tmp_path, rows) == brute(rows)


def test_windows_of_one_word(spark, tmp_path):
    """Very long runs of one word are cut into strings of bounded length."""
    rows = [(5, "la " * 3000), (3, "la " * 1000), (9, "la " * 60 + "x " + "la " * 49), (1, "la " * 49)]
    assert got(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert got(spark, tmp_path, []) == []


def test_clean_keeps_columns_and_other_texts(spark):
    text = "  ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (2, "before " + text + "\nafter\tthat", "en", "a", 1), (3, " a  b ", "en", "a", 1), (None, text, "en", "a", 1), (4, None, "en", "a", 1)]
    out = S.clean(documents(spark, rows))
    assert out.columns == documents(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, text), (2, "before after that"), (3, " a  b "), (None, text), (4, None)], key=str)


def test_bucket_follows_from_the_window_alone():
    rng = random.Random(4)
    a = [b"a%d" % rng.randrange(40) for _ in range(400)]
    b = [b"b%d" % i for i in range(33)] + a[57:211] + [b"c"]

    def buckets(w):
        out = {}
        for s, e, k in zip(*S.super_kmers(w), strict=True):
            out |= {i: k for i in range(s, e)}
        assert sorted(out) == list(range(len(w) - S.WIDTH + 1))
        return out

    x, y = buckets(a), buckets(b)
    assert all(x[57 + i] == y[33 + i] for i in range(211 - 57 - S.WIDTH + 1))


def test_no_text_moves_without_a_shared_bucket(spark):
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(200)), "en", "a", 1) for k in range(5)]
    docs = documents(spark, rows)
    assert S.ranges(docs, C.cut(S.profile(docs))).count() == 0
