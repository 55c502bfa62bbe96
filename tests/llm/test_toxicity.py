import random
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from stratacat.llm import toxicity as T

from .cases import ROWS, documents, labels


def corpus(n=800, seed=2):
    rng = random.Random(seed)
    fine = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rude = ["stinker", "blockhead", "numbskull"]
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(fine) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            word = rng.choice(rude)
            if rng.random() < 0.3:  # with inserted letters
                k = rng.randrange(1, len(word) - 1)
                word = word[:k] + rng.choice(".-_*") + word[k:]
            words[rng.randrange(60)] = word
        rows.append((i, " ".join(words), "en", "x", 0))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = corpus()
    out = T.score(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    truth = {d: y for d, _, y in marks}
    held = [r for r in out if r.held_out]
    assert 100 < len(held) < 220
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, marks = corpus(300)
    docs, known = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    other = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in T.score(docs, x).collect()} for x in (known, other))
    assert a == b


def test_awkward_rows(spark):
    for marks in (labels(spark), labels(spark).limit(0), labels(spark).filter("toxic = 1")):
        out = T.score(documents(spark), marks).collect()
        assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert T.score(documents(spark).limit(0), labels(spark)).count() == 0


def test_kernel_likes_inserted_letters():
    k = T.Kernel(["stinker", "garden"]).of(["stinker", "st-inker", "s.t.i.n.k.e.r", "garden", "tulip", "", "x" * 500 + "stinker" + "y" * 300])
    assert k[0, 0] > 0.99 and k[3, 1] > 0.99 and k[1, 0] > 0.5 > k[4, 0] and k[2, 0] > k[4, 0] and k[5].max() == 0 and k[6, 0] > 0.2


def test_windows_cover_long_words():
    word = "".join(chr(97 + i % 26) for i in range(333))
    parts = T.windows(word)
    assert all(len(p) <= T.LONG for p in parts) and all(any(word[i : i + 3] in p for p in parts) for i in range(331))


def plain_kernel(word, landmark):
    """The kernel by its definition: all triples of places, gaps included."""

    def places(w):
        w = f"\x02{w}\x03"
        return [(w[i] + w[j] + w[k], T.DECAY ** (k - i + 1)) for i, j, k in combinations(range(len(w)), 3) if k - i < T.SPAN]

    kinds = {}
    for g, n in places(landmark):
        kinds[g] = kinds.get(g, 0) + n
    norms = sum(n * n for _, n in places(word)) ** 0.5 * sum(n * n for n in kinds.values()) ** 0.5
    return min(1, sum(n * kinds.get(g, 0) for g, n in places(word)) / (norms or 1))


def test_kernel_matches_its_definition():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(40)] + ["idiot", "id1ot", "i.d.i.o.t"]
    got = T.Kernel(words[:12]).of(words)
    for i, w in enumerate(words):
        for j, landmark in enumerate(words[:12]):
            assert abs(got[i, j] - plain_kernel(w, landmark)) < 1e-4


def test_marks_around_and_inside_words():
    assert T.readings("..stu.pid!") == {"stu.pid", "stupid"} and T.readings("idiot***") == {"idiot"} and T.readings("###") == {"###"}
    got = T.Documents(T.windows("idiot")).of(["you idiot### there", "i-d-i-o-t!", "###"])
    assert got[0, 0] > 0.99 and got[1, 0] > 0.99 and got[2, 0] == 0


def test_copies_choose_no_landmarks(spark):
    """One toxic text in many near copies: its own words come after an insult that different texts share."""
    rows, marks = corpus(300)
    rng = random.Random(5)
    for i in range(300, 360):
        words = [f"only{k}" for k in range(40)]
        words[rng.randrange(40)] = f"changed{i}"
        rows.append((i, " ".join(words), "en", "x", 0))
        marks.append((i, 1, 1))
    landmarks, _, _ = T.train(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert {x.strip("\x02\x03") for x in landmarks[:3]} == {"stinker", "blockhead", "numbskull"}


def test_scores_match_brute_force(spark):
    """The whole query by its definition: every reading of every word against every landmark."""
    rows, marks = corpus(120)
    rows = [*rows, *((1000 + i, t, "en", "x", 0) for i, t in enumerate([None, "", "s.t.i.n.k.e.r!", "you n u m b s k u l l", "###", "q" * 90 + "stinker"]))]
    docs, known = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    landmarks, weights, offset = T.train(docs, known)
    one = cache(plain_kernel)
    checked = 0
    for r in T.score(docs, known).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        words = {x for w in T.words_of(text) for x in T.readings(w)}
        if any(len(w) > T.LONG - 2 for w in words):
            continue  # windows have their own tests
        k = [max([v for w in words if (v := one(w, m.strip("\x02\x03"))) >= T.FLOOR], default=0.0) for m in landmarks]
        assert abs(r.score - 1 / (1 + np.exp(-(np.array(k) ** T.POWER @ weights + offset)))) < 1e-3
        checked += 1
    assert checked == len(rows) - 1


def test_spelled_out_words():
    assert {"idiot", "you", "are"} <= T.words_of("You are i d i o t") and "ab" not in T.words_of("a b cd")
    got = T.Documents([x for x in T.windows("idiot")]).of(["you i d i o t go", "you are well", None])
    assert got[0, 0] > 0.99 and got[1, 0] == got[2, 0] == 0


def test_long_landmarks_are_whole():
    """Toxic by the end of one long word: beyond the first window."""
    word = "neutralopening" * 4 + "blockheadstinker"
    parts = T._pick([(word, 1.0)], 8)
    assert all(any(word[i : i + 5] in p for p in parts) for i in range(len(word) - 5))
    k = T.Documents(parts).of([f"plain {word} words", "plain " + word[:56], "blockheadstinkers"])
    last = next(i for i, p in enumerate(parts) if "stinker" in p)
    assert k[0].min() > 0.99 and k[2][last] > 0.4 and k[2].argmax() == last
