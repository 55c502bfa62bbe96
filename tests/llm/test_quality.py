import math
from collections import Counter

from pyspark.sql import functions as F

from stratacat.llm import quality_rules as Q
from stratacat.llm import weak_quality as W

from ..oracle import TABLES, same
from .cases import ROWS, documents, labels


def base(text):
    t = text or ""
    w = t.encode().split()
    w = [x.decode() for x in w]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    n_dup = len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), n_dup, len(covered), failed)


TEXTS = ["a b c a b c x", "a a a a", "l1 x\nl1 x\n\n \nl1 x", "### | <a> &", "b c d e b c d " * 40, "\x0b\x0c\x1c x", "\U0001f389 é"]


def test_base_counts(spark, tmp_path):
    rows = ROWS + [(50 + i, t, "en", "x", 0) for i, t in enumerate(TEXTS)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.query(spark, str(tmp_path)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(repr((r.doc_id, *[r[c] for c in names])) for r in got) == sorted(repr((d, *base(t))) for d, t, *_ in rows)
    assert not any(r.kept and r.base_failed for r in got)


def test_binomial_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 10, 500, 3000) for k in (0, 1, 2, 5, 12) if k <= n]
    frame = spark.createDataFrame(cases, "n long, k long").withColumn("p", F.exp(Q._log_tail(F.col("n"), F.col("k"), 0.004)))
    for r in frame.collect():
        want = sum(math.comb(r.n, i) * 0.004**i * 0.996 ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(r.p, want, rel_tol=1e-9)


def stats(spark, rows):
    """Frames with only the columns that cutoffs need."""
    frame = spark.createDataFrame(rows, "doc_id long, lang string, qr_symbols double")
    return frame.withColumns({f"qr_{r}": F.lit(0.0) for r in Q.LADDERS if r != "symbols"} | {"qr_base_failed": F.lit(False)})


def test_cutoffs_hold_the_risk(spark):
    rows = [(i, "en", 0.06 if i % 1000 == 0 else 0.0) for i in range(6000)] + [(10_000 + i, "de", 0.0) for i in range(500)]
    junk = [(20_000 + i, "en", 0.15 if i % 2 else 0.03) for i in range(400)] + [(30_000 + i, "de", 0.4) for i in range(100)]
    labelled = spark.createDataFrame([(r[0], 1) for r in rows] + [(r[0], 0) for r in junk], "doc_id long, quality int")
    cuts = {r.qr_lang: r for r in Q.cutoffs(stats(spark, rows + junk), labelled, risk=0.004).collect()}
    assert cuts["en"].qr_cut_symbols == 0.02  # 6 of 6000 rejections prove less than 0.4 %
    assert cuts["de"].qr_cut_symbols is None  # 500 documents prove nothing
    worse = [(i, "en", 0.06 if i % 100 == 0 else 0.0) for i in range(6000)]
    assert Q.cutoffs(stats(spark, worse + junk), labelled, risk=0.004).filter("qr_lang = 'en'").first().qr_cut_symbols == 0.1
    # what good documents lose weighs more than what bad ones do: 60 good for 400 bad, then 200 bad for none
    assert Q.cutoffs(stats(spark, worse + junk), labelled).filter("qr_lang = 'en'").first().qr_cut_symbols == 0.1
    assert Q.cutoffs(stats(spark, worse + junk), labelled, price=1).filter("qr_lang = 'en'").first().qr_cut_symbols == 0.02


def test_repeated_rows_are_one_trial(spark):
    rows = [(1, "en", 0.0)] * 3000 + [(2, "en", 0.5)] * 1000
    labelled = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.good, r.qr_symbols) for r in Q.trials(stats(spark, rows), labelled).collect()) == [(1, True, 0.0), (2, False, 0.5)]
    assert Q.cutoffs(stats(spark, rows), labelled).first().qr_cut_symbols is None


def test_rules_fire_as_the_oracle_says(spark, tmp_path):
    """Enough labels for every rule to be on in one language; a second one with too few."""
    prose = lambda i: " ".join(f"plain{(i * 7 + k) % 83} word{k}" for k in range(30))
    rows = [(i, prose(i), "en", "x", 0) for i in range(300)] + [(1000 + i, prose(i) + " ### $$$ |||" * 8, "en", "x", 0) for i in range(60)]
    rows += [(2000 + i, prose(i).upper(), "en", "x", 0) for i in range(60)] + [(3000 + i, "\n".join([prose(i), *["same line"] * 6]), "en", "x", 0) for i in range(60)] + [(4000 + i, prose(i) + " ### $$$" * 8, "de", "x", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(r[0], int(r[0] < 1000), 0) for r in rows] + [(r[0], 1, 0) for r in rows[:5]]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for t in set(TABLES) - {"documents", "labels"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    same(spark, Q.query, Q.ORACLE, str(tmp_path))
    by = Counter(r.rejected_by for r in Q.query(spark, str(tmp_path)).collect() if not r.base_failed)
    assert by[""] == 300 + 60 and sum(n for k, n in by.items() if "symbols" in k) == 60 and sum(n for k, n in by.items() if "upper" in k) >= 60 and sum(n for k, n in by.items() if "dup_lines" in k) == 60


def test_keep_returns_documents(spark):
    docs = documents(spark)
    out = Q.keep(docs, labels(spark))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 2, 3]  # the long text repeats itself
    assert Q.keep(docs.limit(0), labels(spark)).count() == 0


def test_weak_labels_find_junk(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 83} plain" for k in range(60)) + ". Then it ends. So be it.", "en", "x", 0) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! $$$ ### " * 20, "en", "x", 0) for i in range(25)]
    odd = [(900, None, "en", "x", 0), (901, "", "en", "x", 0), (None, good[0][1], "en", "x", 0), (0, good[0][1], "en", "x", 0)]
    got = W.classify(documents(spark, good + bad + odd)).collect()
    assert len(got) == len(good) + len(bad) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[r[0]].kept for r in good) and not any(by[r[0]].kept for r in bad)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got)
    assert W.classify(documents(spark).limit(0)).count() == 0


def test_fences_follow_the_corpus(spark):
    """Votes by fences against plain quartiles; the fixed bounds hold where junk sets the quartiles."""
    plain = [(i, " ".join(f"word{(i * 7 + k) % 83} plain" for k in range(30 + i)) + ". It ends.", "en", "x", 0) for i in range(60)]
    odd = [(90, "some words | in | a table | row | " * 20, "en", "x", 0), (91, "short | one", "en", "x", 0), (92, None, "en", "x", 0), (93, "", "en", "x", 0)]
    stat = W.statistics(documents(spark, plain + odd)).cache()
    limits = W.fences(stat)
    rows = {r.doc_id: r for r in stat.collect()}
    for k, column in {"symbols": "qr_symbols", "word_length": "qr_long_words", "capitals": "qr_upper"}.items():
        x = sorted(r[column] for r in rows.values())
        q1, q3 = x[-(-len(x) // 4) - 1], x[-(-3 * len(x) // 4) - 1]
        _, step, low, high = W.measures()[k]
        reach = W.FAR * max(q3 - q1, step)
        assert abs(limits[k][1] - min(high, q3 + reach)) < 1e-9 and (low is None or abs(limits[k][0] - max(low, q1 - reach)) < 1e-9)
    got = {r.doc_id: dict(zip(W.labellers_names(), r.wq_pattern, strict=True)) for r in W.with_votes(stat, limits).collect()}
    assert all(got[r[0]]["symbols"] == "1" and got[r[0]]["capitals"] == "1" for r in plain)
    assert got[90]["symbols"] == got[91]["symbols"] == "0" and got[91]["word_length"] == got[92]["capitals"] == "2" and got[93]["length"] == "0"
    junk = W.fences(W.statistics(documents(spark, [(i, "A! B! ### $$$ C! " * 9, "en", "x", 0) for i in range(40)])))
    assert junk["symbols"] == (None, 0.3) and junk["shouting"][1] == 0.2 and junk["word_length"][0] >= 2.5 - 1e-9
    assert W.fences(stat.limit(0))["symbols"] == (None, W.FAR * 0.01)


def test_kinds_of_junk_stay_one_class():
    """Four kinds of junk, each seen by one labeller: without the anchor two classes split junk from junk."""
    counts = {"1" * 8: 9000, **{"1" * k + "0" + "1" * (7 - k): 200 for k in range(4)}, "12121212": 500, "0" + "2" * 7: 10}
    post, table = W.estimate(counts, anchor=W.ANCHOR)
    assert all(p < 0.1 for k, p in post.items() if "0" in k) and post["1" * 8] > 0.9 and post["12121212"] > 0.9
    assert abs(sum(table[0]["bad"]) - 1) < 1e-9 and table[0]["bad"][W.BAD] > table[5]["bad"][W.BAD]


def test_em_recovers_accuracies():
    import random

    rng, counts = random.Random(1), Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        counts["".join(str((W.GOOD if good else W.BAD) if rng.random() < p else (W.BAD if good else W.GOOD)) for p in (0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9, 0.8))] += 1
    post, table = W.estimate(dict(counts))
    assert abs(table[0]["good"][W.GOOD] - 0.95) < 0.02 and abs(table[5]["good"][W.GOOD] - 0.7) < 0.03
    assert post["1" * 8] > 0.99 > 0.01 > post["0" * 8]


def test_votes_match_plain_rules(spark):
    texts = {
        1: "Plain words stand here. " * 30, 2: "BUY!! NOW!! ### " * 20, 3: None, 4: "one two", 5: "\n".join(["the same line here"] * 12), 6: "wordswithoutanyspacebutlong " * 9, 7: "a b c d e. " * 30,
    }
    got = {r.doc_id: r.wq_pattern for r in W.votes(documents(spark, [(k, t, "en", "x", 0) for k, t in texts.items()])).collect()}
    for k, t in texts.items():
        t = t or ""
        n, chars, symbols, dup, repeats, _ = base(t)
        lines = len([x for x in t.split("\n") if x.split()])
        per = lambda a, b: a / b if b else 0.0
        shouts, stops = t.count("!"), sum(1 for i, c in enumerate(t) if c == "." and i and t[i - 1] not in " \t\n." and (i + 1 == len(t) or t[i + 1] in " \t\n"))
        vote = lambda bad, good: "0" if bad else "1" if good else "2"
        want = [
            vote(per(symbols, n) > 0.3, per(symbols, n) < 0.02), vote(per(dup, lines) > 0.3, lines >= 3 and dup == 0), vote(per(repeats, n) > 0.3, n >= 50 and per(repeats, n) < 0.1),
            vote(per(chars, n) > 10 or per(chars, n) < 2.5, 3.5 <= per(chars, n) <= 7), vote(per(sum(c.isascii() and c.isupper() for c in t), chars) > 0.4, per(sum(c.isascii() and c.isupper() for c in t), chars) < 0.1),
            vote(n < 5, n >= 100), vote(shouts > 0.2 * n, shouts * 50 < n), vote(stops * 60 < n, stops * 30 > n and stops * 3 < n),
        ]
        assert got[k] == "".join(want), (k, got[k], want)


def test_pipeline_of_empty_documents(spark, tmp_path):
    import corpus_pipeline

    documents(spark).limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some words of a benchmark item that nobody holds here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
