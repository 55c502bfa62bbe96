"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Eight heuristics vote good, bad or nothing on every document (Spark functions). Seven of them take their cut points from the
unlabelled corpus itself: a value is bad that lies ``FAR`` interquartile ranges (at least ``FAR`` steps of the labeller) outside the
quartiles of all documents; fixed bounds, which the fences may only tighten, hold where junk is so common that it sets the quartiles.
Texts under ``SHORT`` words are not judged by averages over words, lines or sentences. Documents with the same votes form one
pattern; there are at most 3^8 patterns, whose counts over all documents are gathered on the driver. Expectation-maximisation
estimates, per class, how often each labeller votes for good and bad (nothing is no vote), and with that every pattern's posterior.
Junk comes in kinds that share no labeller, so two free classes would split junk from junk; a prior of ``ANCHOR`` corpora says that labellers
seldom call a good document bad, a weaker one that each sees a part of the bad ones. The posteriors are the
labels of a linear scorer over hashed byte trigrams (shares of the text's trigrams in ``BUCKETS`` buckets), trained on at most
``TRAIN_PER_CLASS`` confident documents a class in the order of a hash of the ids, and applied to every whole text.

No given labels are used. Defined cases: null and empty texts get the scorer's offset as score and the posterior of their
votes; a null doc_id stays null; repeated rows each give a row, and of rows that share an id the text that comes first by its hash
trains; documents with equal hashes of their ids are taken in the order of the ids; a score equal to the threshold is kept; without confident
documents of both classes the score is the posterior; an empty table gives an empty result; quartiles are approximate (a rank error of at most 1 in 10,000); extra columns are ignored. Texts have no
length limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import quality_rules as Q

BUCKETS, TRAIN_PER_CLASS, CONFIDENT, THRESHOLD = 4096, 1000, 0.9, 0.5
FAR, SHORT, ANCHOR = 6.0, 20, 10.0
GOOD, BAD, NONE = 1, 0, 2


def labellers() -> dict[str, Column]:
    """Votes on a frame that has the quality statistics and ``wq_...`` columns."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(NONE)

    c = F.col
    return {
        "symbols": vote(c("qr_symbols") > 0.3, c("qr_symbols") < 0.02),
        "dup_lines": vote(c("qr_dup_lines") > 0.3, (c("qr_n_lines") >= 3) & (c("qr_dup_lines") == 0)),
        "repeats": vote(c("qr_repeat_words") > 0.3, (c("qr_n_words") >= 50) & (c("qr_repeat_words") < 0.1)),
        "word_length": vote((c("qr_long_words") > 10) | (c("qr_long_words") < 2.5), c("qr_long_words").between(3.5, 7)),
        "capitals": vote(c("qr_upper") > 0.4, c("qr_upper") < 0.1),
        "length": vote(c("qr_n_words") < 5, c("qr_n_words") >= 100),
        "shouting": vote(c("wq_shouts") > 0.2 * c("qr_n_words"), c("wq_shouts") * 50 < c("qr_n_words")),
        "sentences": vote(c("wq_stops") * 60 < c("qr_n_words"), (c("wq_stops") * 30 > c("qr_n_words")) & (c("wq_stops") * 3 < c("qr_n_words"))),
    }


#: Labeller with a fence: its value, least spread, bounds of the lower and the upper fence (null: none).
def measures() -> dict[str, tuple[Column, float, float | None, float]]:
    c = F.col
    per_word = lambda x: F.when(c("qr_n_words") > 0, c(x) / c("qr_n_words")).otherwise(0.0)
    return {
        "symbols": (c("qr_symbols"), 0.01, None, 0.3),
        "dup_lines": (c("qr_dup_lines"), 0.05, None, 0.3),
        "repeats": (c("qr_repeat_words"), 0.025, None, 0.3),
        "word_length": (c("qr_long_words"), 0.2, 2.5, 10.0),
        "capitals": (c("qr_upper"), 0.005, None, 0.4),
        "shouting": (per_word("wq_shouts"), 0.01, None, 0.2),
        "sentences": (per_word("wq_stops"), 0.01, 1 / 60, 1 / 3),
    }


def fences(stat: DataFrame) -> dict[str, tuple[float | None, float]]:
    """Lower and upper fence of every measure, by one aggregate over all documents."""
    found = stat.agg(*[F.percentile_approx(value, [0.25, 0.75], 10_000).alias(k) for k, (value, *_) in measures().items()]).first()
    out = {}
    for k, (_, step, low, high) in measures().items():
        q1, q3 = found[k] or (0.0, 0.0)
        reach = FAR * max(q3 - q1, step)
        out[k] = (None if low is None else max(low, q1 - reach), min(high, q3 + reach))
    return out


def fenced(limits: dict[str, tuple[float | None, float]]) -> dict[str, Column]:
    """Votes by fences: bad outside, good inside; what a text is too short for, none."""
    short = F.col("qr_n_words") < SHORT
    out = {"length": labellers()["length"]}
    for k, (value, *_) in measures().items():
        low, high = limits[k]
        vote = F.when((value > high) | (F.lit(False) if low is None else value < low), BAD).otherwise(GOOD)
        if k == "dup_lines":
            vote = F.when(short | ((F.col("qr_n_lines") < 3) & (vote == GOOD)), NONE).otherwise(vote)
        elif k in ("word_length", "capitals", "sentences"):
            vote = F.when(short, NONE).otherwise(vote)
        out[k] = vote
    return {k: out[k] for k in labellers_names()}


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, wq_text`` (hash of the text) and what the labellers look at, for every row."""
    stat = Q.with_statistics(Q.with_features(docs.select("doc_id", "text")))
    text = F.coalesce("text", F.lit(""))
    more = stat.withColumns({"wq_shouts": F.regexp_count(text, F.lit("!")), "wq_stops": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D.][.](?:[\x20\x09-\x0D]|$)"))})
    return more.select("doc_id", _key().alias("wq_text"), "qr_n_words", "qr_n_lines", "qr_symbols", "qr_dup_lines", "qr_repeat_words", "qr_long_words", "qr_upper", "wq_shouts", "wq_stops")


def with_votes(stat: DataFrame, limits: dict[str, tuple[float | None, float]] | None = None) -> DataFrame:
    """``doc_id, wq_text, wq_pattern`` (one digit per labeller) of rows of :func:`statistics`, by ``limits`` or, without them, by the fixed bounds."""
    rules = labellers() if limits is None else fenced(limits)
    return stat.select("doc_id", "wq_text", F.concat(*[v.cast("string") for v in rules.values()]).alias("wq_pattern"))


def votes(docs: DataFrame) -> DataFrame:
    """Votes by the fixed bounds."""
    return with_votes(statistics(docs))


def estimate(patterns: dict[str, int], rounds: int = 100, anchor: float = 0.0) -> tuple[dict[str, float], list[dict]]:
    """Posterior of "good" per pattern, and each labeller's shares of bad and good votes per class (abstentions left out).

    ``anchor``: the weight, in corpora, of a prior by which good documents get good votes; a hundredth of it says that a
    labeller calls a fourth of the bad documents bad, so that documents without a bad vote can't fill both classes.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, []
    votes_ = np.array([[int(x) for x in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    good, bad = (votes_ == GOOD).sum(axis=1), (votes_ == BAD).sum(axis=1)
    # the first guess: bad votes are rarer and count double
    post = 1 / (1 + np.exp(-(good - 2.0 * bad)))
    for _ in range(rounds):
        share, rates = [], np.zeros((2, votes_.shape[1], 2))
        for cls, p in ((1, post), (0, 1 - post)):
            w = n * p
            share.append((w.sum() + 1) / (n.sum() + 2))
            for v in (BAD, GOOD):
                rates[cls, :, v] = ((votes_ == v) * w[:, None]).sum(axis=0)
            # a vote for the class is a little likelier from the start, which keeps the classes' meaning
            rates[cls] += 0.5
            rates[cls, :, GOOD if cls else BAD] += 1
            rates[cls] += anchor * n.sum() * (np.array([0.0, 1.0]) if cls else np.array([0.25, 0.75]) / 100)
            rates[cls] /= rates[cls].sum(axis=1, keepdims=True)
        columns = np.arange(votes_.shape[1])
        logs = [np.log(s) + np.where(votes_ == NONE, 0, np.log(rates[cls][columns, np.minimum(votes_, GOOD)])).sum(axis=1) for cls, s in ((1, share[0]), (0, share[1]))]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    table = [{"labeller": k, "good": rates[1, i].tolist(), "bad": rates[0, i].tolist()} for i, k in enumerate(labellers_names())]
    return dict(zip(keys, post.tolist(), strict=True)), table


def labellers_names() -> list[str]:
    return ["symbols", "dup_lines", "repeats", "word_length", "capitals", "length", "shouting", "sentences"]


def trigrams(text: str | None) -> np.ndarray:
    """The bucket of every byte trigram."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    with np.errstate(over="ignore"):
        return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)  # the top 12 bits


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.column("text"):
            k = trigrams(t.as_py())
            rows.append((np.bincount(k, minlength=BUCKETS) / max(1, len(k))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(rows, pa.list_(pa.float32()))], ["y", "x"])


def _fit(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels; trigram shares are scaled by their spread. Accelerated gradient steps."""
    scale = (1 / (x.std(axis=0) + 1e-4)).astype(np.float32)
    mean = x.mean(axis=0)
    z = (x - mean) * scale
    size = 4 / (np.einsum("ij,ij->i", z, z).mean() + 1)
    w, v, b, vb = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 0.0, 0.0
    for t in range(steps):
        ahead, ahead_b = w + t / (t + 3) * v, b + t / (t + 3) * vb
        g = (1 / (1 + np.exp(-np.clip(z @ ahead + ahead_b, -30, 30))) - y).astype(np.float32)
        nw, nb = (ahead - size * (g @ z / len(y) + reg * ahead)).astype(np.float32), ahead_b - size * float(g.mean())
        v, vb, w, b = nw - w, nb - b, nw, nb
    return (w * scale).astype(float), float(b - (mean * scale) @ w)


def train(docs: DataFrame, posterior: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights per bucket and offset. ``posterior``: ``doc_id, p``."""
    order = F.xxhash64("doc_id")
    sure = posterior.filter(F.col("doc_id").isNotNull())
    chosen = C.cut(sure.filter(F.col("p") >= CONFIDENT).orderBy(order, "doc_id").limit(TRAIN_PER_CLASS).unionByName(sure.filter(F.col("p") <= 1 - CONFIDENT).orderBy(order, "doc_id").limit(TRAIN_PER_CLASS)))
    picked = chosen.groupBy("doc_id").agg(F.avg("p").alias("y"))  # at most 2 * TRAIN_PER_CLASS rows
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", _key()).alias("text"))
    rows = texts.orderBy("doc_id").select("y", "text").mapInArrow(_features, "y double, x array<float>").toArrow()  # bounded; numbers stay packed
    y = rows.column("y").to_numpy()
    if not len(y) or y.min() > 0.5 or y.max() < 0.5:
        return None
    return _fit(rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), BUCKETS), y)


def classify(docs: DataFrame) -> DataFrame:
    """``doc_id, votes, posterior, score, kept`` for every row of ``docs``."""
    stat = C.cut(statistics(docs))
    found = C.cut(with_votes(stat, fences(stat)))
    counts = {r.wq_pattern: r.n for r in found.groupBy("wq_pattern").agg(F.count("*").alias("n")).collect()}  # at most 3^8
    post, _ = estimate(counts, anchor=ANCHOR)
    table = docs.sparkSession.createDataFrame(sorted(post.items()), "wq_pattern string, p double")
    model = train(docs, found.join(F.broadcast(table), "wq_pattern").select("doc_id", "p"))
    weights, offset = model if model else (np.zeros(BUCKETS), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column("text"):
                k = trigrams(t.as_py())
                margin = offset + (weights[k].mean() if len(k) else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(margin, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "wq_text")), pa.array(out, pa.float64())], ["doc_id", "wq_text", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", _key().alias("wq_text"), "text").mapInArrow(run, f"doc_id {kind}, wq_text long, score double")
    # rows that repeat have the same votes, so one row for each id and text is enough
    one = found.distinct().join(F.broadcast(table), "wq_pattern").withColumnsRenamed({"doc_id": "wq_id", "wq_text": "wq_text2"})
    both = scored.join(one, F.col("doc_id").eqNullSafe(F.col("wq_id")) & (F.col("wq_text") == F.col("wq_text2")), "left")
    final = F.col("score") if model else F.col("p")
    return both.select("doc_id", F.col("wq_pattern").alias("votes"), F.col("p").alias("posterior"), final.alias("score"), (final >= THRESHOLD).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.table(spark, sf_dir, "documents"))
