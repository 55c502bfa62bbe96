"""Toxicity by a support vector machine over a gapped subsequence string kernel, with Nystrom landmarks.

Two words are compared by the three-letter subsequences that they share; a subsequence that spans s letters (at most
``SPAN``) weighs ``DECAY`` ** s, so inserted letters cost little. Word ends count as letters. Three or more single letters in a
row are read as one more word, so that spelled-out insults meet their landmarks. A word is read without the marks at its ends, and also
without those inside it. Landmark words are taken from the
labelled sentences: words that toxic documents hold far more often, spread by a greedy pass; of a word beyond ``LONG`` letters every window is a
candidate. Copies of a toxic document (equal least hash of its words) count once there, so that one text's own words don't crowd out
the words that many texts share. A document's kernel with a landmark is the best of its words' normalised kernels (values under ``FLOOR`` count as 0), raised to
``POWER``: products of kernels are kernels, and words that are merely alike fall behind equal ones. The
inverse square root of the landmarks' own kernel matrix turns these into features, on which a linear squared-hinge machine is
trained. Its margin becomes a probability by a fitted sigmoid that restores the labels' own class shares.

Training takes at most ``TRAIN_PER_CLASS`` labelled documents a class, in the order of a hash of their ids, none of them held
out; of rows that share an id the text that comes first by its hash. Labels, language, source and ids are no inputs of a score.

Defined cases: null and empty texts have no words and get the score of an empty document; a null doc_id stays null and is
not held out; repeated rows each give a row; of several labels for one document the largest counts; with no labelled
document of a class every score is that of the other class (0.5 without labels); words with one score are taken in their own order; an
empty table gives an empty result; extra columns are ignored. Texts have no length limit: words beyond ``LONG`` letters are read in
overlapping windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPAN, DECAY, FLOOR, LONG = 5, 0.7, 0.3, 40
LANDMARKS, TRAIN_PER_CLASS, CANDIDATES = 96, 3000, 1500
POWER, FOLDS = 2, 5
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_TABLE = 1 << 20
_REMEMBERED = 300_000


def windows(word: str) -> list[str]:
    """The word, or overlapping windows that cover it, with marked ends."""
    word = f"\x02{word}\x03"
    return [word] if len(word) <= LONG else [word[i : i + LONG] for i in range(0, len(word) - LONG // 2, LONG // 2)]


_SPELLED = re.compile(r"(?<!\S)\w(?:\s+\w(?!\S)){2,}")


def words_of(text: str | None) -> set[str]:
    """The words, lower-cased, and what runs of single letters spell."""
    low = (text or "").lower()
    return {*low.split(), *("".join(m.split()) for m in _SPELLED.findall(low))}


_MARKS = r"[^\p{L}\p{M}\p{N}]+"
_ENDS = f"^{_MARKS}|{_MARKS}$"
_marks, _ends = regex.compile(_MARKS), regex.compile(_ENDS)


def readings(word: str) -> set[str]:
    """The word without the marks at its ends, and without any; a word of marks alone as it is."""
    core = _ends.sub("", word)
    return {core, _marks.sub("", core)} if core else {word}


def subsequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all three-letter subsequences: which text, a hash, the weight. Texts are laid out flat, apart by SPAN zeros."""
    flat = np.frombuffer(("\0" * SPAN).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + SPAN)
    out = []
    with np.errstate(over="ignore"):
        for a, b in _GAPS:
            n = len(flat) - b
            if n <= 0:
                continue
            x, y, z = flat[:n], flat[a : a + n], flat[b : b + n]
            ok = np.flatnonzero((x != 0) & (y != 0) & (z != 0) & (owner[:n] == owner[b : b + n]))
            h = (x[ok] * np.uint64(0x9E3779B97F4A7C15)) ^ (y[ok] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (z[ok] * np.uint64(0x165667B19E3779F9))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((owner[ok], (h >> np.uint64(44)).astype(np.int64), np.full(len(ok), DECAY ** (b + 1))))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Kernel:
    """Normalised kernels of words with the landmarks (words with marked ends, or windows of them)."""

    def __init__(self, landmarks: list[str], marked: bool = False):
        self.landmarks = landmarks = landmarks if marked else [p for x in landmarks for p in windows(x)]
        who, h, weight = subsequences(landmarks)
        keys, row = np.unique(h, return_inverse=True)
        table = np.zeros((len(keys) + 1, len(landmarks)), np.float32)  # row 0: not in any landmark
        np.add.at(table, (row + 1, who), weight)
        norms = np.sqrt((table**2).sum(axis=0))
        self.table = table / np.where(norms > 0, norms, 1)
        self.place = np.zeros(_TABLE, np.int32)
        self.place[keys] = np.arange(1, len(keys) + 1)

    def of(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per landmark."""
        parts = [(k, p) for k, w in enumerate(words) for p in windows(w)]
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        np.maximum.at(out, np.fromiter((k for k, _ in parts), np.int64, len(parts)), self.of_parts([p for _, p in parts]))
        return out

    def of_parts(self, texts: list[str]) -> np.ndarray:
        """One row per marked word or window. Its norm counts places, a landmark's counts kinds of subsequences: letters that repeat around an insult don't hide it."""
        who, h, weight = subsequences(texts)
        norms = np.sqrt(np.bincount(who, weight**2, len(texts)))
        sums = np.zeros((len(texts), len(self.landmarks)), np.float32)
        at = self.place[h]
        hit = np.flatnonzero(at)
        if len(hit):
            order = hit[np.argsort(who[hit], kind="stable")]
            first = np.flatnonzero(np.diff(who[order], prepend=-1))
            sums[who[order][first]] = np.add.reduceat(self.table[at[order]] * weight[order, None].astype(np.float32), first, axis=0)
        sums /= np.where(norms > 0, norms, 1)[:, None]
        return np.minimum(sums, 1)


class Documents:
    """Kernels of documents with the landmarks, remembering words."""

    def __init__(self, landmarks: list[str]):
        self.kernel, self.known = Kernel(landmarks, marked=True), {}

    def of(self, texts: list[str | None]) -> np.ndarray:
        sets = [words_of(t) for t in texts]
        out = np.zeros((len(texts), len(self.kernel.landmarks)), np.float32)
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        new = {w: readings(w) for s in sets for w in s if w not in self.known}
        names, found = list({r for s in new.values() for r in s}), {}
        for i in range(0, len(names), 2000):
            some = names[i : i + 2000]
            rows = self.kernel.of(some)
            for k in np.flatnonzero(rows.max(axis=1) >= FLOOR):
                found[some[k]] = np.where(rows[k] >= FLOOR, rows[k], 0)
        for w, s in new.items():
            rows = [found[r] for r in s if r in found]
            self.known[w] = np.max(rows, axis=0) if rows else None
        for k, s in enumerate(sets):
            rows = [r for w in s if (r := self.known[w]) is not None]
            if rows:
                out[k] = np.max(rows, axis=0)
        return out


def _kernels(landmarks: list[str], finish, names: list[str]):
    """An Arrow function that gives ``finish(kernels)`` beside the id columns."""
    opened: list[Documents] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened.append(Documents(landmarks))
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                done = finish(opened[0].of(part.column("text").to_pylist()) ** POWER)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), *done], [*(c for c in part.schema.names if c != "text"), *names])

    return run


def _pick(candidates: list[tuple[str, float]], many: int) -> list[str]:
    """Greedily the best-scored words of which none is too much like a chosen one; then the best of the rest."""
    names = list(dict.fromkeys(x for w, _ in candidates for x in windows(w)))
    chosen: list[int] = []
    nearest = np.zeros(len(names), np.float32)  # kernel with the nearest chosen word
    for limit in (0.6, 0.8, 1.1):
        for k, name in enumerate(names):
            if len(chosen) < many and k not in chosen and nearest[k] < limit:
                chosen.append(k)
                nearest = np.maximum(nearest, Kernel([name], marked=True).of_parts(names)[:, 0])
    return [names[k] for k in chosen]


def _machine(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Squared-hinge linear machine (last weight: the offset) by Newton steps over the rows inside the margin; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    ridge = np.diag([reg] * (x.shape[1] - 1) + [1e-9])
    last = None
    for _ in range(steps):
        inside = y * (x @ w) < 1
        if last is not None and (inside == last).all():
            break
        last = inside
        a = x[inside] * weight[inside, None]
        w = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
    return w


def _sigmoid(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the probability of class 1, by Newton's method on smoothed targets."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-6
        step = np.linalg.solve(h, x.T @ (weight * (target - p)))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """Landmarks, weights of the kernels, offset: the score is the sigmoid of their sum."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return [], np.zeros(0), 6.0 if 1 in shares else -6.0 if shares else 0.0
    order = F.xxhash64(F.col("doc_id"))
    sample = C.cut(known.filter("y = 1").orderBy(order, "doc_id").limit(TRAIN_PER_CLASS).unionByName(known.filter("y = 0").orderBy(order, "doc_id").limit(TRAIN_PER_CLASS)))
    texts = C.cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")))  # at most 2 * TRAIN_PER_CLASS rows
    sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return [], np.zeros(0), 6.0 if 1 in sizes else -6.0 if sizes else 0.0
    core = F.transform(C.words(F.lower("text")), lambda w: F.coalesce(F.nullif(F.regexp_replace(w, _ENDS, ""), F.lit("")), w))
    held = texts.select("y", F.array_distinct(core).alias("words")).withColumn("copy", F.array_min(F.transform("words", lambda w: F.xxhash64(w))))
    toxic = held.filter("y = 1").agg(F.count_distinct("copy")).first()[0]
    words = held.select("y", "copy", F.explode("words").alias("w")).groupBy("w").agg(F.count_distinct(F.when(F.col("y") == 1, F.col("copy"))).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (sizes[0] + 1))
    score = (odds * F.sqrt("a")).alias("score")
    least = max(2, sizes[1] // 50)
    top = words.filter((F.col("a") >= least) & (odds > 1)).select("w", score).orderBy(F.desc("score"), "w").limit(CANDIDATES).collect()
    landmarks = _pick([(r.w, r.score) for r in top], LANDMARKS)
    if not landmarks:
        return [], np.zeros(0), float(np.log(shares[1] / shares[0]))
    run = _kernels(landmarks, lambda k: [pa.array(list(k.astype(float)), pa.list_(pa.float64()))], ["k"])
    rows = texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, k array<double>").orderBy("doc_id").toArrow()  # bounded; numbers stay packed
    y = np.where(rows.column("y").to_numpy() > 0, 1.0, -1.0)
    x = rows.column("k").combine_chunks().flatten().to_numpy().reshape(len(y), len(landmarks))
    own = Kernel(landmarks, marked=True).of_parts(landmarks).astype(float)
    values, vectors = np.linalg.eigh(((own + own.T) / 2) ** POWER)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    z = x @ root
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        test = np.arange(len(y)) % FOLDS == k
        w = _machine(z[~test], y[~test])
        margin[test] = z[test] @ w[:-1] + w[-1]
    total = shares[0] + shares[1]
    prior = np.where(y > 0, shares[1] / total / max(1, (y > 0).sum()), shares[0] / total / max(1, (y < 0).sum())) * len(y)
    slope, offset = _sigmoid(margin, y, prior)
    w = _machine(z, y)
    return landmarks, slope * (root @ w[:-1]), slope * w[-1] + offset


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    landmarks, weights, offset = train(docs, labels)

    def finish(k: np.ndarray) -> list[pa.Array]:
        return [pa.array(1 / (1 + np.exp(-np.clip(k.astype(float) @ weights + offset, -500, 500))), pa.float64())]

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(_kernels(landmarks or ["\x02"], finish if landmarks else lambda k: [pa.array(np.full(len(k), 1 / (1 + np.exp(-offset))))], ["score"]), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
