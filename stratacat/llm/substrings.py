"""Repeated passages of ``WIDTH`` words, found by partitioning windows into super-k-mers by their minimiser.

A window is ``WIDTH`` consecutive words of one document. Its minimiser is the smallest hash of the runs of ``GRAM`` words
in it, so it depends on the window's words alone and equal windows meet in one bucket. Consecutive windows with the same
minimiser travel as one string, the words that they cover (a super-k-mer). In its bucket the windows of all strings are sorted
as rows of word numbers, and each gets the smallest doc_id among its equals. A word is removed if a window covers it
whose words also start in a document with a smaller doc_id.

Before any text moves, the bucket numbers alone (about one for 24 words) tell which buckets see two documents; only their
super-k-mers are cut. Equal whole texts are one text, and equal strings of a bucket are one string, before they are sorted.
A bucket with more than ``MOST`` different strings (what stands before and after a passage of very many documents) is dealt
out again by minimisers of another hash, up to ``LEVELS`` times; what is crowded even then is counted by 128-bit window digests, with
partial sums, so that no bucket has to fit one task.

Defined cases: null, empty and blank texts have no words; texts under ``WIDTH`` words keep all words; a null doc_id neither
removes words nor loses any; rows that share a doc_id remove nothing from each other; equal windows within one document
remove nothing; a repeated row gets the same result each time; an empty table gives an empty result; extra columns are ignored by
:func:`ranges` and kept by :func:`clean`. Texts have no length limit; a super-k-mer covers ``LONGEST`` windows at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WIDTH, GRAM = 50, 4
LONGEST, MOST, LEVELS = 256, 1000, 3
#: Windows that are sorted together, unless one bucket has more.
CHUNK = 30_000
_KMERS = "p1 long, p2 long, at int, bucket long, digest long, packed string, low long, high long"
_FOUND = "bucket long, digest long, a int, b int, m long"


def _spread(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def super_kmers(words: list[bytes], width: int = WIDTH, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer the first window, the window after its last one, and the bucket."""
    gram = min(GRAM, width)
    count = len(words) - width + 1
    if count < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    odd = np.random.default_rng(1009 + level).integers(1, 2**63, gram, np.int64).astype(np.uint64) | np.uint64(1)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - gram + 1
    with np.errstate(over="ignore"):
        h = w[:n] * odd[0]
        for i in range(1, gram):
            h += w[i : n + i] * odd[i]
    least = np.lib.stride_tricks.sliding_window_view(_spread(h), width - gram + 1).min(axis=1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.append(starts[1:], count)
    if (ends - starts).max() > LONGEST:
        starts = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(starts, ends, strict=True)])
        ends = np.append(starts[1:], count)
    return starts, ends, least[starts].view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sha, buckets = [], [], []
        for text in batch.column("text"):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            buckets.append(super_kmers(words, width)[2])
        found = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(buckets, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("md5"), *found], ["doc_id", "key", "md5", "n", "sha256", "buckets"])


def _cut_up(batches: Iterator[pa.RecordBatch], width: int, level: int) -> Iterator[pa.RecordBatch]:
    """Rows ``p1, p2, text, low, high`` and, for some levels, ``picks`` (which super-k-mers are wanted) become super-k-mers."""
    names = [c.split()[0] for c in _KMERS.split(", ")]
    for batch in batches:
        out: dict[str, list] = {c: [] for c in names}
        picks = batch.column("picks") if "picks" in batch.schema.names else None
        for i, (p1, p2, text, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "text", "low", "high")), strict=True)):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            starts, ends, buckets = super_kmers(words, width, level)
            for k in range(len(starts)) if picks is None else sorted(set(picks[i].as_py())):
                packed = b" ".join(words[starts[k] : ends[k] + width - 1])
                row = (p1, p2, int(starts[k]), int(buckets[k]), np.uint64(xxhash.xxh3_64_intdigest(packed)).view(np.int64), packed.decode("utf-8", "surrogatepass"), low, high)
                for c, v in zip(names, row, strict=True):
                    out[c].append(v)
        if out["p1"]:
            types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c.split()[0]], types[c.split()[1]]) for c in _KMERS.split(", ")], names)


def _runs(bucket: np.ndarray, digest: np.ndarray, at: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """Joins neighbouring windows (of one string, with one smallest doc_id) into runs ``a`` to ``b``, end exclusive."""
    if not len(at):
        return pa.RecordBatch.from_pylist([], pa.schema([("bucket", pa.int64()), ("digest", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())]))
    new = np.flatnonzero(np.concatenate(([True], (digest[1:] != digest[:-1]) | (bucket[1:] != bucket[:-1]) | (at[1:] != at[:-1] + 1) | (m[1:] != m[:-1]))))
    last = np.append(new[1:], len(at)) - 1
    return pa.RecordBatch.from_arrays([pa.array(bucket[new]), pa.array(digest[new]), pa.array(at[new].astype(np.int32)), pa.array((at[last] + 1).astype(np.int32)), pa.array(m[new])], ["bucket", "digest", "a", "b", "m"])


def _sort_windows(rows: list[tuple[int, int, list[str], int, int]], width: int) -> pa.RecordBatch:
    """The smallest doc_id of each window of the strings ``(bucket, digest, words, low, high)``, where it can remove something."""
    number: dict[str, int] = {}
    parts, string = [], []
    for k, (bucket, _, words, _, _) in enumerate(rows):
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words))
        windows = np.lib.stride_tricks.sliding_window_view(ids, width)
        head = np.array([bucket], np.int64).view(np.uint32)
        parts.append(np.concatenate([np.broadcast_to(head, (len(windows), 2)), windows], axis=1))
        string.append(np.full(len(windows), k))
    table, string = np.ascontiguousarray(np.concatenate(parts)), np.concatenate(string)
    order = np.argsort(table.view(np.dtype((np.void, table.shape[1] * 4)))[:, 0])
    ordered = table[order]
    first = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1))))
    low, high = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[string[order]], first), np.diff(np.append(first, len(order))))
    begins = np.cumsum([0, *[len(p) for p in parts[:-1]]])
    at = np.arange(len(string)) - begins[string]
    keep = least < high[string]
    pick = string[keep]
    return _runs(np.array([r[0] for r in rows], np.int64)[pick], np.array([r[1] for r in rows], np.int64)[pick], at[keep], least[keep])


def _sort_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets, one after the other, as rows sorted by bucket."""
    rows: list = []
    windows = 0
    for batch in batches:
        for bucket, digest, packed, low, high in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "packed", "low", "high")), strict=True):
            if windows >= CHUNK and rows[-1][0] != bucket:
                yield _sort_windows(rows, width)
                rows, windows = [], 0
            words = packed.split(" ")
            rows.append((bucket, digest, words, low, high))
            windows += len(words) - width + 1
    if rows:
        yield _sort_windows(rows, width)


def _digest_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for bucket, digest, packed, low, high in zip(*(batch.column(c).to_pylist() for c in ("bucket", "digest", "packed", "low", "high")), strict=True):
            words = packed.split(" ")
            out += [(bucket, digest, i, xxhash.xxh3_128_hexdigest(" ".join(words[i : i + width]).encode("utf-8", "surrogatepass")), low, high) for i in range(len(words) - width + 1)]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "digest", "a", "window", "low", "high"])


def _counted(strings: DataFrame, width: int, level: int) -> DataFrame:
    """``bucket, digest, a, b, m``: windows ``a`` to ``b`` (exclusive) of a string start in document ``m``, no smaller one, and in a larger one that has the string or a window like it."""
    if level == LEVELS:
        windows = C.store(strings.mapInArrow(partial(_digest_windows, width=width), "bucket long, digest long, a int, window string, low long, high long"), "windows")
        least = windows.groupBy("window").agg(F.min("low").alias("m"))
        return windows.join(least, "window").filter("m < high").select("bucket", "digest", "a", (F.col("a") + 1).alias("b"), "m")
    sizes = C.cut(strings.groupBy("bucket").agg(F.count("*").alias("strings"), F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("bucket", "strings"))
    crowded = sizes.filter(F.col("strings") > MOST).select("bucket")
    some = sizes.filter(F.col("strings") <= MOST).select("bucket")
    easy = strings.join(some, "bucket", "left_semi").repartition("bucket").sortWithinPartitions("bucket")
    found = easy.mapInArrow(partial(_sort_buckets, width=width), _FOUND)
    if crowded.isEmpty():
        return found
    again = C.join_sized(strings, crowded, "bucket", "left_semi").select(F.col("bucket").alias("p1"), F.col("digest").alias("p2"), F.col("packed").alias("text"), "low", "high")
    deeper = _dealt(again, width, level + 1)
    return found.unionByName(deeper.select(F.col("p1").alias("bucket"), F.col("p2").alias("digest"), F.inline("hits")))


def _dealt(parents: DataFrame, width: int, level: int) -> DataFrame:
    """``p1, p2, hits`` (``a, b, m``): windows of the parents (rows ``p1, p2, text, low, high``), one row for each of their super-k-mers that has some."""
    kmers = C.store(parents.mapInArrow(partial(_cut_up, width=width, level=level), _KMERS), "kmers")
    # equal strings of one bucket are one; the digest only names them
    strings = C.store(kmers.groupBy("bucket", "digest", "packed").agg(F.min("low").alias("low"), F.max("high").alias("high")), "strings")
    found = _counted(strings, width, level)
    # a string has LONGEST windows at most, so its runs are one short list: a super-k-mer meets one row, however many runs its string has
    runs = found.groupBy("bucket", "digest").agg(F.collect_list(F.struct("a", "b", "m")).alias("runs"))
    joined = kmers.select("p1", "p2", "at", "bucket", "digest", "high").join(runs, ["bucket", "digest"])
    low = F.filter("runs", lambda r: r["m"] < F.col("high"))
    hits = F.transform(low, lambda r: F.struct((F.col("at") + r["a"]).alias("a"), (F.col("at") + r["b"]).alias("b"), r["m"].alias("m")))
    return joined.select("p1", "p2", hits.alias("hits")).filter(F.size("hits") > 0)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def profile(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, key, md5`` (of the text), ``n`` (words), ``sha256`` of the words joined by one space, and ``buckets`` of the super-k-mers of each row, without text."""
    keyed = _keyed(docs).withColumn("md5", F.md5(F.coalesce("text", F.lit(""))))
    return keyed.mapInArrow(partial(_profile, width=width), "doc_id long, key long, md5 string, n long, sha256 string, buckets array<bigint>")


def ranges(docs: DataFrame, known: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, key, ranges``: the words to remove from the text with this ``xxhash64``, as merged pairs (first, end exclusive) in order. ``known`` is the written :func:`profile` of ``docs``."""
    long = known.filter((F.col("n") >= width) & F.col("doc_id").isNotNull())
    repeated = C.cut(long.groupBy("md5").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("md5", "first"))
    marked = C.join_sized(long, repeated, "md5", "left")
    whole = marked.filter("doc_id > first").select("doc_id", "key", F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b"))).alias("ranges")).distinct()
    # a text that repeats counts once, for its smallest document
    ones = marked.filter("first IS NULL OR doc_id = first").select("doc_id", "key", "buckets")
    shared = C.cut(ones.select("doc_id", F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("l"), F.max("doc_id").alias("h")).filter("l < h").select("bucket"))
    places = ones.select("doc_id", "key", F.posexplode("buckets").alias("pick", "bucket"))
    wanted = C.cut(C.join_sized(places, shared, "bucket", "inner").groupBy("doc_id", "key").agg(F.collect_list("pick").alias("picks")))
    texts = _keyed(docs).join(wanted, ["doc_id", "key"]).select(F.col("doc_id").alias("p1"), F.col("key").alias("p2"), "text", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"), "picks")
    hit = _dealt(texts, width, 0).select(F.col("p1").alias("doc_id"), F.col("p2").alias("key"), F.transform("hits", lambda r: F.struct(r["a"].alias("a"), (r["b"] + width - 1).alias("b"))).alias("hits"))
    merged = hit.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("hits")).alias("found")).mapInArrow(_merge, "doc_id long, key long, ranges array<struct<a:int,b:int>>")
    return merged.unionByName(whole)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and touching ranges of each text become one."""
    pairs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        out = []
        for found in batch.column("found"):
            a, b = np.array([(r["a"], r["b"]) for r in found.as_py()], np.int64).T
            order = np.argsort(a)
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
            out.append([{"a": x, "b": y} for x, y in zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out, pairs)], ["doc_id", "key", "ranges"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, out = [], []
        for text, gone in zip(batch.column("text"), batch.column("ranges"), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            left, at = [], 0
            for r in gone.as_py() or []:
                left += words[at : r["a"]]
                at = r["b"]
            left += words[at:]
            n.append(len(words) - len(left))
            out.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(out, pa.string())], ["doc_id", "key", "n_removed", "kept"])


def _changed(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``doc_id, key, n_removed, kept`` of the texts that lose words."""
    texts = _keyed(docs).join(gone, ["doc_id", "key"])
    return texts.mapInArrow(_kept, "doc_id long, key long, n_removed long, kept string").dropDuplicates(["doc_id", "key"])


def clean(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages taken out: a text that loses words becomes its kept words, joined by one space; the others stay as they are."""
    gone = C.cut(ranges(docs, C.cut(profile(docs, width)), width))
    new = _changed(docs, gone).select(F.col("doc_id").alias("sub_id"), F.col("key").alias("sub_key"), F.col("kept").alias("sub_text"), F.lit(True).alias("sub_hit"))
    joined = docs.join(new, (F.col("doc_id").cast("long") == F.col("sub_id")) & (F.xxhash64("text") == F.col("sub_key")), "left")
    return joined.select(*[F.when(F.col("sub_hit"), F.col("sub_text")).otherwise(F.col("text")).alias(c) if c == "text" else docs[c] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    known = C.cut(profile(docs))
    lost = C.cut(_changed(docs, C.cut(ranges(docs, known))).select("doc_id", "key", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
    found = C.join_sized(known, lost, ["doc_id", "key"], "left")
    return found.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)
, s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
, win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM s)
, least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g)
, hit AS (SELECT doc_id, i FROM win JOIN least USING (g) WHERE m < doc_id)
, p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
, seen AS (SELECT p.doc_id, p.i, p.w[p.i] AS word, max(hit.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS h FROM p LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.i = p.i)
, k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM seen WHERE h IS NULL OR i - h >= 50 GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
