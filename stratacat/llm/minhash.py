"""Near-duplicate documents by one-permutation MinHash with optimal densification, banded buckets and star edges.

Every document becomes the set of its 5-word shingles (A-Z lower-cased). Equal sets collapse to one class first. A class is
sketched by the smallest hash in each of ``BINS`` ranges of one hash; an empty bin copies a bin that a fixed
pseudo-random walk over the bins reaches first and that is not empty. ``ROWS`` bins form a band, classes that share a band's
bucket are candidates: first each member with its bucket's centre (a star; the centre is the member that meets most
others in all its buckets), then, for buckets that the confirmed links leave in several components, those pairs across
components that could be similar enough. What a member lacks of the centre and has beyond it, each hashed to 512 bits,
bounds what two members can share, so most pairs end at that bound, which never excludes a link. All links are confirmed
on the full sets, and components of links are the result.

A pair at similarity s shares no bucket with probability (1 - s^ROWS)^(BINS / ROWS): 2e-5 at 0.75.

Defined cases: null, empty and blank texts have the empty set and are linked with nothing; rows that share a doc_id are
one document, linked through any of their texts (when duplicates go, any one of such rows stays); a null doc_id is linked with nothing and
kept; a component is named by its smallest doc_id; an empty table gives an empty result; extra columns are ignored. Texts have no length limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacat.operators.components import components

from . import common as C

WIDTH, NEED = 5, 75
BINS, ROWS = 200, 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; bytes.split() splits at exactly the six ASCII spaces."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    with np.errstate(over="ignore"):
        if len(w) < width:
            return _scramble((w * np.resize(_MIX, len(w))).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
        n = len(w) - width + 1
        h = w[:n] * _MIX[0]
        for i in range(1, width):
            h += w[i : n + i] * np.resize(_MIX, width)[i]
    return np.unique(_scramble(h))


def _walks(bins: int, steps: int = 1024) -> np.ndarray:
    """Row t: the bin that each bin looks at in its t-th step, the same for all documents."""
    return np.random.default_rng(20240229).integers(0, bins, (steps, bins))


class Sketcher:
    def __init__(self, bins: int = BINS, rows: int = ROWS):
        self.bins, self.rows, self.walks = bins, rows, _walks(bins)
        self.edges = (np.arange(1, bins + 1, dtype=object) * 2**64 // bins - 1).astype(np.uint64)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """The smallest hash of each range, densified. ``hashes`` are sorted, so it is the first of each range."""
        ends = np.searchsorted(hashes, self.edges, side="right")
        starts = np.concatenate(([0], ends[:-1]))
        full = ends > starts
        out = hashes[np.minimum(starts, len(hashes) - 1)]
        empty = np.flatnonzero(~full)
        for step in self.walks:
            if not len(empty):
                return out
            to = step[empty]
            ok = full[to]
            out[empty[ok]] = out[to[ok]]
            empty = empty[~ok]
        out[empty] = hashes[0]
        return out

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key per band."""
        s = self.sketch(hashes).reshape(-1, self.rows)
        with np.errstate(over="ignore"):
            mixed = (s * np.resize(_MIX, self.rows)).sum(axis=1, dtype=np.uint64) + np.arange(len(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return _scramble(mixed)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = Sketcher()
    for b in batches:
        ids, n, digest, bands = b.column("doc_id"), [], [], []
        for text in b.column("text"):
            h = shingles(text.as_py())
            n.append(len(h))
            digest.append(_digest(h))
            bands.append(make.bands(h).view(np.int64) if len(h) else None)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "bands"]
        )


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n`` (set size), ``digest`` (of the set) and ``bands``; the last two null for empty sets."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signatures, "doc_id long, n long, digest string, bands array<bigint>")


def _digest(hashes: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else None


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py()) for t in b.column("text")]
        columns = [b.column("doc_id"), pa.array(map(_digest, sets), pa.string()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "set"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a centre ``a`` and a member ``b``: the size of the intersection, and bits of what ``b`` has beyond ``a`` (8 numbers) and lacks of it (8 more)."""

    def bits(h: np.ndarray) -> np.ndarray:
        flags = np.zeros(512, np.uint8)
        flags[(h >> np.uint64(7)) & np.uint64(511)] = 1
        return np.packbits(flags).view(np.int64)

    for batch in batches:
        both, marks = [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
            both.append(len(np.intersect1d(x, y, assume_unique=True)))
            marks.append(np.concatenate([bits(np.setdiff1d(y, x, assume_unique=True)), bits(np.setdiff1d(x, y, assume_unique=True))]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int32()), pa.array(marks, pa.list_(pa.int64()))], ["a", "b", "both", "marks"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(left, "a").join(right, "b")


def confirmed(pairs: DataFrame, sets: DataFrame, need: int = NEED) -> DataFrame:
    """The pairs ``a, b`` whose full sets have 100 * intersection >= need * union."""
    joined = _with_sets(pairs, sets).withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return joined.filter(100 * F.col("both") >= need * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def _most_shared() -> Column:
    """No two members of a bucket (columns ``..._x`` and ``..._y``) share more than this; null where the centre was not compared with both.

    Of the centre they share at most what neither lacks; beyond it, at most what one has and the other's bits don't rule out.
    """
    count = lambda cols: sum((F.bit_count(c) for c in cols[1:]), F.bit_count(cols[0]))
    x, y = [F.col("marks_x")[k] for k in range(16)], [F.col("marks_y")[k] for k in range(16)]
    own = lambda p, a, b: F.col(f"n_{p}") - F.col(f"both_{p}") - count([a[k].bitwiseAND(F.bitwise_not(b[k])) for k in range(8)])
    return F.col("low_n_x") - count([x[k].bitwiseOR(y[k]) for k in range(8, 16)]) + F.least(own("x", x, y), own("y", y, x))


def linked(docs: DataFrame, need: int = NEED) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    sig = C.cut(signatures(docs))
    known = sig.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # a class is a node of its own, since the least doc_id of several classes can be the same; the cut fixes the numbers
    classes = C.cut(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))
    # a document whose rows have different texts links their classes
    several = known.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one <> other").select("doc_id")
    theirs = known.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest").select("doc_id", "node")
    own = theirs.join(theirs.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    reps = known.join(classes, ["digest", "doc_id"])
    rows = reps.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    many = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("m")).filter("least < most").select("bucket", "m")
    members = C.cut(rows.join(many, "bucket"))  # (node, n, bucket, m): members of buckets with several
    weights = C.cut(members.groupBy("node").agg(F.sum("m").alias("weight"), F.min("n").alias("n")))
    centre = members.join(weights.select("node", "weight"), "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("weight", -F.col("node"))).alias("c"))
    shared = C.cut(members.join(centre.select("bucket", F.col("c.node").alias("low"), F.col("c.n").alias("low_n")), "bucket").filter("node <> low").select("bucket", "node", "n", "low", "low_n"))
    # a pair can only be similar enough if the smaller set has need % of the larger one's size
    fits = lambda x, y: 100 * F.least(x, y) >= need * F.greatest(x, y)
    star = shared.filter(fits(F.col("n"), F.col("low_n"))).select(F.col("low").alias("a"), F.col("node").alias("b"), "n", "low_n").distinct()
    wanted = C.cut(classes.join(weights.select("node"), "node", "left_semi"))
    texts = C.join_sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    # a doc_id can have several texts: only that of the class is its set
    own_sets = texts.mapInArrow(_sets, "doc_id long, digest string, set array<bigint>").filter("digest IS NOT NULL").dropDuplicates(["doc_id", "digest"])
    sets = C.cut(C.join_sized(own_sets, wanted, ["doc_id", "digest"], "inner").select("node", "set"))
    compared = C.cut(_with_sets(star.select("a", "b"), sets).select("a", "b", "set_a", "set_b").mapInArrow(_compare, "a long, b long, both int, marks array<bigint>"))
    first = C.cut(star.join(compared, ["a", "b"]).filter(100 * F.col("both") >= need * (F.col("n") + F.col("low_n") - F.col("both"))).select("a", "b"))
    grouped = components(first)
    # members of one bucket that are still apart, its centre included; the centre's own pairs are done
    whole = shared.select("bucket", "node", "n", "low", "low_n").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = whole.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("bucket")
    known_marks = compared.select(F.col("a").alias("low"), F.col("b").alias("node"), "both", "marks")
    open_ = C.cut(whole.join(apart, "bucket", "left_semi").distinct().join(known_marks, ["low", "node"], "left"))
    x, y = (open_.select("bucket", *[F.col(c).alias(f"{c}_{p}") for c in ("node", "n", "low_n", "component", "both", "marks")]) for p in "xy")
    most = _most_shared()
    possible = F.coalesce(100 * most >= need * (F.col("n_x") + F.col("n_y") - most), F.lit(True))
    apart_pair = (x["bucket"] == y["bucket"]) & (F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & fits(F.col("n_x"), F.col("n_y"))
    across = x.join(y, apart_pair & possible).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    links = first.unionByName(confirmed(across, sets, need)).unionByName(own)
    comps = components(links)
    named = C.cut(classes.join(comps, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("group")))
    # only groups of several classes have to meet; their names are written first, so that a group with very many classes can be split over tasks
    groups = C.cut(named.groupBy("group").agg(F.min("doc_id").alias("component"), F.count("*").alias("classes")).filter("classes > 1").drop("classes"))
    by_class = C.join_sized(named, groups, "group", "left").select("digest", F.coalesce("component", "doc_id").alias("component"))
    found = sig.select("doc_id", "n", "digest").join(by_class, "digest", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, need: int = NEED) -> DataFrame:
    """One document per component: the one whose doc_id names it; one row of it. Columns stay."""
    gone = C.cut(linked(docs, need).filter("doc_id <> component_id").select(F.col("doc_id").alias("mh_id")).distinct())
    left = C.join_sized(docs, gone, F.col("doc_id") == F.col("mh_id"), "left_anti")
    named, nameless = left.filter(F.col("doc_id").isNotNull()), left.filter(F.col("doc_id").isNull())
    return named.dropDuplicates(["doc_id"]).unionByName(nameless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linked(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)
, s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0))
, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
, p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
, l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common))
, e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l)
, reach(node, root) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.root FROM reach r JOIN e ON e.u = r.node)
, c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""
