"""A trie of conversation prefixes by fixed-length blocks of turns.

Each conversation is rebuilt from the opening of its hundred's first conversation and its own later turns. Turns become 128-bit digests of
role, text and depth; the digest of a prefix is their sum in four lanes of 32 bits, so prefixes of any length come from partial
sums. Conversations are grouped by the digests at the ends of blocks of ``BLOCK`` turns first. Where all that go on from one block's start
share one block, the nodes inside it have its members, and nothing is grouped again; only blocks with several siblings
are opened, and their turns grouped by prefix digest.

Figures of subtrees need no walk of the tree. Each node belongs to its smallest member, so a conversation owns the end of its path,
from its own depth on. Of a node's members each but the owner shares the path from the node to its own depth, and leaves belong to
one conversation each; so saved code points and leaves are sums over members. The conversations that end in a node are sorted by
range over all tasks, packed into strings of up to ``PACK`` ids, and these are hashed one after the other, whatever their number.

Ranks and running digests of a very long conversation are worked out in parts: rows are dealt out by range, summed in each
part, and parts carry the sums of those before them.

Defined cases: null role or text is empty; rows without conv_id are left out; a null turn comes first; equal turns of one
conversation are ordered by the digest of role and text, and all count; a conversation whose opening's first conversation is missing
starts with nothing of it; a conversation without turns after rebuilding ends in the root; an empty table gives no nodes;
extra columns are ignored. Texts and conversations have no length limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK, PACK = 4, 4096
HUNDRED, HEADS = 100, 6
_LANES = ["l0", "l1", "l2", "l3"]
_MASK = (1 << 32) - 1


def running(df: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``before_<c>``: the sum of each column over the earlier rows of its key. No key has to fit one task."""
    placed = C.cut(df.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})
    parts = placed.groupBy(key, "part").agg(*[F.sum(c).alias(c) for c in sums])
    above = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one key goes on from each part to the next
    carried = C.cut(parts.select(key, "part", *[F.sum(c).over(above).alias(f"carry_{c}") for c in sums]).filter(F.col(f"carry_{sums[0]}").isNotNull()))
    joined = C.join_sized(local, carried, [key, "part"], "left")
    return joined.withColumns({f"before_{c}": F.col(f"before_{c}") + F.coalesce(f"carry_{c}", F.lit(0)) for c in sums}).drop("part", *[f"carry_{c}" for c in sums])


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes over from the first one of its hundred."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, digest, size`` of the rebuilt turns, and ``conv_id`` of all conversations."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("one")
    )
    ranked = C.cut(running(rows, "conv_id", ["turn", "digest"], ["one"]).select("conv_id", (F.col("before_one") + 1).alias("rank"), "digest", "size"))
    counted = C.cut(ranked.groupBy("conv_id").agg(F.count("*").alias("turns")))
    convs = counted.select("conv_id", head_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"))
    # at most 199 conversations have one base, and each takes five turns at most
    bases = ranked.filter((F.col("conv_id") % HUNDRED == 0) & (F.col("rank") < HEADS)).select(F.col("conv_id").alias("base"), "rank", "digest", "size")
    heads = convs.join(bases, "base").filter("rank <= h").select("conv_id", F.col("rank").alias("depth"), "digest", "size")
    shift = convs.join(counted.select(F.col("conv_id").alias("base"), "turns"), "base", "left").select("conv_id", (F.least("h", F.coalesce("turns", F.lit(0))) - F.col("h")).alias("shift")).filter("shift < 0")
    own = ranked.filter(F.col("rank") > head_turns(F.col("conv_id")))
    own = C.join_sized(own, C.cut(shift), "conv_id", "left").select("conv_id", (F.col("rank") + F.coalesce("shift", F.lit(0))).alias("depth"), "digest", "size")
    return heads.unionByName(own), counted.select("conv_id")


def _prefix(lanes: list[Column]) -> list[Column]:
    """Two longs from four lanes."""
    low = [c.bitwiseAND(F.lit(_MASK)) for c in lanes]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation and block: the prefix digests ``pa, pb`` at its start and ``a, b`` at its end, its number of turns ``l``, and ``steps``, what each turn adds."""
    mixed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")))
    lanes = [F.conv(F.substring(mixed, 1 + 8 * k, 8), 16, 10).cast("long").alias(c) for k, c in enumerate(_LANES)]
    rows = turns.select("conv_id", F.floor((F.col("depth") - 1) / block).alias("block"), "depth", "size", *lanes)
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    grown = rows.withColumns({f"up_{c}": F.sum(c).over(inside) for c in [*_LANES, "size"]})
    whole = grown.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("depth", *[f"up_{c}" for c in _LANES], "size", "up_size"))).alias("turns"), *[F.max(f"up_{c}").alias(c) for c in _LANES], F.max("up_size").alias("size"), F.count("*").alias("l")
    )
    placed = running(whole, "conv_id", ["block"], [*_LANES, "size"])
    start = [F.col(f"before_{c}") for c in _LANES]

    def step(t: Column) -> Column:
        a, b = _prefix([s + t[f"up_{c}"] for s, c in zip(start, _LANES, strict=True)])
        return F.struct(t["depth"].alias("depth"), a.alias("a"), b.alias("b"), t["size"].alias("size"), (F.col("before_size") + t["up_size"] - t["size"]).alias("before"))

    pa_, pb = _prefix(start)
    a, b = _prefix([s + F.col(c) for s, c in zip(start, _LANES, strict=True)])
    return placed.select("conv_id", "block", pa_.alias("pa"), pb.alias("pb"), a.alias("a"), b.alias("b"), "l", "size", F.transform("turns", step).alias("steps"))


def _opened(of: DataFrame, *more: str) -> DataFrame:
    """The turns of blocks, each with the digest of the prefix before it."""
    at = F.posexplode("steps").alias("i", "s")
    rows = of.select("pa", "pb", "steps", "several", *more, at)
    before = lambda c: F.when(F.col("i") == 0, F.col(f"p{c}")).otherwise(F.get("steps", F.col("i") - 1)[c])
    return rows.select(F.col("s.depth").alias("depth"), F.col("s.a").alias("a"), F.col("s.b").alias("b"), before("a").alias("pa"), before("b").alias("pb"), F.col("s.size").alias("size"), F.col("s.before").alias("before"), "several", *more)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``depth, a, b, conv_id`` become strings of up to PACK ids of one node."""
    names = ["depth", "a", "b", "first", "ids"]
    open_: list = []

    def flush(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    key, ids = None, []
    for batch in batches:
        for *now, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "conv_id")), strict=True):
            if now != key or len(ids) == PACK:
                if ids:
                    open_.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = now, []
            ids.append(conv)
        if len(open_) >= PACK:
            yield flush(open_)
            open_ = []
    if ids:
        open_.append((*key, ids[0], ",".join(map(str, ids))))
    if open_:
        yield flush(open_)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings of ids become one digest per node; only the state of one hash is kept."""
    key, state = None, None
    for batch in batches:
        out = []
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _digests(out)
    if key is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "a": pa.int64(), "b": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(kinds.items())})


def endings(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: the digest of the ids that end in each node, ascending, joined by commas."""
    node = ["depth", "a", "b"]
    spread = C.cut(ends).repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    packed = C.cut(spread.mapInArrow(_pack, "depth long, a long, b long, first long, ids string"))
    return packed.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_hash, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node, with the figures of the contract."""
    node, key = ["depth", "a", "b"], ["block", "pa", "pb", "a", "b", "l"]
    turns, convs = rebuilt(conversations)
    convs = C.cut(convs)
    parts = C.cut(blocks(turns, block))
    # 1. blocks: who shares them, and whether they have siblings
    shared = parts.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.first("steps").alias("steps"))
    shared = C.cut(shared)
    siblings = shared.groupBy("block", "pa", "pb").agg((F.count("*") > 1).alias("several"))
    known = C.cut(shared.join(siblings, ["block", "pa", "pb"]))
    # 2. nodes: turns are grouped only where siblings diverge
    open_ = _opened(known, "owner", "n")
    grouped = open_.filter("several").groupBy(*node).agg(*[F.min(c).alias(c) for c in ("pa", "pb", "size", "before", "owner")], F.sum("n").alias("n"))
    nodes = open_.filter("NOT several").drop("several").unionByName(grouped)
    nodes = C.cut(nodes)
    children = nodes.filter("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = C.cut(nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))
    # 3. what each conversation owns: from which depth, with how much before it, and whether its end is a leaf
    own = nodes.groupBy("owner").agg(F.min("depth").alias("own_depth"), F.min("before").alias("own_before"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    own = C.cut(own)
    length = parts.groupBy("conv_id").agg(F.sum("l").alias("length"), F.sum("size").alias("total"))
    mine = length.join(own.withColumnRenamed("owner", "conv_id"), "conv_id", "left").select("conv_id", "length", F.coalesce("own_before", "total").alias("shares"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    mine = C.cut(convs.join(mine, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("length", "shares", "leaf")]))
    # 4. sums over members
    both = parts.select("conv_id", *key, F.element_at("steps", -1)["depth"].alias("depth")).join(mine, "conv_id")
    sums = both.groupBy(*key).agg(F.sum("shares").alias("shares"), F.sum("leaf").alias("n_leaves"))
    inner = _opened(known.join(sums, key), "shares", "n_leaves")
    summed = inner.filter("several").groupBy(*node).agg(F.sum("shares").alias("shares"), F.sum("n_leaves").alias("n_leaves"))
    summed = inner.filter("NOT several").select(*node, "shares", "n_leaves").unionByName(summed)
    full = C.cut(nodes.join(summed, node).join(own.drop("leaf"), "owner").withColumn("saved_tokens", F.col("shares") - F.col("own_before") - (F.col("n") - 1) * F.col("before")))
    # 5. parents: a node below its owner's first one has the same owner as its parent
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("owner").alias("up"))
    first = full.filter((F.col("depth") == F.col("own_depth")) & (F.col("depth") > 1)).join(parents, ["depth", "pa", "pb"])
    least = convs.agg(F.min("conv_id").alias("up"))
    top = full.filter((F.col("depth") == F.col("own_depth")) & (F.col("depth") == 1)).crossJoin(F.broadcast(least))
    rest = full.filter(F.col("depth") > F.col("own_depth")).withColumn("up", F.col("owner"))
    wanted = [*node, F.col("owner").alias("conv_id"), F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"]
    below = first.select(*wanted).unionByName(top.select(*wanted)).unionByName(rest.select(*wanted))
    # 6. the root has all members
    on_top = nodes.filter("depth = 1").agg(F.count("*").alias("n_children"))
    root = mine.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("shares").alias("saved_tokens")).filter("n_convs > 0").crossJoin(F.broadcast(on_top))
    zero = F.lit(0).cast("long")
    root = root.select(
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), "saved_tokens"
    )
    ends = both.filter("depth = length").select(*node, "conv_id").unionByName(mine.filter("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id"))
    joined = below.unionByName(root).join(endings(ends), node, "left")
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(C.table(spark, sf_dir, "conversations"))


ORACLE = """
WITH q AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
, t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text))) AS r FROM q)
, bits AS (SELECT conv_id, list_transform(range(8 * length(conv_id::VARCHAR)), lambda i: (ascii((conv_id::VARCHAR)[i // 8 + 1]) >> (i % 8)::INTEGER) & 1) AS x FROM (SELECT DISTINCT conv_id FROM q))
, c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, x::BIGINT[]), lambda s, b: xor(s >> 1, xor(s & 1, b) * 3988292384)), 4294967295) % 6 AS h FROM bits)
, r AS (SELECT c.conv_id, 0 AS own, r, role, text FROM c JOIN t ON t.conv_id = c.base AND r <= h UNION ALL SELECT c.conv_id, 1, r, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND r > h)
, s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, r) AS depth, length(text) AS size, md5(concat(length(role), ':', role, text)) AS k FROM r)
, p AS (SELECT conv_id, depth, size, string_agg(k, '/') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c)
, n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, CASE WHEN depth > 0 THEN left(path, greatest(length(path) - 33, 0)) END AS up FROM p GROUP BY path, depth)
, ch AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up)
, sub AS (SELECT v.path, count(*) FILTER (WHERE ch.up IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved_tokens
  FROM n v JOIN n u ON u.depth >= v.depth AND starts_with(u.path, v.path) LEFT JOIN ch ON ch.up = u.path GROUP BY v.path)
, e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sub USING (path) LEFT JOIN n m ON m.path = n.up LEFT JOIN ch ON ch.up = n.path LEFT JOIN e ON e.path = n.path"""
