"""Streams with state per key: scans against stored skus, change logs, deaths of skus.

Rows that depend on their order wait in lists that Spark keeps for each key and span of event time, until the watermark has passed the end of the span; they
are then handed over in order of event time, so the result is the same for any split into micro-batches whose rows are at most ``late`` out of order. Rows of spans
that have been handed over are dropped, as a watermark does. State is kept per key in RocksDB; a stream goes on from its checkpoint after a restart. Calls between
the state and a Python worker are slow, so a key has two in each micro-batch that hands over rows of it, and none while rows wait.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from stratacat.durable import shared_dir
from stratacat.streaming import catalog as ST

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: Rows wait this much longer than ``late`` at most.
SPAN, SPAN_MS = "1 hour", 3_600_000


class InOrder(StatefulProcessor):
    """Gets the rows of a key that the watermark has passed, packed by span; ``step`` gets them in order. Later spans come in later micro-batches."""

    #: Columns of the value that ``step`` carries on.
    carried: str

    def init(self, handle) -> None:
        self.value = handle.getValueState("value", self.carried)

    def step(self, key, row: tuple, value: tuple | None) -> tuple[tuple, list[Row]]:
        """The carried value after ``row``, and what is emitted."""
        raise NotImplementedError

    def read(self, span: Row) -> Iterator[tuple]:
        """What ``step`` gets of each row of a span, which has an array per column, in order."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.value.get()
        value = None if found is None else tuple(found)
        out: list[Row] = []
        for span in sorted(rows, key=lambda r: r.us[0]):
            for row in self.read(span):
                value, more = self.step(key, row, value)
                out += more
        self.value.update(value)
        return iter(out)


class ChangeLog(InOrder):
    carried = "value long, known boolean"

    def read(self, span: Row) -> Iterator[tuple]:
        return ((number, value or 0, value is not None) for number, value in zip(span.id, span.value, strict=True))

    def step(self, key, row, value):
        number, *now = row
        return tuple(now), [] if tuple(now) == value else [Row(key=key[0], id=number, value=now[0] if now[1] else None)]


def change_log(observations: DataFrame, late: str, span: str = SPAN) -> DataFrame:
    """Of a stream ``key, id, ts, value`` (long) the first row of each key and every row whose value differs from the row before in order of (ts, id); nulls are equal."""
    return _ordered(observations, late, span).transformWithState(ChangeLog(), "key long, id long, value long", "Append", "None")


class Misses(InOrder):
    """A sku's life from what feeds and page checks say of it.

    A feed sighting revives and clears misses, a good read clears them. A page that is gone is only a miss if no feed showed the sku within a
    day; if one did, the sku is flagged. Three misses without a sighting or good read between them are its death. Blocked reads say nothing, and
    dead skus are not read again.
    """

    carried = "seen_us long, misses int, dead int"

    def read(self, span: Row) -> Iterator[tuple]:
        return zip(span.us, span.id, span.kind, strict=True)

    def step(self, key, row, value):
        us, number, kind = row
        seen, misses, dead = value or (-1, 0, 0)
        said = None
        if kind == "seen":
            said = "revived" if dead else None
            seen, misses, dead = us, 0, 0
        elif dead or kind == "blocked":
            pass
        elif kind == "gone":
            if seen >= 0 and us - seen < DAY_MS * 1000:
                said = "flagged"
            else:
                misses += 1
                dead = int(misses >= 3)
                said = "dead" if dead else "missed"
        elif kind == "missing":
            said = "flagged"
        else:
            misses = 0
        return (seen, misses, dead), [Row(key=key[0], id=number, action=said, misses=misses)] if said else []


def misses(signals: DataFrame, late: str, span: str = SPAN) -> DataFrame:
    """Of a stream ``key, id, ts, kind`` (seen, ok, gone, missing, blocked) what happens to each sku: ``key, id, action, misses``."""
    return _ordered(signals, late, span).transformWithState(Misses(), "key long, id long, action string, misses int", "Append", "None")


def _ordered(rows: DataFrame, late: str, span: str):
    """Rows by key, packed by span of event time; a span comes when the watermark has passed its end, so all that come in one micro-batch are earlier than those of the next."""
    timed = rows.filter("key IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    others = [c for c in rows.columns if c not in ("key", "ts")]
    row = F.struct(F.unix_micros("ts").alias("us"), "id", *[c for c in others if c != "id"])
    packed = timed.groupBy("key", F.window("ts", span)).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return packed.select("key", *[F.col(f"rows.{c}").alias(c) for c in ("us", *others)]).groupBy("key")


_PRODUCT = ("pid", "url", "title", "price", "stock", "reused", "collides")


@dataclass
class Latest:
    """A stream of which a key's later rows replace its earlier ones."""

    rows: DataFrame


def sightings(skus: DataFrame, products: DataFrame) -> Latest:
    """The log of a scan that comes as a stream: for each sku the product that counts, again when more of its products come.

    Products meet the stored skus by pid and by address without state; what is kept per sku (by source and address) is the product that counts so far, as a minimum that
    Spark keeps itself: with ten thousands of skus a task, a call from the state to a Python worker and back for each of them takes far longer than the rest.
    """
    # a stream's plan isn't adapted: a table of skus that is small only as it lies in its file would be broadcast
    hit = ST.identified(skus.hint("merge"), products).select("*", F.coalesce("k.url", "url").alias("key_url"), F.col("k").isNotNull().alias("known"))
    # of a stored sku's products the first by (reused, pid, url) counts; products of a new one have one url and aren't reused: the first by (pid, title). No pid comes last.
    order = F.struct(F.coalesce("reused", F.lit(False)).alias("reused"), F.col("pid").isNull().alias("bare"), "pid", "url", "title", "price", "stock", "collides")
    best = hit.groupBy("source_id", "key_url", "known").agg(F.min(order).alias("p"))
    return Latest(best.select("source_id", "key_url", "known", *[F.col(f"p.{c}").alias(f"p_{c}") for c in _PRODUCT]))


def settled(skus: DataFrame, log: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The next skus and the observations, of the last row of the log for each sku."""
    last = log.withColumn("turn", F.row_number().over(Window.partitionBy("source_id", "key_url").orderBy(F.desc("number")))).filter("turn = 1")
    seen = last.filter("known").select(F.struct("source_id", F.col("key_url").alias("url")).alias("k"), *[F.col(f"p_{c}").alias(c if c in ("reused", "collides") else f"p_{c}") for c in _PRODUCT])
    fresh = last.filter("NOT known").select("source_id", *[F.col(f"p_{c}").alias(c) for c in _PRODUCT[:5]])
    return ST.applied(skus, seen, fresh, now_ms)


def landed(rows: DataFrame, files: int, *, folder: str | None = None) -> str:
    """Writes ``rows`` as that many files, dealt at random, into a folder that a stream can read."""
    folder = folder or f"{shared_dir(rows.sparkSession)}/landed-{uuid.uuid4().hex}"
    rows.repartition(files, F.rand(11)).write.mode("append").parquet(folder)
    return folder


def drained(spark: SparkSession, folder: str, schema: StructType | str, plan, out: str, checkpoint: str, a_batch: int = 2) -> DataFrame:
    """Runs ``plan`` over the files in ``folder`` that its checkpoint doesn't know yet, some in each micro-batch, and reads all that it has written so far.

    Of :class:`Latest` rows each micro-batch writes those of the keys it has met, with its ``number``; written again after a failure, they replace themselves.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        made = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", a_batch).parquet(folder))
        if isinstance(made, Latest):
            written = StructType([*made.rows.schema, StructField("number", LongType())])
            to = made.rows.writeStream.outputMode("update").foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/number={number}"))
        else:
            written = made.schema
            to = made.writeStream.outputMode("append").format("parquet").option("path", out)
        to.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(written).parquet(out)


def replayed(rows: DataFrame, plan, late_ms: int, files: int = 4) -> DataFrame:
    """Lands ``rows`` (with ``key`` and ``ts``) in files at random, drains them, then lands one more row, far on in time, and goes on from the checkpoint: it moves the watermark past all others.

    ``late_ms`` must be the watermark's delay of ``plan``, with what its spans are longer than an hour, and cover how far the files are out of order.
    """
    spark = rows.sparkSession
    folder = landed(rows, files)
    out, checkpoint = f"{folder}-out", f"{folder}-state"
    drained(spark, folder, rows.schema, plan, out, checkpoint)
    end = rows.agg((F.max(F.col("ts").cast("timestamp")) + F.make_dt_interval(secs=F.lit((late_ms + SPAN_MS) / 1000 + 60))).cast(rows.schema["ts"].dataType).alias("ts"))
    beat: list[Column] = [F.col("ts") if c == "ts" else F.lit(-1 if c == "key" else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    landed(end.filter("ts IS NOT NULL").select(*beat), 1, folder=folder)
    return drained(spark, folder, rows.schema, plan, out, checkpoint).filter("key >= 0")
