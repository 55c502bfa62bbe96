"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each of which holds whole records of about ``FRAME`` bytes. It ends with two
skippable frames: an index (JSON: record id -> frame number, offset and length in the frame's text) and the seek
table of the public seekable format (compressed and decompressed size of every frame, then a 9-byte footer). Readers of
plain Zstandard skip both, so the bundle also decompresses as an ordinary .warc.zst.

Executors write bundles to a folder that all share, under names of their own attempt, and return a manifest row
for each. Only bundles in the manifest (Spark keeps the rows of successful attempts) are read, so lost executors and
repeated tasks leave neither gaps nor doubles.

Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is a response and the
others revisit it; pages that share that page_id are all responses. Defined cases: a null html is an empty
payload; a null page_id is written without an id to refer to, and is a response unless another page has its payload;
extra columns are ignored; an empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FRAME, BUNDLE = 256 << 10, 32 << 20
_SKIP_INDEX, _SKIP_SEEK, _SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, key: str) -> bytes:
    """One WARC/1.1 record. A revisit has no block; it names the payload's size, since readers can't see it."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:stratacat:{key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.translate({10: "%0A", 13: "%0D"}))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:stratacat:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = payload if refers_to is None else b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in ``data``."""
    data, at = bytes(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


class Writer:
    """Builds one bundle in a binary file."""

    def __init__(self, out):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=6)
        self.frames: list[tuple[int, int]] = []
        self.index: dict[str, tuple[int, int, int]] = {}
        self.held, self.size, self.written = [], 0, 0

    def add(self, key: str, data: bytes) -> None:
        if self.held and self.size + len(data) > FRAME:
            self.flush()
        self.index[key] = (len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)

    def flush(self) -> None:
        if self.held:
            frame = self.pack.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.written += len(frame)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = zstandard.ZstdCompressor().compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<2I", _SKIP_INDEX, len(index)) + index)
        frames = [*self.frames, (len(index) + 8, 0)]
        table = b"".join(struct.pack("<2I", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEK_MAGIC)
        self.out.write(struct.pack("<2I", _SKIP_SEEK, len(table)) + table)


class Reader:
    """Random access to a bundle in a seekable binary file: footer, seek table, index, then single frames."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != _SEEK_MAGIC:
            raise ValueError("no seek table")
        file.seek(end - 9 - 8 * n)
        table = file.read(8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<2I", table):
            self.frames.append((at, packed, plain))
            at += packed
        at, packed, _ = self.frames.pop()
        file.seek(at + 8)
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(file.read(packed - 8)))

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def get(self, key: str) -> tuple[dict[str, str], bytes]:
        """The record of one id: only its frame is read."""
        k, offset, size = self.index[key]
        return next(parse(self.frame(k)[offset : offset + size]))

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.frames)):
            yield from parse(self.frame(k))


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``wr_refers``: the page_id of the response that a page revisits, else null.

    Payload groups meet as digests and ids only; the revisits' ids then come to the pages, whose texts move only where these ids are too many to broadcast.
    """
    payload = F.coalesce("html", F.lit(""))
    names = {"wr_sha": F.sha1(payload.cast("binary")), "wr_bytes": F.octet_length(payload)}
    narrow = pages.select("page_id", *[v.alias(k) for k, v in names.items()])
    # several pages and at least one of them named, else there is nothing to refer to
    groups = narrow.groupBy("wr_sha", "wr_bytes").agg(F.max("page_id").alias("wr_first"), F.count("*").alias("wr_n"))
    groups = C.cut(groups.filter((F.col("wr_n") > 1) & (F.col("wr_bytes") >= min_bytes) & F.col("wr_first").isNotNull()).drop("wr_n"))
    revisits = C.join_sized(narrow, groups, ["wr_sha", "wr_bytes"], "inner").filter(~F.col("page_id").eqNullSafe(F.col("wr_first")))
    revisits = C.cut(revisits.groupBy(F.col("page_id").alias("wr_page"), F.col("wr_sha").alias("wr_sha2"), F.col("wr_bytes").alias("wr_bytes2")).agg(F.max("wr_first").alias("wr_refers")))
    same = F.col("page_id").eqNullSafe(F.col("wr_page")) & (F.col("wr_sha") == F.col("wr_sha2")) & (F.col("wr_bytes") == F.col("wr_bytes2"))
    return C.join_sized(pages.withColumns(names), revisits, same, "left").drop("wr_sha", "wr_sha2", "wr_bytes", "wr_bytes2", "wr_page")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the pages' records as bundles under ``folder``; the manifest: ``path, n_records, n_bytes, frames``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = C.filesystem(folder)
        made, out, bundle = [], None, None
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]

        def close():
            bundle.close()
            out.close()
            made.append((name, len(bundle.index), bundle.written, len(bundle.frames)))

        count = 0
        for b in batches:
            for page_id, url, html, refers in zip(*(b.column(c) for c in ("page_id", "url", "html", "wr_refers")), strict=True):
                if bundle is None:
                    name = f"bundle-{part:06d}-{len(made):04d}-{attempt}.warc.zst"
                    out = fs.open_output_stream(os.path.join(root, name), compression=None)
                    bundle = Writer(out)
                page = page_id.as_py()
                key = f"page:{page}" if page is not None else f"row:{part}:{attempt}:{count}"
                if key in bundle.index:
                    key += f":{count}"
                count += 1
                bundle.add(key, record(page, url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers.as_py(), key))
                if bundle.written >= BUNDLE:
                    close()
                    bundle = None
        if bundle is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if made else [pa.array([], pa.string())] + [pa.array([], pa.int64())] * 3, ["path", "n_records", "n_bytes", "frames"])

    fs, root = C.filesystem(folder)
    fs.create_dir(root, recursive=True)
    linked = with_references(pages.select("page_id", "url", "html"), min_bytes)
    return C.cut(linked.mapInArrow(run, "path string, n_records long, n_bytes long, frames long"))


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """The records of all bundles in the manifest: headers and block, one bundle at a time, frame by frame. Digests and lengths of responses are worked out from the stored blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = C.filesystem(folder)
        fields = ["WARC-Record-ID", "WARC-Type", "WARC-Page-ID", "WARC-Target-URI", "WARC-Refers-To"]
        for b in batches:
            for name in b.column("path"):
                with fs.open_input_file(os.path.join(root, name.as_py())) as f:
                    bundle = Reader(f)
                    for k in range(len(bundle.frames)):
                        got = list(parse(bundle.frame(k)))
                        # a revisit has no block: only its header knows the payload's digest and length
                        payload = [(h["WARC-Payload-Digest"], h["WARC-Payload-Length"]) if h["WARC-Type"] == "revisit" else ("sha1:" + digest32(block), str(len(block))) for h, block in got]
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.array([h.get(x) for h, _ in got], pa.string()) for x in fields], *[pa.array(x, pa.string()) for x in zip(*payload, strict=True)], pa.array([block for _, block in got], pa.binary())],
                            ["record_id", "type", "page_id", "url", "refers_to", "digest", "length", "block"],
                        )

    names = manifest.select("path").repartition(max(1, 2 * spark.sparkContext.defaultParallelism))
    return names.mapInArrow(run, "record_id string, type string, page_id string, url string, refers_to string, digest string, length string, block binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read(spark, folder, write(C.table(spark, sf_dir, "pages"), folder))
    return records.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("length").cast("long").alias("payload_bytes"),
        F.substring_index("digest", ":", -1).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.regexp_extract("refers_to", r"page:(-?[0-9]+)", 1).try_cast("long").alias("refers_to"),
    )


#: The digest's 160 bits in base 32: five hexadecimal digits are 20 bits, which are four characters.
ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM g
"""
