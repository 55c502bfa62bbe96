import hashlib
import io

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratacat.llm import warc as W


def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (5, "http://a/5", "<p>x</p>"), (3, None, "<p>x</p>"), (7, "http://b", None), (8, "http://b\r\nX: y", ""), (9, "u", "é\U0001f389" * 200_000), (5, "http://a/5", "<p>x</p>"), (None, "n", "alone"), (None, "n", "alone")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "block": F.lit(2), "wr_x": F.lit(3)})


def test_query(spark, tmp_path):
    pages(spark).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = W.query(spark, str(tmp_path)).collect()
    rows = pages(spark).collect()
    tops = {}
    for r in rows:
        k = r.html or ""
        tops[k] = max(tops.get(k, -1), -1 if r.page_id is None else r.page_id)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        top = tops[r.html or ""]
        revisit = top != -1 and r.page_id != top
        want.append(repr((r.page_id, len(body), W.digest32(body), "revisit" if revisit else "response", top if revisit else None)))
    assert sorted(repr(tuple(r)) for r in got) == sorted(want)


def test_small_payloads_are_all_responses(spark):
    out = W.with_references(pages(spark).filter("page_id is not null"), min_bytes=5).collect()
    assert {r.page_id for r in out if r.wr_refers is not None} == {1, 3} and all(r.wr_refers == 5 for r in out if r.wr_refers is not None)


def test_folder_and_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    manifest = W.write(pages(spark), folder)
    (tmp_path / "out" / "bundle-999999-0000-lost.warc.zst").write_bytes(b"left by a lost attempt")
    found = W.read(spark, folder, manifest)
    assert found.count() == 9 and found.filter("block = cast('alone' as binary)").count() == 2
    assert W.read(spark, folder, W.write(pages(spark).limit(0), folder)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=30), st.integers(100, 5000))
def test_bundle_round_trip_and_random_access(payloads, frame):
    old, W.FRAME = W.FRAME, frame
    try:
        out = io.BytesIO()
        bundle = W.Writer(out)
        for i, p in enumerate(payloads):
            bundle.add(f"page:{i}", W.record(i, f"http://x/{i}", p, None, f"page:{i}"))
        bundle.close()
    finally:
        W.FRAME = old
    reader = W.Reader(io.BytesIO(out.getvalue()))
    for i in reversed(range(len(payloads))):
        headers, block = reader.get(f"page:{i}")
        assert block == payloads[i] and headers["WARC-Payload-Digest"] == "sha1:" + W.digest32(payloads[i])
    assert [b for _, b in reader.records()] == payloads
    # ordinary readers see one stream of records
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert [b for _, b in W.parse(plain)] == payloads


def test_digest():
    assert W.digest32(b"abc") == "VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5" and hashlib.sha1(b"abc").digest()
