import glob
import hashlib
import os

import pyarrow.parquet as pq
import pytest

from logtables.llm import warc
from logtables.sources.scratch import scratch_dir

PAGES = [
    (1, "http://a/x y", "short"), (2, "http://a/", "short"), (5, None, "long é " * 40), (4, "u", "long é " * 40), (6, "u", "long é " * 40),
    (7, "", None), (8, "u", ""), (9, "u", "\r\n\r\nWARC/1.0\r\n" * 3), (10, "é\r\nX: y", "😀" * 30_000), (11, "u", "z" * 100), (12, "u", "z" * 100),
    (None, "u", "z" * 100), (12, "u", "z" * 100), (13, "u", "y" * 99), (14, "u", "y" * 99),
]


def test_roundtrip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    path = scratch_dir(spark, "warc")
    found = warc.roundtrip(pages, path).collect()
    first = {}
    for page, _, html in PAGES:
        data = (html or "").encode()
        if page is not None and len(data) >= 100:
            first[data] = min(page, first.get(data, page))
    wanted = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        again = page is not None and data in first and page > first[data]
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None, None, None if again else data))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.fault, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    records = warc.read_records(spark, path)
    assert records.where("type = 'continuation'").count() > 3
    assert warc.roundtrip(pages.limit(0), scratch_dir(spark, "warc")).count() == 0


def test_ids_of_any_text(spark):
    ids = ["none", "", "a\r\nWARC-Type: x", "a:b:3", "100%", "%41", "+ +", "é😀", "<x>", " lead ", None, None, "z"]
    pages = spark.createDataFrame([(i, "u", "same text " * 20) for i in ids] + [("own", "u", "x")], "page_id string, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = warc.roundtrip(pages, scratch_dir(spark, "warc")).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    wanted = [(i, "revisit", "") if i else (i, "response", None) for i in ids]  # the empty id is the least
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in found if r.page_id != "own"), key=str) == sorted(wanted, key=str)
    assert {r.fault for r in found} == {None} and {r.payload_bytes for r in found} == {1, 200}


def record(number, block, total=None, kind="continuation", origin="o", digest=None):
    return (f"{origin}:{number}", origin, kind, number, total, digest, None, block)


def test_faults(spark):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    a, b = block[:30], block[30:]
    rows = [
        record(2, b, len(block), origin="good"), record(1, a, kind="response", origin="good"),
        record(1, a, kind="response", origin="lost"),
        record(1, a, kind="response", origin="gap"), record(3, b, len(block), origin="gap"),
        record(1, a, kind="response", origin="long"), record(2, b, 1, origin="long"),
        record(1, block[:-9], kind="response", origin="torn"),
        record(1, block, kind="response", origin="other", digest="00"),
        record(1, b"HTTP/1.0 200 OK\r\n\r\nplain", kind="response", origin="plain"),
    ]
    found = {r.record_id: (r.fault, r.payload and bytes(r.payload)) for r in warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert found == {
        "good": (None, b"hello world"), "lost": ("length", None) if found["lost"][0] == "length" else ("framing", None), "gap": ("segments", None),
        "long": ("length", None), "torn": ("framing", None), "other": ("digest", None), "plain": (None, b"plain"),
    }


def test_framing():
    for size in (0, 1, 4095, 4096, 4097):
        assert warc.unchunked(warc.chunked(b"x" * size)) == b"x" * size
    assert warc.unchunked(b"3 ;name=x\r\nabc\r\n0\r\n\r\n") == b"abc"
    for body in (b"5\r\nabc", b"+3\r\nabc\r\n0\r\n\r\n", b"-3\r\nabc\r\n0\r\n\r\n", b"0x3\r\nabc\r\n0\r\n\r\n", b"0_3\r\nabc\r\n0\r\n\r\n", b"\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(body)
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_disk_holds_payloads_once(spark):
    def shuffled():
        return {f.getName() for f in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles())) if f.getName().startswith("shuffle_")}

    pages = spark.createDataFrame([(k, "u", f"page {k % 7} " * 50) for k in range(40)], "page_id long, url string, html string").repartition(3)
    before = shuffled()
    found = warc.roundtrip(pages, scratch_dir(spark, "warc"))
    assert not shuffled() - before  # neither those that wrote the archive nor those of its segments
    (table,) = {os.path.dirname(f) for f in found.select("payload").inputFiles()}
    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{table.removeprefix('file:')}/*.parquet")]
    assert {m.row_group(0).column(2).compression for m in groups if m.num_row_groups} == {"ZSTD"}
    assert found.where("payload is not null").count() == 7 and found.count() == 40
