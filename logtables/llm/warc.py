"""WARC archives: records written in segments with chunked transfer framing, and reassembled."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.llm.staging import BATCH_ROWS, arrow_rows, shuffles_removed, stage

VERSION = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
MIN_REVISIT = 100
#: The block of a record holds at most this much, and a file at most so many records, so that a file
#: is read whole within bounded memory.
SEGMENT = 16384
RECORDS_PER_FILE = 1024
CHUNK = 4096
#: Files that a Python worker gets at once.
FILES_PER_BATCH = 4
DATE = "2024-01-01T00:00:00Z"
_SIZE = re.compile(rb"[0-9A-Fa-f]+")


def _record_id(page: object, place: int) -> str:
    """A row without id has a name of its own kind; of others, all but letters, digits and ``_.-~`` is escaped."""
    return f"<urn:unnamed:{place}>" if page is None else f"<urn:page:{quote(str(page), safe='')}:{place}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if it is cut short or badly framed."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("chunk size is missing")
        digits = body[at:stop].split(b";")[0].strip(b" \t")
        if not _SIZE.fullmatch(digits):
            raise ValueError("chunk size is not a number")
        size = int(digits, 16)
        at = stop + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message, its transfer framing undone."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("HTTP header has no end")
    coded = re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n"))
    return unchunked(body) if coded else body


def records_of_page(page: object, place: int, url: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int) -> list[bytes]:
    """The records of one page, each without the two line ends that close it."""
    target = quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")
    own = _record_id(page, place)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha256:{digest}")]
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{quote(refers_to, safe='')}>")]
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(head))]
        return [_head(fields) + head]
    block = head + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    records = []
    for number, part in enumerate(parts, 1):
        fields = [("WARC-Type", "response" if number == 1 else "continuation"), ("WARC-Record-ID", own if number == 1 else f"{own[:-1]}:{number}>")]
        fields += common
        if number == 1:
            fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
        else:
            fields += [("WARC-Segment-Origin-ID", own)]
        if len(parts) > 1:
            fields += [("WARC-Segment-Number", number)]
            if number == len(parts):
                fields += [("WARC-Segment-Total-Length", len(block))]
        records.append(_head([*fields, ("Content-Length", len(part))]) + part)
    return records


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """A WARC record per row below ``path``, in gzipped files of bounded size.

    Of rows with equal payloads of at least 100 bytes, those with the smallest id are responses and the
    others revisits of them; a row without id is a response. Blocks longer than ``segment`` go on in
    continuation records, which are dealt out anew and so may be in other files. The text writer puts
    the two line ends after each record that the format asks for.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.monotonically_increasing_id().alias("place"),
    )
    long = F.octet_length("payload") >= MIN_REVISIT
    firsts = rows.where(long).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select(F.col("digest").alias("known"), "first")
    joined = rows.join(firsts, long & (F.col("digest") == F.col("known")), "left")
    refers = F.when(F.col("page") > F.col("first"), F.col("first").cast("string"))
    joined = joined.select("page", "place", "url", "payload", "digest", refers.alias("refers_to"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for row in batch.to_pylist() for r in records_of_page(**row, segment=segment)]
            yield pa.record_batch([pa.array(found, pa.binary())], names=["record"])

    written = joined.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    with arrow_rows(pages.sparkSession, BATCH_ROWS), shuffles_removed(pages.sparkSession):
        written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


RECORD = "record_id string, origin_id string, type string, segment int, total long, digest string, refers_to string, block binary"


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record; raises ValueError if one is cut short."""
    at = 0
    while at < len(content):
        stop = content.find(END, at)
        if content[at : at + 5] != b"WARC/" or stop < 0:
            raise ValueError(f"no record at byte {at}")
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start = stop + 4
        end = start + int(fields["content-length"])
        if end + 4 > len(content) or content[end : end + 4] != END:
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, content[start:end]
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files below ``path``, one row each."""
    import zlib

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("origin_id", pa.string()), ("type", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    plain = []
                    while data:  # one gzip member after another
                        member = zlib.decompressobj(31)
                        plain.append(member.decompress(data) + member.flush())
                        data = member.unused_data
                    data = b"".join(plain)
                rows = []
                for fields, block in parse_records(data):
                    own = fields["warc-record-id"]
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    total = fields.get("warc-segment-total-length")
                    rows.append((own, fields.get("warc-segment-origin-id", own), fields["warc-type"], int(fields.get("warc-segment-number", 1)), total and int(total), digest, fields.get("warc-refers-to"), block))
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit: ``record_id``, ``record_type``, ``payload`` (null for revisits),
    ``digest`` (of the header), ``refers_to`` (record id) and ``fault``.

    Segments meet by the id of their origin, in one group as large as one payload, and are ordered by
    number. ``fault`` says what is wrong, and the payload is null then: a segment missing or twice, a
    total length that differs, bad transfer framing, or a digest that differs.
    """
    piece = F.struct("segment", "total", "type", "digest", "refers_to", "block")
    grouped = records.groupBy("origin_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))

    def join(pieces: list[dict]) -> tuple:
        first = pieces[0]
        if first["type"] == "revisit":
            return "revisit", None, first["digest"], first["refers_to"], None
        given = ("response", None, first["digest"], None)
        if [p["segment"] for p in pieces] != list(range(1, len(pieces) + 1)) or first["type"] != "response":
            return *given, "segments"
        block = b"".join(p["block"] for p in pieces)
        totals = [p["total"] for p in pieces if p["total"] is not None]
        if (len(pieces) > 1 or totals) and totals != [len(block)]:
            return *given, "length"
        try:
            payload = http_payload(block)
        except ValueError:
            return *given, "framing"
        if first["digest"] not in (None, hashlib.sha256(payload).hexdigest()):
            return *given, "digest"
        return "response", payload, first["digest"], None, None

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [join(p) for p in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.binary(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["record_id", "record_type", "payload", "digest", "refers_to", "fault"])

    return grouped.mapInArrow(joined, "record_id string, record_type string, payload binary, digest string, refers_to string, fault string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of archives by :func:`write_warc`: ``page_id`` (as text, null if it was null),
    ``record_type``, ``payload``, ``payload_bytes``, ``payload_digest``, ``refers_to`` (page id) and ``fault``.

    A revisit has the length and digest of the response it refers to; its payload stays there. The disk holds
    payloads in the shuffle of the segments and in the table of pages, and after that in the table alone.
    """
    with arrow_rows(spark, FILES_PER_BATCH), shuffles_removed(spark):
        pages = stage(reassemble(read_records(spark, path)), "pages", compression="zstd")
    named = F.col("record_id").startswith("<urn:page:")
    page = F.url_decode(F.regexp_extract("record_id", r"^<urn:page:(.*):\d+>$", 1))
    full = pages.select(
        F.when(named, page).alias("page_id"), "record_type", "payload", F.octet_length("payload").cast("long").alias("own_bytes"),
        F.col("digest").alias("payload_digest"), F.url_decode(F.regexp_extract("refers_to", r"^<urn:page:(.*)>$", 1)).alias("refers_to"), "fault",
    )
    full = full.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("refers_to")))
    wanted = full.where("refers_to is not null").select("refers_to", "payload_digest").distinct()
    known = full.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", "own_bytes")
    known = known.join(wanted, ["refers_to", "payload_digest"], "left_semi").dropDuplicates(["refers_to", "payload_digest"])
    met = full.join(known.withColumnRenamed("own_bytes", "known_bytes"), ["refers_to", "payload_digest"], "left")
    return met.select(
        "page_id", "record_type", "payload", F.coalesce("own_bytes", "known_bytes").alias("payload_bytes"), "payload_digest", "refers_to", "fault"
    )


def roundtrip(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The pages as they are read back after they have been written below ``path``.

    A null html is an empty payload, a null url an empty one, a row without id a response without
    ``page_id``. Ids may be any text, line ends included, and come back as they were. Repeated rows give a record each: those with the smallest id are all responses. Other
    columns are not archived. An empty table gives an empty one.
    """
    write_warc(pages, path, page_id, url, html)
    found = read_warc(pages.sparkSession, path)
    kind = pages.schema[page_id].dataType
    return found.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "fault", "payload",
    )
