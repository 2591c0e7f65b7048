"""Entry points: the flagship query, one query per operator, and their SQL counterparts.

Every query reads a whole table. Arrays are joined to strings and times given in microseconds, so
that both engines return plain columns.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles  # noqa: E402
from logtables.functions.templates import key_of  # noqa: E402
from logtables.operators import catalog, chunks, encode, live, mine, parse, query, report  # noqa: E402
from logtables.plans import compact  # noqa: E402
from logtables.plans.ingest import ingest_batch, records_of  # noqa: E402
from logtables.plans.measure import measure_archive  # noqa: E402
from logtables.plans.search import query_archive  # noqa: E402
from logtables.plans.verify import verify_archive  # noqa: E402
from logtables.sources import archive, feed, index, samples  # noqa: E402
from logtables.sources import lines as sources  # noqa: E402
from logtables.sources.scratch import scratch_dir  # noqa: E402
from logtables.streaming import live as streaming_live  # noqa: E402
from logtables.streaming.collect import flush_waiting, stream_archive  # noqa: E402

try:
    import corpus_pipeline
    from logtables.llm import queries as llm
except ModuleNotFoundError as missing:  # the subpackage or a library of its own may be left out; other imports may not
    if missing.name not in ("corpus_pipeline", "logtables.llm", "xxhash", "zstandard", "tiktoken", "public_tokenizers", "numpy", "pyarrow"):
        raise
    corpus_pipeline = llm = None

SEPARATOR = "\u001f"
HEADER = ["hostname", "app_name", "procid", "msgid", "structured_data"]
FAILURE_PATTERN = "Request <*> failed with code <*> after <*> ms"


def lines_of(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    # Times are shown and derived in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return samples.event_lines(spark, sf_dir, dealt)


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.to_messages(lines_of(spark, sf_dir))


def bulk(messages: DataFrame) -> DataFrame:
    return chunks.chunk_by_line(messages, chunks.BULK_CHUNK)


def live_chunks(messages: DataFrame) -> DataFrame:
    return chunks.assign_chunks(messages, chunks.LIVE_CHUNK)


def texts(messages: DataFrame) -> DataFrame:
    """What mining needs, for queries that ask for nothing else of a message."""
    return messages.select("node_id", "seq", "message")


def joined(array: str) -> Column:
    return F.array_join(array, SEPARATOR).alias(array)


def micros(name: str, alias: str) -> Column:
    return F.unix_micros(F.col(name)).alias(alias)


def landed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "landing")
    samples.land_lines(lines_of(spark, sf_dir, dealt=True), path, dealt=True)
    return path


# Sources and sinks


def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_lines(spark, landed(spark, sf_dir)).select("node_id", "line")


def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = sources.read_lines(spark, landed(spark, sf_dir))
    return sources.number_lines(read, scratch_dir(spark, "numbered"), sources.BY_NAME).select("node_id", "seq", "line")


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, sink = landed(spark, sf_dir), scratch_dir(spark, "sink")
    stream = sources.stream_lines(spark, path).writeStream.format("parquet").option("path", f"{sink}/lines")
    stream.option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{sink}/lines").select("node_id", "line")


def framed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as TCP would frame them: some counted, some counted wrongly, some empty."""
    size = F.octet_length("line")
    counted = [F.concat((size + extra).cast("string"), F.lit(" "), "line") for extra in (0, 5, 1)]
    framed = (
        F.when(F.col("seq") % 11 == 4, F.lit("\r"))
        .when(F.col("seq") % 3 == 0, counted[0])
        .when((F.col("seq") % 3 == 1) & (F.col("seq") % 7 == 0), counted[1])
        .when(F.col("seq") % 5 == 0, counted[2])
        .otherwise(F.col("line"))
    )
    return lines_of(spark, sf_dir).withColumn("line", framed)


def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.classify_lines(framed_lines(spark, sf_dir)).select("seq", "kind", "line")


def count_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.count_kinds(framed_lines(spark, sf_dir))


def archived(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "archive")
    archive.write_archive(bulk_records(spark, sf_dir), path)
    return path


def write_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.read_archive(spark, archived(spark, sf_dir))[1].drop("batch_id")


def read_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive.read_archive(spark, archived(spark, sf_dir))
    return records.select(
        F.col("chunk_id").cast("long").alias("chunk_id"),
        "seq",
        "node_id",
        F.unix_millis("event_ts").alias("event_ms"),
        "priority",
        *HEADER,
        "is_rfc5424",
        "template_key",
        "pattern",
        joined("variables"),
    )


def to_json_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.to_json_feed(messages_of(spark, sf_dir))


# Parse job


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_lines(lines_of(spark, sf_dir))
    return parsed.select("seq", "node_id", "priority", *HEADER, "message", "is_rfc5424")


def decode_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse.parse_lines(lines_of(spark, sf_dir))
    return parse.decode_priority(parsed).select("seq", "priority", "facility", "severity")


def severity_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.severity_label(messages_of(spark, sf_dir)).select("seq", "severity", "severity_name")


def event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = parse.event_time(parse.parse_lines(lines_of(spark, sf_dir)))
    return timed.select("seq", micros("event_ts", "event_us"), "ts_source")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.quarantine(lines_of(spark, sf_dir)).drop("received_at")


def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_quality(lines_of(spark, sf_dir))


def tag_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.tag_node(messages_of(spark, sf_dir), "node-a").select("seq", "node_id", "message")


def tag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = messages_of(spark, sf_dir)
    owners = messages.groupBy("hostname").agg(F.concat(F.lit("node-of-"), F.min("node_id")).alias("node_id"))
    return parse.tag_nodes(messages, owners, "hostname").select("seq", "hostname", "node_id")


# Template mining


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.tokenize(messages_of(spark, sf_dir)).select("seq", joined("tokens"), "token_count")


def assign_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_chunks(texts(messages_of(spark, sf_dir))).select("node_id", "seq", "chunk_id")


def chunk_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk(messages_of(spark, sf_dir)).select("seq", "chunk_id")


def mined_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.mine_templates(bulk(texts(messages_of(spark, sf_dir))))


def mined_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.mine_templates(live_chunks(texts(messages_of(spark, sf_dir))))


def mined_view(mined: DataFrame) -> DataFrame:
    return mined.select("chunk_id", "token_count", "pattern", "opened_seq", "seq")


def mine_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_view(mined_bulk(spark, sf_dir))


def mine_templates_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_view(mined_live(spark, sf_dir))


def mine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined_view(mine.mine_templates(bulk(samples.document_messages(spark, sf_dir))))


def mine_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = samples.conversation_messages(spark, sf_dir)
    return mined_view(mine.mine_templates(chunks.chunk_by_line(turns, 100 << 32)))


def bulk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(bulk(messages_of(spark, sf_dir)))


def live_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(live_chunks(messages_of(spark, sf_dir)))


def extract_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk_records(spark, sf_dir).select("chunk_id", "seq", "template_key", joined("variables"))


def chunk_template_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine.chunk_template_ids(mined_live(spark, sf_dir))


def chunk_template_ids_imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk knows the patterns of the chunk before, as published by a peer."""
    mined = mined_bulk(spark, sf_dir)
    own = mine.chunk_template_ids(mined)
    published = own.select(
        (F.col("chunk_id") + 1).alias("chunk_id"), "pattern", F.col("template_id").alias("position")
    )
    imported = published.join(own.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return mine.chunk_template_ids(mined, imported)


def template_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.template_catalog(mined_bulk(spark, sf_dir))


def new_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of all nodes that the catalog of one node lacks."""
    path = scratch_dir(spark, "mined")
    mined_live(spark, sf_dir).select("node_id", "seq", "pattern").write.parquet(path)  # mined once, used on both sides
    mined = spark.read.schema("node_id string, seq long, pattern string").parquet(path)
    peer = catalog.template_catalog(mined.where(F.col("node_id") == "node-0"))
    return catalog.new_templates(mined, peer)


def merge_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_node = catalog.template_catalog(mined_live(spark, sf_dir), "node_id")
    return catalog.merge_catalogs(per_node).withColumn("nodes", F.array_join("nodes", ","))


def string_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.string_pool(bulk_records(spark, sf_dir))


def encode_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_strings(live_records(spark, sf_dir))


def arrival_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.arrival_gaps(bulk_records(spark, sf_dir))


def times_from_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = encode.arrival_gaps(bulk_records(spark, sf_dir)).drop("event_ms")
    return encode.times_from_gaps(gaps).drop("gap_ms")


# Query and reconstruct


def filter_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive.read_archive(spark, archived(spark, sf_dir))
    number = F.col("chunk_id").cast("long").alias("chunk_id")
    return query.filter_template(records, key_of(FAILURE_PATTERN)).select(number, "seq", "priority", joined("variables"))


def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their pattern, looked up in the archived catalog."""
    records, templates = archive.read_archive(spark, archived(spark, sf_dir))
    return query.reconstruct(records.drop("pattern"), templates).select("seq", "message")


def reconstruct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = records_of(bulk(samples.document_messages(spark, sf_dir)))
    return query.reconstruct(records).select("seq", "message")


def resolve_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = bulk_records(spark, sf_dir)
    resolved = encode.resolve_strings(encode.encode_strings(records), encode.string_pool(records))
    return resolved.select("seq", *encode.POOLED_FIELDS)


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query.search(query.reconstruct(bulk_records(spark, sf_dir)), 'id47 ev@32473 K="7')
    return found.select("seq", "node_id", "message")


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query.render(query.reconstruct(bulk_records(spark, sf_dir))).select("seq", "rendered")


def query_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_archive(spark, archived(spark, sf_dir), key_of(FAILURE_PATTERN), "HOST1").select("seq", "rendered")


def indexed(spark: SparkSession, sf_dir: str) -> str:
    path = archived(spark, sf_dir)
    index.index_archive(spark, path)
    return path


def index_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.indexed_keys(spark, indexed(spark, sf_dir)).select("template_key").distinct()


def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of an archive by template and text, in files that can match."""
    found = query_archive(spark, indexed(spark, sf_dir), key_of(FAILURE_PATTERN), "HOST1", indexed=True)
    return found.select("seq", "rendered")


def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive.read_archive(spark, archived(spark, sf_dir))
    return query.roundtrip_check(messages_of(spark, sf_dir), records)


def damaged(records: DataFrame) -> DataFrame:
    """Records of which some are lost, some are there twice and some have another priority."""
    changed = records.withColumn("priority", F.when(F.col("seq") % 1009 == 3, F.col("priority") + 1).otherwise(F.col("priority")))
    left = changed.where(F.col("seq") % 997 != 5)
    return left.unionByName(left.where(F.col("seq") % 1013 == 11))


def verify_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a comparison by spans finds in an archive with planted damage."""
    records, _ = archive.read_archive(spark, archived(spark, sf_dir))
    return verify_archive(messages_of(spark, sf_dir), damaged(records), 4096)


# Streaming


def collected(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "collected")
    lines = sources.stream_lines(spark, landed(spark, sf_dir))
    collector = stream_archive(lines, f"{path}/archive", f"{path}/work", file_order=sources.BY_NAME)
    collector.awaitTermination()
    flush_waiting(spark, f"{path}/archive", f"{path}/work", collector.lastProgress["batchId"])
    return f"{path}/archive"


def stream_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive.read_archive(spark, collected(spark, sf_dir))
    # A missing header time is the time of landing, which differs from run to run.
    known = F.when(F.col("ts_source") == "header", F.unix_micros("event_ts")).alias("event_us")
    return records.select(
        "node_id", "seq", "priority", *HEADER, "is_rfc5424", "ts_source", known, "pattern", joined("variables")
    )


def stream_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every published pattern with the number of archived lines that use it."""
    records, templates = archive.read_archive(spark, collected(spark, sf_dir))
    used = records.groupBy("pattern").agg(F.count("*").alias("n_lines"))
    return templates.select("pattern").join(used, "pattern", "full")


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = archive.read_table(spark, collected(spark, sf_dir), "rejects")
    return rejects.select("node_id", "line", "protocol", "reason")


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "ingested")
    ingest_batch(spark, landed(spark, sf_dir), f"{path}/archive", f"{path}/work", file_order=sources.BY_NAME)
    records, _ = archive.read_archive(spark, f"{path}/archive")
    known = F.when(F.col("ts_source") == "header", F.unix_micros("event_ts")).alias("event_us")
    return records.select(*ARCHIVED, known, joined("variables"))


def framed_landed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_dir(spark, "landing-framed")
    samples.land_lines(framed_lines(spark, sf_dir), path)
    return path


ARCHIVED = ["node_id", "seq", "priority", *HEADER, "is_rfc5424", "ts_source", "pattern"]


def ingest_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as TCP would frame them, archived without their counts."""
    path = scratch_dir(spark, "ingested-framed")
    ingest_batch(spark, framed_landed(spark, sf_dir), f"{path}/archive", f"{path}/work", file_order=sources.BY_NAME, framed=True)
    records, _ = archive.read_archive(spark, f"{path}/archive")
    return records.select(*ARCHIVED, joined("variables"))


def stream_framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "collected-framed")
    lines = sources.stream_lines(spark, framed_landed(spark, sf_dir))
    collector = stream_archive(lines, f"{path}/archive", f"{path}/work", file_order=sources.BY_NAME, framed=True)
    collector.awaitTermination()
    flush_waiting(spark, f"{path}/archive", f"{path}/work", collector.lastProgress["batchId"])
    records, _ = archive.read_archive(spark, f"{path}/archive")
    return records.select(*ARCHIVED, joined("variables"))


def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named loads, one of them repeated, in one archive."""
    path, landing = scratch_dir(spark, "loads"), landed(spark, sf_dir)
    for name in ("01", "1", "01"):
        ingest_batch(spark, landing, f"{path}/archive", f"{path}/work", batch_id=name, file_order=sources.BY_NAME)
    records, templates = archive.read_archive(spark, f"{path}/archive")
    published = templates.groupBy("pattern").agg(F.count("*").alias("n_published"))
    return records.join(published, "pattern", "left").select("batch_id", *ARCHIVED, joined("variables"), "n_published")


def compact_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of which two are compacted, one is repeated after that, and what they replace is removed."""
    path, landing = scratch_dir(spark, "compacted"), landed(spark, sf_dir)

    def load(name: str) -> None:
        ingest_batch(spark, landing, f"{path}/archive", f"{path}/work", batch_id=name, file_order=sources.BY_NAME)

    load("01")
    load("1")
    compact.compact_archive(spark, f"{path}/archive")
    load("1")
    compact.vacuum_archive(spark, f"{path}/archive")
    records, templates = archive.read_archive(spark, f"{path}/archive")
    published = templates.groupBy("pattern").agg(F.count("*").alias("n_published"))
    return records.join(published, "pattern", "left").select("batch_id", *ARCHIVED, joined("variables"), "n_published")


def in_parts(rows: DataFrame, path: str, parts: int = 6) -> DataFrame:
    """``rows`` landed as some files and read as a stream, a few files at a time."""
    rows.repartitionByRange(parts, "seq").write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tail")
    lines = in_parts(lines_of(spark, sf_dir), f"{path}/lines")
    tail = streaming_live.stream_tail(lines, f"{path}/kept", f"{path}/checkpoint")
    tail.awaitTermination()
    return streaming_live.tail_of(spark, f"{path}/kept", tail.lastProgress["batchId"]).drop("received_at")


def stream_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last arrival and the lines of each node; what the sketch estimates is held against the exact number."""
    path = scratch_dir(spark, "liveness")
    records = live_records(spark, sf_dir).select("node_id", "seq", "received_at", "template_key")
    query = streaming_live.stream_liveness(in_parts(records, f"{path}/records"), f"{path}/kept", f"{path}/checkpoint")
    query.awaitTermination()
    seen = streaming_live.liveness_of(spark, f"{path}/kept", query.lastProgress["batchId"])
    exact = spark.read.schema(records.schema).parquet(f"{path}/records").groupBy("node_id").agg(F.count_distinct("template_key").alias("exact"))
    near = (F.abs(F.col("n_templates") - F.col("exact")) <= 0.08 * F.col("exact")).alias("estimate_is_near")
    return seen.join(exact, "node_id").select("node_id", micros("last_seen", "last_seen_us"), "n_lines", "exact", near)


def stream_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templates with most message bytes: candidates from a summary of a stream, then exact."""
    path = scratch_dir(spark, "heavy")
    records = bulk_records(spark, sf_dir).select("seq", "template_key", "pattern", "variables")
    query = streaming_live.stream_heavy(in_parts(records, f"{path}/records"), f"{path}/kept", f"{path}/checkpoint", most=64)
    query.awaitTermination()
    state = streaming_live.heavy_of(spark, f"{path}/kept", query.lastProgress["batchId"])
    stored = spark.read.schema(records.schema).parquet(f"{path}/records")
    return report.heavy_templates(stored, state, 10).select("template_key", "n_lines", "message_bytes")


def live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_tail(messages_of(spark, sf_dir)).drop("received_at")


def live_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_search(messages_of(spark, sf_dir), "ERRhost1").drop("received_at")


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "found")
    lines = sources.stream_lines(spark, landed(spark, sf_dir))
    streaming_live.stream_search(lines, "infoHOST3", f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    # Lines without an app are RFC 3164, whose time is the time of landing.
    ts = F.when(F.col("app") == "-", "").otherwise(F.col("ts")).alias("ts")
    return spark.read.parquet(f"{path}/rows").select(ts, *[c for c in live.CELLS if c != "ts"])


def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "feed")
    lines = sources.stream_lines(spark, landed(spark, sf_dir))
    streaming_live.stream_feed(lines, f"{path}/objects", f"{path}/checkpoint").awaitTermination()
    schema = "node_id string, priority int, facility int, severity int, hostname string, app_name string, procid string, msgid string, "
    objects = spark.read.schema(schema + "structured_data string, message string, is_rfc5424 boolean, timestamp string").json(f"{path}/objects")
    header_time = F.when(F.col("is_rfc5424"), F.col("timestamp")).alias("header_time")
    return objects.select(
        "node_id", "priority", "facility", "severity", *HEADER, "message", "is_rfc5424", header_time
    )


def node_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = live.node_liveness(live_records(spark, sf_dir))
    return seen.select("node_id", micros("last_seen", "last_seen_us"), "n_lines", "n_templates")


# Measurement


def raw_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.raw_size(lines_of(spark, sf_dir))


def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the report does not depend on how Parquet packs the archive, and whether the rest agrees with itself."""
    sizes = measure_archive(lines_of(spark, sf_dir), scratch_dir(spark, "measured"))
    raw, kept = F.col("raw_bytes"), F.col("archived_bytes")
    return sizes.select(
        "n_lines",
        "raw_bytes",
        "n_chunks",
        ((F.col("n_files") > 0) & (kept > 0)).alias("has_files"),
        (kept < raw).alias("is_smaller"),
        (F.abs(F.col("ratio") * kept - raw) <= 0.005 * kept).alias("ratio_agrees"),
        (F.abs(raw * (1 - F.col("savings_percent") / 100) - kept) <= 0.0005 * raw).alias("savings_agree"),
    )


def template_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.template_report(bulk_records(spark, sf_dir))


def template_report_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = report.template_report(bulk_records(spark, sf_dir), 10)
    return top.select("template_key", "n_lines", "message_bytes")


def entry(spark: SparkSession) -> DataFrame:
    """Reconstructed lines that mention a failure: parse, mine, split, put back together, search."""
    records = bulk_records(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001"))
    found = query.render(query.search(query.reconstruct(records), "failed"))
    return found.select("chunk_id", "seq", "template_key", "pattern", "rendered")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    added = {} if llm is None else {**llm.QUERIES, "pipeline": corpus_pipeline.run}
    return {
        "read_lines": read_lines,
        "number_lines": number_lines,
        "stream_lines": stream_lines,
        "classify_lines": classify_lines,
        "count_kinds": count_kinds,
        "write_archive": write_archive,
        "read_archive": read_archive,
        "to_json_feed": to_json_feed,
        "parse_lines": parse_lines,
        "decode_priority": decode_priority,
        "severity_label": severity_label,
        "event_time": event_time,
        "quarantine": quarantine,
        "parse_quality": parse_quality,
        "tag_node": tag_node,
        "tag_nodes": tag_nodes,
        "tokenize": tokenize,
        "assign_chunks": assign_chunks,
        "chunk_by_line": chunk_by_line,
        "mine_templates": mine_templates,
        "mine_templates_live": mine_templates_live,
        "mine_documents": mine_documents,
        "mine_conversations": mine_conversations,
        "extract_variables": extract_variables,
        "chunk_template_ids": chunk_template_ids,
        "chunk_template_ids_imported": chunk_template_ids_imported,
        "template_catalog": template_catalog,
        "new_templates": new_templates,
        "merge_catalogs": merge_catalogs,
        "string_pool": string_pool,
        "encode_strings": encode_strings,
        "arrival_gaps": arrival_gaps,
        "times_from_gaps": times_from_gaps,
        "filter_template": filter_template,
        "reconstruct": reconstruct,
        "reconstruct_documents": reconstruct_documents,
        "resolve_strings": resolve_strings,
        "search": search,
        "render": render,
        "query_archive": query_archived,
        "index_archive": index_archive,
        "search_indexed": search_indexed,
        "roundtrip_check": roundtrip_check,
        "verify_archive": verify_damaged,
        "stream_archive": stream_archived,
        "stream_catalog": stream_catalog,
        "stream_rejects": stream_rejects,
        "ingest_batch": ingested,
        "ingest_batches": ingest_batches,
        "compact_archive": compact_archive,
        "ingest_framed": ingest_framed,
        "stream_framed": stream_framed,
        "stream_tail": stream_tail,
        "stream_liveness": stream_liveness,
        "stream_heavy": stream_heavy,
        "live_tail": live_tail,
        "live_search": live_search,
        "stream_search": stream_search,
        "stream_feed": stream_feed,
        "node_liveness": node_liveness,
        "raw_size": raw_size,
        "size_report": size_report,
        "template_report": template_report,
        "template_report_top": template_report_top,
        **added,
    }


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **({} if llm is None else llm.ORACLES)}
