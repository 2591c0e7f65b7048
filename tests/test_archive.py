import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtables.functions.syslog import iso_time, short_time, utc_date
from logtables.operators import catalog, chunks, encode, live, parse, query, report
from logtables.plans.ingest import ingest_batch, records_of
from logtables.plans.measure import measure_archive
from logtables.plans.search import query_archive
from logtables.plans.verify import compare_spans, verify_archive
from logtables.sources import archive, feed, samples
from logtables.sources import lines as sources
from logtables.sources.scratch import scratch_dir


@pytest.fixture(scope="module")
def messages(spark, sf_dir):
    return chunks.chunk_by_line(parse.to_messages(samples.event_lines(spark, sf_dir)), 100).cache()


@pytest.fixture(scope="module")
def records(messages):
    return records_of(messages).cache()


def rows_of(table):
    return sorted(map(repr, table.select(*sorted(table.columns)).collect()))


def formula_lines(spark, n):
    """Repetitive lines: three valves, eight process numbers."""
    line = """concat('<77>1 2024-03-05T06:07:08.009Z plant3 boiler ', 400 + id % 8, ' VALVE - Valve ',
        element_at(array('north', 'south', 'inlet'), int(id % 3) + 1), ' moved to position ', id % 199)"""
    return spark.range(n).selectExpr(
        "id AS seq", "timestamp'2023-10-12 00:00:00' AS received_at", "'node-0' AS node_id", f"{line} AS line"
    )


def test_what_is_written_is_read(spark, tmp_path, records):
    path = str(tmp_path / "archive")
    archive.write_archive(records, path)
    read, known = archive.read_archive(spark, path)
    kept = [name for name in archive.STORED if name != "event_ms"]
    whole_ms = F.timestamp_millis(F.unix_millis("event_ts")).alias("event_ts")
    assert rows_of(read.drop("batch_id", "date")) == rows_of(records.withColumn("chunk_id", F.col("chunk_id").cast("string")).select(*kept, whole_ms))
    assert rows_of(known.drop("batch_id")) == rows_of(catalog.template_catalog(records))


def test_batches_add_up_and_a_repeated_batch_adds_nothing(spark, tmp_path, records):
    path = str(tmp_path / "archive")
    archive.write_archive(records, path, 0)
    for _ in range(2):
        archive.write_archive(records, path, 1, known=archive.read_table(spark, path, "templates").where("batch_id = 0"))
    read, known = archive.read_archive(spark, path)
    assert read.count() == 2 * records.count()
    assert known.count() == records.select("pattern").distinct().count()


def test_a_day_with_most_rows_is_split_and_a_small_batch_is_not(spark, tmp_path, records):
    one_day = records.withColumn("received_at", F.lit(dt.datetime(2024, 1, 1)))
    archive.write_records(one_day, str(tmp_path / "whole"), 0)
    assert len(list((tmp_path / "whole").rglob("*.parquet"))) == 1
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "16KB")
    try:
        archive.write_records(one_day.repartition(8), str(tmp_path / "split"), 0)
    finally:
        spark.conf.set(setting, before)
    assert len(list((tmp_path / "split").rglob("*.parquet"))) > 3


def test_one_record_with_its_pool(spark):
    line = "<34>1 2024-01-01T00:00:00Z testhost testapp - - - Something happened"
    lines = spark.createDataFrame([(0, dt.datetime(2024, 1, 1), None, line)], "seq long, received_at timestamp, node_id string, line string")
    record = records_of(chunks.chunk_by_line(parse.to_messages(lines)))
    assert record.count() == 1
    assert [(r.string_id, r.value) for r in encode.string_pool(record).collect()] == [(0, "testhost"), (1, "testapp")]
    resolved = encode.resolve_strings(encode.encode_strings(record), encode.string_pool(record)).first()
    assert (resolved.hostname, resolved.app_name, resolved.procid, resolved.node_id) == ("testhost", "testapp", "-", "-")


def test_template_filter_reaches_the_scan(spark, tmp_path, records):
    path = str(tmp_path / "archive")
    archive.write_archive(records, path)
    key = records.first().template_key
    found = query_archive(spark, path, key, "user")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(template_key), EqualTo(template_key" in plan
    assert "Exchange" not in plan
    assert found.count() == query.search(query.reconstruct(records.where(F.col("template_key") == key)), "user").count()
    narrow = archive.read_archive(spark, path)[0].groupBy("template_key").count()
    scan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<template_key:string>" in scan


def test_string_numbers_follow_first_use(records, messages):
    stored = encode.stored_order(records).orderBy("chunk_id", "row_pos").collect()
    pools, expected = {}, {}
    for r in stored:
        pool = pools.setdefault(r.chunk_id, {})
        numbers = [None if r[f] is None else pool.setdefault(r[f], len(pool)) for f in encode.POOLED_FIELDS]
        expected[r.seq] = tuple(numbers)
    encoded = encode.encode_strings(records)
    got = {r.seq: tuple(r[f"{f}_id"] for f in encode.POOLED_FIELDS) for r in encoded.collect()}
    assert got == expected
    strings = {(r.chunk_id, r.value): r.string_id for r in encode.string_pool(records).collect()}
    assert strings == {(c, value): k for c, pool in pools.items() for value, k in pool.items()}


def test_encoding_shuffles_once_per_table(records):
    # One exchange by chunk beyond those of the records themselves.
    plan = encode.encode_strings(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange") == 1


def test_pools_hold_each_record_once(spark):
    """No task sorts or numbers one row per record and field: its memory would be many times its share of the input."""
    rows = [(c, k, None if k % 4 == 0 else f"h{k % 5}", f"s{c}-{k}", "n") for c in (0, 1, None) for k in (2, 3, 3, 0, 1)]
    records = spark.createDataFrame(rows, "chunk_id long, seq long, hostname string, structured_data string, node_id string").select(
        "*", F.lit(2).alias("token_count"), (-F.col("seq")).alias("opened_seq"), *[F.lit(None).cast("string").alias(f) for f in ("app_name", "procid", "msgid")]
    )
    pool, encoded = encode.string_pool(records), encode.encode_strings(records)
    plan = encode.resolve_strings(encoded, pool)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan
    pools = {(r.chunk_id, r.string_id): r.value for r in pool.collect()}
    assert [pools[None, k] for k in range(7)] == ["h3", "sNone-3", "n", "h2", "sNone-2", "h1", "sNone-1"] and len(pools) == 3 * 8
    got = sorted((repr(r.chunk_id), r.row_pos, r.seq, pools.get((r.chunk_id, r.hostname_id)), r.app_name_id, pools[r.chunk_id, r.structured_data_id]) for r in encoded.collect())
    assert got == [
        (repr(c), i, k, None if k == 0 else f"h{k}", None, f"s{c}-{k}") for c in (0, 1, None) for i, k in enumerate((3, 3, 2, 1, 0))
    ]
    resolved = encode.resolve_strings(encoded, pool).where("chunk_id = 1").collect()
    assert sorted((r.seq, r.hostname, r.procid) for r in resolved) == [(0, "-", "-"), (1, "h1", "-"), (2, "h2", "-"), (3, "h3", "-"), (3, "h3", "-")]


def test_gaps_and_back(records):
    gaps = encode.arrival_gaps(records)
    back = encode.times_from_gaps(gaps.drop("event_ms"))
    assert rows_of(back.select("seq", "event_ms")) == rows_of(gaps.select("seq", "event_ms"))


def test_unknown_template(spark, records):
    empty = spark.createDataFrame([], "template_key string, pattern string")
    assert {r.message for r in query.reconstruct(records, empty).select("message").distinct().collect()} == {"UNKNOWN"}


def test_filling_is_positional(spark):
    rows = [("a <*> b <*>", ["<*>", "x"]), ("<*>", ["$1\\"]), ("a<*>b <*>", ["v"]), ("<*> <*>", ["only"]), ("", []), ("s", ["extra"])]
    table = spark.createDataFrame(rows, "pattern string, variables array<string>")
    got = [r.message for r in query.reconstruct(table).collect()]
    assert got == ["a <*> b x", "$1\\", "a<*>b v", "only <*>", "", "s"]


def test_rendering(spark):
    lines = [
        "<34>1 2023-10-11T22:14:15.003Z myhost myapp 1234 ID47 [x y=\"1\"] hello  world",
        "<34>1 2023-10-11T22:14:15.000999Z - - - - - m",
        "<13>Oct  1 00:00:00 h su: m",
    ]
    table = spark.createDataFrame(
        [(i, dt.datetime(2024, 2, 3, 4, 5, 6), "n", line) for i, line in enumerate(lines)],
        "seq long, received_at timestamp, node_id string, line string",
    )
    rendered = query.render(query.reconstruct(records_of(chunks.chunk_by_line(parse.to_messages(table)))))
    assert [r.rendered for r in rendered.orderBy("seq").collect()] == [
        '[n] <34>1 2023-10-11T22:14:15.003+00:00 myhost myapp 1234 ID47 [x y="1"] hello world',
        "[n] <34>1 2023-10-11T22:14:15+00:00 - - - - [-] m",
        "[n] <13>Feb 03 04:05:06 h su: m",
    ]


def test_search_is_literal_and_ignores_case(spark, records):
    full = query.reconstruct(records)
    assert query.search(full, "").count() == full.count()
    assert query.search(full, "%").count() == 0
    assert query.search(full, "ERROR 100").count() == query.search(full, "error 100").count() > 0


def test_roundtrip_counts_what_differs(messages, records):
    clean = query.roundtrip_check(messages, records).first()
    assert tuple(clean) == (clean.n_messages, clean.n_messages, 0, 0, 0, 0)
    twice = query.roundtrip_check(messages, records.union(records)).first()
    assert (twice.n_duplicate, twice.n_extra, twice.n_different) == (clean.n_messages, 0, 0)
    first = records.agg(F.min("seq")).first()[0]
    lost = query.roundtrip_check(messages, records.where(F.col("seq") != first)).first()
    assert (lost.n_missing, lost.n_extra, lost.n_different) == (1, 0, 0)
    swapped = records.withColumn("app_name", F.when(F.col("seq") == first, F.col("procid")).otherwise(F.col("app_name")))
    swapped = swapped.withColumn("procid", F.when(F.col("seq") == first, None).otherwise(F.col("procid")))
    assert query.roundtrip_check(messages, swapped).first().n_different == 1


@pytest.mark.parametrize("span", [1, 16, 1 << 16])
def test_spans_find_what_the_join_finds(spark, messages, records, span):
    odd = F.pmod(F.xxhash64("seq"), F.lit(7))
    changed = records.withColumn("msgid", F.when(odd == 1, F.lit("other")).otherwise(F.col("msgid")))
    fewer = records.where(odd != 2)
    cases = [
        records,
        changed,
        fewer,
        records.unionByName(records.where(odd == 3)),
        records.where(odd != 4).unionByName(records.where(odd == 5)),  # as many lost as there are twice
        changed.where(odd != 0).unionByName(records.where(odd == 1)),
        records.withColumn("seq", F.when(odd == 6, F.lit(None)).otherwise(F.col("seq"))),
        records.withColumn("node_id", F.when(odd == 6, F.lit(None)).otherwise(F.col("node_id"))),
        records.limit(0),
    ]
    for case in cases:
        assert verify_archive(messages, case, span).first().asDict() == query.roundtrip_check(messages, case).first().asDict()
    assert tuple(verify_archive(messages.limit(0), records.limit(0), span).first()) == (0,) * 6


def test_equal_archives_need_no_join_of_rows(spark, messages, records):
    plan = verify_archive(messages, records)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and compare_spans(messages, records).where("not same").isEmpty()


def test_files_are_numbered_line_by_line_whatever_the_split(spark, tmp_path):
    texts = {node: [f"<1>Oct 1 00:00:00 h {node} {i} " + "x" * (i % 50) for i in range(2000)] for node in ("a", "b")}
    for node, rows in texts.items():
        folder = tmp_path / f"node_id={node}"
        folder.mkdir()
        for k in range(3):
            (folder / f"part-{k}.log").write_text("\n".join(rows[k * 700 : (k + 1) * 700]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("7000", "40000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            numbered = sources.number_lines(
                sources.read_lines(spark, str(tmp_path)), scratch_dir(spark, "numbered"), sources.BY_NAME
            )
            got = {(r.node_id, r.seq): r.line for r in numbered.collect()}
            assert got == {(node, i): line for node, rows in texts.items() for i, line in enumerate(rows)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_end_at_line_feeds_only(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\rstill one\r\n\ntwo \xff\xfe bytes\nthree")
    got = [r.line for r in sources.read_lines(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == ["one\rstill one\r", "", "two �� bytes", "three"]


def test_framing(spark):
    cases = [
        ("12 <34>Oct 1 ab", "octet", "<34>Oct 1 ab"),
        ("12 <34>Oct 1 xé", "octet_partial", "12 <34>Oct 1 xé"),
        ("13 <34>Oct 1 xé", "octet", "<34>Oct 1 xé"),
        ("14 <34>Oct 1 xé", "octet", "<34>Oct 1 xé"),
        ("<34>Oct", "delimited", "<34>Oct"),
        ("\r<34>Oct", "delimited", "\r<34>Oct"),
        ("", "skipped", ""),
        ("\r\r", "skipped", "\r\r"),
        ("junk", "junk", "junk"),
        ("5", "octet_partial", "5"),
        ("99999999999999999999 x", "octet_partial", "99999999999999999999 x"),
    ]
    table = spark.createDataFrame([(i, "n", c[0]) for i, c in enumerate(cases)], "seq long, node_id string, line string")
    got = [(r.kind, r.line) for r in sources.classify_lines(table).orderBy("seq").collect()]
    assert got == [c[1:] for c in cases]


def test_ingest_equals_records_in_memory(spark, sf_dir, tmp_path):
    lines = samples.event_lines(spark, sf_dir)
    samples.land_lines(lines, str(tmp_path / "landing"))
    ingest_batch(spark, str(tmp_path / "landing"), str(tmp_path / "archive"), str(tmp_path / "work"), file_order=sources.BY_NAME)
    read, templates = archive.read_archive(spark, str(tmp_path / "archive"))
    own = records_of(chunks.assign_chunks(parse.to_messages(lines)))
    assert read.where(~F.startswith("chunk_id", F.concat("batch_id", F.lit("/")))).isEmpty()
    read = read.withColumn("chunk_id", F.expr("substring(chunk_id, length(batch_id) + 2)"))
    columns = ["chunk_id", "node_id", "priority", "hostname", "pattern", "variables"]
    assert rows_of(read.select(*columns)) == rows_of(own.select(*columns))
    assert templates.count() == own.select("pattern").distinct().count()
    assert archive.read_table(spark, str(tmp_path / "archive"), "rejects").count() + read.count() == lines.count()


def test_size_report_counts_all_files(spark, tmp_path):
    lines = formula_lines(spark, 5000)
    row = measure_archive(lines, str(tmp_path / "archive")).first()
    stored = sum(f.stat().st_size for f in (tmp_path / "archive").rglob("*.parquet"))
    assert (row.n_lines, row.n_chunks, row.archived_bytes) == (5000, 5, stored)
    assert row.raw_bytes == lines.agg(F.sum(F.length("line"))).first()[0]
    assert row.ratio == pytest.approx(row.raw_bytes / stored, abs=0.01)


def test_feed_objects(spark):
    lines = ["<34>1 - h a - - - say \"x\"\t/é", "<34>1 2023-10-11T22:14:15.5+01:00 h - - - [] m"]
    table = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1), "n", line) for i, line in enumerate(lines)],
        "seq long, received_at timestamp, node_id string, line string",
    )
    got = [r.value for r in feed.to_json_feed(parse.to_messages(table).orderBy("seq")).collect()]
    assert got == [
        '{"priority":34,"facility":4,"severity":2,"timestamp":null,"hostname":"h","app_name":"a","procid":null,"msgid":null,'
        '"structured_data":null,"message":"say \\"x\\"\\t/é","is_rfc5424":true,"node_id":"n"}',
        '{"priority":34,"facility":4,"severity":2,"timestamp":"2023-10-11T21:14:15.500Z","hostname":"h","app_name":null,"procid":null,'
        '"msgid":null,"structured_data":"","message":"m","is_rfc5424":true,"node_id":"n"}',
    ]


def test_tail_and_liveness(messages, records):
    newest = sorted((r.received_at, r.seq) for r in messages.select("received_at", "seq").collect())[-7:]
    tail = live.live_tail(messages, 7)
    assert sorted((r.received_at, r.seq) for r in tail.collect()) == newest
    assert "TakeOrderedAndProject" in tail._jdf.queryExecution().executedPlan().toString()
    exact = {r.node_id: r.n_templates for r in live.node_liveness(records).collect()}
    rough = {r.node_id: r.n_templates for r in live.node_liveness(records, exact=False).collect()}
    assert exact == rough and len(exact) == 3


def test_template_report_adds_up(records):
    rows = report.template_report(records).collect()
    total = query.reconstruct(records).agg(F.sum(F.octet_length("message"))).first()[0]
    assert sum(r.message_bytes for r in rows) == total
    assert sum(r.n_lines for r in rows) == records.count()
    top = [r.message_bytes for r in report.template_report(records, 3).collect()]
    assert top == sorted((r.message_bytes for r in rows), reverse=True)[:3]


def test_loads_add_up_and_a_repeated_load_adds_nothing(spark, tmp_path):
    path, work = str(tmp_path / "archive"), str(tmp_path / "work")
    landings = []
    for k in range(2):
        folder = tmp_path / f"landing-{k}" / "node_id=a"
        folder.mkdir(parents=True)
        rows = [f"<34>Oct 11 22:14:15 host app: load {k} of user{i}" for i in range(25)]
        (folder / "part.log").write_text("\n".join(rows) + "\n")
        landings.append(str(tmp_path / f"landing-{k}"))
    for landing in (*landings, landings[0]):
        ingest_batch(spark, landing, path, work)
    read, known = archive.read_archive(spark, path)
    assert read.count() == 50 and read.select("batch_id", "node_id", "seq").distinct().count() == 50
    assert read.select("chunk_id").distinct().count() == 6
    assert known.count() == known.select("template_key").distinct().count()
    assert query.reconstruct(read, known.union(known)).count() == 50


def test_framed_lines_are_archived(spark, tmp_path):
    folder = tmp_path / "landing" / "node_id=10.0.0.1%3A514"
    folder.mkdir(parents=True)
    rows = [f"<34>Oct 11 22:14:15 host app: user{i} came" for i in range(12)]
    (folder / "part.log").write_text("".join(f"{len(row)} {row}\n" for row in rows))
    ingest_batch(spark, str(tmp_path / "landing"), str(tmp_path / "archive"), str(tmp_path / "work"), framed=True)
    read, _ = archive.read_archive(spark, str(tmp_path / "archive"))
    assert read.count() == 12
    assert {row.node_id for row in read.select("node_id").collect()} == {"10.0.0.1:514"}


def test_times_are_shown_in_utc_in_any_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    times = ["2023-10-11T22:14:15.003Z", "1969-12-31T23:59:59.000003Z", "2024-02-29T00:00:00Z"]
    shown = ["2023-10-11T22:14:15.003", "1969-12-31T23:59:59.000003", "2024-02-29T00:00:00"]
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            ts = spark.createDataFrame([(t,) for t in times], "t string").withColumn("ts", F.to_timestamp("t"))
            rows = ts.select(iso_time(F.col("ts")), short_time(F.col("ts")), utc_date(F.col("ts")).cast("string")).collect()
            assert [row[0] for row in rows] == shown
            assert [row[1] for row in rows] == ["Oct 11 22:14:15", "Dec 31 23:59:59", "Feb 29 00:00:00"]
            assert [row[2] for row in rows] == [text[:10] for text in shown]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_heavy_templates_of_summaries_are_exact(spark):
    # Weights fall off slowly at first and have a long tail, dealt unevenly over the batches.
    rows = [(k * 1000 + i, f"key {k:04}", f"line {k} <*>", ["v" * (1 + i % 5)]) for k in range(400) for i in range(1 + 3000 // (k + 1) ** 2)]
    rows += [(10**6 + k, f"key {k:04}", "same <*>", ["x"]) for k in range(400, 420)]
    rows.append((10**7, None, None, None))
    table = spark.createDataFrame(rows, "seq long, template_key string, pattern string, variables array<string>").repartition(4)
    known = table.where("template_key is not null")
    parts = [table.where(F.pmod(F.xxhash64("seq"), F.lit(5)) == k) for k in range(5)]
    exact = [tuple(r) for r in report.template_report(known, 500).collect()]
    for most in (1, 10, 40, 4096):
        state = None
        for part in parts:
            state = report.heavy_state(part, state, most)
            assert state.count() <= most + 1
        apart = report.merge_heavy(*[report.heavy_state(part, most=most) for part in parts], most=most)
        for k, summary in ((1, state), (3, apart), (8, state), (500, apart)):
            assert [tuple(r) for r in report.heavy_templates(known, summary, k).collect()] == exact[:k]
    # Few candidates are left to read if weights are skewed.
    weights = {r["template_key"]: r["weight"] for r in apart.collect()}
    assert weights[None] == 0 and len(weights) == known.select("template_key").distinct().count() + 1
    assert report.heavy_templates(known.limit(0), report.heavy_state(known.limit(0)), 3).isEmpty()
