import os

import pytest
from pyspark.sql import functions as F

from logtables.operators import chunks, live, parse
from logtables.operators.query import reconstruct
from logtables.plans.ingest import records_of
from logtables.sources import archive, samples
from logtables.sources import lines as sources
from logtables.streaming import collect
from logtables.streaming import live as streaming_live


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = samples.event_lines(spark, sf_dir).orderBy("seq").select("node_id", "line").collect()
    by_node = {}
    for r in rows:
        by_node.setdefault(r.node_id, []).append(r.line)
    return by_node


def land(folder, texts, first, last, second):
    """One more file per node with a slice of its lines; times order the files."""
    for node, rows in texts.items():
        target = folder / f"node_id={node}"
        target.mkdir(parents=True, exist_ok=True)
        path = target / f"{second}.log"
        hidden = target / f".{second}.log"
        hidden.write_text("".join(line + "\n" for line in rows[int(first * len(rows)) : int(last * len(rows))]))
        os.utime(hidden, (1_700_000_000 + second, 1_700_000_000 + second))
        hidden.rename(path)


def run(spark, folder, n=10, per_trigger=None):
    lines = sources.stream_lines(spark, str(folder / "landing"), per_trigger)
    query = collect.stream_archive(lines, str(folder / "archive"), str(folder / "work"), n)
    query.awaitTermination()
    return query.lastProgress["batchId"] if query.lastProgress else None


def templates_by_line(records):
    rows = records.select("node_id", "seq", "pattern", "variables").collect()
    return {(r.node_id, r.seq): (r.pattern, tuple(r.variables)) for r in rows}


def batch_result(spark, texts, n=10):
    rows = [(i, None, node, line) for node, lines in texts.items() for i, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "seq long, received_at timestamp, node_id string, line string")
    return records_of(chunks.assign_chunks(parse.to_messages(lines), n))


def test_stream_equals_batch_whatever_the_micro_batches(spark, texts, tmp_path):
    folder = tmp_path
    for k in range(4):
        land(folder / "landing", texts, k / 4, (k + 1) / 4, k)
    # Two triggers of two files per node each, then a second run, then the rest on shutdown.
    last = run(spark, folder, per_trigger=6)
    assert last == 1
    read, _ = archive.read_archive(spark, str(folder / "archive"))
    sizes = read.groupBy("chunk_id").count().select("count").distinct().collect()
    assert [r[0] for r in sizes] == [10]
    collect.flush_waiting(spark, str(folder / "archive"), str(folder / "work"), last)
    expected = templates_by_line(batch_result(spark, texts))
    read, known = archive.read_archive(spark, str(folder / "archive"))
    assert read.count() == len(expected)
    assert templates_by_line(read) == expected
    assert sorted(r.pattern for r in known.select("pattern").collect()) == sorted({p for p, _ in expected.values()})
    rejected = archive.read_table(spark, str(folder / "archive"), "rejects").count()
    assert rejected + len(expected) == sum(map(len, texts.values()))


def test_restart_and_flush_add_nothing_twice(spark, texts, tmp_path):
    folder = tmp_path
    land(folder / "landing", texts, 0, 0.5, 0)
    last = run(spark, folder)
    run(spark, folder)
    for _ in range(2):
        collect.flush_waiting(spark, str(folder / "archive"), str(folder / "work"), last)
    half = archive.read_archive(spark, str(folder / "archive"))[0].count()
    land(folder / "landing", texts, 0.5, 1, 1)
    last = run(spark, folder)
    collect.flush_waiting(spark, str(folder / "archive"), str(folder / "work"), last)
    read, known = archive.read_archive(spark, str(folder / "archive"))
    everything = batch_result(spark, texts).count()
    assert 0 < half < everything == read.count()
    assert read.select("node_id", "seq").distinct().count() == everything
    assert known.count() == known.select("pattern").distinct().count() == read.select("pattern").distinct().count()


def test_a_failed_batch_is_replaced(spark, texts, tmp_path, monkeypatch):
    folder = tmp_path
    land(folder / "landing", texts, 0, 0.5, 0)
    run(spark, folder)
    land(folder / "landing", texts, 0.5, 1, 1)

    def broken(*args, **kwargs):
        archive.write_records(args[0], args[1], args[2])
        raise RuntimeError("lost after the records were written")

    with monkeypatch.context() as patch:
        patch.setattr(collect, "write_archive", broken)
        with pytest.raises(Exception, match="lost after"):
            run(spark, folder)
    last = run(spark, folder)
    collect.flush_waiting(spark, str(folder / "archive"), str(folder / "work"), last)
    read, known = archive.read_archive(spark, str(folder / "archive"))
    assert templates_by_line(read) == templates_by_line(batch_result(spark, texts))
    assert known.count() == read.select("pattern").distinct().count()


def test_a_flush_cut_short_is_completed(spark, texts, tmp_path, monkeypatch):
    folder = tmp_path
    land(folder / "landing", texts, 0, 0.55, 0)
    last = run(spark, folder)

    def broken(*args, **kwargs):
        archive.write_records(args[0], args[1], args[2])
        raise RuntimeError("lost after the records were written")

    with monkeypatch.context() as patch:
        patch.setattr(collect, "write_archive", broken)
        with pytest.raises(RuntimeError):
            collect.flush_waiting(spark, str(folder / "archive"), str(folder / "work"), last)
    land(folder / "landing", texts, 0.55, 1, 1)
    last = run(spark, folder)
    collect.flush_waiting(spark, str(folder / "archive"), str(folder / "work"), last)
    read, known = archive.read_archive(spark, str(folder / "archive"))
    everything = batch_result(spark, texts).count()
    assert read.count() == read.select("node_id", "seq").distinct().count() == everything
    assert known.count() == known.select("pattern").distinct().count() == read.select("pattern").distinct().count()


def test_streamed_search_and_feed(spark, texts, tmp_path):
    land(tmp_path / "landing", texts, 0, 1, 0)
    lines = sources.stream_lines(spark, str(tmp_path / "landing"))
    streaming_live.stream_search(lines, "FAILED", str(tmp_path / "found"), str(tmp_path / "c1")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "found"))
    accepted = [line for rows in texts.values() for line in rows if "failed" in line]
    assert found.count() == len(accepted)
    streaming_live.stream_feed(lines, str(tmp_path / "feed"), str(tmp_path / "c2")).awaitTermination()
    feed = spark.read.json(str(tmp_path / "feed"))
    assert feed.count() == batch_result(spark, texts).count()
    assert set(feed.columns) >= {"priority", "timestamp", "hostname", "message", "node_id"}


def test_streamed_tail_keeps_the_newest(spark, texts, tmp_path):
    for k in range(4):
        land(tmp_path / "landing", texts, k / 4, (k + 1) / 4, k)
    lines = sources.stream_lines(spark, str(tmp_path / "landing"), 3)
    query = streaming_live.stream_tail(lines, str(tmp_path / "tail"), str(tmp_path / "c"), 50)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last >= 2 and len(list((tmp_path / "tail").glob("batch_id=*"))) == 2
    kept = spark.read.parquet(str(tmp_path / f"tail/batch_id={last}"))
    assert kept.count() == 50
    assert kept.select(F.min("received_at")).first()[0].timestamp() == 1_700_000_003
    tail = streaming_live.tail_of(spark, str(tmp_path / "tail"), last)
    assert tail.count() == 50 and set(live.CELLS) <= set(tail.columns)
    node = max(texts)
    newest = [r.message for r in tail.orderBy(F.desc("position")).collect()]
    assert texts[node][-1].endswith(newest[0]) or texts[node][-1].startswith("junk")


def test_lines_older_than_the_tail_are_left_out_ahead_of_parsing(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{k % 60:02d}", "n", f"<34>1 - h a - - - line {k}") for k in [*range(40, 60), *range(0, 40)]]
    lines = spark.createDataFrame(rows, "seq long, received_at string, node_id string, line string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    for part, bounds in enumerate(("seq >= 40", "seq < 20", "seq >= 20 and seq < 40")):
        lines.where(bounds).coalesce(1).write.parquet(str(tmp_path / f"lines/{part}"))
        stream = spark.readStream.schema(lines.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "lines"))
        query = streaming_live.stream_tail(stream, str(tmp_path / "tail"), str(tmp_path / "c"), 15)
        query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert sorted(r.seq for r in streaming_live.tail_of(spark, str(tmp_path / "tail"), last).collect()) == list(range(45, 60))


def test_liveness_as_a_stream(spark, tmp_path):
    rows = [(k, f"node-{k % 3}", 1_700_000_000 + k, f"key {k % (700 * (1 + k % 3))}") for k in range(9000)]
    records = spark.createDataFrame(rows, "seq long, node_id string, at long, template_key string").withColumn("received_at", F.timestamp_seconds("at"))
    records.repartitionByRange(5, "seq").write.parquet(str(tmp_path / "records"))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "records"))
    query = streaming_live.stream_liveness(stream, str(tmp_path / "kept"), str(tmp_path / "c"))
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last == 4 and len(list((tmp_path / "kept").glob("batch_id=*"))) == 2
    found = {r.node_id: r for r in streaming_live.liveness_of(spark, str(tmp_path / "kept"), last).collect()}
    exact = {r.node_id: r for r in live.node_liveness(records).collect()}
    assert set(found) == set(exact)
    for node, r in found.items():
        assert (r.last_seen, r.n_lines) == (exact[node].last_seen, exact[node].n_lines)
        assert abs(r.n_templates - exact[node].n_templates) <= 0.06 * exact[node].n_templates
    # Merging in any order and grouping gives the same, the estimate within its error.
    parts = [live.liveness_state(records.where(F.col("seq") % 4 == k)) for k in range(4)]
    merged = live.liveness_view(live.merge_liveness(live.merge_liveness(parts[3], parts[1]), live.merge_liveness(parts[0], parts[2])))
    for r in merged.collect():
        assert (r.last_seen, r.n_lines) == (found[r.node_id].last_seen, found[r.node_id].n_lines)
        assert abs(r.n_templates - exact[r.node_id].n_templates) <= 0.06 * exact[r.node_id].n_templates


def test_archived_stream_reads_back_as_text(spark, texts, tmp_path):
    land(tmp_path / "landing", texts, 0, 1, 0)
    last = run(spark, tmp_path)
    collect.flush_waiting(spark, str(tmp_path / "archive"), str(tmp_path / "work"), last)
    read, _ = archive.read_archive(spark, str(tmp_path / "archive"))
    rows = reconstruct(read).select("node_id", "seq", "message").collect()
    assert all(texts[r.node_id][r.seq].endswith(r.message) for r in rows)
