import pytest
from pyspark.sql import functions as F

from logtables.operators import chunks, parse
from logtables.operators.report import size_report
from logtables.plans import compact
from logtables.plans.ingest import records_of
from logtables.plans.search import query_archive
from logtables.sources import archive, index, manifest, samples

NAMES = ["01", "1", "2", "large"]


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    lines = samples.event_lines(spark, sf_dir).where("seq < 400")
    return records_of(chunks.chunk_by_line(parse.to_messages(lines), 100)).cache()


def part(records, k):
    return records.where(F.col("seq") % 8 < 5) if k == 3 else records.where(F.col("seq") % 8 == 5 + k)


def rows_of(table):
    return sorted(map(repr, table.select(*sorted(table.columns)).collect()))


def state(spark, path):
    """All that readers see."""
    read, known = archive.read_archive(spark, path)
    found = query_archive(spark, path, text="host1", indexed=True)
    return rows_of(read), rows_of(known), rows_of(found.select("batch_id", "seq", "rendered"))


def test_compaction_changes_nothing_that_is_read(spark, tmp_path, records, monkeypatch):
    path = str(tmp_path / "archive")
    for k, name in enumerate(NAMES):
        archive.write_archive(part(records, k), path, name)
    index.index_archive(spark, path)
    before = state(spark, path)
    assert len(before[0]) == records.count() and before[2]
    sizes = {b: size for b, (size, _) in manifest.batch_marks(spark, f"{path}/records").items()}
    assert set(sizes) == set(NAMES) and sizes["large"] == max(sizes.values())
    early = archive.read_archive(spark, path)[0]  # listed before any of it

    # A run that ends before it publishes, and a version that was cut short.
    def stop(*_):
        raise OSError("cut short")

    with monkeypatch.context() as cut:
        cut.setattr(compact, "publish", stop)
        with pytest.raises(OSError):
            compact.compact_archive(spark, path, sizes["large"])
    assert state(spark, path) == before
    (tmp_path / "archive" / "manifest").mkdir()
    (tmp_path / "archive" / "manifest" / f"{1:012}.json").write_text('{"0000')
    assert state(spark, path) == before

    assert compact.compact_archive(spark, path, sizes["large"]) == NAMES[:3]
    assert state(spark, path) == before
    assert manifest.read_manifest(spark, path)[0] == 2
    with pytest.raises(Exception, match="[eE]xist"):  # another run was faster
        manifest.publish(spark, path, 2, {})
    assert compact.compact_archive(spark, path, sizes["large"]) == []
    files = {f.split("/records/")[1].split("/")[0] for f in archive.read_archive(spark, path)[0].inputFiles()}
    assert files == {"_compacted", "batch_id=large"}
    assert len(rows_of(early)) == len(before[0])

    # Cut short between the removal of patterns and of records.
    with monkeypatch.context() as cut:
        cut.setattr(compact, "remove", stop)
        with pytest.raises(OSError):
            compact.vacuum_archive(spark, path)
    assert state(spark, path) == before
    compact.vacuum_archive(spark, path)
    assert state(spark, path) == before
    assert sorted(p.name for p in (tmp_path / "archive" / "records").glob("[!.]*")) == ["_compacted", "batch_id=large"]
    assert len(list((tmp_path / "archive" / "records" / "_compacted").glob("[!.]*"))) == 1
    report = size_report(spark.createDataFrame([("x",)], "line string"), archive.read_archive(spark, path)[0], path).first()
    assert report.archived_bytes == sum(f.stat().st_size for f in (tmp_path / "archive").rglob("*.parquet") if "/index" not in str(f))

    # A batch written anew counts in place of its copy, also after it is compacted again.
    archive.write_archive(part(records, 1).where("seq % 16 < 8"), path, "1")
    after = state(spark, path)
    kept = records.where("seq % 8 != 6 OR seq % 16 < 8").count()
    assert len(after[0]) == kept < len(before[0])
    archive.write_archive(part(records, 0), path, "new")
    after = state(spark, path)
    assert compact.compact_archive(spark, path, sizes["large"]) == ["1", "new"]
    assert state(spark, path) == after
    compact.vacuum_archive(spark, path)
    assert state(spark, path) == after


def test_a_batch_written_meanwhile_is_not_replaced(spark, tmp_path, records, monkeypatch):
    path = str(tmp_path / "archive")
    for k in range(2):
        archive.write_archive(part(records, k), path, k)
    whole, calls = compact.batch_marks, []

    def marks(*of):
        calls.append(of)
        if len(calls) == 2:  # after copying
            archive.write_archive(part(records, 2), path, 1)
        return whole(*of)

    monkeypatch.setattr(compact, "batch_marks", marks)
    assert compact.compact_archive(spark, path) == []
    read = archive.read_archive(spark, path)[0]
    assert {r.seq % 8 for r in read.collect()} == {5, 7} and not list((tmp_path / "archive" / "records" / "_compacted").glob("[!.]*"))
