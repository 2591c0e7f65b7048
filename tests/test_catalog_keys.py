import pytest

from logtables.operators import catalog
from logtables.sources import archive, keys


def records(spark, patterns):
    rows = [(k, p) for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "seq long, pattern string").selectExpr("*", "md5(pattern) AS template_key")


def publish(spark, where, batch, patterns, every):
    """What a collector does with the patterns of a batch, without its lines."""
    folder = str(where)
    keys.compact(spark, f"{folder}/keys", batch, every)
    known = keys.known_keys(spark, f"{folder}/keys", batch - 1, every)
    new = catalog.new_templates(records(spark, patterns), known)
    archive.write_batch(new, f"{folder}/archive/templates", batch)
    keys.add_keys(spark, f"{folder}/keys", f"{folder}/archive", batch)


def test_reads_do_not_grow_with_the_batches(spark, tmp_path):
    every, reads, folders = 4, [], []
    for batch in range(22):
        patterns = [f"steady {k}" for k in range(20)] + [f"only in {batch}"]
        for _ in range(2 if batch in (4, 8, 9, 15) else 1):  # some batches run twice
            publish(spark, tmp_path, batch, patterns, every)
        known = keys.known_keys(spark, f"{tmp_path}/keys", batch, every)
        assert known.count() == known.distinct().count() == 21 + batch
        reads.append(len(known.inputFiles()))
        folders.append(len(list((tmp_path / "keys").glob("*/batch_id=*"))))
    assert max(reads[12:]) <= max(reads[4:12]) and max(folders[12:]) <= max(folders[:12]) + 1
    published = archive.read_table(spark, f"{tmp_path}/archive", "templates")
    assert published.count() == published.select("pattern").distinct().count() == 20 + 22


def test_flushed_keys_are_known(spark, tmp_path):
    publish(spark, tmp_path, 0, ["a"], 2)
    archive.write_batch(catalog.template_catalog(records(spark, ["b"])), f"{tmp_path}/archive/templates", keys.rest_of(0))
    keys.add_keys(spark, f"{tmp_path}/keys", f"{tmp_path}/archive", keys.rest_of(0))
    publish(spark, tmp_path, 1, ["a", "b", "c"], 2)
    publish(spark, tmp_path, 2, ["b", "c", "d"], 2)
    published = archive.read_table(spark, f"{tmp_path}/archive", "templates")
    assert sorted(r.pattern for r in published.collect()) == ["a", "b", "c", "d"]


def test_loads_of_any_plain_name_stay_apart(spark, tmp_path):
    from logtables.plans.ingest import ingest_batch

    landing = tmp_path / "landing" / "node_id=n1"
    landing.mkdir(parents=True)
    lines = [f"<34>1 2023-10-11T22:14:15.003Z h{k} app - - - User u{k} left room {k}" for k in range(25)]
    (landing / "a.log").write_text("\n".join([*lines, "junk"]) + "\n")
    names = ["01", "1", "1e3", "2024-01-02", 7]
    for name in [*names, "01", 7]:
        ingest_batch(spark, str(tmp_path / "landing"), str(tmp_path / "archive"), str(tmp_path / "work"), batch_id=name)
    read, known = archive.read_archive(spark, str(tmp_path / "archive"))
    assert {r.batch_id: r["count"] for r in read.groupBy("batch_id").count().collect()} == {str(n): 25 for n in names}
    assert known.count() == known.select("pattern").distinct().count() == read.select("pattern").distinct().count() > 0
    rejects = archive.read_table(spark, str(tmp_path / "archive"), "rejects")
    assert rejects.count() == len(names) and rejects.schema["batch_id"].dataType.simpleString() == "string"
    assert not list((tmp_path / "work").glob("*/batch_id=*"))
    for bad in ("a/b", "", "_x", ".x", "a b", "x=1"):
        with pytest.raises(ValueError):
            archive.batch_path("/a", bad)


def test_each_line_is_parsed_once(spark, tmp_path):
    """Only the table that lines are numbered from evaluates the line pattern."""
    from logtables.plans import ingest
    from logtables.sources.lines import number_lines, read_lines

    landing = tmp_path / "landing" / "node_id=n1"
    landing.mkdir(parents=True)
    (landing / "a.log").write_text("<34>1 - h a - - - hello\njunk\n")
    judged = ingest.judged_lines(read_lines(spark, str(tmp_path / "landing")), False)

    def patterns(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")

    assert patterns(judged) == 2  # one for each format
    lines = number_lines(judged, str(tmp_path / "staged"))
    for table in (ingest.judged_messages(lines).drop("event_ts", "ts_source"), ingest.rejected_lines(lines)):
        assert patterns(table) == 0
    assert ingest.rejected_lines(lines).count() == 1 and ingest.judged_messages(lines).count() == 1
