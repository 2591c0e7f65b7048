import random

import pytest
from pyspark.sql import functions as F

from logtables.functions.templates import key_of
from logtables.operators import chunks, parse
from logtables.plans.ingest import records_of
from logtables.plans.search import query_archive
from logtables.sources import archive, index, samples


@pytest.fixture(scope="module")
def indexed(spark, sf_dir, tmp_path_factory):
    """Batches of lines with words of their own; the last one has no index."""
    path = str(tmp_path_factory.mktemp("indexed"))
    lines = samples.event_lines(spark, sf_dir).withColumn("received_at", F.lit("2024-01-01").cast("timestamp"))
    for batch in range(6):
        own = lines.where(F.col("seq") % 6 == batch)
        marked = own.withColumn("line", F.concat("line", F.lit(f" Étape batchmark{batch} Straße{batch}")))
        archive.write_archive(records_of(chunks.chunk_by_line(parse.to_messages(marked), 1000)), path, batch)
        if batch < 5:
            index.index_archive(spark, path)
    return path


def found(spark, path, **asked):
    return sorted(tuple(r) for r in query_archive(spark, path, **asked).select("batch_id", "seq", "rendered").collect())


def test_same_rows_as_the_full_search(spark, indexed):
    rows = query_archive(spark, indexed).select("rendered", "template_key").orderBy(F.xxhash64("rendered")).limit(24).collect()
    rng = random.Random(5)
    for k, row in enumerate(rows):
        text = row.rendered.split("] ", 1)[1]
        start = rng.randrange(len(text))
        needle = text[start : start + rng.randint(1, 25)]
        needle = rng.choice([needle, needle.upper(), needle.lower()])
        asked = {"text": needle} if k % 2 else {"text": needle, "template_key": row.template_key}
        assert found(spark, indexed, indexed=True, **asked) == found(spark, indexed, **asked), needle


def test_files_that_cannot_match_are_not_opened(spark, indexed):
    every = index.record_files(spark, indexed).count()
    assert every >= 6

    def opened(**asked):
        return len(index.read_records_for(spark, indexed, **asked).inputFiles())

    unindexed = index.record_files(spark, indexed).where("file like 'batch_id=5/%'").count()
    assert opened() == every
    assert opened(text="BATCHMARK3 ") == 1 + unindexed
    assert opened(text="no such text anywhere") == unindexed
    assert opened(text="ab") == every  # too short to tell
    own = spark.read.parquet(f"{indexed}/records/batch_id=2").where("pattern like '%batchmark2%'").first().template_key
    assert opened(template_key=own) == 1 + unindexed
    assert opened(template_key=key_of("nothing like this")) == unindexed
    # Across the border of a wildcard: a variable, a blank, then text of the pattern.
    row = query_archive(spark, indexed).where("pattern like '% batchmark1 %' and size(variables) > 0").first()
    token = row.message.split().index("batchmark1")
    needle = " ".join(row.message.split()[token - 2 : token + 2])
    assert found(spark, indexed, text=needle, indexed=True) == found(spark, indexed, text=needle) != []


def test_index_again_and_replaced_batches(spark, indexed, tmp_path):
    import shutil

    path = str(tmp_path / "copy")
    shutil.copytree(indexed, path)
    for _ in range(2):
        index.index_archive(spark, path)
    files = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/{index.FILES}")
    assert files.count() == files.select("file").distinct().count() == index.record_files(spark, path).count()
    assert index.read_records_for(spark, path, text="no such text").inputFiles() == []
    # A batch written anew has files that the index lacks; files of the old one are gone.
    again = archive.read_archive(spark, indexed)[0].where("batch_id = 2").withColumn("received_at", F.col("date").cast("timestamp"))
    archive.write_archive(again.drop("date", "batch_id"), path, 2)
    assert found(spark, path, text="batchmark2", indexed=True) == found(spark, path, text="batchmark2") != []
    assert len(index.read_records_for(spark, path, text="batchmark4", most=0).inputFiles()) == index.record_files(spark, path).count()


def test_no_archive_yet(spark, tmp_path):
    index.index_archive(spark, str(tmp_path / "none"))
    assert found(spark, str(tmp_path / "none"), text="x", indexed=True) == []
