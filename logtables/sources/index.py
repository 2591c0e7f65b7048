"""An index of the archive's record files, so that a query opens only files that can hold what it asks for.

For each file it lists the template keys and a set of trigrams. The index is built after loads, for files that it
lacks; files without an index are always read, so a query never misses rows, however old the index is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.sources.archive import CODEC, RECORDS, SCHEMAS, new_batch, read_table
from logtables.sources.manifest import live_folders, read_copies

FILES, KEYS = "index_files", "index_keys"
INDEX = {FILES: "file string, n_rows long, grams array<int>", KEYS: "file string, template_key string"}

#: Trigrams are counted as numbers below this, so what is kept of a file has a bound.
GRAM_NUMBERS = 1 << 16
#: Lists of more files than this are not made on the driver; the whole table is read instead.
MOST_FILES = 20_000
#: The text columns of a record that a search looks at, beside its pattern and variables.
SEARCHED = ["hostname", "app_name", "procid", "msgid", "structured_data", "node_id", "priority"]
# Only characters whose lower case is the same wherever they stand.
PLAIN_PIECE = r"[\x21-\x7e]{3,}"


def _relative(path: Column) -> Column:
    return F.regexp_extract(path, rf"/{RECORDS}/(batch_id=.*)$", 1).alias("file")


def _grams(pieces: Column) -> Column:
    """Numbers of the trigrams of an array of pieces of text."""

    def of_piece(piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(piece) - 2)
        return F.transform(starts, lambda k: F.pmod(F.xxhash64(F.substr(piece, k, F.lit(3))), F.lit(GRAM_NUMBERS)).cast("int"))

    return F.array_distinct(F.flatten(F.transform(pieces, of_piece)))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN_PIECE), F.lit(0))


def _table(spark: SparkSession, path: str, table: str) -> DataFrame:
    try:
        return spark.read.schema(INDEX[table]).option("recursiveFileLookup", "true").parquet(f"{path}/{table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX[table])


def indexed_keys(spark: SparkSession, path: str) -> DataFrame:
    """The template keys of each indexed file: ``file, template_key``."""
    return _table(spark, path, KEYS)


def record_files(spark: SparkSession, path: str) -> DataFrame:
    """The names of all record files, from their listing; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        return listed.load(f"{path}/{RECORDS}").select(_relative(F.col("path")))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string")


def index_archive(spark: SparkSession, path: str) -> None:
    """Index the record files that have no index. Run it after loads; running it again adds nothing.

    A trigram never spans a blank, and a wildcard is a whole token, so the trigrams of patterns, variables and
    header fields are all that can occur in a line. Distinct texts of a file come first, as most repeat.
    """
    missing = record_files(spark, path).join(_table(spark, path, FILES).select("file"), "file", "left_anti")
    names = [r["file"] for r in missing.limit(MOST_FILES).collect()]  # the rest the next time
    while names:
        _index_files(spark, path, names)
        names = [r["file"] for r in missing.limit(MOST_FILES).collect()] if len(names) == MOST_FILES else []


def _index_files(spark: SparkSession, path: str, names: list[str]) -> None:
    read = _read(spark, path, names).select("*", _relative(F.col("_metadata.file_path")))
    texts = F.array_append(F.col("variables"), F.col("pattern"))
    for name in SEARCHED:
        texts = F.array_append(texts, F.col(name).cast("string"))
    said = read.select("file", F.explode(F.array_distinct(texts)).alias("text")).where("text is not null").distinct()
    grams = said.select("file", F.explode(_grams(_pieces(F.col("text")))).alias("gram")).distinct()
    grams = grams.groupBy("file").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    rows = read.groupBy("file").agg(F.count("*").alias("n_rows"))
    batch = new_batch()
    keys = read.select("file", "template_key").distinct().hint("rebalance").sortWithinPartitions("template_key", "file")
    keys.write.options(**CODEC).parquet(f"{path}/{KEYS}/{batch}")
    # Last, as a file counts as indexed from then on; keys that a run cut short has left are harmless.
    found = rows.join(grams, "file", "left").select("file", "n_rows", F.coalesce("grams", F.array().cast("array<int>")).alias("grams"))
    found.hint("rebalance").write.options(**CODEC).parquet(f"{path}/{FILES}/{batch}")


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[RECORDS]).option("basePath", f"{path}/{RECORDS}")
    return reader.parquet(*[f"{path}/{RECORDS}/{name}" for name in names])


def files_for(spark: SparkSession, path: str, template_key: str | None = None, text: str | None = None) -> DataFrame:
    """The names of the record files that can hold records of a template and with a text; also all without an index."""
    files = _table(spark, path, FILES)
    asked = F.lit(True)
    if text is not None:
        wanted = spark.range(1).select(_grams(_pieces(F.lit(text))).alias("grams")).first()["grams"]
        asked = F.size(F.array_except(F.array(*map(F.lit, wanted)).cast("array<int>"), "grams")) == 0
    fits = files.where(asked).select("file")
    if template_key is not None:
        having = _table(spark, path, KEYS).where(F.col("template_key") == template_key).select("file").distinct()
        fits = fits.join(having, "file", "left_semi")
    there = record_files(spark, path)
    unknown = there.join(files.select("file"), "file", "left_anti")
    return there.join(fits.distinct(), "file", "left_semi").unionByName(unknown)


def read_records_for(spark: SparkSession, path: str, template_key: str | None = None, text: str | None = None, most: int = MOST_FILES) -> DataFrame:
    """The records table, of files that can match only. All its rows that match are there, and others.

    Copies of compacted batches are read whole: they are sorted by template, and have no index.
    Names of up to ``most`` files pass through the driver; if more can match, the whole table is read, as it
    would not pay to leave files out.
    """
    passed, folders = live_folders(spark, path, RECORDS)
    batch = F.regexp_extract("file", "^batch_id=([^/]+)/", 1)
    wanted = files_for(spark, path, template_key, text)
    names = [r["file"] for r in (wanted.where(~batch.isin(sorted(passed))) if passed else wanted).limit(most + 1).collect()]
    if len(names) > most:
        return read_table(spark, path, RECORDS)
    rows = _read(spark, path, names) if names else spark.createDataFrame([], SCHEMAS[RECORDS])
    for copies in read_copies(spark, f"{path}/{RECORDS}", SCHEMAS[RECORDS], folders):
        rows = rows.unionByName(copies)
    return rows
