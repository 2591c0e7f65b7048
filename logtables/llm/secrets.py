"""Secret scans over a ledger of content-addressed texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtables.llm.staging import stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``key`` is the group that must have ``least`` characters, 0 the whole match.
    ``hint`` is a cheaper expression that every text with a match fulfils."""

    kind: str
    pattern: str
    key: int = 0
    least: int = 1
    hint: str | None = None
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans of equal start are listed.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A run that is too short holds no longer one, so the length may stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
ADDED = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", hint="eyJ"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", hint="AIza"),
]
RULES = [*BASE, *ADDED]
MASK = "[secret]"
#: Bits, by a hash of the address, that tell texts that may have findings from those that have none.
MARKS = 1 << 20

SCANNED = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, kind_no int, kind string, start long, end long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the ledger, empty if nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("r")).select("r.*")


def blob_of(text: str) -> Column:
    """The address of a text, null counting as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def _placed(number: int, rule: Rule):
    def placed(match: Column, place: Column) -> Column:
        return F.struct(
            F.lit(number).alias("kind_no"), place.alias("place"), match["before"].cast("long").alias("before"),
            match["length"].cast("long").alias("length"), (match["key"] >= rule.least).alias("valid"),
        )

    return placed


def scan_blobs(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings, one row per span, of rows (``blob``, ``text``, ``todo``: names of the rules to apply).

    Spans are in code points, end exclusive; matches of a kind are leftmost and do not overlap. The
    parts of a text between its matches and the matches give the places: their lengths are summed by a
    window over the matches of one text and kind, while the texts themselves stay where they are.
    """
    found = []
    for number, rule in enumerate(rules):
        hinted = F.col("text").contains(rule.hint) if rule.hint else F.lit(True)
        due = F.array_contains("todo", rule.name) & hinted & F.col("text").rlike(rule.pattern)
        pattern = F.lit(rule.pattern)
        matches = F.regexp_extract_all("text", pattern, F.lit(0))
        keys = F.regexp_extract_all("text", pattern, F.lit(rule.key)) if rule.key else matches
        before = F.transform(F.split("text", rule.pattern, -1), F.char_length)
        # The last part, after all matches, has no match: its length is null and it is left out below.
        zipped = F.arrays_zip(before.alias("before"), F.transform(matches, F.char_length).alias("length"), F.transform(keys, F.char_length).alias("key"))
        found.append(F.when(due, F.transform(zipped, _placed(number, rule))))
    parts = F.flatten(F.array_compact(F.array(*found)))
    rows = blobs.select("blob", F.explode(parts).alias("m")).select("blob", "m.*").where("length is not null")
    to_here = Window.partitionBy("blob", "kind_no").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("before") + F.col("length")).over(to_here)).where("valid")
    names = [F.array(*[F.lit(x) for x in xs]) for xs in ([r.name for r in rules], [r.kind for r in rules])]
    at = F.col("kind_no") + 1
    return ends.select(
        "blob", F.element_at(names[0], at).alias("rule"), "kind_no", F.element_at(names[1], at).alias("kind"),
        (F.col("end") - F.col("length")).alias("start"), "end",
    )


def update_ledger(docs: DataFrame, ledger: str, text: str = "text", rules: list[Rule] | None = None) -> None:
    """Scans what the tables below ``ledger`` do not have yet and appends it.

    A text is scanned once per rule and version, however many rows, paths or earlier runs hold it.
    Findings are written before the pairs they belong to: if a run ends between, the next one scans
    again, and :func:`findings_of` counts equal findings once.
    """
    spark, rules = docs.sparkSession, rules or RULES
    scanned = _read(spark, f"{ledger}/scanned", SCANNED)
    done = scanned.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    blobs = docs.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates(["blob"])
    todo = F.array_except(F.array(*[F.lit(r.name) for r in rules]), F.coalesce("done", F.array().cast("array<string>")))
    unseen = blobs.join(done, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)
    # Both tables come from the same pass: a row per text with the spans of each of its matches.
    spans = scan_blobs(unseen, rules)
    spans.write.mode("append").parquet(f"{ledger}/findings")
    addresses = docs.select(blob_of(text).alias("blob")).distinct()
    left = addresses.join(done, "blob", "left").select("blob", todo.alias("rules")).where(F.size("rules") > 0)
    stage(left, "scanned").write.mode("append").parquet(f"{ledger}/scanned")


def findings_of(docs: DataFrame, ledger: str, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``findings``, an array of (``start``, ``kind_no``, ``kind``, ``end``) in that order, of the
    given rules, from the ledger; empty if there are none. A column by that name is replaced.

    Paths meet the findings by address: every row with a text, now or in a later version, gets them.
    """
    rules = rules or RULES
    order = {r.name: k for k, r in enumerate(rules)}
    numbers = F.create_map(*[x for name, k in order.items() for x in (F.lit(name), F.lit(k))])
    known = _read(docs.sparkSession, f"{ledger}/findings", FINDINGS).where(F.col("rule").isin(list(order)))
    span = F.struct("start", numbers[F.col("rule")].alias("kind_no"), "kind", "end")
    by_blob = known.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("findings")).withColumnRenamed("blob", "_found")
    own = [c for c in docs.columns if c not in ("findings", "_found", "_blob", "_bits", "_bucket")]
    by_blob = by_blob.withColumn("_mark", F.pmod(F.xxhash64("_found"), F.lit(MARKS)))
    bits = by_blob.groupBy(_bucket("_mark").alias("_bucket")).agg(F.bitmap_construct_agg(F.expr("_mark % 32768")).alias("_bits"))
    addressed = docs.select(*own, blob_of(text).alias("_blob")).withColumn("_mark", F.pmod(F.xxhash64("_blob"), F.lit(MARKS)))
    # At most MARKS bits in all. A text without its bit has no findings and does not move.
    marked = addressed.withColumn("_bucket", _bucket("_mark")).join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_mark % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("_byte", byte)
    perhaps = F.coalesce(F.expr("shiftright(_byte, cast(_mark % 8 as int)) % 2 = 1"), F.lit(False))
    none = F.array().cast(by_blob.schema["findings"].dataType)
    met = marked.where(perhaps).select(*own, "_blob").join(by_blob, F.col("_blob") == F.col("_found"), "left")
    met = met.select(*own, F.coalesce("findings", none).alias("findings"))
    return met.union(marked.where(~perhaps).select(*own, none.alias("findings")))


def _bucket(mark: str) -> Column:
    return F.expr(f"{mark} div 32768")


def secret_scan(docs: DataFrame, ledger: str, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with ``findings``, after the ledger has been brought up to date.

    A null text is empty and has none. Equal texts, repeated rows and rows without id share one scan
    and each get its findings. Only the text is looked at, whatever other columns there are. An empty
    table gives an empty one and leaves the ledger as it is.
    """
    update_ledger(docs, ledger, text, rules)
    return findings_of(docs, ledger, text, rules)


def mask_secrets(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``[secret]``; spans that meet or overlap, by one."""
    whole = F.col(f"_doc.{text}")
    found = secret_scan(docs.select(F.struct(*docs.columns).alias("_doc")), ledger, f"_doc.{text}")
    # Copies what is before a span that begins after the last end, and moves the end.
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(state: Column, span: Column) -> Column:
        apart = (span["start"] > state["at"]) | (state["at"] == 0)
        between = F.substring(whole, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        grown = F.when(apart, F.concat(state["done"], between, F.lit(MASK))).otherwise(state["done"])
        return F.struct(grown.alias("done"), F.greatest(state["at"], span["end"]).alias("at"))

    def finish(state: Column) -> Column:
        return F.concat(state["done"], F.substring(whole, (state["at"] + 1).cast("int"), F.lit(2147483647)))

    masked = F.when(F.size("findings") > 0, F.aggregate("findings", start, step, finish)).otherwise(whole)
    return found.select(*[masked.alias(c) if c == text else F.col("_doc")[c].alias(c) for c in docs.columns])
