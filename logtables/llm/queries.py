"""One query per operator over its whole table, and their DuckDB counterparts where SQL has one."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.llm import conversations, embeddings, language, merkle, mixing, packing, quality, secrets, simhash, suffix_tree, tokens, toxicity, warc
from logtables.llm.staging import crc32_of_id
from logtables.sources.scratch import scratch_dir


def documents(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.token_lengths(documents(spark, sf_dir, "text")).select("n_tokens"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_near_dedup(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", crc32_of_id() % 4 == 2)
    model = language.train(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(documents(spark, sf_dir, "doc_id", "text"), scratch_dir(spark, "ledger"))
    base = [r.kind for r in secrets.BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    digest = F.sha2(joined(F.filter("findings", lambda s: s["kind_no"] < len(base))), 256)
    return found.select("doc_id", *map(count, base), digest.alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir, "doc_id", "text")).drop("text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "source", mixing.word_count("text").alias("words"))
    mixed = mixing.mix(docs, size=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.roundtrip(pages, scratch_dir(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir, "doc_id", "text"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", crc32_of_id() % 5 == 1)
    tree, words = suffix_tree.train(docs.where("not held_out").select("text"), whole=True)
    found = suffix_tree.score(docs, tree, words, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", crc32_of_id() % 5 == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc32_of_id() % 5 != 0)
    model = toxicity.train(docs.where("not held_out"), labels.select("doc_id", "toxic"))
    return toxicity.toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", "n_windows", "n_hits")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, *merkle.FIELDS)
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, now=F.when(tampered, lowered).otherwise(F.col("text")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversations.repair_report(rows, conversations.damaged(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_simhash_near_dedup, op3_language_id, op4_secret_scans, op5_embedding_near_dedup,
        op6_quality_rules, op7_mixing, op8_warc, op9_packing, op10_lm_scoring, op11_toxicity, op12_merkle_manifest, op13_conversation_repair,
    )
}


def _secrets_sql() -> str:
    # The SQL engine takes case-insensitive groups in the same notation; matches are leftmost as well.
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
    SELECT doc_id, {k} AS kind_no, '{rule.kind}' AS kind, place, length(unnested.m) AS len, length(unnested.v) >= {rule.least} AS valid,
        length(unnested.b) AS before
    FROM (SELECT doc_id, unnest(list_zip(range(len(ms)), ms, vs, bs[1:len(ms)])) AS z FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {rule.key}) AS vs,
            string_split_regex(t, '{pattern}') AS bs FROM docs)),
        LATERAL (SELECT z[1] AS place, z[2] AS m, z[3] AS v, z[4] AS b) AS unnested""")
    base = len(secrets.BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
spans AS (SELECT *, stop - len AS start FROM (SELECT *, sum(before + len) OVER (PARTITION BY doc_id, kind_no ORDER BY place) AS stop FROM found)
    WHERE valid),
listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_no) FILTER (kind_no < {base}) AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_no) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed USING (doc_id)"""


EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a, v b
    WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
least AS (SELECT u AS vec_id, min(v) AS component_id FROM reached GROUP BY u),
counts AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)"""

#: The water level from the sources in order of what would lift their target above their cap.
MIXING_SQL = f"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, source_size * {mixing.MAX_COPIES} AS cap,
    [1, 2, 3][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM sources),
ordered AS (SELECT *, sum(source_size) OVER () AS total, cap / weight AS turn,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed),
levels AS (SELECT arg_min(((total - fixed)::BIGINT)::DOUBLE / rest::DOUBLE, turn) AS level FROM ordered WHERE ((total - fixed)::BIGINT)::DOUBLE / rest::DOUBLE <= turn),
targets AS (SELECT source, source_size, least(weight * level, cap::DOUBLE) AS target,
    CASE WHEN source_size > 0 THEN round(least(weight * level, cap::DOUBLE) / source_size * {mixing.UNIT})::BIGINT ELSE 0 END AS expected,
    md5('{mixing.SEED}:' || coalesce(source, '')) AS h FROM weighed, levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS place FROM docs),
placed AS (SELECT doc_id, size, source_size, target, expected, place * expected
    + list_sum(list_transform(range(1, 7), lambda i: (instr('0123456789abcdef', substr(h, i, 1)) - 1) * (16 ** (6 - i))::BIGINT))::BIGINT AS here
    FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((here + expected) // {mixing.UNIT} - here // {mixing.UNIT}) * size AS taken FROM placed"""

WARC_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {warc.MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text by its definition; the SQL engine has no function for it."""
    return f"""xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""


def _merkle_sql() -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"

    lowered = "CASE WHEN CRC % 3 = 0 THEN LOWERED ELSE text END"
    lowered = lowered.replace("CRC", _crc32_sql("doc_id::VARCHAR")).replace("LOWERED", f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")

    def up(name: str) -> str:
        """All levels of the trees in ``name`` (of, place, h)."""
        return f"""levels_{name} AS (SELECT 0 AS level, * FROM {name} UNION ALL
    SELECT level + 1, of, place // 8, sha256(string_agg(h, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY of) AS n FROM levels_{name})
    WHERE n > 1 GROUP BY level, of, place // 8)"""

    def beside(name: str) -> str:
        """The other nodes of the run of each node, before and after it."""
        return f"""beside_{name} AS (SELECT a.level, a.of, a.place, coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
        coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
    FROM levels_{name} a JOIN levels_{name} b ON a.level = b.level AND a.of IS NOT DISTINCT FROM b.of AND a.place // 8 = b.place // 8
    WHERE a.level < (SELECT max(level) FROM levels_{name} t WHERE t.of IS NOT DISTINCT FROM a.of) GROUP BY ALL)"""

    def fold(name: str, start: str) -> str:
        return f"""fold_{name} AS (SELECT 0 AS level, * FROM {start} UNION ALL
    SELECT f.level + 1, f.id, f.of, f.place // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r
    FROM fold_{name} f JOIN beside_{name} s ON f.level = s.level AND f.of IS NOT DISTINCT FROM s.of AND f.place = s.place),
end_{name} AS (SELECT * FROM fold_{name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)"""

    return f"""
WITH RECURSIVE hashed AS (SELECT row_number() OVER () AS id, doc_id, lang AS of, {leaf("text")} AS h, {leaf("now")} AS now
    FROM (SELECT *, {lowered} AS now FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY of ORDER BY doc_id NULLS FIRST, h) - 1 AS place FROM hashed),
leaves AS (SELECT of, place, h FROM placed),
{up("leaves")},
{beside("leaves")},
roots AS (SELECT of, h FROM levels_leaves QUALIFY row_number() OVER (PARTITION BY of ORDER BY level DESC) = 1),
langs AS (SELECT 0 AS of, row_number() OVER (ORDER BY encode(of) NULLS FIRST) - 1 AS place, h FROM roots),
ranks AS (SELECT of AS lang, row_number() OVER (ORDER BY encode(of) NULLS FIRST) - 1 AS rank FROM roots),
{up("langs")},
{beside("langs")},
changed AS (SELECT id, of, place, now AS h, '' AS proof FROM placed),
{fold("leaves", "changed")},
carried AS (SELECT e.id, 0 AS of, k.rank AS place, e.h, e.proof FROM end_leaves e JOIN ranks k ON e.of IS NOT DISTINCT FROM k.lang),
{fold("langs", "carried")}
SELECT p.doc_id, p.h AS leaf, r.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN end_langs f USING (id) JOIN roots r ON p.of IS NOT DISTINCT FROM r.of,
    (SELECT h FROM levels_langs ORDER BY level DESC LIMIT 1) t"""


def _conversations_sql() -> str:
    """The plain programme: the least cost and, at that cost, the least initials for each state, row by row. A
    state is one text, the cost in nine digits and then the initials, so that the least text is the best."""

    def plus(cost: str, edit: str, state: str) -> str:
        return f"lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}'"

    keep, rerole = (f"(CASE WHEN fault = 'truncated' THEN {n + 3} ELSE {n} END)" for n in (0, 3))
    stays = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"

    def may(initial: str, value: str) -> str:
        return f"CASE WHEN {stays} AND initial = '{initial}' THEN {value} END"

    def rerolled(state: str) -> str:
        return f"CASE WHEN {stays} THEN {plus(rerole, 'R', state)} END"

    # Insertions before a row (two suffice), then the row itself.
    inserted = f"SELECT *, least(u0, {plus('3', 'I', 'n0')}, {plus('3', 'I', 's0')}, {plus('3', 'I', 'a0')}) AS u1 FROM dp"
    row = f"""SELECT conv_id, place + 1 AS place, {plus("4", "D", "n0")} AS n0,
        least({plus("4", "D", "s0")}, {may("s", plus(keep, "K", "n0"))}) AS s0,
        least({plus("4", "D", "u2")}, {", ".join(may("u", plus(keep, "K", q)) for q in ("n0", "s0", "a1"))}, {", ".join(rerolled(q) for q in ("n0", "s0", "a1"))}) AS u0,
        least({plus("4", "D", "a1")}, {may("a", plus(keep, "K", "u2"))}, {rerolled("u2")}) AS a0"""
    key = "concat_ws(':', coalesce(conv_id::VARCHAR, ' '), coalesce(turn::VARCHAR, ' '))"
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql(key)} % 20 AS number FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN number = 4 THEN 'user' ELSE role END AS role,
    CASE number WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM keyed, LATERAL (SELECT unnest(range(CASE number WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, unhex(md5(text))) AS place,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM damaged),
judged AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN final = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
dp AS (SELECT DISTINCT conv_id, 0::BIGINT AS place, '000000000' AS n0, NULL::VARCHAR AS s0, NULL::VARCHAR AS u0, NULL::VARCHAR AS a0 FROM judged UNION ALL
    {row} FROM (SELECT *, least(u1, {plus("3", "I", "a1")}) AS u2 FROM (SELECT *, least(a0, {plus("3", "I", "u1")}) AS a1 FROM (
        {inserted})) x JOIN (SELECT conv_id AS c, place AS nth, role, initial, fault FROM judged) j ON x.conv_id IS NOT DISTINCT FROM j.c AND x.place + 1 = j.nth)),
ended AS (SELECT conv_id, least(n0, a0, {plus("3", "I", "u0")}, {plus("6", "II", "s0")}) AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
best AS (SELECT conv_id, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM ended),
letters AS (SELECT conv_id, audit, i, substr(audit, i, 1) AS edit, length(replace(substr(audit, 1, i), 'I', '')) AS place,
    length(replace(substr(audit, 1, i), 'D', '')) AS nth, length(replace(audit, 'D', '')) % 2 AS odd FROM best, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS i)),
repaired AS (SELECT l.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS repaired_sha256
    FROM letters l LEFT JOIN judged j ON l.conv_id IS NOT DISTINCT FROM j.conv_id AND l.place = j.place AND l.edit <> 'I' WHERE edit <> 'D' GROUP BY l.conv_id),
pairs AS (SELECT conv_id, turn, fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM judged),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id"""


ORACLES = {
    "op4_secret_scans": _secrets_sql(),
    "op5_embedding_near_dedup": EMBEDDINGS_SQL,
    "op7_mixing": MIXING_SQL,
    "op8_warc": WARC_SQL,
    "op12_merkle_manifest": _merkle_sql(),
    "op13_conversation_repair": _conversations_sql(),
}
