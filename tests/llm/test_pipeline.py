import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from logtables.llm import mixing, packing, quality
from tests.llm import fixtures
from tests.llm.test_mixing import plain as plain_mix
from tests.llm.test_quality_tokens import counts
from tests.llm.test_secrets import masked, spans
from tests.llm.test_simhash import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source"]


def corpus():
    """Good texts in copies and near copies, texts with secrets, and all awkward rows."""
    rows = [r[:4] for r in fixtures.rows()]
    for k in range(40):
        text = fixtures.prose(k + 10, 80 + 9 * k)
        rows += [(1000 + 10 * k + i, text, "aa", ["s1", "s2", "hot"][k % 3]) for i in range(1 + k % 3)]
        rows.append((5000 + k, text + (f" password: hunter{k}secret" if k % 4 == 0 else " end"), "bb", "hot"))
    return rows


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    columns = list(zip(*corpus()))
    table = pa.table({name: pa.array(column, pa.int64() if name == "doc_id" else pa.string()) for name, column in zip(COLUMNS, columns)})
    pq.write_table(table, folder / "documents.parquet", row_group_size=20)
    return str(folder)


def rows_of(table):
    assert table.columns == COLUMNS
    return [tuple(r) for r in table.collect()]


def test_stages_are_those_of_plain_models(spark, sf_dir, tmp_path):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "simhash near-dedup", "secret scans", "mixing sources", "best-fit packing"]
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        tables[name] = docs

    # Quality: what fails the base rules or the bands goes, nothing else.
    compressor = quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    good = [r for r in corpus() if not counts(r[1])[5] and quality.measure(r[1], compressor)[6]]
    assert Counter(rows_of(tables["quality rules"])) == Counter(good) and 40 < len(good) < len(corpus())

    # Near copies: one of each group, and groups are those of all pairs of fingerprints.
    prints = {r: fingerprint(r[1]) for r in good}
    group = fixtures.components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    kept = rows_of(tables["simhash near-dedup"])
    assert set(kept) <= set(good) and Counter(group[prints[r]] for r in kept) == Counter(set(group[p] for p in prints.values()))
    assert len(kept) < len(set(good))

    # Secrets: all rows stay, masked.
    clean = rows_of(tables["secret scans"])
    assert Counter(clean) == Counter((d, masked(t), lang, source) for d, t, lang, source in kept)
    assert any(spans(r[1]) for r in kept) and not any("hunter" in (r[1] or "") for r in clean)

    # Mix: whole documents, at most three times, near the targets.
    taken = Counter(rows_of(tables["mixing sources"]))
    assert set(taken) <= set(clean) and max(taken.values()) <= 3
    sizes, total, target = plain_mix([(r[0], r[1], r[3]) for r in clean])
    of = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) * n for r, n in taken.items() if r[3] == s) for s in total}
    for s in total:
        assert abs(of[s] - target[s]) <= 3 * max(sizes)

    # Packing: every document's ids, in gapless sequences.
    tokenizer, wanted = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for (doc_id, text, _, _), n in taken.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            data = b"".join(i.to_bytes(4, "little") for i in ids[start : start + length])
            wanted[doc_id, piece, start, length, packing.zlib.crc32(data)] += n
    found = tables["best-fit packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048

    # All of it in one call.
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == wanted


def test_no_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mixing.emit(spark.read.parquet(str(tmp_path / "documents.parquet"))).count() == 0
