import hashlib
import re

from logtables.llm import secrets
from logtables.sources.scratch import scratch_dir
from tests.llm import fixtures


def spans(text):
    text, found = text or "", []
    for k, rule in enumerate(secrets.RULES):
        # Case is that of ASCII letters only, as the pattern language of the engine has it.
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m[rule.key]) >= rule.least:
                found.append((m.start(), k, rule.kind, m.end()))
    return sorted(found)


def masked(text):
    if text is None or not spans(text):
        return text
    done, at = [], 0
    for start, _, _, end in spans(text):
        if start > at or at == 0:
            done += [text[at:start], secrets.MASK]
        at = max(at, end)
    return "".join(done) + text[at:]


def test_spans_of_every_row(spark):
    ledger = scratch_dir(spark, "ledger")
    found = secrets.secret_scan(fixtures.frame(spark), ledger).collect()
    assert len(found) == len(fixtures.rows())
    for r in found:
        assert [tuple(s) for s in r.findings] == spans(r.text), r.text
    assert sum(len(r.findings) > 0 for r in found) >= 5
    assert secrets.secret_scan(fixtures.frame(spark, []), scratch_dir(spark, "ledger")).count() == 0


def test_masked(spark):
    found = secrets.mask_secrets(fixtures.frame(spark), scratch_dir(spark, "ledger"))
    assert found.columns == fixtures.frame(spark).columns
    assert sorted((r.doc_id or -1, r.text or "", r.kept or "") for r in found.collect()) == sorted(
        (r[0] or -1, masked(r[1]) or "", r[5] or "") for r in fixtures.rows()
    )


def test_ledger_scans_only_what_is_new(spark):
    ledger = scratch_dir(spark, "ledger")
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "plain"), (3, "token=abcdef")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "token=abcdef"), (5, "secret=ghijkl"), (6, None)], "doc_id long, text string")

    def written(name):
        return spark.read.parquet(f"{ledger}/{name}").count()

    secrets.update_ledger(first, ledger)
    assert written("scanned") == 2 and written("findings") == 1
    secrets.update_ledger(first, ledger)
    assert written("scanned") == 2 and written("findings") == 1
    found = {r.doc_id: len(r.findings) for r in secrets.secret_scan(second, ledger).collect()}
    assert found == {4: 1, 5: 1, 6: 0}
    assert written("scanned") == 4 and written("findings") == 2
    # A new version of one rule is due for every text, the others are not.
    newer = [secrets.Rule("assign", r"token=[a-z]+", version=2), *secrets.RULES[1:]]
    secrets.update_ledger(first, ledger, rules=newer)
    rows = spark.read.parquet(f"{ledger}/scanned").where("array_contains(rules, 'assign@2')").collect()
    assert {bytes(r.blob) for r in rows} == {hashlib.sha256(t).digest() for t in (b"token=abcdef", b"plain")}
    assert all(list(r.rules) == ["assign@2"] for r in rows)
    assert {r.doc_id: len(r.findings) for r in secrets.findings_of(first, ledger, rules=newer).collect()} == {1: 1, 2: 0, 3: 1}
