from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from logtables.llm import merkle
from tests.llm import fixtures

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, place):
    for level in levels[:-1]:
        first = place - place % 8
        yield level[first:place], level[place + 1 : first + 8]
        place //= 8


def plain(rows, now):
    """What the operator returns, from whole lists."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted((k for k in range(len(rows)) if rows[k][2] == x), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf(rows[k]))) for x in langs}
    trees = {x: tree([leaf(rows[k]) for k in order[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    found = Counter()
    for n, x in enumerate(langs):
        for place, k in enumerate(order[x]):
            path = [*way(trees[x], place), *way(top, n)]
            folded = leaf((*rows[k][:4], now(rows[k])))
            for before, after in path:
                folded = h([*before, folded, *after])
            proof = h(node for pair in path for side in pair for node in side)
            found[(rows[k][0], leaf(rows[k]), trees[x][-1][0], top[-1][0], proof, folded, folded == top[-1][0])] += 1
    return found


@pytest.mark.parametrize("block_levels", [1, 4])
def test_against_plain_trees(spark, block_levels):
    rows = [(k * 7 % 1009 - 3, ["web", None, "é"][k % 3], ["en", "en", "en", None, "", "zh", f"x{k}"][min(k % 31, 6)], k, fixtures.prose(k, k % 5)) for k in range(700)]
    rows += [rows[5], rows[5], (None, None, "en", None, None), (8, "a", "lone", 3, "Only ONE")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    # Tampered where the id is even; lower-casing leaves most texts as they are.
    now = F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    found = merkle.manifest(docs, now, block_levels=block_levels).collect()
    expected = plain(rows, lambda r: r[4].upper() if r[0] is not None and r[0] % 2 == 0 and r[4] else r[4])
    assert Counter(map(tuple, found)) == expected
    assert {r.verified for r in found} == {True, False}


def test_awkward_rows(spark):
    docs = fixtures.frame(spark).withColumn("root", F.lit("clash")).withColumn("_tree", F.lit(1))
    found = merkle.manifest(docs).collect()
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in fixtures.rows()]
    assert Counter(map(tuple, found)) == plain(rows, lambda r: r[4])
    assert all(r.verified for r in found)
    assert merkle.manifest(fixtures.frame(spark, [])).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root == leaf((1, None, None, None, None)) and one.proof_sha256 == h([])
