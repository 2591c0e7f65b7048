from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5

from logtables.llm import mixing
from tests.llm import fixtures


def plain(rows):
    """Size, target and copies of each row, by exact fractions."""
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, source), n in zip(rows, sizes):
        total[source] += n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    fixed, target = {}, {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = Fraction(sum(total.values()) - sum(fixed.values()), sum(weight[s] for s in rest)) if rest else 0
        over = [s for s in rest if weight[s] * level > 3 * total[s]]
        if not over:
            break
        fixed |= {s: 3 * total[s] for s in over}
    target = {s: fixed.get(s, weight[s] * level) for s in order}
    return sizes, total, target


def test_targets_and_copies(spark):
    rows = [(k, fixtures.prose(k, 1 + k % 17), ["a", "b", "c", None][min(3, k % 13)]) for k in range(400)] + [(400, None, "z"), (7, fixtures.prose(7, 8), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(docs).collect()
    sizes, total, target = plain(rows)
    assert Counter((r.doc_id, r.size, r.source, r.source_size) for r in found) == Counter((d, n, s, total[s]) for (d, _, s), n in zip(rows, sizes))
    taken, copies = defaultdict(int), defaultdict(int)
    for r in found:
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        copies[r.source] += r.copies
    for s in total:
        assert abs(taken[s] - target[s]) <= 3 * 17, s
    # One offset and exact sums: copies are the whole numbers crossed.
    for s in total:
        ordered = sorted((n, d) for (d, _, x), n in zip(rows, sizes) if x == s)
        each = round(float(target[s]) / total[s] * mixing.UNIT) if total[s] else 0
        offset = int(md5(f"{mixing.SEED}:{s or ''}".encode()).hexdigest()[:6], 16)
        assert copies[s] == (offset + len(ordered) * each) // mixing.UNIT - offset // mixing.UNIT
    assert sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=str) == sorted(map(tuple, found), key=str)


def test_awkward_rows(spark):
    docs = fixtures.frame(spark)
    found = mixing.mix(docs)
    assert found.count() == len(fixtures.rows())
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    assert emitted.count() == sum(r.copies for r in found.collect())
    assert mixing.mix(fixtures.frame(spark, [])).count() == 0
    nothing = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(nothing).collect()] == [(0.0, 0)]
