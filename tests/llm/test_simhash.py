import random
import re

import numpy as np
import xxhash

from logtables.llm import simhash
from logtables.llm.staging import connected_components
from tests.llm import fixtures


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark):
    found = simhash.simhash_near_dedup(fixtures.frame(spark)).collect()
    rows = fixtures.rows()
    assert len(found) == len(rows)
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    assert all(int(f.fingerprint, 16) == prints[f.doc_id] for f in found)
    assert all(re.fullmatch("[0-9a-f]{16}", f.fingerprint) for f in found)
    least = fixtures.components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    members = {}
    for doc_id, p in prints.items():
        if doc_id is not None:
            members[least[p]] = min(doc_id, members.get(least[p], doc_id))
    assert {(f.doc_id, f.component_id) for f in found} == {(d, members.get(least[p])) for d, p in prints.items()}
    kept = simhash.one_of_each(fixtures.frame(spark))
    assert kept.columns == fixtures.frame(spark).columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len({least[p] for p in prints.values()}) and "no id here" in texts


def test_empty(spark):
    assert simhash.simhash_near_dedup(fixtures.frame(spark, [])).count() == 0


def test_pairs_of_crowded_fingerprints(spark):
    rng = random.Random(5)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(400):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
        prints.add(rng.getrandbits(64))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for parts_from in (1, 1 << 23):
        simhash.TWO_PARTS_FROM, before = parts_from, simhash.TWO_PARTS_FROM
        found = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), 2).distinct().collect()
        simhash.TWO_PARTS_FROM = before
        expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
        assert {(r.u, r.v) for r in found} == expected


def test_allocation_is_the_best_of_all():
    rng = np.random.default_rng(1)
    widths, counts = [21, 21, 22], rng.integers(0, 50, (3, simhash.COUNTERS))
    values = [rng.integers(0, 1 << w, 20) for w in widths]
    chosen = simhash.allocate(values, widths, counts, 1000, 3)
    assert (chosen.sum(axis=0) == 3).all() and (chosen >= 0).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 600)] + [(7, 7)]
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.root for r in found.collect()} == {**{k: 0 for k in range(1, 101)}, **{k: 500 for k in range(501, 600)}}
