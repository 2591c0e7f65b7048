import numpy as np
import pytest

from logtables.llm import embeddings
from tests.llm import fixtures


def plain(rows):
    sound = {k: np.array(v, float) for k, v in rows if v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)}

    def linked(a, b):
        x, y = sound[a], sound[b]
        return len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95

    least = fixtures.components(sorted(sound), linked)
    found = {k: (sum(linked(k, o) for o in sound if o != k), least[k], least[k] == k) for k in sound}
    return {k: found.get(k, (0, k, True)) for k, _ in rows}


@pytest.mark.parametrize("cell_rows, group_rows", [(4096, 2048), (40, 16)])
def test_links_and_components(spark, monkeypatch, cell_rows, group_rows):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embeddings, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(2)
    vectors = list(rng.normal(size=(120, 20)))
    vectors += [v + rng.normal(size=20) * s for v in vectors[:20] for s in (0.05, 0.2, 0.3, 0.35)]  # near, some at the border
    vectors += [vectors[0] * 2, vectors[0], -vectors[0]] + [vectors[5]] * 5
    vectors += [vectors[7] + 0.01 * rng.normal(size=20) for _ in range(60)]  # a crowd
    rows = [(k, list(map(float, v))) for k, v in enumerate(vectors)]
    rows += [(900, None), (901, [0.0] * 20), (902, [float("nan")] * 20), (903, [1.0, None] * 10), (904, [float("inf")] * 20), (905, []), (906, [1.0] * 3), (907, [2.0] * 3)]
    table = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, component_id string").repartition(4)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.embedding_near_dedup(table).collect()}
    assert found == plain(rows)


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.embedding_near_dedup(table).count() == 0
    alone = spark.createDataFrame([(None, [1.0]), (3, None)], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.embedding_near_dedup(alone).collect()} == {
        (None, 0, None, False), (3, 0, 3, True),
    }
