import numpy as np

from logtables.llm import toxicity as tx
from tests.llm import fixtures


def texts(n, insults=("zanker", "blorfig", "quelth")):
    """Every fourth text has some insults, whole or with varied endings."""
    rows = []
    for k in range(n):
        words = fixtures.prose(k, 40 + k % 90).split()
        toxic = k % 4 == 0
        if toxic:
            for j in range(3):
                words.insert((k * 7 + j * 11) % len(words), insults[(k + j) % 3] + ["", "s", "ing"][(k + j) % 3])
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(k, t, "clash", 0.5) for k, t, _ in rows], "doc_id long, text string, score string, _scored double").repartition(3)
    labels = spark.createDataFrame([(k, 1, x) for k, _, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = frames(spark, texts(900))
    model = tx.train(docs.where("doc_id % 5 != 0"), labels.where("doc_id % 5 != 0"))
    assert all(stem in model.toxic for stem in (b" zank", b" blor", b" quel"))
    found = tx.toxicity(docs, model).where("doc_id % 5 = 0").collect()
    assert len(found) == 180 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert np.mean([r.predicted for r in found if r.doc_id % 4 == 0]) >= 0.9
    assert np.mean([r.predicted for r in found if r.doc_id % 4]) <= 0.03
    again = tx.train(docs.where("doc_id % 5 != 0").repartition(7), labels.where("doc_id % 5 != 0").repartition(2))
    assert again == model


def test_labels(spark):
    rows = [(1, 0), (1, 1), (2, 0), (2, None), (None, 1), (3, None), (4, 1), (4, 0), (4, 0)]
    found = tx.resolved(spark.createDataFrame(rows, "doc_id long, toxic int"), "doc_id", "toxic")
    assert {r._id: r._toxic for r in found.collect()} == {1: True, 2: False, 4: False}


def test_awkward_rows_and_few_labels(spark):
    docs = fixtures.frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for labels, high in ((none, False), (spark.createDataFrame([(k, 1) for k in range(30)], none.schema), True)):
        model = tx.train(docs, labels)
        found = tx.toxicity(docs, model).collect()
        assert len(found) == len(fixtures.rows())
        assert all((r.score > 0.5) == high and r.predicted == high for r in found)
    assert tx.toxicity(fixtures.frame(spark, []), model).collect() == []
    assert {r.n_windows for r in found if not (r.text or "").strip()} == {1}


def test_pieces_and_windows():
    assert tx.windows_of(tx.words_of("A  b\n" * 13)) == [b" " + b" ".join([b"a", b"b"] * 6) + b" "] * 2 + [b" a b "]
    counted = [(b" zanker ", 60, 0), (b" zank", 61, 0), (b" banal ", 60, 500), (b" rare ", 3, 0), (b" zankerx", 9, 0)]
    assert tx.toxic_content(counted, 100, 1000) == b" zanker "
    # What toxic content adds is what its own words are shortened by.
    ordinary = tx.ordinary_content([fixtures.prose(k, 12).encode() for k in range(400)])
    plain, insulted = fixtures.prose(5, 12), fixtures.prose(5, 10) + " zanker zanker"
    assert max(tx.advantages(insulted, ordinary, b" zanker ")) > max(tx.advantages(plain, ordinary, b" zanker "))


def test_calibration_prefers_the_telling_advantage():
    rng = np.random.default_rng(1)
    toxic = (np.arange(400) % 4 == 0).astype(float)
    noise = rng.integers(0, 6, 400)
    sure = np.where(toxic > 0, 2, 0)
    counted = np.column_stack([np.full(400, 20), np.full(400, 5), noise + sure, noise + sure, sure, sure * 0, sure * 0, sure * 0]).astype(float)
    advantage, weights = tx.calibrate(counted, toxic, np.ones(400))
    assert advantage == 3
    score = tx._logistic(tx.features(counted, advantage) @ np.array(weights))
    assert ((score >= 0.5) == (toxic > 0)).all()
