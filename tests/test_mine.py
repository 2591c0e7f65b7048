import random

import pytest
from pyspark.sql import functions as F

from logtables.functions import templates
from logtables.operators import catalog, chunks, mine
from logtables.plans.ingest import records_of
from logtables.operators.query import reconstruct
from tests.model import mine as model_mine

SCHEMA = "chunk_id long, seq long, message string"


def mined_rows(messages):
    rows = mine.extract_variables(mine.mine_templates(messages)).collect()
    return {(r.chunk_id, r.seq): (r.pattern, r.variables, r.opened_seq) for r in rows}


def expected_rows(rows):
    by_chunk = {}
    for chunk, seq, message in sorted(rows):
        by_chunk.setdefault(chunk, []).append((seq, message))
    return {(chunk, seq): found for chunk, lines in by_chunk.items() for seq, found in model_mine(lines).items()}


def test_users_and_restart(spark):
    texts = ["User alice logged in from 192.168.1.1", "User bob logged in from 192.168.1.2", "System restart"]
    rows = [(0, i, text) for i, text in enumerate(texts)]
    got = mined_rows(spark.createDataFrame(rows, SCHEMA))
    assert got[0, 0] == ("User <*> logged in from <*>", ["alice", "192.168.1.1"], 0)
    assert got[0, 1] == ("User <*> logged in from <*>", ["bob", "192.168.1.2"], 0)
    assert got[0, 2] == ("System restart", [], 2)


EDGES = [
    (["a b", "a c", "d c"], ["<*> <*>"] * 3),
    (["a b c", "a x y"], ["a b c", "a x y"]),
    (["a  b", "a b"], ["a b", "a b"]),
    (["", ""], ["", ""]),
    (["a <*> x", "a q x"], ["a <*> x"] * 2),
    (["x a<*>b y", "x a<*>b z"], ["x a<*>b <*>"] * 2),
]


@pytest.mark.parametrize("texts, patterns", EDGES)
def test_edges(spark, texts, patterns):
    got = mined_rows(spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], SCHEMA))
    assert [got[0, i][0] for i in range(len(texts))] == patterns


def random_rows(n, chunk, seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "<*>"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 4, 4, 7]))) for _ in range(n)]
    return [(i // chunk, i, text) for i, text in enumerate(texts)]


@pytest.mark.parametrize("partitions", ["1", "8"])
@pytest.mark.parametrize("chunk", [10, 1000])
def test_equals_model_on_random_lines(spark, partitions, chunk):
    rows = random_rows(4000, chunk, seed=chunk)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert mined_rows(spark.createDataFrame(shuffled, SCHEMA).repartition(int(partitions))) == expected_rows(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_hot_shape_holds_most_rows(spark):
    rows = [(i // 1000, i, f"hot line {i % 7} of {i}" if i % 10 else f"x{i}") for i in range(6000)]
    assert mined_rows(spark.createDataFrame(rows, SCHEMA)) == expected_rows(rows)


def test_every_line_has_its_variables_and_comes_back(spark):
    rows = random_rows(3000, 100, seed=5)
    records = records_of(spark.createDataFrame(rows, SCHEMA))
    checked = reconstruct(records).select(
        "seq", "message", (F.size("variables") == templates.wildcard_count(F.col("pattern"))).alias("whole")
    )
    got = {r.seq: (r.message, r.whole) for r in checked.collect()}
    assert got == {seq: (" ".join(text.split()), True) for _, seq, text in rows}


def test_mining_needs_one_shuffle_and_folds_once(spark):
    messages = spark.createDataFrame([(0, 0, "a b")], SCHEMA)
    plan = records_of(messages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("aggregate(sequence(0") == 1


def test_mined_messages_are_refused(spark):
    mined = mine.mine_templates(spark.createDataFrame([(0, 0, "a")], SCHEMA))
    with pytest.raises(ValueError):
        mine.mine_templates(mined.withColumn("message", F.lit("a")))


@pytest.mark.parametrize("stride", [1, 3, 70_000, 5_000_000_000])
def test_positions_within_a_hot_node(spark, stride):
    rng = random.Random(stride)
    rows = [("hot" if rng.random() < 0.6 else f"n{rng.randrange(5)}", i * stride) for i in range(3000)]
    expected, seen = {}, {}
    for node, seq in rows:
        expected[node, seq] = seen.get(node, 0)
        seen[node] = seen.get(node, 0) + 1
    table = spark.createDataFrame(rows, "node string, seq long").repartition(5)
    got = chunks.position_within(table, "node", "seq", "position", total="total").collect()
    assert {(r.node, r.seq): r.position for r in got} == expected
    assert {r.node: r.total for r in got} == seen


def test_chunks_close_after_n_messages_of_a_node(spark):
    rows = [("a" if i % 3 else None, i, "m") for i in range(70)]
    got = chunks.assign_chunks(spark.createDataFrame(rows, "node_id string, seq long, message string"), 10).collect()
    sizes = {}
    for r in got:
        sizes[r.chunk_id] = sizes.get(r.chunk_id, 0) + 1
    assert sizes == {"a/0": 10, "a/1": 10, "a/2": 10, "a/3": 10, "a/4": 6, "-/0": 10, "-/1": 10, "-/2": 4}


def test_template_numbers(spark):
    rows = [(0, 0, "long one here"), (0, 1, "b"), (0, 2, "a"), (0, 3, "b"), (1, 4, "x y"), (1, 5, "x z")]
    mined = mine.mine_templates(spark.createDataFrame(rows, SCHEMA))
    got = {(r.chunk_id, r.pattern): r.template_id for r in mine.chunk_template_ids(mined).collect()}
    assert got == {(0, "b"): 0, (0, "a"): 1, (0, "long one here"): 2, (1, "x <*>"): 0}
    imported = spark.createDataFrame([(0, "z", 0), (0, "a", 1), (0, "z", 2)], "chunk_id long, pattern string, position long")
    got = {(r.chunk_id, r.pattern): r.template_id for r in mine.chunk_template_ids(mined, imported).collect()}
    assert got == {(0, "z"): 0, (0, "a"): 1, (0, "b"): 2, (0, "long one here"): 3, (1, "x <*>"): 0}


def test_templates_that_merge_to_one_text_share_a_number(spark):
    rows = [row for row in random_rows(8000, 1000, seed=9)]
    mined = mine.mine_templates(spark.createDataFrame(rows, SCHEMA))
    openings = mined.select("chunk_id", "pattern", "opened_seq").distinct().count()
    numbers = mine.chunk_template_ids(mined)
    assert numbers.count() < openings
    assert numbers.select("chunk_id", "template_id").distinct().count() == numbers.count()


def test_catalogs(spark):
    rows = [(0, 0, "a b c"), (0, 1, "a b d"), (0, 2, "z")]
    one = catalog.template_catalog(mine.mine_templates(spark.createDataFrame(rows, SCHEMA)))
    other = catalog.template_catalog(
        mine.mine_templates(spark.createDataFrame([(0, 7, "z"), (0, 8, "q r")], SCHEMA))
    )
    got = {r.pattern: (r.n_wildcards, r.first_seq, r.n_lines) for r in one.collect()}
    assert got == {"a b <*>": (1, 0, 2), "z": (0, 2, 1)}
    fresh = catalog.new_templates(mine.mine_templates(spark.createDataFrame(rows, SCHEMA)), other)
    assert [r.pattern for r in fresh.collect()] == ["a b <*>"]
    merged = catalog.merge_catalogs(
        one.withColumn("node_id", F.lit("n1")), other.withColumn("node_id", F.lit("n2"))
    )
    got = {r.pattern: (r.first_seq, r.n_lines, r.nodes) for r in merged.collect()}
    assert got == {"a b <*>": (0, 2, ["n1"]), "z": (2, 2, ["n1", "n2"]), "q r": (8, 1, ["n2"])}
    together = one.withColumn("node_id", F.lit("n1")).unionByName(other.withColumn("node_id", F.lit("n2")))
    assert {r.pattern: (r.first_seq, r.n_lines, r.nodes) for r in catalog.merge_catalogs(together).collect()} == got
    # Merging again changes nothing but the counts.
    assert catalog.merge_catalogs(one, other, one).count() == 3
