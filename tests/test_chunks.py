import random

import pytest

from logtables.operators import chunks
from logtables.plans import ingest


def expected_chunks(rows, n):
    """By node, a missing one beside "-", in order of seq; of equal numbers the named node comes first."""
    by_node = {}
    for node, seq in rows:
        by_node.setdefault("-" if node is None else node, []).append((seq, node is None))
    return {
        (None if missing else key, seq): f"{key}/{k // n}" for key, seqs in by_node.items() for k, (seq, missing) in enumerate(sorted(seqs))
    }


@pytest.mark.parametrize("n", [1, 10])
def test_numbered_chunks_equal_a_plain_count(spark, tmp_path, n):
    rng = random.Random(n)
    gaps = [*range(0, 200), 255, 256, 319, 65_535, 65_536, *range(65_900, 66_100), 5 << 16, (5 << 16) + 63, 3 << 32, (3 << 32) + 65_535]
    rows = [(node, seq) for node in ("a", "b", "-", None) for seq in gaps if node == "a" or rng.random() < 0.8]
    rng.shuffle(rows)
    messages = spark.createDataFrame(rows, "node_id string, seq long")
    got = chunks.assign_numbered_chunks(messages, str(tmp_path), n)
    assert got.columns == ["node_id", "seq", "chunk_id"]
    found = got.collect()
    assert len(found) == len(rows) and {(r.node_id, r.seq): r.chunk_id for r in found} == expected_chunks(rows, n)


def test_no_messages_no_chunks(spark, tmp_path):
    messages = spark.createDataFrame([], "node_id string, seq long")
    assert chunks.assign_numbered_chunks(messages, str(tmp_path)).collect() == []


def test_a_load_moves_a_message_once_before_it_is_archived(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing" / "node_id=a"
    landing.mkdir(parents=True)
    (landing / "x.log").write_text("".join(f"<34>1 2024-01-01T00:00:00Z host app - - - User u{i} logged in\n" for i in range(50)))
    plans = []

    def write(records, archive, batch_id, known):
        plans.append(records._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(ingest, "write_archive", write)
    ingest.ingest_batch(spark, str(tmp_path / "landing"), str(tmp_path / "archive"), str(tmp_path / "work"), batch_id="1")
    (plan,) = plans
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    # Gathered after the move, not before: the partial step reads what was dealt.
    assert plan.index("partial_collect_list") < plan.index("Exchange hashpartitioning(chunk_id")
