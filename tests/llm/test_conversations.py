import random
import re
from collections import Counter
from hashlib import sha256
from itertools import product

import pytest

from logtables.llm import conversations as c
from tests.llm import fixtures

SCHEMA = "conv_id long, turn long, role string, text string, place string, edits string"
NOT_WHITE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        said = NOT_WHITE.findall(text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        found.append(fault)
    return found


def best(rows):
    """Cost, initials and repaired rows by trying all sequences of edits in which no three insertions follow one another."""
    found = None
    for choice in product("DKR", repeat=len(rows)):
        for inserts in product(range(3), repeat=len(rows) + 1):
            cost, letters, out = 3 * sum(inserts), "", []
            for k, fault in enumerate([*faults(rows), "end"]):
                letters += "I" * inserts[k]
                out += [(None, "")] * inserts[k]
                if fault == "end":
                    continue
                letters += choice[k]
                cost += {"D": 4, "K": 0, "R": 3}[choice[k]] + (3 if fault == "truncated" and choice[k] != "D" else 0)
                if fault in ("blank", "duplicate") and choice[k] != "D":
                    cost = None
                    break
                if choice[k] != "D":
                    out.append((rows[k][0] if choice[k] == "K" else None, rows[k][1]))
            if cost is None or (found and (cost, letters) >= found[:2]):
                continue
            odd = len(out) % 2
            wanted = ["s"] * odd + ["u", "a"] * (len(out) // 2)
            if odd and (len(out) == 1 or out[0][0] is None):
                continue
            if all(role is None or role[:1] == w for (role, _), w in zip(out, wanted)):
                named = [(role or {"u": "user", "a": "assistant"}[w], text) for (role, text), w in zip(out, wanted)]
                found = (cost, letters, named)
    return found


def ordered(rows):
    from hashlib import md5

    filled = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2].encode()).digest()))


def expected(rows):
    rows = ordered(rows)
    turns = [t for t, _, _ in rows if t is not None]
    said = [(r, x) for _, r, x in rows]
    counts = Counter(faults(said))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
    cost, letters, out = best(said)
    digest = sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, digest)


def random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(["Yes.", "No!", "no end", "", " \t", None, "Why?  ", f"so {rng.random()}."])) for _ in range(n)]


def table(spark, convs):
    rows = [(k, t, r, x, "p", "e") for k, of in convs.items() for t, r, x in of]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("segment", [2, 16_384])
def test_against_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(c, "SEGMENT", segment)
    convs = {k: random_rows(k, 1 + k % 4) for k in range(120)}
    convs[None] = random_rows(7, 4)
    rows = table(spark, convs)
    found = {r.conv_id: tuple(r)[1:] for r in c.repair_report(rows, rows).collect()}
    assert found == {k: expected(of) for k, of in convs.items()}


def test_powers_and_segments_agree_with_single_steps():
    rng = random.Random(3)
    for _ in range(200):
        symbols = "".join(rng.choice("suaSUA-_x") * rng.choice([1, 1, 2, 9]) for _ in range(rng.randint(1, 12)))
        costs = c.AT_END
        for symbol in reversed(symbols):
            costs = c.advance(c.power(symbol, 0), costs)
        assert c.advance(c.matrix_of(symbols), c.AT_END) == costs
        letters, state, total = c.unroll(symbols, c.AT_END, c.START, True)
        assert total == costs[c.START] and c.AT_END[state] == 0
        # A cut anywhere gives the same edits.
        cut = rng.randint(0, len(symbols))
        rest = c.advance(c.matrix_of(symbols[cut:]), c.AT_END)
        first, middle, _ = c.unroll(symbols[:cut], rest, c.START, False)
        assert first + c.unroll(symbols[cut:], c.AT_END, middle, True)[0] == letters


def test_repaired_rows_and_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(c, "SEGMENT", 64)
    long = [(k, ["user", "assistant"][k % 2], f"line {k}.") for k in range(3000)]
    del long[1500]
    convs = {1: long, 2: [(0, "user", "hi."), (1, "user", "there.")], 3: [(0, "system", "be kind.")]}
    rows = table(spark, convs)
    pieces = c.solved(c.segments(c.judged(rows)))
    found = c.repaired_rows(rows, pieces).orderBy("conv_id", "place").collect()
    one = [(r.edit, r.role, r.text) for r in found if r.conv_id == 1]
    assert [e for e, _, _ in one].count("I") == 1 and one[1500] == ("I", "user", "")
    assert [r for _, r, _ in one] == ["user", "assistant"] * 1500
    assert [(r.edit, r.role, r.text) for r in found if r.conv_id == 2] == [("K", "user", "hi."), ("R", "assistant", "there.")]
    assert [r for r in found if r.conv_id == 3] == []  # deleting costs less than two insertions


def test_empty_tables(spark):
    rows = table(spark, {1: [(0, "user", "a.")]})
    none = rows.where("false")
    assert c.repair_report(none, none).collect() == []
    assert [tuple(r) for r in c.repair_report(rows, none).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_planted_damage(spark):
    from zlib import crc32

    rows = [(k, t, ["user", "assistant"][t % 2], f"{fixtures.prose(k, 3)}. So?") for k in range(40) for t in range(5)] + [(None, None, None, None)]
    found = Counter(map(tuple, c.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    expected = Counter()
    for conv, turn, role, text in rows:
        n = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = text or " ", role or " "
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        expected[(conv, turn, "user" if n == 4 else role, text)] += {0: 0, 3: 2}.get(n, 1)
    assert found == +expected
