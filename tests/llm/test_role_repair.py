import itertools

import numpy as np
import pytest

import __spark_entry__ as E
from tessera.llm import role_repair as R


def brute_cost(roles):
    """Smallest cost over all assignments of roles, with merges and empty turns where the automaton needs them."""
    best = np.inf
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, p = 0.0, 0
        for role, q in zip(roles, states):
            cost += 0 if R.STATES[q] == role else R.RELABEL
            if p == q:
                ways = [R.MERGE] + ([R.INSERT] if q in (2, 3) else [])
            elif (p, q) in {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}:
                ways = [0.0]
            elif (p, q) in {(0, 3), (1, 3)}:
                ways = [R.INSERT]
            else:
                ways = [np.inf]
            cost, p = cost + min(ways), q
        best = min(best, cost + R.INSERT * {0: 0, 1: 2, 2: 1, 3: 0}[p])
    return best


def legal(text):
    heads = [line[2:-2] for line in text.split("\n") if line.startswith("<|")]
    body = heads[1:] if heads[:1] == ["system"] else heads
    return len(body) % 2 == 0 and body == ["user", "assistant"] * (len(body) // 2) and len(body) > 0


@pytest.mark.parametrize("block", [256, 2])
def test_costs_equal_brute_force_and_results_are_legal(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    kinds = ["system", "user", "assistant", "tool", None]
    rng = np.random.default_rng(6)
    convs = {c: [kinds[int(k)] for k in rng.integers(0, 5, rng.integers(1, 7))] for c in range(60)}
    rows = [(c, t, r, f"text {c} {t}") for c, roles in convs.items() for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in R.repair_roles(df).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for c, roles in convs.items():
        mine = sorted(got[c], key=lambda r: r["turn"])
        assert {r["total_cost"] for r in mine} == {brute_cost(roles)}, roles
        whole = "".join(r["rendered"] for r in mine)
        assert legal(whole) and [x for x in whole.split("\n") if x.startswith("text")] == [f"text {c} {t}" for t in range(len(roles))]


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, 0, "user", None), (1, None, "user", "z"), (1, 0, "assistant", ""), (1, 0, "assistant", ""),
                                (2, 0, "user", "x" * 200000)], "conv_id long, turn long, role string, text string")
    rows = R.repair_roles(df).collect()
    assert len(rows) == 5
    one = [r for r in rows if r["conv_id"] == 1]
    assert len(one) == 3 and {r["total_cost"] for r in one} == {brute_cost(["assistant", "assistant", "user"])}
    assert next(r for r in rows if r["conv_id"] is None)["rendered"] == "<|user|>\n\n<|assistant|>\n"


def test_empty_and_registered(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert E.queries()["op1_role_repair"](spark, str(tmp_path)).collect() == []


def test_min_plus_chain_is_associative():
    a, b, c = (R.turn_costs(r) for r in ("user", "assistant", None))
    assert np.array_equal(R.chain(R.chain(a, b), c), R.chain(a, R.chain(b, c)))


def test_hot_conversation_is_split_and_stays_legal(spark):
    rng = np.random.default_rng(9)
    kinds = ["system", "user", "assistant", "tool", None]
    rows = [(None, int(t) if t % 3 else None, kinds[int(k)], f"t{t}") for t, k in enumerate(rng.integers(0, 5, 100_000))]
    rows += [(7, 1, "user", "the same turn")] * 20_000 + [(8, 0, "user", "x"), (8, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("first", R.F.lit("clash")).repartition(9)
    out = R.repair_roles(df, position="place").collect()
    assert len(out) == len(rows)
    for conv in (None, 7, 8):
        mine = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["place"])
        assert legal("".join(r["rendered"] for r in mine))
        turns = [r["turn"] for r in mine]
        known = [t for t in turns if t is not None]
        assert known == sorted(known) and turns[:len(known)] == known
        cost, state = 0.0, 0
        for r in mine:      # the total is that of the choices made
            q = R.STATES.index(r["repaired_role"])
            cost += R.STEPS[state, q][0] + (0 if r["role"] == r["repaired_role"] else R.RELABEL)
            state = q
        assert {r["total_cost"] for r in mine} == {cost + R.INSERT * len(R.CLOSING[state])}


def test_whole_conversations(spark):
    df = spark.createDataFrame([(1, 2, "user", "c"), (1, 1, "user", "b"), (1, 0, "system", "a"), (None, 0, "assistant", None)],
                               "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r["rendered"] for r in R.conversation_texts(df).collect()}
    assert got == {1: "<|system|>\na\n<|user|>\nb\nc\n<|assistant|>\n", None: got[None]}
    assert legal(got[None])


def test_plain_trace_equals_the_arrays():
    rng = np.random.default_rng(3)
    for _ in range(100):
        codes = rng.integers(0, 4, rng.integers(1, 9)).tolist()
        costs = [R._ROLE_COSTS[c] for c in codes]
        total = costs[0][0]
        for c in costs[1:]:
            total = (total[:, None] + c).min(axis=0)
        leave = int((total + R.closing_cost()).argmin())
        assert R.traced(codes, 0, leave) == R.trace(costs, 0, leave)
