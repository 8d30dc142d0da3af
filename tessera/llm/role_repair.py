"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Dynamic programming over this automaton chooses for each turn, at the smallest total cost, its role
(another than its own costs ``RELABEL``), whether it is merged into the message before it (``MERGE``), and where an
empty turn is put in (``INSERT``); ties go to the earlier state in ``STATES``. The repaired sequence is rendered turn
by turn: a header line for each message, then its texts.

Turns are sorted once by range (a conversation with a third of all turns spans many tasks) and cut into blocks of at
most ``BLOCK`` consecutive rows. Roles alone are packed, one row for each conversation and block, many to an Arrow batch:
a block becomes a min-plus matrix (cost from state to state), the matrices of a conversation are chained to find the
states at the block edges, and each block is traced on its own. Texts stay in the JVM, which renders each turn. The
rendering of a conversation is that of its rows in order (``conversation_texts``).

Defined cases: a null or unknown role has to be relabelled; a null text counts as empty; turns come in order of number
(a null number last), then of the text's first ``TIE_CHARS`` characters and its hash; rows without a conversation id form
one; an empty table gives an empty result.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, read, stage
from tessera.llm.registry import query

MERGE, INSERT, RELABEL = 1.0, 2.0, 3.0
BLOCK = 4096                # consecutive rows of a sorted partition
TIE_CHARS = 64
# fixed values: the automaton; state k is "the last message is of role k"
STATES = ("start", "system", "user", "assistant")
_LEGAL = {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}
# with an empty turn of the third state in between
_WITH_ONE = {(2, 2): 3, (0, 3): 2, (1, 3): 2, (3, 3): 2}
# closing a conversation: the empty turns that make it legal
CLOSING = {0: (), 1: (2, 3), 2: (3,), 3: ()}


def _step(p: int, q: int) -> tuple[float, str, int]:
    """Cheapest way from state p to a turn of role q: cost, action, state put in before it (0: none)."""
    ways = []
    if (p, q) in _LEGAL:
        ways.append((0.0, "keep", 0))
    if p == q:
        ways.append((MERGE, "merge", 0))
    if (p, q) in _WITH_ONE:
        ways.append((INSERT, "insert", _WITH_ONE[p, q]))
    return min(ways, default=(np.inf, "", 0))


STEPS = {(p, q): _step(p, q) for p in range(4) for q in range(1, 4)}
_COST = np.array([[np.inf, *[STEPS[p, q][0] for q in range(1, 4)]] for p in range(4)])


def turn_costs(role: str | None) -> np.ndarray:
    """4 x 4 costs of one turn, from state to state."""
    return _COST + np.array([0.0 if STATES[q] == role else RELABEL for q in range(4)])


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None]).min(axis=1)


def trace(costs: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States after each step on the cheapest way from ``entry`` to ``leave``; ties to the earlier state."""
    best = np.full(4, np.inf)
    best[entry] = 0.0
    came = []
    for c in costs:
        total = best[:, None] + c
        came.append(total.argmin(axis=0))
        best = total.min(axis=0)
    path = [leave]
    for back in reversed(came[1:]):
        path.append(int(back[path[-1]]))
    return path[::-1]


def closing_cost() -> np.ndarray:
    return np.array([INSERT * len(CLOSING[p]) for p in range(4)])


_ROLE_COSTS = {code: turn_costs(role) for code, role in enumerate((None, *STATES[1:]))}


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, first, codes) -> (conv, first, costs): the matrix of each block; all blocks of a batch step together."""
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        codes = lists.flatten().to_numpy(zero_copy_only=False)
        start = np.cumsum(sizes) - sizes
        costs = np.stack(list(_ROLE_COSTS.values()))
        order = np.argsort(-sizes, kind="stable")
        m = costs[codes[start]] if len(sizes) else np.zeros((0, 4, 4))
        for step in range(1, int(sizes.max(initial=0))):
            live = order[:np.searchsorted(-sizes[order], -step, side="left")]      # blocks with a turn at this step
            m[live] = (m[live][:, :, :, None] + costs[codes[start[live] + step]][:, None]).min(axis=2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(m.reshape(len(m), 16).tolist(), pa.list_(pa.float64()))], ["conv", "first", "costs"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blocks of a conversation in order) -> first, entry, leave, last, total_cost of each block."""
    for batch in batches:
        out: list[tuple] = []
        for blocks in batch.column(0).to_pylist():
            costs = [np.array(b["costs"]).reshape(4, 4) for b in blocks]
            total = costs[0][0]
            for c in costs[1:]:
                total = (total[:, None] + c).min(axis=0)
            total = total + closing_cost()
            leave = int(total.argmin())
            path = trace(costs, 0, leave) if len(costs) > 1 else [leave]
            out += [(b["first"], e, v, i == len(path) - 1, float(total.min()))
                    for i, (b, e, v) in enumerate(zip(blocks, [0, *path[:-1]], path))]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                         ["first", "entry", "leave", "last", "total_cost"])


_STEP_COSTS = {code: c.tolist() for code, c in _ROLE_COSTS.items()}


def traced(codes: list[int], entry: int, leave: int) -> list[int]:
    """``trace`` over the costs of role codes, without arrays."""
    best, came = [np.inf] * 4, []
    best[entry] = 0.0
    for code in codes:
        c, now, back = _STEP_COSTS[code], [np.inf] * 4, [0] * 4
        for q in range(4):
            for p in range(4):
                if best[p] + c[p][q] < now[q]:
                    now[q], back[q] = best[p] + c[p][q], p
        best = now
        came.append(back)
    path = [leave]
    for back in reversed(came[1:]):
        path.append(back[path[-1]])
    return path[::-1]


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(codes, entry, leave) with the rest of the row -> states, and the state before each."""
    for batch in batches:
        states, before = [], []
        for codes, entry, leave in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("codes", "entry", "leave"))):
            path = traced(codes, entry, leave)
            states.append(path)
            before.append([entry, *path[:-1]])
        lists = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, lists), pa.array(before, lists)],
                                         [*batch.schema.names, "states", "before"])


def _looked_up(values: dict, *keys) -> Column:
    """A small dictionary as an expression; keys are columns."""
    out = F.lit(None)
    for k, v in values.items():
        same = F.lit(True)
        for c, part in zip(keys, k if isinstance(k, tuple) else (k,)):
            same = same & (c == part)
        out = F.when(same, F.lit(v)).otherwise(out)
    return out


def _header(state: int) -> str:
    return f"<|{STATES[state]}|>\n" if state else ""


def repair_roles(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", position: str | None = None) -> DataFrame:
    """A row for each turn: conversation, turn, role, repaired_role, action, total_cost (of the conversation), rendered;
    with ``position`` also a column of that name in which the turns of a conversation count up."""
    spark = turns.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                        F.col(text_col).cast("string").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    # the last key splits repeated rows
    order = ["conv", F.col("turn").asc_nulls_last(), F.substring(text, 1, TIE_CHARS), F.xxhash64(text), "tie"]
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    rows = stage(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
                 .withColumn("at", F.monotonically_increasing_id()), "turns")
    code = _looked_up({STATES[q]: q for q in range(1, 4)}, F.col("role"))
    blocks = rows.select("conv", "at", F.coalesce(code, F.lit(0)).cast("int").alias("code")).withColumn(
        "block", F.floor(F.col("at") / BLOCK)).groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "code"))).alias("t")).select(
        "conv", F.col("t")[0]["at"].alias("first"), F.transform("t", lambda x: x["code"]).alias("codes"),
        F.transform("t", lambda x: x["at"]).alias("ats"))
    blocks = stage(blocks, "turn-blocks")
    kind = dict(rows.dtypes)["conv"]
    matrices = blocks.select("conv", "first", "codes").mapInArrow(_matrices, f"conv {kind}, first long, costs array<double>")
    chains = matrices.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("first", "costs"))).alias("b"))
    edges = chains.select("b").mapInArrow(_edges, "first long, entry int, leave int, last boolean, total_cost double")
    joined = blocks.drop("conv").join(stage(edges, "turn-edges"), "first")
    found = joined.mapInArrow(_decisions, ", ".join(f"{n} {k}" for n, k in joined.dtypes) + ", states array<int>, before array<int>")
    size = F.size("ats")
    each = found.select("total_cost", "last", size.alias("n"), F.posexplode(F.arrays_zip("ats", "states", "before")).alias("i", "d")).select(
        F.col("d.ats").alias("at"), "total_cost", F.col("d.states").alias("state"), F.col("d.before").alias("before"),
        (F.col("last") & (F.col("i") == F.col("n") - 1)).alias("ends"))
    both = rows.join(stage(each, "turn-decisions"), "at")
    steps = {k: v for k, v in STEPS.items() if v[1]}
    action = _looked_up({k: v[1] for k, v in steps.items()}, F.col("before"), F.col("state"))
    put_in = _looked_up({k: _header(v[2]) for k, v in steps.items()}, F.col("before"), F.col("state"))
    repaired = _looked_up({q: STATES[q] for q in range(1, 4)}, F.col("state"))
    head = F.when(action == "merge", "").otherwise(F.concat(put_in, _looked_up({q: _header(q) for q in range(1, 4)}, F.col("state"))))
    closing = F.when(F.col("ends"), _looked_up({q: "".join(map(_header, CLOSING[q])) for q in CLOSING}, F.col("state"))).otherwise("")
    relabel = F.when(F.col("role").eqNullSafe(repaired), "").otherwise("+relabel")
    return both.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), repaired.alias("repaired_role"),
        F.concat(action, relabel).alias("action"), "total_cost",
        F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n"), closing).alias("rendered"),
        *([F.col("at").alias(position)] if position else []))


def conversation_texts(turns: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """(conversation, rendered): the repaired text of each whole conversation, one row each, as long as it is."""
    rows = repair_roles(turns, conv_col, position="_position", **columns)
    parts = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list(F.struct("_position", "rendered"))).alias("r"))
    return parts.select(conv_col, F.array_join(F.transform("r", lambda x: x["rendered"]), "").alias("rendered"))


@query("op1_role_repair")
def op1_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered turns of all ``conversations``."""
    return repair_roles(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
