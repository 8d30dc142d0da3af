"""One-to-one matching of predicted groups to true groups, per group key.

Input is always a long cell table ``(keys..., row, col, value)`` with at most
k x k cells per group (a contingency table or a cost table), so every group
is bounded by k^2 rows whatever the size of the data behind it.

- Optimal matching (max overlap or min cost): each group is packed into one row of
  flat arrays and solved inside ``mapInArrow``, totals and pairs together: by shortest augmenting paths in numpy,
  O(k^3), or for large tables of counts by an auction over the cells that are there. ``large_matching`` has rounds of
  DataFrame jobs for groups whose cells no task should hold.
- Greedy matching: cells sorted by (-value, row order, col order), folded with
  used-row / used-col sets; equal to repeated delete-the-max.
"""
from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship_package


# groups of more rows and columns than this, of integer overlaps, are solved over their cells alone
DENSE_K = 128


def pack_cells(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str,
               pad: str | None = None) -> DataFrame:
    """One row per group holding its (<= k^2) cells.

    Columns: ``_rows`` / ``_cols`` (sorted distinct row and column values),
    ``_k`` (square size), ``_cells`` (array of (_i, _j, _v, _r, _c) with 0-based
    indices into ``_rows`` / ``_cols``) and ``_pad`` (per row, the value of a column that is
    not there; 0 unless ``pad`` names a column that is constant along each row).
    """
    keys = list(keys)
    within = Window.partitionBy(*keys)
    c = cells.select(*keys, F.col(row).alias("_r"), F.col(col).alias("_c"), F.col(value).cast("double").alias("_v"),
                     (F.col(pad).cast("double") if pad else F.lit(0.0)).alias("_p"))
    c = (c.withColumn("_i", (F.dense_rank().over(within.orderBy("_r")) - 1).cast("int"))
         .withColumn("_j", (F.dense_rank().over(within.orderBy("_c")) - 1).cast("int")))
    g = c.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("_i", "_r", "_p"))).alias("_rs"),
        F.array_sort(F.collect_set(F.struct("_j", "_c"))).alias("_cs"),
        F.collect_list(F.struct("_i", "_j", "_v", "_r", "_c")).alias("_cells"))
    return (g.withColumn("_rows", F.transform("_rs", lambda x: x["_r"])).withColumn("_cols", F.transform("_cs", lambda x: x["_c"]))
            .withColumn("_pad", F.transform("_rs", lambda x: x["_p"]))
            .withColumn("_k", F.greatest(F.size("_rows"), F.size("_cols"))).drop("_rs", "_cs"))


def _solve_dense(cost: np.ndarray) -> np.ndarray:
    """Min-cost assignment of a square matrix (shortest augmenting paths with potentials).

    Returns ``col_of_row``. O(k^3).
    """
    n = cost.shape[0]
    u = np.zeros(n + 1)
    v = np.zeros(n + 1)
    p = np.zeros(n + 1, dtype=np.int64)     # p[j]: row matched to column j (1-based), 0 = free
    way = np.zeros(n + 1, dtype=np.int64)
    for i in range(1, n + 1):
        p[0] = i
        j0 = 0
        minv = np.full(n + 1, np.inf)
        used = np.zeros(n + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = p[j0]
            cur = cost[i0 - 1, :] - u[i0] - v[1:]
            free = ~used[1:]
            better = free & (cur < minv[1:])
            minv[1:][better] = cur[better]
            way[1:][better] = j0
            cand = np.where(free, minv[1:], np.inf)
            j1 = int(np.argmin(cand)) + 1
            delta = cand[j1 - 1]
            used_idx = np.nonzero(used)[0]
            u[p[used_idx]] += delta
            v[used_idx] -= delta
            minv[1:][free] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while True:
            j1 = way[j0]
            p[j0] = p[j1]
            j0 = j1
            if j0 == 0:
                break
    col_of_row = np.zeros(n, dtype=np.int64)
    for j in range(1, n + 1):
        if p[j] > 0:
            col_of_row[p[j] - 1] = j - 1
    return col_of_row


def _solve_sparse(i: np.ndarray, j: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Max-total assignment of a k x k table given by its cells, integers of 0 or more; what is missing is 0.

    Sequential auction with epsilon scaling over the cells alone: memory grows with the cells, not with k squared. The
    table is doubled (a copy of each row and column stands for staying alone), so that a perfect matching exists.
    Returns ``col_of_row``; rows that stay alone get the columns left over.
    """
    i, j, v = i[v > 0], j[v > 0], v[v > 0].astype(np.int64) * (2 * k + 1)
    both = np.arange(k)
    # persons: rows 0..k-1 and copies of columns k..2k-1; objects: columns 0..k-1 and copies of rows k..2k-1
    person = np.concatenate([i, j + k, both, both + k])
    target = np.concatenate([j, i + k, both + k, both])
    worth = np.concatenate([v, np.zeros(len(j) + 2 * k, np.int64)])
    order = np.argsort(person, kind="stable")
    target, worth = target[order], worth[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(person, minlength=2 * k))])
    price, epsilon = np.zeros(2 * k, np.int64), max(1, int(worth.max(initial=0)) // 6)
    while True:
        owner, free = np.full(2 * k, -1), list(range(2 * k - 1, -1, -1))
        while free:
            p = free.pop()
            options = target[start[p]:start[p + 1]]
            net = worth[start[p]:start[p + 1]] - price[options]
            at = int(net.argmax())
            best, net[at] = int(net[at]), -(1 << 62)
            o = options[at]
            # a person with one option alone keeps its object
            price[o] += epsilon + (best - int(net.max()) if len(net) > 1 else 0)
            if owner[o] >= 0:
                free.append(owner[o])
            owner[o] = p
        if epsilon == 1:
            break
        epsilon = max(1, epsilon // 6)
    col_of_row = np.full(k, -1)
    for c in range(k):
        if owner[c] < k:
            col_of_row[owner[c]] = c
    col_of_row[col_of_row < 0] = np.setdiff1d(both, col_of_row)
    return col_of_row


def _dense(k: int, n_rows: int, n_cols: int, cells: dict[str, np.ndarray], pad: np.ndarray) -> np.ndarray:
    """Square matrix of a packed group; absent columns hold their row's padding value."""
    w = np.zeros((k, k))
    w[:n_rows, n_cols:] = pad[:, None]
    w[cells["_i"], cells["_j"]] = cells["_v"]
    return w


def with_matching(packed: DataFrame, mode: str = "max", out: str = "total") -> DataFrame:
    """Adds the optimal matching total and its (i, j) index pairs ``_mi``, ``_mj`` to packed rows; no shuffle."""
    ship_package(packed.sparkSession)
    dense_k = DENSE_K
    schema = T.StructType([*packed.schema.fields, T.StructField(out, T.DoubleType()),
                           T.StructField("_mi", T.ArrayType(T.IntegerType())), T.StructField("_mj", T.ArrayType(T.IntegerType()))])
    names = packed.columns

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, rows, cols = [], [], []
            cells, pads = batch.column(names.index("_cells")), batch.column(names.index("_pad"))
            for g in range(batch.num_rows):
                fields = cells[g].values
                flat = {n: fields.field(n).to_numpy(zero_copy_only=False) for n in ("_i", "_j", "_v")}
                pad = pads[g].values.to_numpy(zero_copy_only=False)
                k = batch.column(names.index("_k"))[g].as_py()
                v = flat["_v"]
                if mode == "max" and k > dense_k and not pad.any() and (v >= 0).all() and (v == np.floor(v)).all():
                    match = _solve_sparse(flat["_i"].astype(np.int64), flat["_j"].astype(np.int64), v, k)
                    totals.append(float(v[match[flat["_i"]] == flat["_j"]].sum()))
                else:
                    w = _dense(k, len(pad), int(flat["_j"].max()) + 1, flat, pad)
                    match = _solve_dense(-w if mode == "max" else w)
                    totals.append(float(w[np.arange(k), match].sum()))
                rows.append(list(range(k)))
                cols.append(match.tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(totals, pa.float64()), pa.array(rows, pa.list_(pa.int32())),
                 pa.array(cols, pa.list_(pa.int32()))], [*names, out, "_mi", "_mj"])

    return packed.mapInArrow(solve, schema)


def assignment_total(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str,
                     mode: str = "max", out: str = "total", pad: str | None = None) -> DataFrame:
    """Best 1:1 matching total per group (``mode`` = "max" or "min")."""
    return with_matching(pack_cells(cells, keys, row, col, value, pad), mode, out).select(*keys, out)


def assignment_pairs(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str,
                     mode: str = "max", pad: str | None = None, padding: bool = False) -> DataFrame:
    """Matched (row, col, value) pairs per group, any group size.

    With ties, the chosen pairs may differ from another solver's; the total does not.
    Rows matched to a padded column are left out, or kept with a null column if ``padding``.
    """
    keys = list(keys)
    d = with_matching(pack_cells(cells, keys, row, col, value, pad), mode)
    inside = "p._mi < size(_rows)" + ("" if padding else " AND p._mj < size(_cols)")
    pairs = d.select(*keys, "_rows", "_cols", F.explode(F.expr(f"filter(arrays_zip(_mi, _mj), p -> {inside})")).alias("_p")).select(
        *keys, F.expr("_rows[_p._mi]").alias(row), F.expr("get(_cols, _p._mj)").alias(col))
    # the value of a pair without a cell is 0
    known = cells.select(*keys, row, col, F.col(value).cast("double").alias("value"))
    return pairs.join(known, [*keys, row, col], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def greedy_cell(row_order: str, col_order: str, value: str):
    """A cell as a struct whose order is that of the greedy choice."""
    return F.struct((-F.col(value).cast("double")).alias("nv"), F.col(row_order).cast("long").alias("r"),
                    F.col(col_order).cast("long").alias("c"), F.col(value).cast("double").alias("v"))


def greedy_fold(cells: str):
    """Greedy total of a sorted array of ``greedy_cell``: each cell whose row and column are still free counts."""
    return F.expr(
        f"aggregate({cells}, named_struct('ur', cast(array() as array<bigint>), "
        "'uc', cast(array() as array<bigint>), 't', 0D), "
        "(acc, x) -> IF(array_contains(acc.ur, x.r) OR array_contains(acc.uc, x.c), acc, "
        "named_struct('ur', array_append(acc.ur, x.r), 'uc', array_append(acc.uc, x.c), 't', acc.t + x.v)), "
        "acc -> acc.t)")


def greedy_total(cells: DataFrame, keys: Sequence[str], row_order: str, col_order: str,
                 value: str, out: str = "total") -> DataFrame:
    """Greedy matching total: take the largest cell, delete its row and column, repeat.

    Ties go to the first cell in (row_order, col_order) order.
    """
    keys = list(keys)
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(greedy_cell(row_order, col_order, value))).alias("_s"))
    return packed.select(*keys, greedy_fold("_s").alias(out))
