"""K-means over the whole table and inside many small groups.

A step of the whole-table fit is one job: each task adds up, for each cluster, its vectors, their number, their squared
distances and how many of them were in another cluster under the centroids before; k rows come back to the driver.
The table is written once before the first step, centroids travel with the task.

``parallel_start`` is a k-means|| start: every round draws ``2 k`` rows with chances by their squared distance to
what was drawn before (smallest -ln(u) / d^2, u from a hash of the id, so that one scan a round is enough and reruns
agree); the few candidates are weighted by the rows nearest to them and reduced to k on the driver.
"""
from __future__ import annotations

from typing import Callable, Iterator, NamedTuple, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize, ship_package

# values of (rows x clusters x dimensions) compared at a time: for groups, and for the rows of one table, few enough to
# stay in a core's cache
CHUNK_VALUES = 1 << 22
NEAR_VALUES = 1 << 15
START_ROUNDS = 5


class Fit(NamedTuple):
    centroids: np.ndarray
    steps: int
    converged: bool
    inertia: float          # under the centroids before the last step


def vector_rows(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix; vectors of unequal length are an error."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each row (ties to the lowest) and its squared distance."""
    if x.shape[1] != centroids.shape[1]:
        raise ValueError("vectors of unequal length")
    near, dist = np.empty(len(x), np.int64), np.empty(len(x))
    rows = max(1, NEAR_VALUES // max(1, centroids.size))
    for at in range(0, len(x), rows):
        d = ((x[at:at + rows, None, :] - centroids[None]) ** 2).sum(axis=2)
        near[at:at + rows] = d.argmin(axis=1)
        dist[at:at + rows] = d.min(axis=1)
    return near, dist


_SUMS = "q int, n long, moved long, inertia double, total array<double>"


def _step(rows: DataFrame, vec: str, now: np.ndarray, before: np.ndarray | None) -> list:
    """One row for each cluster that has vectors: (q, n, moved, inertia, total)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now)
        n, moved, inertia, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(now.shape)
        for batch in batches:
            x = vector_rows(batch.column(0))
            if not len(x):
                continue
            q, d = nearest(x, now)
            n += np.bincount(q, minlength=k)
            inertia += np.bincount(q, d, k)
            np.add.at(total, q, x)
            other = np.ones(len(q), bool) if before is None else nearest(x, before)[0] != q
            moved += np.bincount(q[other], minlength=k)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(n[held]), pa.array(moved[held]), pa.array(inertia[held]),
             pa.array(total[held].tolist(), pa.list_(pa.float64()))], ["q", "n", "moved", "inertia", "total"])

    parts = rows.select(vec).mapInArrow(run, _SUMS)
    return parts.groupBy("q").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), F.sum("inertia").alias("inertia"),
                                  vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).collect()


def written(df: DataFrame, columns: Sequence[str], vec: str = "x") -> DataFrame:
    """The columns a fit reads again and again, written once; rows without a vector are left out."""
    ship_package(df.sparkSession)
    return materialize(df.where(F.col(vec).isNotNull()).select(*columns), "fit-vectors")


def lloyd(df: DataFrame, start: Sequence[Sequence[float]], steps: int | None = None, vec: str = "x",
          rows: DataFrame | None = None) -> Fit:
    """Lloyd steps from the centroids ``start`` until no row changes its cluster, or ``steps`` of them.

    Every step lowers the inertia unless nothing moves, so the fit ends; should rounding of tied rows keep some moving
    without a lower inertia three times in a row, it ends there too. An empty cluster keeps its centroid.
    """
    rows = written(df, [vec], vec) if rows is None else rows
    now, before = np.array(start, dtype=np.float64), None
    if not len(now):
        return Fit(now, 0, True, 0.0)
    best, stuck, inertia, step = np.inf, 0, np.inf, 0
    while steps is None or step < steps:
        sums = _step(rows, vec, now, before)
        inertia = float(sum(r["inertia"] for r in sums))
        if before is not None and not sum(r["moved"] for r in sums):
            return Fit(now, step, True, inertia)
        best, stuck = (inertia, 0) if inertia < best else (best, stuck + 1)
        if stuck >= 3:
            return Fit(now, step, True, inertia)
        before, now, step = now, now.copy(), step + 1
        for r in sums:
            now[r["q"]] = np.array(r["total"]) / r["n"]
    return Fit(now, step, False, inertia)


def parallel_start(df: DataFrame, k: int, seed: int = 1, id_col: str = "id", vec: str = "x", rounds: int = START_ROUNDS,
                   rows: DataFrame | None = None) -> np.ndarray:
    """k starting centroids by k-means||; fewer if the table holds fewer different vectors."""
    rows = written(df, [id_col, vec], vec) if rows is None else rows
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    first = rows.orderBy(u, id_col).limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    drawn = [list(first[0][vec])]
    for r in range(rounds):
        draw = (F.pmod(F.xxhash64(F.lit(seed), F.lit(r + 1), F.col(id_col)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        keyed = rows.select(draw.alias("u"), F.col(id_col).alias("id"), F.col(vec).alias("x")).mapInArrow(
            _race(np.array(drawn), 2 * k), f"key double, id {dict(rows.dtypes)[id_col]}, x array<double>")
        drawn += [list(row["x"]) for row in keyed.orderBy("key", "id").limit(2 * k).collect()]
    candidates = np.unique(np.array(drawn), axis=0)
    weight = np.zeros(len(candidates))
    for row in _step(rows, vec, candidates, None):
        weight[row["q"]] = row["n"]
    return reduced(candidates, weight, k, seed)


def _race(centres: np.ndarray, most: int) -> Callable:
    """The ``most`` rows of a task with the smallest -ln(u) / d^2; rows that are a centre already never win."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = vector_rows(batch.column(2))
            d = nearest(x, centres)[1] if len(x) else np.zeros(0)
            able = np.flatnonzero(d > 0)
            key = -np.log(batch.column(0).to_numpy(zero_copy_only=False)[able]) / d[able]
            part = pa.RecordBatch.from_arrays(
                [pa.array(key), batch.column(1).take(pa.array(able)), pa.array(x[able].tolist(), pa.list_(pa.float64()))], ["key", "id", "x"])
            whole = pa.Table.from_batches([part] if held is None else [held, part]).combine_chunks()
            held = whole.take(np.argsort(whole["key"].to_numpy(), kind="stable")[:most]).combine_chunks().to_batches()
            held = held[0] if held else None
        if held is not None:
            yield held
    return run


def reduced(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids of a few weighted candidates: D-squared draws, the best of several, then weighted Lloyd steps."""
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    best, least = None, np.inf
    for _ in range(8):
        chosen = [int(rng.choice(len(x), p=weight / weight.sum()))]
        while len(chosen) < k:
            d = weight * nearest(x, x[chosen])[1]
            if d.sum() <= 0:
                break
            chosen.append(int(rng.choice(len(x), p=d / d.sum())))
        centres, near = x[chosen], None
        while True:
            q, d = nearest(x, centres)
            if near is not None and (q == near).all():
                break
            near, centres = q, centres.copy()
            for c in np.unique(q[weight > 0]):
                own = q == c
                centres[c] = np.average(x[own], axis=0, weights=np.maximum(weight[own], 1e-300))
        if (cost := float((weight * d).sum())) < least:
            best, least = centres, cost
    return best


def in_groups(packed: DataFrame, k: int, vecs: str, out: str, most_steps: int) -> DataFrame:
    """``packed`` (one row a group, ``vecs`` its vectors in order) with the cluster of each vector, from the first k."""
    ship_package(packed.sparkSession)
    at, names = packed.columns.index(vecs), packed.columns
    schema = T.StructType([*packed.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def fit(x: np.ndarray) -> np.ndarray:
        """(groups, rows, dimensions) -> clusters (groups, rows)."""
        centres, near = x[:, :k].copy(), None
        for _ in range(most_steps):
            d = ((x[:, :, None, :] - centres[:, None]) ** 2).sum(axis=3)
            q = d.argmin(axis=2)
            if near is not None and (q == near).all():
                return q
            near = q
            member = q[:, :, None] == np.arange(centres.shape[1])
            n = member.sum(axis=1)[:, :, None]
            centres = np.where(n > 0, np.einsum("gnk,gnd->gkd", member, x) / np.maximum(n, 1), centres)
        raise RuntimeError(f"k-means of a group still moves after {most_steps} steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            sizes = np.diff(lists.offsets.to_numpy())
            found: list = [[]] * len(sizes)
            for size in np.unique(sizes[sizes > 0]):
                groups = np.flatnonzero(sizes == size)
                x = vector_rows(lists.take(pa.array(groups)).flatten()).reshape(len(groups), int(size), -1)
                step = max(1, CHUNK_VALUES // max(1, int(size) * min(k, int(size)) * x.shape[2]))
                for a in range(0, len(groups), step):
                    for g, q in zip(groups[a:a + step], fit(x[a:a + step])):
                        found[g] = q.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*names, out])

    return packed.mapInArrow(run, schema)
