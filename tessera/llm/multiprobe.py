"""Approximate nearest neighbours by multiprobe p-stable hashing (Euclidean distance).

Each of ``TABLES`` hash tables cuts ``PROJECTIONS`` Gaussian projections into cells of a width fitted to the data.
A query visits, in every table, the ``PROBES`` cells most likely to hold a vector at the fitted distance: the
chance of each neighbouring cell is the normal mass that falls into it, summed as logarithms over projections,
and the best sums are found one projection at a time (keeping the best ``PROBES`` partial sums is exact, as the
terms are independent). Candidates of all tables are ranked by exact distance in double precision.

Vectors of a cell are packed into blocks of about ``BLOCK`` (a crowded cell, such as copies of one vector, has
many blocks), queries likewise; blocks of one cell meet in a join and a task compares two blocks at a time,
passing on the nearest ``k`` of each query. No row is made for a pair that is only compared.

The width is fitted on at most ``SAMPLE`` vectors (first by a hash of the id); every vector is indexed. Each query
is put on a ladder of reaches (``STEP`` apart, the median distance in the middle) by its own distance to its k-th
neighbour in that sample; the middle and each reach asked for by more than ``SCAN_QUERIES`` queries has tables of its
own width. Queries of other reaches, and those whose k-th neighbour is missing or lies beyond the reach of the cells,
are finished by comparing them with all vectors, block by block. Recall against brute force is measured in the tests
and the README.

Defined cases: vectors that are null, zero or hold null or non-finite parts, and rows without an id, take no part;
vectors of another length are not near anything of this one; of rows that repeat an id the nearest counts; a
table without queries gives an empty result.
"""
from __future__ import annotations

import math
import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ddl, per_worker, prepare, read, slices, stage
from tessera.llm.registry import query

TABLES, PROJECTIONS, PROBES = 8, 5, 56
WIDTH = 1.2                 # cell width, in fitted distances
SAMPLE = 2000
BLOCK = 1024                # vectors of a block
QUERY_BLOCK = 128
STEP = 1.25                 # ratio of neighbouring reaches
SCAN_QUERIES = 64           # queries of a reach from which it gets tables of its own
SCAN_BYTES = 32 << 20       # query blocks that are broadcast to the scan
SCAN_KEPT = 50_000          # queries a task of the scan keeps the nearest of
_erf = np.vectorize(math.erf, otypes=[float])


class Hashing:
    """Projections of all tables for vectors of one length."""

    def __init__(self, dim: int, width: float, reach: float, tables: int, projections: int, seed: int = 17):
        rng = np.random.default_rng([seed, dim])
        self.tables, self.projections, self.width, self.reach = tables, projections, width, reach
        self.lines = rng.standard_normal((dim, tables * projections))
        self.shift = rng.uniform(0, width, tables * projections)
        self.mix = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1
        self.salt = rng.integers(0, 1 << 62, tables, dtype=np.int64)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Positions in cell widths, (vectors, tables, projections)."""
        return ((x @ self.lines + self.shift) / self.width).reshape(len(x), self.tables, self.projections)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit key of each (..., table, projections) cell."""
        with np.errstate(over="ignore"):
            h = (cells * self.mix).sum(axis=-1) ^ self.salt
            h = (h ^ (h >> 29)) * np.int64(0x1CE4E5B9BF58476D)
        return h ^ (h >> 32)

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """Keys of the ``count`` likeliest cells in each table, likeliest first: (vectors, tables, up to count)."""
        at = self.places(x)
        cells = np.floor(at).astype(np.int64)
        inside, scale = at - cells, self.width / (self.reach * math.sqrt(2))
        steps = np.arange(-2, 3)
        edges = _erf((np.arange(-2, 4) - inside[..., None]) * scale)
        chance = np.log(np.maximum(np.diff(edges, axis=-1) / 2, 1e-300))
        best, moves = chance[..., 0, :], steps[None, None, :, None] + np.zeros((*at.shape[:2], 1, 1), np.int64)
        for j in range(1, self.projections):
            total = (best[..., :, None] + chance[..., j, None, :]).reshape(*best.shape[:2], -1)
            top = np.argsort(-total, axis=-1, kind="stable")[..., :count]
            best = np.take_along_axis(total, top, axis=-1)
            before = np.take_along_axis(moves, (top // len(steps))[..., None], axis=2)
            moves = np.concatenate([before, steps[top % len(steps)][..., None]], axis=-1)
        order = np.argsort(-best, axis=-1, kind="stable")[..., :count]
        visited = cells[:, :, None, :] + np.take_along_axis(moves, order[..., None], axis=2)
        return self.keys(visited.transpose(0, 2, 1, 3)).transpose(0, 2, 1)


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values (double) and offsets of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vec.isNotNull() & ~bad & F.exists(vec, lambda v: v != 0)


def sampled(base: DataFrame) -> dict[int, tuple[list, np.ndarray]]:
    """length -> (ids, vectors) of a bounded sample."""
    rows = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "vec").collect()
    by_dim: dict[int, tuple[list, list]] = {}
    for r in rows:
        ids, vecs = by_dim.setdefault(len(r["vec"]), ([], []))
        ids.append(r["id"])
        vecs.append(r["vec"])
    return {dim: (ids, np.array(vecs, dtype=np.float64)) for dim, (ids, vecs) in by_dim.items()}


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * q @ x.T, 0))


def fitted_distance(x: np.ndarray, near: int) -> float:
    """Median distance to the ``near``-th neighbour within the sample."""
    if len(x) < 2:
        return 1.0
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    nth = np.median(np.sort(d, axis=1)[:, min(near, len(x) - 1) - 1])
    return float(nth) if nth > 0 else float(np.median(d[np.isfinite(d)])) or 1.0


def rungs(sent, reach: float, k: int):
    """Adds to each query the rung of the ladder of reaches nearest to its ``k``-th distance in the sample; null
    where the sample has fewer than ``k`` others of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            flat, offsets = matrix(batch.column(1))
            own = batch.column(0).to_pylist()
            sizes, found = np.diff(offsets), [None] * len(own)
            for dim in np.unique(sizes):
                ids, x = sent.value.get(int(dim), ([], None))
                at = {}
                for j, v in enumerate(ids):
                    at.setdefault(v, []).append(j)
                rows = np.flatnonzero(sizes == dim)
                if len(ids) <= k:
                    continue
                d = distances(flat[offsets[rows][:, None] + np.arange(dim)], x)
                for i, row in enumerate(rows):
                    d[i, at.get(own[row], [])] = np.inf
                    nth = np.partition(d[i], k - 1)[k - 1]
                    if np.isfinite(nth):
                        found[row] = round(math.log(nth / reach, STEP)) if nth > 0 else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.int32())], ["id", "vec", "rung"])
    return run


def _blocks(rows: DataFrame, most: int, ids: str, vecs: str) -> DataFrame:
    """(key, ids, vecs): the rows of a key packed in blocks of about ``most``."""
    parts = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts")).where("_parts > 1")
    # a key that fits one block needs no count
    dealt = rows.join(parts, "key", "left").withColumn(
        "_part", F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))))
    return dealt.groupBy("key", "_part").agg(F.collect_list("id").alias(ids), F.collect_list("vec").alias(vecs)).drop("_part")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, projections: int = PROJECTIONS, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found for each row that ``is_query`` (a condition on the id column)."""
    spark = vectors.sparkSession
    prepare(spark)
    base = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sample = sampled(base)
    reach = fitted_distance(max((x for _, x in sample.values()), key=len, default=np.empty((0, 1))), k)
    sent = spark.sparkContext.broadcast(sample)
    key = uuid.uuid4().hex
    kinds = dict(base.dtypes)
    asking = stage(base.where("asks").select("id", "vec").mapInArrow(
        rungs(sent, reach, k), ddl(base, ["id", "vec"]) + ", rung int"), "ann-queries")
    sizes = {r["rung"]: r["count"] for r in asking.where("rung is not null").groupBy("rung").count().collect()}
    laddered = sorted(r for r, n in sizes.items() if r == 0 or n > SCAN_QUERIES)

    def hashed(visits: bool, rung: int):
        reach_here = reach * STEP ** rung

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 64 if visits else 512):
                flat, offsets = matrix(batch.column(1))
                sizes = np.diff(offsets)
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    hashing = per_worker(("hashing", key, rung, int(dim)), lambda: Hashing(
                        int(dim), WIDTH * reach_here, reach_here, tables, projections))
                    x = flat[offsets[rows][:, None] + np.arange(dim)]
                    if visits:
                        keys = hashing.probes(x, probes).reshape(len(rows), -1)
                    else:
                        keys = hashing.keys(np.floor(hashing.places(x)).astype(np.int64))
                    take = pa.array(np.repeat(rows, keys.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), batch.column(0).take(take), batch.column(1).take(take)],
                        ["key", "id", "vec"])
        return run

    schema = "key long, " + ddl(base, ["id", "vec"])
    hits = f"query_id {kinds['id']}, id {kinds['id']}, score double"

    def met(rung: int) -> DataFrame:
        index = stage(base.select("id", "vec").mapInArrow(hashed(False, rung), schema), "ann-index")
        asked = stage(asking.where(F.col("rung") == rung).select("id", "vec").mapInArrow(hashed(True, rung), schema), "ann-probes")
        blocks = _blocks(index, BLOCK, "ids", "vecs").join(_blocks(asked, QUERY_BLOCK, "query_ids", "query_vecs"), "key")
        return blocks.select("ids", "vecs", "query_ids", "query_vecs").mapInArrow(compare, hits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, query_ids = batch.column(0).flatten(), batch.column(2).flatten()
            x, at = matrix(batch.column(1).flatten())
            q, q_at = matrix(batch.column(3).flatten())
            dim = int(at[1])
            if dim != q_at[1]:      # cells of different lengths that share a key by chance
                continue
            x, q = x.reshape(-1, dim), q.reshape(-1, dim)
            numbers, own = ids.to_numpy(zero_copy_only=False), query_ids.to_numpy(zero_copy_only=False)
            by_id = np.argsort(numbers, kind="stable")
            x, numbers = x[by_id], numbers[by_id]
            rough = rough_squares(q, x, numbers)
            for i in range(len(q)):
                some, d = closest(x, numbers, q[i], own[i], k, rough and (rough[0][i], rough[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own[i], len(some))), pa.array(some), pa.array(d)], ["query_id", "id", "score"])

    # at most tables x probes x blocks of a cell x k rows a query, then one row each
    best = None
    for rung in laddered:
        more = met(rung)
        best = more if best is None else best.unionByName(more)
    if best is None:
        best = spark.createDataFrame([], hits)
    best = stage(_best(best, k), "ann-found")
    # not settled: no tables of its reach, fewer than k found, or the last one beyond the reach of the cells
    edge = F.lit(reach) * F.pow(F.lit(STEP), F.col("rung") + 0.5)
    known = asking.select("id", "rung").join(best.withColumnRenamed("query_id", "id"), "id", "left")
    settled = F.col("rung").isin(laddered) & (F.size("best") >= k) & (F.element_at("best", -1)["score"] <= edge)
    left = known.where(~F.coalesce(settled, F.lit(False))).select("id").distinct()
    queries = stage(asking.join(left, "id", "left_semi").select("id", "vec"), "ann-left")
    if not queries.isEmpty():
        scanned = _best(scan(base.select("id", "vec"), queries, k, hits), k)
        best = best.join(left, best["query_id"] == left["id"], "left_anti").unionByName(scanned)
    return best.select("query_id", F.posexplode("best").alias("rank", "hit")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score"))


def rough_squares(q: np.ndarray, x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Squared distances by one matrix product, and a bound on twice their rounding error; none where ids repeat or
    the numbers are too large for it."""
    if len(np.unique(numbers)) < len(numbers):
        return None
    q2, x2 = (q * q).sum(axis=1), (x * x).sum(axis=1)
    rough = q2[:, None] + x2 - 2 * q @ x.T
    most = float(q2.max(initial=0.0) + x2.max(initial=0.0))
    return (rough, 1e-15 * (8 + x.shape[1]) * 4 * most) if np.isfinite(rough).all() else None


def closest(x: np.ndarray, numbers: np.ndarray, q: np.ndarray, own, k: int, rough: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``k`` rows of ``x`` nearest to ``q``, nearest first; of rows that repeat an id one.

    With rough squared distances only the rows that may be among the nearest are measured exactly.
    """
    if rough is not None and len(x) > k + 1:
        square = np.where(numbers == own, np.inf, rough[0])
        edge = np.partition(square, k - 1)[k - 1]
        some = np.flatnonzero(square <= edge + rough[1])
        x, numbers, repeats = x[some], numbers[some], False
    else:
        repeats = rough is None
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    d[numbers == own] = np.inf
    some = np.lexsort((numbers, d))
    if repeats:
        some = some[np.sort(np.unique(numbers[some], return_index=True)[1])]
    some = some[:k]
    some = some[np.isfinite(d[some])]
    return numbers[some], d[some]


def _best(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    return merged.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "id"))), 1, k).alias("best"))


def _packs(most: int):
    """Rows of one length packed into lists of at most ``most``, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most):
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], ["ids", "vecs"])
    return run


def scan(base: DataFrame, queries: DataFrame, k: int, hits: str) -> DataFrame:
    """(query_id, id, score): the nearest of each query within each task, all vectors compared, block by block."""
    id_kind, vec_kind = (kind for _, kind in base.dtypes)
    packed = f"ids array<{id_kind}>, vecs array<{vec_kind}>"
    asked = stage(queries.coalesce(8).mapInArrow(_packs(QUERY_BLOCK), packed), "scan-queries").toDF("query_ids", "query_vecs")
    size = asked.agg(F.sum(F.size("query_vecs") * F.size(F.col("query_vecs")[0]) * 8)).first()[0] or 0
    pairs = base.mapInArrow(_packs(BLOCK), packed).crossJoin(F.broadcast(asked) if size <= SCAN_BYTES else asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([q for q, near in kept.items() for _ in near], id_type),
                 pa.array([i for near in kept.values() for i in near], id_type),
                 pa.array([d for near in kept.values() for d in near.values()], pa.float64())], ["query_id", "id", "score"])

        for batch in slices(batches, 1):
            ids, query_ids = batch.column(0).flatten(), batch.column(2).flatten()
            id_type = ids.type
            x, at = matrix(batch.column(1).flatten())
            q, q_at = matrix(batch.column(3).flatten())
            if at[1] != q_at[1]:
                continue
            x, q = x.reshape(-1, int(at[1])), q.reshape(-1, int(at[1]))
            numbers, own = ids.to_numpy(zero_copy_only=False), query_ids.to_numpy(zero_copy_only=False)
            rough = rough_squares(q, x, numbers)
            for i, name in enumerate(query_ids.to_pylist()):
                some, d = closest(x, numbers, q[i], own[i], k, rough and (rough[0][i], rough[1]))
                near = kept.setdefault(name, {})
                for n, s in zip(some.tolist(), d.tolist()):
                    if s < near.get(n, math.inf):
                        near[n] = s
                if len(near) > k:
                    kept[name] = dict(sorted(near.items(), key=lambda e: (e[1], e[0]))[:k])
            if len(kept) > SCAN_KEPT:
                yield rows()
                kept.clear()
        if kept:
            yield rows()

    return pairs.select("ids", "vecs", "query_ids", "query_vecs").mapInArrow(compare, hits)


@query("op3_multiprobe_lsh")
def op3_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors found for each vector whose id is divisible by 100."""
    found = nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")
