"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

An anchor's positives are its best rows of the same label by inner product. For each of them the hard negatives are
the best rows of other labels whose score lies in the window from ``LEAST`` per cent of the positive's score up to it.

The tree is fitted on at most ``SAMPLE`` rows (first by a hash of the id): a node holds ``FANOUT`` split points, a
row belongs to the nearest one, ``LEVELS`` deep. Every row is then routed, and all rows together give each node its
ranges: the least and greatest distance from split point i to the rows below sibling j, for every pair (i, j), with
the least and greatest norm below j. For a query with scores wanted in [a, b] the identity |q-x|^2 = |q|^2 + |x|^2 -
2qx makes an annulus of distances; a sibling is passed over if the range of any split point misses what the triangle
inequality leaves of that annulus. Leaves that are left are compared exactly, in blocks.

Rows of a leaf are packed into blocks of about ``BLOCK``, blocks into parts, and a query goes to every part of the
leaves it visits, so a crowded leaf (copies of one vector) is the work of many tasks. Visits and blocks meet in an
equi-join on (length, leaf, part); a task holds one block against one block of queries. Bounds from the sample (the
k-th best score there is one that the true k-th can't be below) narrow the windows before the tree is walked. Two
searches run, for the positives and for the windows they give. The result is exact, whatever the sample was.

Defined cases: rows without an id or a label, and vectors that are null or hold null or non-finite parts, take no
part; zero and empty vectors do (their scores are 0); vectors of another length are not compared; of rows that
repeat an id the least (label, vector) counts; components beyond 32 bits after scaling are the nearest 32-bit
integer; a positive with a score below 0 has an empty window; anchors without positives or negatives give no rows.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, read, slices, stage
from tessera.llm.registry import query

# fixed values of the mining
SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST = 80

SAMPLE = 2048
FANOUT, LEVELS = 8, 2
BLOCK = 1024                # rows of a block
PART_BLOCKS = 64            # blocks of a part
QUERY_BLOCK = 128
_FLOOR, _TOP = -(1 << 62), 1 << 62
_LIMIT = (1 << 31) - 1


class Node:
    """Split points with one child each: another node or a leaf number."""

    def __init__(self, points: np.ndarray, path: tuple[int, ...]):
        self.points, self.path, self.children = points, path, []
        m = len(points)
        # (i, j): distances from split point i to the rows below child j; norms of the rows below j
        self.low, self.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        self.least, self.most = np.full(m, np.inf), np.full(m, -np.inf)


class Tree:
    """The split points of vectors of one length."""

    def __init__(self, x: np.ndarray, fanout: int, levels: int, seed: int = 5):
        self.leaves = 0
        rng = np.random.default_rng([seed, x.shape[1]])
        self.root = self._grow(x, fanout, levels, (), rng)

    def _grow(self, x: np.ndarray, fanout: int, levels: int, path: tuple[int, ...], rng):
        points = _spread(x, fanout, rng) if levels and len(x) >= 4 * fanout else x[:0]
        if len(points) < 2:
            self.leaves += 1
            return self.leaves - 1
        node = Node(points, path)
        near = _gaps(x, points).argmin(axis=1)
        node.children = [self._grow(x[near == j], fanout, levels - 1, (*path, j), rng) for j in range(len(points))]
        return node

    def route(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[Node, np.ndarray, np.ndarray, np.ndarray]]]:
        """Leaf of each row, and (node, rows, child of each, distances to the split points) of all nodes passed."""
        leaf, passed = np.zeros(len(x), np.int64), []

        def down(node, rows):
            if not isinstance(node, Node):
                leaf[rows] = node
                return
            gaps = _gaps(x[rows], node.points)
            near = gaps.argmin(axis=1)
            passed.append((node, rows, near, gaps))
            for j, child in enumerate(node.children):
                if (near == j).any():
                    down(child, rows[near == j])
        down(self.root, np.arange(len(x)))
        return leaf, passed

    def visits(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, queries that must see it) for windows of scores [low, high], one row of windows a query."""
        found, norm = [], np.sqrt((q * q).sum(axis=1))

        def down(node, rows):
            if not isinstance(node, Node):
                found.append((node, rows))
                return
            gaps = _gaps(q[rows], node.points)
            for j, child in enumerate(node.children):
                if node.most[j] < 0:        # no row below
                    continue
                sq = norm[rows, None] ** 2
                inner = np.sqrt(np.maximum(sq + node.least[j] ** 2 - 2 * high[rows], 0))
                outer = np.sqrt(np.maximum(sq + node.most[j] ** 2 - 2 * low[rows], -1e-9) + 1e-9)
                # what the ranges leave of the distances between the query and the rows below j
                least = np.maximum(np.maximum(gaps - node.high[:, j], node.low[:, j] - gaps), 0).max(axis=1)
                most = (gaps + node.high[:, j]).min(axis=1)
                slack = 1e-6 * (1 + norm[rows] + node.most[j])
                meets = (least[:, None] <= outer + slack[:, None]) & (most[:, None] >= inner - slack[:, None])
                # no score exceeds the product of the norms
                meets &= low[rows] <= (norm[rows] * node.most[j])[:, None] * (1 + 1e-9) + 1
                some = (meets & (low[rows] <= high[rows])).any(axis=1)
                if some.any():
                    down(child, rows[some])
        down(self.root, np.arange(len(q)))
        return found

    def nodes(self) -> dict[tuple[int, ...], Node]:
        held, todo = {}, [self.root]
        for node in todo:
            if isinstance(node, Node):
                held[node.path] = node
                todo += node.children
        return held


def _gaps(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T, 0))


def _spread(x: np.ndarray, fanout: int, rng) -> np.ndarray:
    """Split points far from one another: each is the farthest of the rows from those before; no copies."""
    points = x[[int(rng.integers(len(x)))]]
    while len(points) < fanout:
        gap = _gaps(x, points).min(axis=1)
        if gap.max() <= 1e-6:
            break
        points = np.vstack([points, x[gap.argmax()]])
    return points


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors held as doubles."""
    if np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1] < 2 ** 53:
        return (q @ x.T).astype(np.int64)
    exact = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.clip(exact, _FLOOR, _TOP).astype(np.int64)


def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of the vectors in column ``at``."""
    sizes = np.diff(batch.column(at).offsets.to_numpy())
    for dim in np.unique(sizes):
        yield int(dim), batch.take(pa.array(np.flatnonzero(sizes == dim)))


def scaled(vec: Column, scale: int) -> Column:
    def whole(v):
        return F.greatest(F.lit(-float(_LIMIT)), F.least(F.lit(float(_LIMIT)), F.floor(v.cast("double") * scale).cast("double"))).cast("int")
    return F.transform(vec, whole)


def takes_part(id_col: str, label_col: str, vec_col: str) -> Column:
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & vec.isNotNull() & ~bad


class Index:
    """Routed and packed rows (``blocks``), the trees with their ranges, and the sample, sent to the workers."""

    def __init__(self, rows: DataFrame, sample: int, fanout: int, levels: int, block: int):
        spark = rows.sparkSession
        self.kind, self.block = dict(rows.dtypes)["id"], block
        self.total = rows.count()
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        self.sample: dict[int, tuple] = {}
        for dim in {len(r["vec"]) for r in drawn}:
            own = [r for r in drawn if len(r["vec"]) == dim]
            self.sample[dim] = ([r["id"] for r in own], [r["label"] for r in own],
                                np.array([r["vec"] for r in own], np.float64).reshape(len(own), dim))
        self.trees = {dim: Tree(x, fanout, levels) for dim, (_, _, x) in self.sample.items() if dim}
        routed = self._routed(rows)
        self._fit_ranges(routed)
        self.sent = spark.sparkContext.broadcast((self.trees, self.sample, self.counts))
        self.blocks = self._packed(routed)

    def _routed(self, rows: DataFrame) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 4096):
                for dim, part in by_length(batch, 2):
                    tree = sent.value.get(dim)
                    # a length that the sample doesn't hold has no tree, all its rows are leaf -1
                    leaf = tree.route(matrix(part.column(2), dim))[0] if tree else np.full(part.num_rows, -1)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(part.num_rows, dim, np.int32)), pa.array(leaf.astype(np.int32))],
                        [*part.schema.names, "dim", "leaf"])
        schema = ", ".join(f"{n} {k}" for n, k in rows.select("id", "label", "vec").dtypes) + ", dim int, leaf int"
        return stage(rows.select("id", "label", "vec").mapInArrow(run, schema), "gnat-routed")

    def _fit_ranges(self, routed: DataFrame) -> None:
        """Ranges of all nodes and rows of all leaves from every row: a few numbers a node and task, merged by node."""
        sent = routed.sparkSession.sparkContext.broadcast(self.trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list] = {}
            for batch in slices(batches, 4096):
                for dim, part in by_length(batch, 0):
                    tree = sent.value.get(dim)
                    if tree is None:
                        continue
                    x = matrix(part.column(0), dim)
                    norm = np.sqrt((x * x).sum(axis=1))
                    leaf, passed = tree.route(x)
                    for name, n in zip(*np.unique(leaf, return_counts=True)):
                        key = (dim, f"leaf {name}")
                        held[key] = [[held.get(key, [[0]])[0][0] + float(n)], [0.0]]
                    for node, rows, near, gaps in passed:
                        for j in np.unique(near):
                            own = gaps[near == j]
                            n_own = norm[rows[near == j]]
                            key = (dim, " ".join(map(str, (*node.path, j))))
                            low, high = [*own.min(axis=0), n_own.min()], [*own.max(axis=0), n_own.max()]
                            if key in held:
                                low, high = np.minimum(low, held[key][0]), np.maximum(high, held[key][1])
                            held[key] = [list(map(float, low)), list(map(float, high))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.string()),
                 pa.array([v[0] for v in held.values()], pa.list_(pa.float64())),
                 pa.array([v[1] for v in held.values()], pa.list_(pa.float64()))], ["dim", "place", "low", "high"])

        found = routed.select("vec").mapInArrow(run, "dim int, place string, low array<double>, high array<double>")
        flat = found.select("dim", "place", F.posexplode(F.arrays_zip("low", "high")).alias("at", "r"))
        # leaves x split points of the path: bounded by the shape of the trees
        merged = flat.groupBy("dim", "place", "at").agg(
            F.min("r.low").alias("low"), F.max("r.high").alias("high"), F.sum("r.low").alias("sum")).collect()
        self.counts: dict[tuple[int, int], int] = {}
        nodes = {dim: tree.nodes() for dim, tree in self.trees.items()}
        for r in merged:
            if r["place"].startswith("leaf"):
                self.counts[r["dim"], int(r["place"][5:])] = int(r["sum"])
                continue
            *path, j = map(int, r["place"].split())
            node = nodes[r["dim"]][tuple(path)]
            if r["at"] < len(node.points):
                node.low[r["at"], j], node.high[r["at"], j] = r["low"], r["high"]
            else:
                node.least[j], node.most[j] = r["low"], r["high"]

    def _packed(self, routed: DataFrame) -> DataFrame:
        """(dim, leaf, part, ids, labels, vecs), one row a block; a hash of the id deals rows to the blocks of a leaf."""
        spark = routed.sparkSession
        sizes = [(dim, leaf, -(-n // self.block)) for (dim, leaf), n in self.counts.items()]     # one row a leaf
        known = F.broadcast(spark.createDataFrame(sizes, "dim int, leaf int, _blocks long"))
        block = F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(max(-(-self.total // self.block), 1))))
        packed = routed.join(known, ["dim", "leaf"], "left").withColumn("_block", block).groupBy("dim", "leaf", "_block").agg(
            F.collect_list("id").alias("ids"), F.collect_list("label").alias("labels"), F.collect_list("vec").alias("vecs"))
        part = F.floor(F.col("_block") / PART_BLOCKS).cast("int").alias("part")
        return stage(packed.select("dim", "leaf", part, "ids", "labels", "vecs"), "gnat-index")

    def search(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """(query_id, window, rank, id, score): for each window of scores [lows[w], highs[w]] of each row of ``queries``
        (id, label, vec, lows, highs) its ``k`` best rows of the same label, or of others; never the row's own id."""
        sent, kind = self.sent, self.kind
        label_kind, total, block = dict(queries.dtypes)["label"], self.total, self.block

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, _, counts = sent.value
            for batch in slices(batches, QUERY_BLOCK):
                for dim, part in by_length(batch, 2):
                    windows = len(part.column(3)[0])
                    low, high = matrix(part.column(3), windows), matrix(part.column(4), windows)
                    tree = trees.get(dim)
                    q = matrix(part.column(2), dim)
                    for leaf, rows in tree.visits(q, low, high) if tree else [(-1, np.arange(part.num_rows))]:
                        if tree and (dim, leaf) not in counts:
                            continue
                        some = part.take(pa.array(rows))
                        ends = pa.array([0, some.num_rows], pa.int32())
                        lists = [pa.ListArray.from_arrays(ends, c) for c in some.columns]
                        # a leaf without a tree may have as many parts as the whole table
                        blocks = -(-counts.get((dim, leaf), total) // block)
                        for at in range(-(-blocks // PART_BLOCKS)):
                            place = [pa.array([v], pa.int32()) for v in (dim, leaf, at)]
                            yield pa.RecordBatch.from_arrays([*place, *lists], names)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                dim = batch.column(0)[0].as_py()
                ids, labels, own, q_labels = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2, 4, 5))
                x, q = (matrix(batch.column(c).flatten(), dim) for c in (3, 6))
                low, high = (np.array(batch.column(c).flatten().to_pylist(), np.int64).reshape(len(q), -1) for c in (7, 8))
                score = inner(q, x)
                able = (q_labels[:, None] == labels) == same_label
                able &= own[:, None] != ids
                out = []
                for w in range(low.shape[1]):
                    inside = able & (score >= low[:, [w]]) & (score <= high[:, [w]])
                    for i in np.flatnonzero(inside.any(axis=1)):
                        some = np.flatnonzero(inside[i])
                        some = some[np.lexsort((ids[some], -score[i, some]))[:k]]
                        out.append((i, w, some))
                if out:
                    i, w = (np.repeat([o[c] for o in out], [len(o[2]) for o in out]) for c in (0, 1))
                    some = np.concatenate([o[2] for o in out])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[i]), pa.array(w.astype(np.int32)), pa.array(ids[some]), pa.array(score[i, some])],
                        ["query_id", "window", "id", "score"])

        names = ["dim", "leaf", "part", "q_ids", "q_labels", "q_vecs", "lows", "highs"]
        visits = queries.select("id", "label", "vec", "lows", "highs").mapInArrow(
            walk, f"dim int, leaf int, part int, q_ids array<{kind}>, q_labels array<{label_kind}>, q_vecs array<array<int>>, "
                  "lows array<array<long>>, highs array<array<long>>")
        met = self.blocks.join(stage(visits, "gnat-visits"), ["dim", "leaf", "part"]).select(
            "dim", "ids", "labels", "vecs", "q_ids", "q_labels", "q_vecs", "lows", "highs")
        hits = met.mapInArrow(compare, f"query_id {kind}, window int, id {kind}, score long")
        best = Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _kth(scores: np.ndarray, k: int) -> int:
    """A score that the ``k``-th best can't be below; none if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else _FLOOR


def bounded(queries: DataFrame, index: Index, k: int, same_label: bool) -> DataFrame:
    """``queries`` (id, label, vec, lows, highs) with their lows raised to the ``k``-th best score of each window
    within the sample."""
    sent = index.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sent.value[1]
        for batch in slices(batches, QUERY_BLOCK):
            rows = batch.to_pylist()
            for dim, part in by_length(batch, 2):
                at = [i for i, r in enumerate(rows) if len(r["vec"]) == dim]
                ids, labels, x = sample.get(dim, ([], [], np.zeros((0, dim))))
                scores = inner(matrix(part.column(2), dim), x)
                ids, labels = np.array(ids), np.array(labels)
                for i, s in zip(at, scores):
                    r = rows[i]
                    able = s[((labels == r["label"]) == same_label) & (ids != r["id"])] if len(ids) else s
                    r["lows"] = [max(lo, _kth(able[(able >= lo) & (able <= hi)], k)) for lo, hi in zip(r["lows"], r["highs"])]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    schema = ", ".join(f"{n} {t}" for n, t in queries.dtypes)
    return queries.mapInArrow(run, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
                   scale: int = SCALE, sample: int = SAMPLE, fanout: int = FANOUT, levels: int = LEVELS,
                   block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor``
    (a condition on the id column)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(takes_part(id_col, label_col, vec_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled(F.col(vec_col), scale).alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"), F.first("asks").alias("asks")).select(
        "id", "r.label", "r.vec", "asks")
    rows = stage(rows, "gnat-rows")
    index = Index(rows, sample, fanout, levels, block)
    asking = rows.where("asks").drop("asks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    first = asking.withColumn("lows", F.array(F.lit(_FLOOR).cast("long"))).withColumn("highs", F.array(F.lit(_TOP).cast("long")))
    found = index.search(bounded(first.repartition(parts, "id"), index, positives, True), positives, True)
    pairs = stage(found.select(F.col("query_id").alias("anchor_id"), (F.col("rank") - 1).alias("window"),
                               F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "gnat-positives")

    # at most ``positives`` rows an anchor
    packed = pairs.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("p"))
    lows = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.coalesce(
        F.ceil(F.get("p", w)["positive_score"] * F.lit(least).cast("decimal(20,0)") / F.lit(100)).cast("long"), F.lit(1).cast("long")))
    highs = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.coalesce(
        F.get("p", w)["positive_score"], F.lit(0).cast("long")))
    windows = asking.join(packed.withColumnRenamed("anchor_id", "id"), "id").select(
        "id", "label", "vec", lows.alias("lows"), highs.alias("highs"))
    negative = index.search(bounded(windows, index, negatives, False), negatives, False).select(
        F.col("query_id").alias("anchor_id"), "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(negative, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@query("op13_hard_negatives")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100, a seventh of the labels shifted."""
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
