"""Prototype fitting, cosine scoring against prototypes, and k-means.

Scoring plan: the k prototypes are packed into ONE row
``array<struct<q, c, cn>>`` (k x dim values, measured first) and broadcast;
each vector row computes its k cosines with ``transform`` and takes the
argmax in place. No shuffle, no N x k x dim long table. More prototypes than
one row may hold are scored in blocks.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.session import materialize, one_row

# bound on prototypes (k x dim doubles) held in one broadcast row
MAX_PROTOTYPE_VALUES = 8_000_000
# prototypes that are taken to the driver instead of being written and measured
SMALL_ROWS = 256


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str = "x", out: str = "c") -> DataFrame:
    """Element-wise mean of the vectors of each group.

    ``Summarizer`` is a JVM aggregate with partial aggregation: one shuffle
    carrying partitions x groups buffers of ``dim`` values.
    """
    return df.groupBy(*list(keys)).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias(out))


def max_vectors(df: DataFrame, keys: Sequence[str], vec: str = "x", out: str = "c") -> DataFrame:
    """Element-wise max of the vectors of each group (max pooling)."""
    return df.groupBy(*list(keys)).agg(
        vector_to_array(Summarizer.max(array_to_vector(F.col(vec)))).alias(out))


def class_mean_prototypes(df: DataFrame, label: str = "label", vec: str = "x") -> DataFrame:
    """Prototype q = mean vector of class q: (q, c)."""
    return mean_vectors(df.withColumnRenamed(label, "q") if label != "q" else df, ["q"], vec)


def first_id_prototypes(df: DataFrame, label: str = "label", vec: str = "x", id_col: str = "id") -> DataFrame:
    """Prototype q = the vector with the lowest id in class q (deterministic seed)."""
    firsts = df.groupBy(F.col(label).alias("q")).agg(F.min(id_col).alias("_id"))
    return df.join(firsts, df[id_col] == firsts["_id"]).select("q", F.col(vec).alias("c"))


def pack_prototypes(protos: DataFrame) -> DataFrame:
    """All (q, c) in one row ``P`` sorted by q; for tables whose size was checked."""
    return protos.agg(F.array_sort(F.collect_list(
        F.struct(F.col("q"), F.col("c"), V.norm("c").alias("cn")))).alias("P"))


def _cosines(vec: str):
    return V.bind(V.norm(vec), lambda xn: F.transform("P", lambda p: V.cosine(vec, p["c"], xn, p["cn"])))


def score_prototypes(df: DataFrame, packed: DataFrame, vec: str = "x") -> DataFrame:
    """Adds ``cos`` (k cosines ordered by q), ``qs`` (the q values) and ``pred``.

    ``pred`` is the q of the largest cosine; ties go to the lowest q.
    """
    scored = df.crossJoin(one_row(packed)).withColumn("cos", _cosines(vec))
    return scored.withColumn("qs", F.transform("P", lambda p: p["q"])) \
        .withColumn("pred", F.element_at("qs", V.argmax("cos") + 1)).drop("P")


def _packed_blocks(protos: DataFrame, blocks: int) -> DataFrame:
    return protos.withColumn("_b", F.pmod(F.xxhash64("q"), F.lit(blocks))).groupBy("_b").agg(F.array_sort(
        F.collect_list(F.struct(F.col("q"), F.col("c"), V.norm("c").alias("cn")))).alias("P")).drop("_b")


def score_in_blocks(df: DataFrame, protos: DataFrame, blocks: int, vec: str = "x") -> DataFrame:
    """``score_prototypes`` for any number of prototypes: they are dealt to ``blocks`` rows, each vector meets
    one block at a time, and the parts of a vector are put together again by its row number."""
    packed = _packed_blocks(protos, blocks)
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    part = rows.crossJoin(packed).withColumn("_cos", _cosines(vec)).select(
        *rows.columns, F.arrays_zip(F.transform("P", lambda p: p["q"]).alias("q"), F.col("_cos").alias("cos")).alias("_part"))
    whole = part.groupBy("_row").agg(*[F.first(c).alias(c) for c in df.columns],
                                     F.array_sort(F.flatten(F.collect_list("_part"))).alias("_all")).drop("_row")
    return (whole.withColumn("cos", F.transform("_all", lambda t: t["cos"])).withColumn("qs", F.transform("_all", lambda t: t["q"]))
            .withColumn("pred", F.element_at("qs", V.argmax("cos") + 1)).drop("_all"))


def nearest_in_blocks(df: DataFrame, protos: DataFrame, blocks: int, vec: str = "x") -> DataFrame:
    """``df`` with ``pred`` alone: each vector keeps one (cosine, q) a block, so that is all that is shuffled."""
    packed = _packed_blocks(protos, blocks)
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    best = F.array_max(F.zip_with(_cosines(vec), F.col("P"), lambda cos, p: F.struct(cos.alias("cos"), (-p["q"]).alias("nq"))))
    part = rows.crossJoin(packed).select(*rows.columns, best.alias("_best"))
    whole = part.groupBy("_row").agg(*[F.first(c).alias(c) for c in df.columns], F.max("_best").alias("_best")).drop("_row")
    return whole.withColumn("pred", (-F.col("_best")["nq"]).cast(dict(protos.dtypes)["q"])).drop("_best")


def small_rows(rows: DataFrame, most: int = SMALL_ROWS) -> list | None:
    """The rows if there are at most ``most`` of them; one job, bounded by the limit."""
    found = rows.limit(most + 1).collect()
    return found if len(found) <= most else None


def assign_to_prototypes(df: DataFrame, protos: DataFrame, vec: str = "x", pred_only: bool = False) -> DataFrame:
    """Score every vector against all prototypes (those without a class are no prototypes).

    Up to ``SMALL_ROWS`` prototypes come to the driver and are one broadcast row. More are written once and measured:
    up to ``MAX_PROTOTYPE_VALUES`` values they are one broadcast row too, beyond that they are scored in blocks of that
    size. ``pred_only`` leaves out ``cos`` and ``qs``.
    """
    protos = protos.where(F.col("q").isNotNull()).select("q", "c")
    few = small_rows(protos)
    if few is not None and sum(len(r["c"] or ()) for r in few) <= MAX_PROTOTYPE_VALUES:
        scored = score_prototypes(df, pack_prototypes(df.sparkSession.createDataFrame(few, protos.schema)), vec)
        return scored.drop("cos", "qs") if pred_only else scored
    protos = materialize(protos, "prototypes")
    values = protos.agg(F.sum(F.size("c"))).first()[0] or 0
    if values <= MAX_PROTOTYPE_VALUES:
        scored = score_prototypes(df, pack_prototypes(protos), vec)
        return scored.drop("cos", "qs") if pred_only else scored
    in_blocks = nearest_in_blocks if pred_only else score_in_blocks
    return in_blocks(df, protos, -(-values // MAX_PROTOTYPE_VALUES), vec)


def affine_scores(df: DataFrame, protos: DataFrame, vec: str = "x") -> DataFrame:
    """``df`` with ``dots``, the array of (q, x.c) over the prototypes that have a class: map-only, a vector meets the
    prototypes of one broadcast row, or of one block after the other when they are many (then one row a block)."""
    protos = protos.where(F.col("q").isNotNull()).select("q", "c")
    few = small_rows(protos)
    if few is not None:
        packed = pack_prototypes(df.sparkSession.createDataFrame(few, protos.schema))
    else:
        protos = materialize(protos, "prototypes")
        values = protos.agg(F.sum(F.size("c"))).first()[0] or 0
        packed = _packed_blocks(protos, max(1, -(-values // MAX_PROTOTYPE_VALUES)))
    return df.crossJoin(F.broadcast(packed) if few is not None else packed).withColumn(
        "dots", F.transform("P", lambda p: F.struct(p["q"].alias("q"), V.dot(vec, p["c"]).alias("dot")))).drop("P")


# ---- k-means (Lloyd), optionally per group --------------------------------------------

def kmeans_init_lowest_ids(df: DataFrame, k: int, keys: Sequence[str] = (), id_col: str = "id",
                           vec: str = "x") -> DataFrame:
    """Initial centroids: the k lowest ids of each group, q = 0..k-1 in id order."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(id_col)
    if not keys:
        # global: take the k smallest ids through a top-k, not a single-task window
        seeds = df.select(id_col, vec).orderBy(id_col).limit(k)
        return seeds.withColumn("q", (F.row_number().over(Window.orderBy(id_col)) - 1).cast("int")) \
            .select("q", F.col(vec).alias("c"))
    return (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .select(*keys, (F.col("_rn") - 1).cast("int").alias("q"), F.col(vec).alias("c")))


def _sqdist(a, b):
    return V.vsum(F.zip_with(F.col(a) if isinstance(a, str) else a,
                             F.col(b) if isinstance(b, str) else b, lambda x, y: (x - y) * (x - y)))


def lloyd_assign(df: DataFrame, centroids: DataFrame, keys: Sequence[str] = (), vec: str = "x") -> DataFrame:
    """Nearest centroid by squared Euclidean distance; ties to the lowest q.

    Global: centroids packed in one broadcast row. Per group: joined on the
    group keys (centroid table grows with the number of groups, so no broadcast).
    """
    keys = list(keys)
    if keys:
        packed = centroids.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("q", "c"))).alias("C"))
        j = df.join(packed, keys)
    else:
        # as many centroids as the caller's k
        packed = centroids.agg(F.array_sort(F.collect_list(F.struct("q", "c"))).alias("C"))
        j = df.crossJoin(one_row(packed))
    d = F.transform("C", lambda p: _sqdist(vec, p["c"]))
    return j.withColumn("dist", d) \
        .withColumn("pred", F.element_at(F.transform("C", lambda p: p["q"]), V.argmin("dist") + 1)) \
        .withColumn("min_dist", F.array_min("dist")).drop("C", "dist")


def lloyd_step(df: DataFrame, centroids: DataFrame, keys: Sequence[str] = (), vec: str = "x") -> DataFrame:
    """One Lloyd iteration: assign, then mean of each cluster; an empty cluster keeps its centroid."""
    keys = list(keys)
    assigned = lloyd_assign(df, centroids, keys, vec).select(*keys, F.col("pred").alias("q"), vec)
    means = mean_vectors(assigned, keys + ["q"], vec, out="c_new")
    return centroids.join(means, keys + ["q"], "left").select(
        *keys, "q", F.coalesce("c_new", "c").alias("c"))


def kmeans_lloyd(df: DataFrame, k: int, steps: int | None = None, id_col: str = "id", vec: str = "x",
                 most_steps: int | None = None) -> DataFrame:
    """(q, c): deterministic Lloyd k-means over the whole table from the k lowest ids: ``steps`` steps, or until no row
    changes its cluster (an error if ``most_steps`` steps don't get there; see ``kmeans.lloyd`` for a fit without)."""
    from tessera.operators import kmeans

    start = [r["c"] for r in kmeans_init_lowest_ids(df, k, (), id_col, vec).orderBy("q").collect()]
    fit = kmeans.lloyd(df, start, most_steps if steps is None else steps, vec)
    if steps is None and not fit.converged:
        raise RuntimeError(f"k-means still moves after {most_steps} steps")
    return df.sparkSession.createDataFrame(
        [(q, c.tolist()) for q, c in enumerate(fit.centroids)], f"q int, c {dict(df.dtypes)[vec]}")


def kmeans_in_groups(df: DataFrame, k: int, key: str, id_col: str = "id", vec: str = "x", most_steps: int = 1000) -> DataFrame:
    """``df`` with ``pred``: Lloyd k-means inside each group (a batch), from its k lowest ids until no row changes its
    cluster. One shuffle packs a group into one row; all groups of an Arrow batch are iterated together."""
    from tessera.operators import kmeans

    rest = [c for c in df.columns if c != key]
    items = F.struct(F.col(id_col).alias("_order"), *[F.col(f"`{c}`") for c in rest])
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(items)).alias("_items"))
    found = kmeans.in_groups(packed.select(key, "_items", F.transform("_items", lambda r: r[vec]).alias("_x")), k, "_x", "_pred", most_steps)
    rows = found.select(key, F.explode(F.arrays_zip("_items", "_pred")).alias("_r"))
    return rows.select(*[F.col(key) if c == key else F.col(f"_r._items.`{c}`").alias(c) for c in df.columns],
                       F.col("_r._pred").alias("pred"))
