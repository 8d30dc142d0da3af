"""Objective values: cross-entropy, centre separation, k-means objective, pair margin loss,
and the batch-context combination of rows."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def cross_entropy_double_softmax(scored: DataFrame, label: str = "label") -> DataFrame:
    """Per-row cross-entropy of ``softmax(cos)`` used as logits (softmax applied twice).

    ``-log softmax(p)[t] = log(sum_q exp(p_q)) - p_t`` with ``p = softmax(cos)`` and
    t = position of the row's label among the prototype ids ``qs``.
    """
    p = scored.select("id", label, "qs", V.softmax("cos").alias("p"))
    t = (F.array_position("qs", F.col(label)) - 1).cast("int")
    lse = F.log(V.vsum(F.transform("p", lambda x: F.exp(x))))
    return p.select("id", label, (lse - F.col("p")[t]).alias("loss"))


def kmeans_objective(scored: DataFrame) -> DataFrame:
    """Mean over rows of min_q of -0.5 (cos - 1)."""
    return scored.agg(F.avg(F.array_min(F.transform("cos", V.cos_to_unit))).alias("objective"))


def prototype_pairs(protos: DataFrame) -> DataFrame:
    """(qa, qb, cos) for prototype pairs qa < qb: the pair list itself is the result."""
    a = protos.select(F.col("q").alias("qa"), F.col("c").alias("ca"))
    b = protos.select(F.col("q").alias("qb"), F.col("c").alias("cb"))
    return a.join(b, F.col("qa") < F.col("qb")).select(
        "qa", "qb", V.cosine("ca", "cb").alias("cos"))


def center_separation(protos: DataFrame) -> DataFrame:
    """(sum_{i<j} cos + T) / T with T = k(k-1)/2: 0 = all opposite, 1 = orthogonal, 2 = all equal."""
    # with unit vectors u: sum_{i<j} u_i.u_j = (|sum u|^2 - k) / 2, so no pair is made
    unit = protos.select(F.posexplode(V.bind(V.norm("c"), lambda n: F.transform("c", lambda x: x / n))).alias("pos", "v"), F.lit(1).alias("_one"))
    sums = unit.groupBy("pos").agg(F.sum("v").alias("s"), F.sum("_one").alias("k"))
    d = sums.agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.max("k").alias("k"))
    t = F.col("k") * (F.col("k") - 1) / 2
    return d.select(t.cast("long").alias("n_pairs"), (((F.col("s2") - F.col("k")) / 2 + t) / t).alias("separation"))


def margin_term(cos, y, margin: float):
    """Cosine embedding loss of one pair: y = 1 -> 1 - cos, y = -1 -> max(0, cos - margin)."""
    return F.when(y == 1, F.lit(1.0) - cos).otherwise(F.greatest(F.lit(0.0), cos - F.lit(margin)))


def pair_margin_loss(pairs: DataFrame, margin: float, ratio_cls: float, ratio_model: float,
                     threshold: float = 0.2, keys: Sequence[str] = ()) -> DataFrame:
    """One row (one for each of ``keys``): n, loss_raw, loss_norm, loss (weighted sum), accuracy of the threshold classifier
    (which thresholds the second, normalised pair).

    ``pairs`` has x_1, x_2 and a 0/1 label ``y`` (0 becomes -1). The second
    term compares the layer-normalised vectors.
    """
    y = F.when(F.col("y") == 0, F.lit(-1)).otherwise(F.col("y"))
    d = pairs.select(*keys, y.alias("ypm"), V.cosine("x_1", "x_2").alias("c1"),
                     V.cosine(V.layer_norm("x_1"), V.layer_norm("x_2")).alias("c2"))
    pred = F.when(F.col("c2") < F.lit(threshold), F.lit(-1)).otherwise(F.lit(1))
    agg = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                F.avg(margin_term(F.col("c1"), F.col("ypm"), margin)).alias("loss_raw"),
                F.avg(margin_term(F.col("c2"), F.col("ypm"), margin)).alias("loss_norm"),
                F.avg(F.when(pred == F.col("ypm"), 1.0).otherwise(0.0)).alias("accuracy"))
    return agg.withColumn("loss", F.lit(ratio_cls) * F.col("loss_raw") + F.lit(ratio_model) * F.col("loss_norm"))


def batch_context(df: DataFrame, batch_key: str, vec: str = "x") -> DataFrame:
    """Each row replaced by the softmax(dot)-weighted sum of the rows of its batch.

    A batch (bounded by batch size x classes) is packed into one row; the
    weights and sums are computed there, so no pair rows are materialised.
    """
    packed = df.groupBy(batch_key).agg(F.collect_list(F.struct(F.col("id"), F.col(vec).alias("x"))).alias("_items"))
    combine = F.expr(
        "transform(_items, a -> named_struct('id', a.id, 'y', "
        "aggregate(_items, named_struct('m', CAST(NULL AS DOUBLE), 's', 0D, 'v', transform(a.x, t -> 0D)), "
        # online softmax: keep running max m, running normaliser s and weighted sum v
        "(acc, b) -> aggregate(array(aggregate(zip_with(a.x, b.x, (p, q) -> p * q), 0D, (u, w) -> u + w)), acc, "
        "(st, d) -> IF(st.m IS NULL OR d > st.m, "
        "named_struct('m', d, 's', st.s * exp(coalesce(st.m, d) - d) + 1D, "
        "'v', zip_with(st.v, b.x, (p, q) -> p * exp(coalesce(st.m, d) - d) + q)), "
        "named_struct('m', st.m, 's', st.s + exp(d - st.m), "
        "'v', zip_with(st.v, b.x, (p, q) -> p + exp(d - st.m) * q)))), "
        "st -> transform(st.v, p -> p / st.s))))")
    out = packed.select(F.explode(combine).alias("r"))
    return out.select(F.col("r.id").alias("id"), F.col("r.y").alias("y"))
