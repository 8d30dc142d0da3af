"""Clustering-quality metrics, all derived from one contingency ``groupBy``.

The only full-data step in any metric here is
``groupBy(keys..., pred, label).count()`` (partial aggregation before the
shuffle, so the shuffle carries at most partitions x k^2 rows). Everything
after it runs on at most k^2 rows per group. ``keys`` adds a grouping such as
``batch_id`` so that per-batch metrics of all batches come from one plan.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.large_matching import greedy_sum
from tessera.operators.matching import greedy_cell, greedy_fold, pack_cells, with_matching
from tessera.session import materialize

# overlaps of a table that one row may hold for the greedy fold
FOLD_CELLS = 10_000


def contingency(df: DataFrame, keys: Sequence[str] = (), pred: str = "pred",
                label: str = "label") -> DataFrame:
    """(keys..., pred, label, n_ij): rows with a null on either side are left out."""
    return (df.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
            .groupBy(*keys, F.col(pred).alias("pred"), F.col(label).alias("label"))
            .agg(F.count(F.lit(1)).alias("n_ij")))


def contingency_matrix(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """(pred, label, n_ij) for every pair of classes that occur on either side, zeros filled in (the matrix itself)."""
    cont = contingency(df, (), pred, label)
    classes = cont.select(F.col("pred").alias("d")).union(cont.select("label")).distinct()
    grid = classes.withColumnRenamed("d", "pred").join(classes.withColumnRenamed("d", "label"))
    return grid.join(cont, ["pred", "label"], "left").select("pred", "label", F.coalesce("n_ij", F.lit(0)).alias("n_ij"))


def packed_contingency(df: DataFrame, keys: Sequence[str] = (), pred: str = "pred",
                       label: str = "label") -> DataFrame:
    """Contingency of each group packed into one row (``_rows`` = preds, ``_cols`` = labels)."""
    return pack_cells(contingency(df, keys, pred, label), keys, "pred", "label", "n_ij")


def _stats_expr() -> str:
    """One pass over a packed contingency row: n, true sizes a (aligned with ``_cols``),
    predicted sizes b (aligned with ``_rows``), sum of squares and the diagonal."""
    return ("aggregate(_cells, named_struct('n', 0D, 'sij2', 0D, 'tp', 0D, "
            "'a', array_repeat(0D, size(_cols)), 'b', array_repeat(0D, size(_rows))), "
            "(acc, c) -> named_struct('n', acc.n + c._v, 'sij2', acc.sij2 + c._v * c._v, "
            "'tp', acc.tp + IF(c._r = c._c, c._v, 0D), "
            "'a', transform(acc.a, (x, i) -> IF(i = c._j, x + c._v, x)), "
            "'b', transform(acc.b, (x, i) -> IF(i = c._i, x + c._v, x))))")


def _info_expr() -> str:
    """Mutual information and both entropies; the sizes ride in the accumulator."""
    return ("aggregate(_cells, named_struct('mi', 0D, 'n', _st.n, 'a', _st.a, 'b', _st.b), "
            "(acc, c) -> named_struct('mi', acc.mi + c._v / acc.n * ln(acc.n * c._v / (acc.a[c._j] * acc.b[c._i])), "
            "'n', acc.n, 'a', acc.a, 'b', acc.b), "
            "acc -> named_struct('mi', acc.mi, "
            "'ht', -aggregate(acc.a, 0D, (s, x) -> s + x / acc.n * ln(x / acc.n)), "
            "'hp', -aggregate(acc.b, 0D, (s, x) -> s + x / acc.n * ln(x / acc.n)), "
            "'sa2', aggregate(acc.a, 0D, (s, x) -> s + x * x), "
            "'sb2', aggregate(acc.b, 0D, (s, x) -> s + x * x)))")


def report_from_packed(packed: DataFrame, keys: Sequence[str] = (), matching: bool = True) -> DataFrame:
    """n, matched, acc, ari, nmi, accuracy and micro P/R/F1 from packed contingency rows.

    Without ``matching`` there is no ``matched`` and ``acc``, and no Python in the plan.
    """
    keys = list(keys)
    d = with_matching(packed, "max", "matched") if matching else packed
    d = d.withColumn("_st", F.expr(_stats_expr())).withColumn("_in", F.expr(_info_expr()))
    nn = F.col("_st.n")
    sij2 = F.col("_st.sij2")
    tp = sij2 - nn
    fp = F.col("_in.sb2") - sij2
    fn = F.col("_in.sa2") - sij2
    tn = nn * nn - fp - fn - sij2
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    mi_raw = F.col("_in.mi")
    nmi = (F.when((F.size("_cols") == 1) & (F.size("_rows") == 1), F.lit(1.0))
           .when(F.abs(mi_raw) < F.lit(1e-15), F.lit(0.0))
           .otherwise(F.greatest(mi_raw, F.lit(0.0)) / ((F.col("_in.ht") + F.col("_in.hp")) / 2.0)))
    # micro averages: true positives, false positives and false negatives summed over classes
    hit = F.col("_st.tp")
    wrong_pred = V.vsum(F.col("_st.b")) - hit
    missed = V.vsum(F.col("_st.a")) - hit
    precision, recall = hit / (hit + wrong_pred), hit / (hit + missed)
    f1 = F.when(hit == 0, F.lit(0.0)).otherwise(2 * hit / (2 * hit + wrong_pred + missed))
    acc = [F.col("matched").cast("long").alias("matched"), (F.col("matched") / nn).alias("acc")] if matching else []
    return d.select(*keys, nn.cast("long").alias("n"), *acc, ari.alias("ari"), nmi.alias("nmi"),
                    (hit / nn).alias("accuracy"), precision.alias("precision_micro"),
                    recall.alias("recall_micro"), f1.alias("f1_micro"))


def clustering_report(df: DataFrame, keys: Sequence[str] = (), pred: str = "pred",
                      label: str = "label", matching: bool = True) -> DataFrame:
    """One row per group: n, matched, acc, ari, nmi, accuracy, micro P/R/F1.

    Two shuffles in total: the contingency count and the per-group packing.
    """
    return report_from_packed(packed_contingency(df, keys, pred, label), keys, matching)


def batch_mean(report: DataFrame, cols: Sequence[str], suffix: str = "_batch_mean") -> DataFrame:
    """Unweighted mean over batches of per-batch metric columns."""
    return report.agg(F.count(F.lit(1)).alias("n_batches"),
                      *[F.avg(c).alias(c + suffix) for c in cols])


# ---- greedy P / R (group-overlap matrices) -------------------------------------------

def overlap_matrices(items: DataFrame, keys: Sequence[str] = (), item: str = "item",
                     pred: str = "pred", label: str = "label") -> DataFrame:
    """Recall and precision matrices in long form.

    ``items`` has one row per item index with a nullable ``pred`` and a
    nullable ``label``. recall = overlap / size(true group),
    precision = overlap / size(predicted group). Sizes, first positions and group counts all come
    from one ``groupBy(keys, pred, label)`` with the null groups kept.
    """
    keys = list(keys)
    cells = items.groupBy(*keys, F.col(pred).alias("pred"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n_ij"), F.min(item).alias("_first"))
    by_pred, by_label, within = (Window.partitionBy(*keys, "pred"), Window.partitionBy(*keys, "label"),
                                 Window.partitionBy(*keys))
    m = (cells.withColumn("pred_size", F.sum("n_ij").over(by_pred)).withColumn("_pf", F.min("_first").over(by_pred))
         .withColumn("true_size", F.sum("n_ij").over(by_label)).withColumn("_lf", F.min("_first").over(by_label)))
    # order of first appearance among the groups that have a name
    m = (m.withColumn("pred_order", (F.dense_rank().over(within.orderBy(
            F.when(F.col("pred").isNotNull(), F.col("_pf")).asc_nulls_last())) - 1).cast("long"))
         .withColumn("label_order", (F.dense_rank().over(within.orderBy(
             F.when(F.col("label").isNotNull(), F.col("_lf")).asc_nulls_last())) - 1).cast("long")))
    return m.select(*keys, "pred", "label", "pred_order", "label_order", "n_ij", "true_size", "pred_size",
                    (F.col("n_ij") / F.col("true_size")).alias("recall"),
                    (F.col("n_ij") / F.col("pred_size")).alias("precision"))


def named_overlaps(matrices: DataFrame) -> DataFrame:
    """The cells between two named groups."""
    return matrices.where(F.col("pred").isNotNull() & F.col("label").isNotNull())


def greedy_scores(items: DataFrame, keys: Sequence[str] = (), item: str = "item", pred: str = "pred",
                  label: str = "label", sides: Sequence[str] = ("recall", "precision"), fold_cells: int = FOLD_CELLS) -> DataFrame:
    """Greedy R = greedy(recall) / #predicted groups; greedy P = greedy(precision) / #true groups.

    Everything is read off the one table of overlaps, written once; only the asked ``sides`` are matched. Without
    ``keys`` a table of more than ``fold_cells`` overlaps is matched in rounds of jobs, smaller ones and the (small) tables of
    groups are folded in one row each; both give the sequential greedy.
    """
    keys = list(keys)
    m = overlap_matrices(items, keys, item, pred, label)
    both = F.col("pred").isNotNull() & F.col("label").isNotNull()
    groups = [F.countDistinct("pred").alias("n_pred_groups"), F.countDistinct("label").alias("n_true_groups")]
    fold = True
    if not keys:
        m = materialize(m, "overlaps")
        fold = m.count() <= fold_cells
    if fold:
        packed = m.groupBy(*keys).agg(
            *groups, *[F.array_sort(F.collect_list(F.when(both, greedy_cell("pred_order", "label_order", s)))).alias(f"_{s}") for s in sides])
        out = packed.select(*keys, "n_pred_groups", "n_true_groups",
                            *[greedy_fold(f"_{s}").alias(f"greedy_{s}_sum") for s in sides])
    else:
        out = m.agg(*groups)
        for s in sides:
            out = out.crossJoin(F.broadcast(greedy_sum(m.where(both), [], "pred_order", "label_order", s, f"greedy_{s}_sum")))
    if "recall" in sides:
        out = out.withColumn("greedy_r", F.col("greedy_recall_sum") / F.col("n_pred_groups"))
    if "precision" in sides:
        out = out.withColumn("greedy_p", F.col("greedy_precision_sum") / F.col("n_true_groups"))
    return out


# ---- mergeable state -----------------------------------------------------------------

def metric_state(scored: DataFrame, part: str | None = None, losses: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """([part,] pred, label, n_ij, loss_sum): all that the pooled metrics need, a row for each pair of classes of a part.

    ``losses`` (id, loss) adds the sum of the rows' losses. States add up: see ``merge_states``.
    """
    loss = F.lit(0.0)
    if losses is not None:
        scored, loss = scored.join(losses.select(id_col, F.col("loss").alias("_loss")), id_col), F.col("_loss")
    keys = [part] if part else []
    return scored.where(F.col("pred").isNotNull() & F.col("label").isNotNull()).groupBy(*keys, "pred", "label").agg(
        F.count(F.lit(1)).alias("n_ij"), F.sum(loss).alias("loss_sum"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows from those of disjoint parts, in any order or grouping."""
    both = states[0].select("pred", "label", "n_ij", "loss_sum")
    for more in states[1:]:
        both = both.unionByName(more.select("pred", "label", "n_ij", "loss_sum"))
    return both.groupBy("pred", "label").agg(F.sum("n_ij").alias("n_ij"), F.sum("loss_sum").alias("loss_sum"))


def save_state(state: DataFrame, path: str, part: str) -> None:
    """Keep the state of some parts beside those written before; a part that is written again takes its place."""
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def report_from_state(state: DataFrame, matching: bool = True) -> DataFrame:
    """The pooled report and the mean loss from a merged state; no scan of the rows behind it."""
    report = report_from_packed(pack_cells(state, (), "pred", "label", "n_ij"), (), matching)
    return report.crossJoin(F.broadcast(state.agg((F.sum("loss_sum") / F.sum("n_ij")).alias("loss"))))
