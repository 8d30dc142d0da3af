"""Flagship: score vectors against class-mean prototypes and report agreement metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assign, metrics
from tessera.plans import sqlparts as S
from tessera.plans.registry import query
from tessera.sources import tables

BASE = [S.VECS, S.class_mean_protos(), f"pred AS ({S.nearest_by_cos('vecs')})"]


def scored_vectors(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    protos = assign.class_mean_prototypes(v)
    return assign.assign_to_prototypes(v, protos)


def evaluate_clustering_df(spark, sf_dir, matching=True):
    scored = scored_vectors(spark, sf_dir)
    return metrics.clustering_report(scored.select("pred", "label"), matching=matching)


REPORT_SQL = S.with_ctes(
    BASE + ["cont AS (SELECT 0 AS g, pred, label, count(*) AS n_ij FROM pred GROUP BY pred, label)"]
    + S.dp_best("(SELECT g, pred AS r, label AS c, n_ij AS v FROM cont)") + S.agreement("cont"),
    S.report_select(), recursive=True)


@query("evaluate_clustering", REPORT_SQL)
def evaluate_clustering(spark, sf_dir):
    """K6: fit class-mean prototypes, assign by cosine argmax, report ACC/ARI/NMI/accuracy/micro P,R,F1."""
    return evaluate_clustering_df(spark, sf_dir)


@query("metrics_report", REPORT_SQL)
def metrics_report(spark, sf_dir):
    """The pooled metrics report as a one-row table."""
    return evaluate_clustering_df(spark, sf_dir)


@query("prototype_fit", S.with_ctes(
    [S.VECS, S.class_mean_protos()],
    "SELECT q, CAST(pos AS INTEGER) AS pos, round(c[pos + 1], 6) AS c FROM protos, "
    "(SELECT unnest(range(64)) AS pos) WHERE pos < len(c)"))
def prototype_fit(spark, sf_dir):
    """K4: prototype q = mean vector of class q (long form q, pos, value)."""
    p = assign.class_mean_prototypes(tables.vectors(spark, sf_dir))
    return p.select("q", F.posexplode("c").alias("pos", "c"))


@query("cosine_to_prototypes", S.with_ctes(
    [S.VECS, S.class_mean_protos()],
    f"SELECT v.id, p.q, {S.r6(S.cos('v.x', 'p.c'), 'cos')} FROM vecs v CROSS JOIN protos p"))
def cosine_to_prototypes(spark, sf_dir):
    """Cosine of every row with every prototype (long form id, q, cos)."""
    s = scored_vectors(spark, sf_dir)
    return s.select("id", F.explode(F.arrays_zip("qs", "cos")).alias("t")) \
        .select("id", F.col("t.qs").alias("q"), F.col("t.cos").alias("cos"))


@query("assign_argmax", S.with_ctes(BASE, "SELECT id, label, pred FROM pred"))
def assign_argmax(spark, sf_dir):
    """Argmax over the k cosines, ties to the lowest prototype."""
    return scored_vectors(spark, sf_dir).select("id", "label", "pred")


@query("contingency", S.with_ctes(BASE, "SELECT pred, label, count(*) AS n_ij FROM pred GROUP BY pred, label"))
def contingency(spark, sf_dir):
    """Contingency counts of (pred, label)."""
    return metrics.contingency(scored_vectors(spark, sf_dir))


@query("contingency_matrix", S.with_ctes(
    BASE + ["cont AS (SELECT pred, label, count(*) AS n_ij FROM pred GROUP BY pred, label)",
            "d AS (SELECT pred AS k FROM cont UNION SELECT label FROM cont)"],
    "SELECT a.k AS pred, b.k AS label, coalesce(n_ij, 0) AS n_ij FROM d a CROSS JOIN d b "
    "LEFT JOIN cont ON cont.pred = a.k AND cont.label = b.k"))
def contingency_matrix(spark, sf_dir):
    """A4: the D x D matrix of counts, D = classes on either side, with its zeros."""
    return metrics.contingency_matrix(scored_vectors(spark, sf_dir))


def _metric_sql(cols: str) -> str:
    return S.with_ctes(
        BASE + ["cont AS (SELECT 0 AS g, pred, label, count(*) AS n_ij FROM pred GROUP BY pred, label)"]
        + S.dp_best("(SELECT g, pred AS r, label AS c, n_ij AS v FROM cont)") + S.agreement("cont"),
        f"SELECT {cols} FROM ({S.report_select()})", recursive=True)


@query("metric_acc", _metric_sql("n, matched, acc"))
def metric_acc(spark, sf_dir):
    """Clustering accuracy under the best relabelling."""
    return evaluate_clustering_df(spark, sf_dir).select("n", "matched", "acc")


@query("match_max_overlap", _metric_sql("matched"))
def match_max_overlap(spark, sf_dir):
    """M1: max total overlap of a one-to-one predicted/true matching."""
    return evaluate_clustering_df(spark, sf_dir).select("matched")


@query("metric_ari", _metric_sql("ari"))
def metric_ari(spark, sf_dir):
    """Adjusted Rand index."""
    return evaluate_clustering_df(spark, sf_dir, matching=False).select("ari")


@query("metric_nmi", _metric_sql("nmi"))
def metric_nmi(spark, sf_dir):
    """A10: normalised mutual information (arithmetic mean)."""
    return evaluate_clustering_df(spark, sf_dir, matching=False).select("nmi")


@query("metric_accuracy", _metric_sql("accuracy"))
def metric_accuracy(spark, sf_dir):
    """Plain accuracy without matching."""
    return evaluate_clustering_df(spark, sf_dir, matching=False).select("accuracy")


@query("metric_micro_prf", _metric_sql("precision_micro, recall_micro, f1_micro"))
def metric_micro_prf(spark, sf_dir):
    """Micro precision, recall, F1."""
    return evaluate_clustering_df(spark, sf_dir, matching=False).select("precision_micro", "recall_micro", "f1_micro")
