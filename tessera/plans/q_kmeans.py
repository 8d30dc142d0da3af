"""K-means queries (global and per batch), the k-means benchmark, and model-based fits."""
from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import assign, kmeans, metrics, prep, training
from tessera.plans import sqlparts as S
from tessera.plans.q_vectors import _SM, SCORES
from tessera.plans.registry import query
from tessera.sources import tables

# fixed values: k-means run of the baseline re-aimed to the vector table
K = 10
# steps of the unrolled oracle, past the point where nothing moves at sf0.01
STEPS = 24
BATCH_STEPS = 8
BATCH_SIZE = 4


def _lloyd_sql(src: str, keys: str, k: int, steps: int) -> list[str]:
    """CTEs c0..c{steps} of centroids (keys..., q, c) and a{steps} final assignment (keys..., id, label, q, d)."""
    kk = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    on = " AND ".join(f"c.{x.strip()} = v.{x.strip()}" for x in keys.split(",")) if keys else "TRUE"
    ctes = [f"c0 AS (SELECT {kk}q, c FROM (SELECT {kk}row_number() OVER ({part}ORDER BY id) - 1 AS q, x AS c "
            f"FROM {src}) WHERE q < {k})"]

    def assign_cte(name, cents):
        return (f"{name} AS (SELECT {', '.join('v.' + x.strip() for x in keys.split(',')) + ', ' if keys else ''}"
                f"v.id, v.label, v.x, c.q, list_distance(v.x, c.c) AS d FROM {src} v JOIN {cents} c ON {on} "
                f"QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.x, c.c), c.q) = 1)")
    for s in range(1, steps + 1):
        ctes.append(assign_cte(f"a{s}", f"c{s - 1}"))
        grp = f"{kk}q"
        ctes.append(f"m{s} AS ({S.mean_vectors(f'a{s}', grp)})")
        join_on = " AND ".join([f"p.{x.strip()} = n.{x.strip()}" for x in keys.split(",")] if keys else [])
        join_on = (join_on + " AND " if join_on else "") + "p.q = n.q"
        ctes.append(f"c{s} AS (SELECT {', '.join('p.' + x.strip() for x in keys.split(',')) + ', ' if keys else ''}"
                    f"p.q, coalesce(n.c, p.c) AS c FROM c{s - 1} p LEFT JOIN m{s} n ON {join_on})")
    ctes.append(assign_cte("fin", f"c{steps}"))
    return ctes


def _vecs_batched(spark, sf_dir):
    v = tables.vectors(spark, sf_dir)
    b = prep.batches(v.select("id", "label"), "label", "id", BATCH_SIZE).select("id", "batch_id")
    return v.join(b, "id")


_HB = ("vb AS (SELECT v.id, v.label, v.x, CAST(floor((rn - 1) / 4) AS BIGINT) AS batch_id FROM "
       "(SELECT id, label, x, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM vecs) v)")


@query("kmeans_lloyd", S.with_ctes([S.VECS] + _lloyd_sql("vecs", "", K, STEPS),
       "SELECT q, count(*) AS size, round(sum(d * d), 6) AS inertia FROM fin GROUP BY q"))
def kmeans_lloyd(spark, sf_dir):
    """K1: deterministic Lloyd k-means (k = 10, init = 10 lowest ids, to convergence): cluster sizes and inertia."""
    v = tables.vectors(spark, sf_dir)
    cents = assign.kmeans_lloyd(v, K)
    a = assign.lloyd_assign(v, cents)
    return a.groupBy(F.col("pred").alias("q")).agg(F.count(F.lit(1)).alias("size"), F.sum("min_dist").alias("inertia"))


@query("kmeans_parallel")
def kmeans_parallel(spark, sf_dir, seed: int = 1):
    """K1/K3: k-means from a k-means|| start, to convergence: cluster sizes and inertia, steps of the fit."""
    v = kmeans.written(tables.vectors(spark, sf_dir), ["id", "x"])
    fit = kmeans.lloyd(v, kmeans.parallel_start(v, K, seed, rows=v), rows=v)
    cents = spark.createDataFrame([(q, c.tolist()) for q, c in enumerate(fit.centroids)], "q int, c array<double>")
    a = assign.lloyd_assign(v, cents).groupBy(F.col("pred").alias("q")).agg(
        F.count(F.lit(1)).alias("size"), F.sum("min_dist").alias("inertia"))
    return a.withColumn("steps", F.lit(fit.steps)).withColumn("converged", F.lit(fit.converged))


@query("kmeans_per_batch", S.with_ctes([S.VECS, _HB] + _lloyd_sql("vb", "batch_id", K, BATCH_STEPS),
       "SELECT batch_id, q, count(*) AS size FROM fin GROUP BY batch_id, q"))
def kmeans_per_batch(spark, sf_dir):
    """K2: k-means re-fitted on every batch; all batches in one shuffle."""
    a = assign.kmeans_in_groups(_vecs_batched(spark, sf_dir), K, "batch_id")
    return a.groupBy("batch_id", F.col("pred").alias("q")).agg(F.count(F.lit(1)).alias("size"))


@query("kmeans_benchmark", S.with_ctes(
    [S.VECS, _HB] + _lloyd_sql("vb", "batch_id", K, BATCH_STEPS)
    + ["bcont AS (SELECT batch_id AS g, q AS pred, label, count(*) AS n_ij FROM fin GROUP BY batch_id, q, label)"]
    + S.dp_best("(SELECT g, pred AS r, label AS c, n_ij AS v FROM bcont)") + S.agreement("bcont"),
    "SELECT count(*) AS n_batches, round(avg(b.best / s.n), 6) AS acc_batch_mean, round(avg(s.ari), 6) AS ari_batch_mean, "
    "round(avg(s.nmi), 6) AS nmi_batch_mean FROM s_scores s JOIN m_best b ON b.g = s.g", recursive=True))
def kmeans_benchmark(spark, sf_dir):
    """K3: per-batch k-means, then ACC / ARI / NMI per batch and their means."""
    a = assign.kmeans_in_groups(_vecs_batched(spark, sf_dir), K, "batch_id").select("batch_id", "pred", "label")
    rep = metrics.clustering_report(a, ["batch_id"])
    return metrics.batch_mean(rep, ["acc", "ari", "nmi"])


@query("kmeans_ml")
def kmeans_ml(spark, sf_dir):
    """K1 (library): pyspark.ml KMeans on the whole table, then the clustering report."""
    v = tables.vectors(spark, sf_dir).withColumn("features", array_to_vector("x"))
    model = KMeans(k=K, seed=42, maxIter=20, featuresCol="features", predictionCol="pred").fit(v)
    return metrics.clustering_report(model.transform(v).select("pred", "label"))


@query("prototype_logreg")
def prototype_logreg(spark, sf_dir):
    """K4 (library): multinomial logistic regression as a supervised prototype fit, then the report."""
    v = tables.vectors(spark, sf_dir).withColumn("features", array_to_vector("x"))
    lr = LogisticRegression(maxIter=50, family="multinomial", labelCol="label", featuresCol="features",
                            predictionCol="pred_d")
    model = lr.fit(v)
    out = model.transform(v).select(F.col("pred_d").cast("int").alias("pred"), "label")
    return metrics.clustering_report(out)


# fixed values: rate and epochs of the training run
RATE, EPOCHS = 0.01, 40

# e = softmax(p) - onehot, p = softmax(cos); g = p (e - p.e); the gradient's two parts, then one Adam step
_GRAD = SCORES + [
    _SM, "en AS (SELECT id, q, label, p, exp(p) / sum(exp(p)) OVER (PARTITION BY id) - CASE WHEN q = label THEN 1 ELSE 0 END AS e FROM sm)",
    "gi AS (SELECT id, q, p * (e - sum(p * e) OVER (PARTITION BY id)) AS g FROM en)",
    f"cn AS (SELECT q, c, {S.norm('c')} AS n FROM protos)",
    f"xu AS (SELECT id, x, {S.norm('x')} AS n FROM vecs)",
    "gs AS (SELECT gi.q, sum(gi.g * sc.cs) AS gs, count(*) AS rows FROM gi JOIN sc ON sc.id = gi.id AND sc.q = gi.q GROUP BY gi.q)",
    "gx AS (SELECT q, pos, sum(g * v) AS gx FROM (SELECT gi.q, gi.g, unnest(xu.x) / xu.n AS v, unnest(range(len(xu.x))) AS pos "
    "FROM gi JOIN xu ON xu.id = gi.id) GROUP BY q, pos)",
    "un AS (SELECT q, n, unnest(c) / n AS u, unnest(range(len(c))) AS pos FROM cn)",
    "us AS (SELECT pos, sum(u) AS total FROM un GROUP BY pos)",
    "cs AS (SELECT un.q, sum(un.u * us.total) - 1 AS cos_others FROM un JOIN us ON us.pos = un.pos GROUP BY un.q)",
    "kk AS (SELECT count(*) * (count(*) - 1) / 2 AS pairs FROM protos)",
    "gr AS (SELECT un.q, un.pos, (gx.gx - gs.gs * un.u) / (gs.rows * un.n) + (us.total - un.u - cs.cos_others * un.u) / un.n / kk.pairs AS g, "
    "un.u * un.n AS c FROM un JOIN gx ON gx.q = un.q AND gx.pos = un.pos JOIN gs ON gs.q = un.q JOIN us ON us.pos = un.pos "
    "JOIN cs ON cs.q = un.q CROSS JOIN kk)"]


def _class_means(v):
    """Class-mean prototypes on the driver: as many as there are classes."""
    return [(r["q"], r["c"]) for r in assign.class_mean_prototypes(v).where(F.col("q").isNotNull()).orderBy("q").collect()]


@query("prototype_gradient", S.with_ctes(_GRAD, "SELECT q, CAST(pos AS INTEGER) AS pos, round(g, 6) AS gradient FROM gr"))
def prototype_gradient(spark, sf_dir):
    """K4: gradient of cross-entropy plus separation at the class means, summed in one pass (long form)."""
    v = tables.vectors(spark, sf_dir)
    means = _class_means(v)
    rows = kmeans.written(v, ["x", "label"])
    g = training.gradient(rows, [q for q, _ in means], np.array([c for _, c in means]))[0]
    long = spark.createDataFrame([(q, row.tolist()) for (q, _), row in zip(means, g)], "q int, g array<double>")
    return long.select("q", F.posexplode("g").alias("pos", "gradient"))


@query("prototype_step", S.with_ctes(_GRAD, f"SELECT q, CAST(pos AS INTEGER) AS pos, round(c - {RATE} * g / (sqrt(g * g) + {training.ADAM_EPS}), 6) "
       "AS c FROM gr"))
def prototype_step(spark, sf_dir):
    """K4: the prototypes after one training step (Adam) from the class means (long form)."""
    v = tables.vectors(spark, sf_dir)
    means = _class_means(v)
    g = training.gradient(kmeans.written(v, ["x", "label"]), [q for q, _ in means], np.array([c for _, c in means]))[0]
    after = training.Adam(RATE).step(np.array([c for _, c in means]), g)
    moved = spark.createDataFrame([(q, row.tolist()) for (q, _), row in zip(means, after)], "q int, c array<double>")
    return moved.select("q", F.posexplode("c").alias("pos", "c"))


@query("prototype_train")
def prototype_train(spark, sf_dir):
    """K4: full-batch training of the prototypes from the class means: loss, its two parts and accuracy of each epoch."""
    v = tables.vectors(spark, sf_dir)
    _, log = training.train(v, _class_means(v), EPOCHS, RATE)
    return spark.createDataFrame([tuple(e) for e in log], "epoch int, loss double, cross_entropy double, separation double, accuracy double")
