"""Vector functions, objective values and the pair-model evaluation."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import assign, prep
from tessera.operators.objectives import (batch_context, center_separation, cross_entropy_double_softmax,
                                          kmeans_objective, pair_margin_loss, prototype_pairs)
from tessera.plans import sqlparts as S
from tessera.plans.q_core import BASE, scored_vectors
from tessera.plans.registry import query
from tessera.sources import tables

# fixed values: pair threshold and margin of the pair model, loss weights
PAIR_THRESHOLD = 0.2
MARGIN = 0.2
RATIO_CLS = 0.5
RATIO_MODEL = 0.5
BATCH_SIZE = 4

LONG = "unnest(x) AS v, CAST(unnest(range(len(x))) AS INTEGER) AS pos"
SCORES = BASE + [f"sc AS (SELECT v.id, v.label, p.q, {S.cos('v.x', 'p.c')} AS cs FROM vecs v CROSS JOIN protos p)"]
PAIRS = (f"{S.VECS}, pr AS (SELECT a.id // 2 AS pair_id, a.x AS x_1, b.x AS x_2, "
         "CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS y FROM vecs a JOIN vecs b "
         "ON b.id = a.id + 1 WHERE a.id % 2 = 0)")


def _ln_sql(a: str) -> str:
    mean = f"(list_sum({a}) / len({a}))"
    var = f"(list_sum(list_transform({a}, lambda t: (t - {mean}) * (t - {mean}))) / len({a}))"
    return f"list_transform({a}, lambda t: (t - {mean}) / sqrt({var} + 1e-5))"


def _long(df, key, vec, out="value"):
    return df.select(*key, F.posexplode(vec).alias("pos", out))


@query("vec_max_pool", f"WITH {S.VECS} SELECT {S.page()} AS page, pos, round(max(v), 6) AS value FROM "
       f"(SELECT id, {LONG} FROM vecs) GROUP BY page, pos")
def vec_max_pool(spark, sf_dir):
    """element-wise max over the paragraphs of each page."""
    pv = tables.page_vectors(spark, sf_dir)
    return _long(assign.max_vectors(pv, ["page"], "x"), ["page"], "c")


@query("vec_mean_pool", f"WITH {S.VECS} SELECT {S.page()} AS page, pos, round(avg(v), 6) AS value FROM "
       f"(SELECT id, {LONG} FROM vecs) GROUP BY page, pos")
def vec_mean_pool(spark, sf_dir):
    """element-wise mean over the paragraphs of each page (every row counts)."""
    pv = tables.page_vectors(spark, sf_dir)
    return _long(assign.mean_vectors(pv, ["page"], "x"), ["page"], "c")


@query("vec_arith", f"WITH {PAIRS} SELECT pair_id, CAST(p AS INTEGER) AS pos, round(x_1[p + 1] + x_2[p + 1], 6) AS sum, "
       "round(x_1[p + 1] - x_2[p + 1], 6) AS diff, round((x_1[p + 1] + x_2[p + 1]) / 2, 6) AS half "
       "FROM pr, (SELECT unnest(range(64)) AS p) WHERE p < len(x_1)")
def vec_arith(spark, sf_dir):
    """vector add, subtract and halve on pairs."""
    p = tables.pairs(spark, sf_dir)
    s = V.vadd("x_1", "x_2")
    d = p.select("pair_id", s.alias("s"), V.vsub("x_1", "x_2").alias("d"), V.vscale(s, 0.5).alias("h"))
    z = d.select("pair_id", F.posexplode(F.arrays_zip("s", "d", "h")).alias("pos", "t"))
    return z.select("pair_id", "pos", F.col("t.s").alias("sum"), F.col("t.d").alias("diff"), F.col("t.h").alias("half"))


@query("context_difference", f"WITH {PAIRS}, pm AS ({S.mean_vectors(f'(SELECT {S.page()} AS page, x FROM vecs)', 'page')}) "
       "SELECT pair_id, CAST(p AS INTEGER) AS pos, round(x_1[p + 1] + (pm.c[p + 1] - x_2[p + 1]), 6) AS v_1, "
       f"round(x_2[p + 1] + (pm.c[p + 1] - x_1[p + 1]), 6) AS v_2 FROM pr JOIN pm ON pm.page = {S.page('(pr.pair_id * 2)')}, "
       "(SELECT unnest(range(64)) AS p) WHERE p < len(x_1)")
def context_difference(spark, sf_dir):
    """v1 + (v_all - v2) and v2 + (v_all - v1); v_all = mean vector of the page of the pair."""
    p = tables.pairs(spark, sf_dir).withColumn("page", tables.page_of("id_1"))
    pm = assign.mean_vectors(tables.page_vectors(spark, sf_dir), ["page"], "x", "v_all")
    j = p.join(pm, "page")
    a, b = V.context_difference("x_1", "x_2", "v_all")
    z = j.select("pair_id", F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("pos", "t"))
    return z.select("pair_id", "pos", F.col("t.a").alias("v_1"), F.col("t.b").alias("v_2"))


@query("vec_linear_tanh", S.with_ctes([S.VECS, S.class_mean_protos()],
       "SELECT v.id, p.q, round(tanh(list_dot_product(v.x, p.c)), 6) AS value FROM vecs v CROSS JOIN protos p"))
def vec_linear_tanh(spark, sf_dir):
    """affine map (weights = class-mean prototype matrix, bias 0) followed by tanh."""
    v = tables.vectors(spark, sf_dir)
    long = assign.affine_scores(v, assign.class_mean_prototypes(v)).select("id", F.explode("dots").alias("t"))
    return long.select("id", F.col("t.q").alias("q"), F.tanh("t.dot").alias("value"))


@query("vec_layer_norm", f"WITH {S.VECS}, ln AS (SELECT id, {_ln_sql('x')} AS y FROM vecs) "
       "SELECT id, CAST(unnest(range(len(y))) AS INTEGER) AS pos, round(unnest(y), 6) AS value FROM ln")
def vec_layer_norm(spark, sf_dir):
    """layer normalisation of every vector (biased variance, eps 1e-5)."""
    v = tables.vectors(spark, sf_dir)
    return _long(v.select("id", V.layer_norm("x").alias("y")), ["id"], "y")


@query("pair_cosine", f"WITH {PAIRS} SELECT pair_id, {S.r6(S.cos('x_1', 'x_2'), 'cos')} FROM pr")
def pair_cosine(spark, sf_dir):
    """F16: cosine similarity of each pair."""
    return tables.pairs(spark, sf_dir).select("pair_id", V.cosine("x_1", "x_2").alias("cos"))


@query("pair_threshold", f"WITH {PAIRS} SELECT pair_id, CASE WHEN {S.cos('x_1', 'x_2')} < {PAIR_THRESHOLD} "
       "THEN -1 ELSE 1 END AS pred FROM pr")
def pair_threshold(spark, sf_dir):
    """P10: similarity below 0.2 -> -1, else 1."""
    p = tables.pairs(spark, sf_dir)
    return p.select("pair_id", F.when(V.cosine("x_1", "x_2") < PAIR_THRESHOLD, -1).otherwise(1).alias("pred"))


_PM = (f"{PAIRS}, pc AS (SELECT pair_id, y, {S.cos('x_1', 'x_2')} AS c1, "
       f"{S.cos(_ln_sql('x_1'), _ln_sql('x_2'))} AS c2 FROM pr), "
       f"pl AS (SELECT avg(CASE WHEN y = 1 THEN 1 - c1 ELSE greatest(0.0, c1 - {MARGIN}) END) AS loss_raw, "
       f"avg(CASE WHEN y = 1 THEN 1 - c2 ELSE greatest(0.0, c2 - {MARGIN}) END) AS loss_norm, "
       f"avg(CASE WHEN (CASE WHEN c2 < {PAIR_THRESHOLD} THEN -1 ELSE 1 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy, "
       "count(*) AS n FROM pc)")


@query("pair_margin_loss", f"WITH {_PM} SELECT {S.r6('loss_raw', 'loss_raw')}, {S.r6('loss_norm', 'loss_norm')}, "
       f"{S.r6(f'{RATIO_CLS} * loss_raw + {RATIO_MODEL} * loss_norm', 'loss')} FROM pl")
def pair_margin_loss_q(spark, sf_dir):
    """Cosine margin loss (margin 0.2) on raw and layer-normed pairs, weighted sum."""
    return pair_margin_loss(tables.pairs(spark, sf_dir), MARGIN, RATIO_CLS, RATIO_MODEL).select(
        "loss_raw", "loss_norm", "loss")


@query("pair_accuracy", f"WITH {_PM} SELECT n, {S.r6('accuracy', 'accuracy')} FROM pl")
def pair_accuracy(spark, sf_dir):
    """Share of pairs where the threshold classifier equals the +-1 label."""
    return pair_margin_loss(tables.pairs(spark, sf_dir), MARGIN, RATIO_CLS, RATIO_MODEL,
                            PAIR_THRESHOLD).select("n", "accuracy")


@query("evaluate_pairs", f"WITH {_PM}, bl AS (SELECT avg({RATIO_CLS} * CASE WHEN y = 1 THEN 1 - c1 ELSE greatest(0.0, c1 - {MARGIN}) END "
       f"+ {RATIO_MODEL} * CASE WHEN y = 1 THEN 1 - c2 ELSE greatest(0.0, c2 - {MARGIN}) END) AS l FROM pc GROUP BY pair_id // {BATCH_SIZE}) "
       f"SELECT n, (SELECT round(avg(l), 6) FROM bl) AS loss, {S.r6('accuracy', 'accuracy')} FROM pl")
def evaluate_pairs(spark, sf_dir):
    """K7: pair-model evaluation: mean over batches of the batch's mean margin loss, and threshold accuracy."""
    pairs = tables.pairs(spark, sf_dir).withColumn("batch", F.floor(F.col("pair_id") / BATCH_SIZE))
    per = pair_margin_loss(pairs, MARGIN, RATIO_CLS, RATIO_MODEL, PAIR_THRESHOLD, keys=["batch"])
    return per.agg(F.sum("n").alias("n"), F.avg("loss").alias("loss"),
                   (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"))


_SM = ("sm AS (SELECT id, label, q, e / sum(e) OVER (PARTITION BY id) AS p FROM "
       "(SELECT id, label, q, exp(cs - max(cs) OVER (PARTITION BY id)) AS e FROM sc))")


@query("softmax_rows", S.with_ctes(SCORES + [_SM], "SELECT id, q, round(p, 6) AS p FROM sm"))
def softmax_rows(spark, sf_dir):
    """softmax over the k cosines of each row."""
    s = scored_vectors(spark, sf_dir).select("id", "qs", V.softmax("cos").alias("p"))
    return s.select("id", F.explode(F.arrays_zip("qs", "p")).alias("t")).select(
        "id", F.col("t.qs").alias("q"), F.col("t.p").alias("p"))


@query("softmax_articles", S.with_ctes(SCORES + [_SM], f"SELECT {S.page()} AS page, {S.para()} AS para, q, "
       "round(p, 6) AS p FROM sm"))
def softmax_articles(spark, sf_dir):
    """softmax over articles (prototypes) for each paragraph, inside the row's array."""
    s = scored_vectors(spark, sf_dir)
    long = s.select(tables.page_of().alias("page"), tables.para_of().alias("para"), "qs", V.softmax("cos").alias("p"))
    return long.select("page", "para", F.explode(F.arrays_zip("qs", "p")).alias("t")).select(
        "page", "para", F.col("t.qs").alias("q"), F.col("t.p").alias("p"))


@query("cos_to_unit", S.with_ctes(SCORES, "SELECT id, q, round(-0.5 * (cs - 1), 6) AS dist FROM sc"))
def cos_to_unit(spark, sf_dir):
    """cosine -> [0, 1] distance, -0.5 (x - 1)."""
    s = scored_vectors(spark, sf_dir).select("id", "qs", F.transform("cos", V.cos_to_unit).alias("d"))
    return s.select("id", F.explode(F.arrays_zip("qs", "d")).alias("t")).select(
        "id", F.col("t.qs").alias("q"), F.col("t.d").alias("dist"))


@query("kmeans_objective", S.with_ctes(SCORES, "SELECT round(avg(m), 6) AS objective FROM "
       "(SELECT id, min(-0.5 * (cs - 1)) AS m FROM sc GROUP BY id)"))
def kmeans_objective_q(spark, sf_dir):
    """Mean over rows of the smallest mapped distance to a prototype."""
    return kmeans_objective(scored_vectors(spark, sf_dir))


_PP = [S.VECS, S.class_mean_protos(),
       f"pp AS (SELECT a.q AS qa, b.q AS qb, {S.cos('a.c', 'b.c')} AS cos FROM protos a JOIN protos b ON a.q < b.q)"]


@query("prototype_pairs", S.with_ctes(_PP, "SELECT qa, qb, round(cos, 6) AS cos FROM pp"))
def prototype_pairs_q(spark, sf_dir):
    """Prototype pairs i < j with their cosine."""
    return prototype_pairs(assign.class_mean_prototypes(tables.vectors(spark, sf_dir)))


@query("center_separation", S.with_ctes(_PP, "SELECT count(*) AS n_pairs, "
       "round((sum(cos) + count(*)) / count(*), 6) AS separation FROM pp"))
def center_separation_q(spark, sf_dir):
    """(sum of pairwise prototype cosines + T) / T, T = k(k-1)/2."""
    return center_separation(assign.class_mean_prototypes(tables.vectors(spark, sf_dir)))


_CE = SCORES + [_SM, "ce AS (SELECT id, any_value(label) AS label, ln(sum(exp(p))) - sum(CASE WHEN q = label THEN p END) "
                "AS loss FROM sm GROUP BY id)"]


@query("cross_entropy", S.with_ctes(_CE, "SELECT round(avg(loss), 6) AS cross_entropy FROM ce"))
def cross_entropy(spark, sf_dir):
    """Cross-entropy applied to already soft-maxed scores (softmax twice)."""
    return cross_entropy_double_softmax(scored_vectors(spark, sf_dir)).agg(
        F.avg("loss").alias("cross_entropy"))


@query("total_objective", S.with_ctes(_CE + _PP[2:], "SELECT round(c.ce, 6) AS cross_entropy, "
       "round(s.sep, 6) AS separation, round(c.ce + s.sep, 6) AS total FROM (SELECT avg(loss) AS ce FROM ce) c, "
       "(SELECT (sum(cos) + count(*)) / count(*) AS sep FROM pp) s"))
def total_objective(spark, sf_dir):
    """Cross-entropy + centre separation."""
    v = tables.vectors(spark, sf_dir)
    protos = assign.class_mean_prototypes(v)
    ce = cross_entropy_double_softmax(assign.assign_to_prototypes(v, protos)).agg(F.avg("loss").alias("cross_entropy"))
    sep = center_separation(protos).select("separation")
    return ce.crossJoin(sep).withColumn("total", F.col("cross_entropy") + F.col("separation"))


_HEADB = ("hb AS (SELECT id, label, CAST(floor((rn - 1) / 4) AS BIGINT) AS batch_id FROM "
          "(SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM vecs))")


@query("loss_batch_mean", S.with_ctes(_CE + [_HEADB], "SELECT count(*) AS n_batches, round(avg(bl), 6) AS loss_batch_mean "
       "FROM (SELECT hb.batch_id, avg(ce.loss) AS bl FROM ce JOIN hb ON hb.id = ce.id GROUP BY hb.batch_id)"))
def loss_batch_mean(spark, sf_dir):
    """Mean of per-batch mean losses over balanced batches (4 samples per batch)."""
    v = tables.vectors(spark, sf_dir)
    ce = cross_entropy_double_softmax(assign.assign_to_prototypes(v, assign.class_mean_prototypes(v)))
    b = prep.batches(v.select("id", "label"), "label", "id", BATCH_SIZE).select("id", "batch_id")
    per = ce.join(b, "id").groupBy("batch_id").agg(F.avg("loss").alias("bl"))
    return per.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("bl").alias("loss_batch_mean"))


@query("batch_context", S.with_ctes([S.VECS, _HEADB,
       "bx AS (SELECT hb.id, hb.batch_id, v.x FROM hb JOIN vecs v ON v.id = hb.id)",
       "att AS (SELECT a.id AS i, list_dot_product(a.x, b.x) AS d, b.x AS xj FROM bx a JOIN bx b ON a.batch_id = b.batch_id)",
       "wt AS (SELECT i, xj, e / sum(e) OVER (PARTITION BY i) AS w FROM "
       "(SELECT i, xj, exp(d - max(d) OVER (PARTITION BY i)) AS e FROM att))"],
       "SELECT i AS id, CAST(pos AS INTEGER) AS pos, round(sum(w * xv), 6) AS value FROM "
       "(SELECT i, w, unnest(xj) AS xv, unnest(range(len(xj))) AS pos FROM wt) GROUP BY i, pos"))
def batch_context_q(spark, sf_dir):
    """Rows of a batch combined by softmax(dot) weights (long form id, pos, value)."""
    v = tables.vectors(spark, sf_dir)
    b = prep.batches(v.select("id", "label"), "label", "id", BATCH_SIZE).select("id", "batch_id")
    return _long(batch_context(v.join(b, "id"), "batch_id"), ["id"], "y")
