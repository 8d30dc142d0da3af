"""Matching queries: per-page cost tables and optimal matching, greedy P/R, permutation CE,
per-batch metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import assign, metrics, pages, prep
from tessera.operators.matching import assignment_pairs, assignment_total
from tessera.plans import sqlparts as S
from tessera.plans.q_core import BASE, scored_vectors
from tessera.plans.q_vectors import _SM, SCORES
from tessera.plans.registry import query
from tessera.sources import tables

BATCH_SIZE = 4


def scored_pages(spark, sf_dir):
    s = scored_vectors(spark, sf_dir)
    return s.withColumn("page", tables.page_of()).withColumn("para", tables.para_of())


_COST = SCORES + [
    "arts AS (SELECT DISTINCT label AS j FROM vecs)",
    f"pq AS (SELECT {S.page('p.id')} AS page, pr.q, avg(CASE WHEN p.pred = pr.q THEN 1.0 ELSE 0.0 END) AS p_q "
    "FROM pred p CROSS JOIN protos pr GROUP BY page, pr.q)",
    f"tj AS (SELECT DISTINCT {S.page()} AS page, label AS j, 1.0 AS t FROM vecs)",
    f"cc AS (SELECT {S.page('s.id')} AS page, s.q, a.j, sum(abs(s.cs - CASE WHEN s.label = a.j THEN 1 ELSE -1 END)) "
    "AS match_cost FROM sc s CROSS JOIN arts a GROUP BY page, s.q, a.j)",
    "cost AS (SELECT cc.page, cc.q, cc.j, cc.match_cost, 2 * abs(pq.p_q - coalesce(tj.t, 0.0)) AS class_cost, "
    "cc.match_cost + 2 * abs(pq.p_q - coalesce(tj.t, 0.0)) AS cost FROM cc JOIN pq ON pq.page = cc.page "
    "AND pq.q = cc.q LEFT JOIN tj ON tj.page = cc.page AND tj.j = cc.j)",
]


@query("l1_cost_matrix", S.with_ctes(_COST, "SELECT page, q, j, round(match_cost, 6) AS match_cost, "
       "round(class_cost, 6) AS class_cost, round(cost, 6) AS cost FROM cost JOIN tj USING (page, j)"))
def l1_cost_matrix(spark, sf_dir):
    """Per page, L1 cost of every predicted article q against the true articles j of that page."""
    return pages.cost_table(scored_pages(spark, sf_dir)).select("page", "q", "j", "match_cost", "class_cost", "cost")


@query("match_min_cost", S.with_ctes(
    _COST + S.dp_best("(SELECT page AS g, q AS r, j AS c, cost AS v FROM cost)", "min"),
    "SELECT g AS page, round(best, 6) AS min_cost FROM m_best", recursive=True))
def match_min_cost(spark, sf_dir):
    """M2: min-cost one-to-one matching per page, cost = cosine L1 + class L1."""
    c = pages.cost_table(scored_pages(spark, sf_dir))
    return assignment_total(c, ["page"], "q", "j", "cost", mode="min", out="min_cost", pad="absent_cost")


_PCOST = SCORES + [_SM, "arts AS (SELECT DISTINCT label AS j FROM vecs)",
                   f"pq AS (SELECT {S.page('p.id')} AS page, pr.q, avg(CASE WHEN p.pred = pr.q THEN 1.0 ELSE 0.0 END) AS p_q "
                   "FROM pred p CROSS JOIN protos pr GROUP BY page, pr.q)",
                   f"tj AS (SELECT DISTINCT {S.page()} AS page, label AS j, 1.0 AS t FROM vecs)",
                   f"pc AS (SELECT {S.page('s.id')} AS page, s.q, a.j, sum(abs(s.p - CASE WHEN s.label = a.j THEN 1 ELSE 0 END)) "
                   "AS match_cost FROM sm s CROSS JOIN arts a GROUP BY page, s.q, a.j)",
                   "pcost AS (SELECT pc.page, pc.q, pc.j, pc.match_cost + 2 * abs(pq.p_q - coalesce(tj.t, 0.0)) AS cost "
                   "FROM pc JOIN pq ON pq.page = pc.page AND pq.q = pc.q LEFT JOIN tj ON tj.page = pc.page AND tj.j = pc.j)"]


@query("match_total_cost", S.with_ctes(
    _PCOST + S.dp_best("(SELECT page AS g, q AS r, j AS c, cost AS v FROM pcost)", "min"),
    "SELECT count(*) AS n_pages, round(sum(best), 6) AS total_cost FROM m_best", recursive=True))
def match_total_cost(spark, sf_dir):
    """M3: sum over pages of the min matching cost, cost = L1(label, paragraph softmax) + class L1."""
    c = pages.cost_table(scored_pages(spark, sf_dir), term="para")
    per = assignment_total(c, ["page"], "q", "j", "cost", mode="min", out="best", pad="absent_cost")
    return per.agg(F.count(F.lit(1)).alias("n_pages"), F.sum("best").alias("total_cost"))


@query("match_pairs")
def match_pairs(spark, sf_dir):
    """M4: matched (q, j) index pairs per page (ties may pick other pairs than another solver)."""
    c = pages.cost_table(scored_pages(spark, sf_dir))
    return assignment_pairs(c, ["page"], "q", "j", "cost", mode="min", pad="absent_cost")


@query("gather_matched")
def gather_matched(spark, sf_dir):
    """True-article rows gathered in matched order (paragraph count of each matched article)."""
    sp = scored_pages(spark, sf_dir)
    c = pages.cost_table(sp)
    pairs = assignment_pairs(c, ["page"], "q", "j", "cost", mode="min", pad="absent_cost").select("page", "q", "j")
    sizes = sp.groupBy("page", F.col("label").alias("j")).agg(F.count(F.lit(1)).alias("n_paras"))
    return pairs.join(sizes, ["page", "j"], "left").select("page", "q", "j", F.coalesce("n_paras", F.lit(0)).alias("n_paras"))


@query("matched_l1")
def matched_l1(spark, sf_dir):
    """Masked L1 sums (class, paragraph, cosine) after the per-page matching."""
    sp = scored_pages(spark, sf_dir)
    c = pages.cost_table(sp)
    pairs = assignment_pairs(c, ["page"], "q", "j", "cost", mode="min", pad="absent_cost", padding=True).select("page", "q", "j")
    return pages.matched_l1(c, pages.cost_table(sp, term="para"), pairs)


@query("filter_pred_article", S.with_ctes(_COST, "SELECT DISTINCT page, q, round(p_q, 6) AS p_q FROM pq "
       "WHERE p_q > 1 - p_q"))
def filter_pred_article(spark, sf_dir):
    """Rows whose article score beats the no-article score (cls[1] > cls[0])."""
    c = pages.cost_table(scored_pages(spark, sf_dir))
    return c.where(F.col("p_q") > 1 - F.col("p_q")).select("page", "q", "p_q").distinct()


_SHAPE = (f"{S.VECS}, shape AS (SELECT {S.page()} AS page, count(DISTINCT label) AS n_articles, count(*) AS n_paras "
          "FROM vecs GROUP BY ALL)")


@query("valid_prefix", f"WITH {_SHAPE}, slots AS (SELECT unnest(range({tables.MOST_PARAS})) AS para) "
       "SELECT page, para FROM shape, slots WHERE para < n_paras")
def valid_prefix(spark, sf_dir):
    """The paragraph slots of the padded block that lie inside the page."""
    return _padded(spark, sf_dir).where("valid = 1").select("page", "para")


@query("valid_mask", f"WITH {_SHAPE}, slots AS (SELECT unnest(range({tables.MOST_PARAS})) AS para) "
       "SELECT page, n_articles, n_paras, para, CASE WHEN para < n_paras THEN 1 ELSE 0 END AS valid FROM shape, slots")
def valid_mask(spark, sf_dir):
    """Mask of the padded block: 1 for the page's own paragraphs, 0 for padding."""
    return _padded(spark, sf_dir)


def _padded(spark, sf_dir):
    shape = pages.article_shape(tables.page_vectors(spark, sf_dir))
    return pages.valid_mask(shape, tables.MOST_PARAS)


# fixed value: article slots of the padded block
ARTICLE_SLOTS = 10


@query("article_weight", f"WITH {_SHAPE} SELECT page, CAST(slot AS INTEGER) AS slot, CASE WHEN slot < n_articles THEN 1.0 "
       f"ELSE 0.1 END AS weight FROM (SELECT page, n_articles, unnest(range(greatest({ARTICLE_SLOTS}, n_articles))) AS slot FROM shape)")
def article_weight(spark, sf_dir):
    """Weight 1 for a page's real articles, 0.1 for padding slots."""
    return pages.article_weights(tables.page_vectors(spark, sf_dir), ARTICLE_SLOTS)


# ---- group overlap (greedy P / R) -----------------------------------------------------

_OV = BASE + [
    "items AS (SELECT id AS item, pred, label FROM pred)",
    "ov AS (SELECT pred, label, count(*) AS n_ij FROM items GROUP BY pred, label)",
    "ts AS (SELECT label, count(*) AS true_size FROM items GROUP BY label)",
    "ps AS (SELECT pred, count(*) AS pred_size FROM items GROUP BY pred)",
    "po AS (SELECT pred, dense_rank() OVER (ORDER BY min(item)) - 1 AS ro FROM items GROUP BY pred)",
    "lo AS (SELECT label, dense_rank() OVER (ORDER BY min(item)) - 1 AS co FROM items GROUP BY label)",
    "mat AS (SELECT ov.pred, ov.label, ov.n_ij, ts.true_size, ps.pred_size, ov.n_ij / ts.true_size AS recall, "
    "ov.n_ij / ps.pred_size AS precision, po.ro, lo.co FROM ov JOIN ts USING (label) JOIN ps USING (pred) "
    "JOIN po USING (pred) JOIN lo USING (label))",
]


def _greedy_sql(val: str, name: str) -> list[str]:
    return [
        f"{name}(step, ur, uc, total) AS (SELECT 0, []::BIGINT[], []::BIGINT[], 0.0::DOUBLE "
        f"UNION ALL SELECT step + 1, list_append(ur, ro), list_append(uc, co), total + v FROM ("
        f"SELECT g.step, g.ur, g.uc, g.total, m.ro, m.co, m.{val} AS v, row_number() OVER "
        f"(ORDER BY m.{val} DESC, m.ro, m.co) AS rk FROM {name} g JOIN mat m "
        f"ON NOT list_contains(g.ur, m.ro) AND NOT list_contains(g.uc, m.co)) WHERE rk = 1)",
    ]


_GREEDY = S.with_ctes(
    _OV + _greedy_sql("recall", "gr") + _greedy_sql("precision", "gp"),
    "SELECT (SELECT count(DISTINCT pred) FROM items) AS n_pred_groups, "
    "(SELECT count(DISTINCT label) FROM items) AS n_true_groups, "
    "round((SELECT max(total) FROM gr), 6) AS greedy_recall_sum, round((SELECT max(total) FROM gp), 6) AS greedy_precision_sum, "
    "round((SELECT max(total) FROM gr) / (SELECT count(DISTINCT pred) FROM items), 6) AS greedy_r, "
    "round((SELECT max(total) FROM gp) / (SELECT count(DISTINCT label) FROM items), 6) AS greedy_p", recursive=True)


def _greedy_df(spark, sf_dir, sides=("recall", "precision")):
    items = scored_vectors(spark, sf_dir).select(F.col("id").alias("item"), "pred", "label")
    return metrics.greedy_scores(items, sides=sides)


@query("match_greedy", _GREEDY)
def match_greedy(spark, sf_dir):
    """M5: greedy matching on the recall and precision matrices, with greedy R and P."""
    return _greedy_df(spark, sf_dir)


@query("match_greedy_rounds", _GREEDY)
def match_greedy_rounds(spark, sf_dir):
    """M5/A6/A7 for any number of groups: the greedy in rounds of locally first cells, no row holds the overlaps."""
    items = scored_vectors(spark, sf_dir).select(F.col("id").alias("item"), "pred", "label")
    return metrics.greedy_scores(items, fold_cells=0)


@query("greedy_r", f"SELECT greedy_r FROM ({_GREEDY})")
def greedy_r(spark, sf_dir):
    """greedy(recall matrix) / number of predicted groups."""
    return _greedy_df(spark, sf_dir, ["recall"]).select("greedy_r")


@query("greedy_p", f"SELECT greedy_p FROM ({_GREEDY})")
def greedy_p(spark, sf_dir):
    """greedy(precision matrix) / number of true groups."""
    return _greedy_df(spark, sf_dir, ["precision"]).select("greedy_p")


@query("overlap_matrices", S.with_ctes(_OV, "SELECT pred, label, n_ij, true_size, pred_size, "
       "round(recall, 6) AS recall, round(precision, 6) AS precision FROM mat"))
def overlap_matrices(spark, sf_dir):
    """Recall (overlap / true size) and precision (overlap / predicted size) matrices."""
    items = scored_vectors(spark, sf_dir).select(F.col("id").alias("item"), "pred", "label")
    return metrics.named_overlaps(metrics.overlap_matrices(items)).select("pred", "label", "n_ij", "true_size", "pred_size",
                                                  "recall", "precision")


@query("group_items", S.with_ctes(BASE, "SELECT pred AS grp, id AS item, "
       "row_number() OVER (PARTITION BY pred ORDER BY id) - 1 AS pos FROM pred"))
def group_items(spark, sf_dir):
    """A3: group -> ordered item list, in long form (group, item, position); skew-safe ranking."""
    s = scored_vectors(spark, sf_dir).select(F.col("pred").alias("grp"), F.col("id").alias("item"))
    return prep.rank_by_id(s, ["grp"], "item", "pos").withColumn("pos", F.col("pos") - 1)


@query("match_min_ce", S.with_ctes(
    SCORES + [_SM, "lse AS (SELECT id, ln(sum(exp(p))) AS l FROM sm GROUP BY id)",
              "cec AS (SELECT 0 AS g, s.label AS r, s.q AS c, sum(l.l - s.p) AS v FROM sm s JOIN lse l ON l.id = s.id "
              "GROUP BY s.label, s.q)"] + S.dp_best("cec", "min"),
    "SELECT (SELECT count(*) FROM vecs) AS n, round(b.best / (SELECT count(*) FROM vecs), 6) AS ce_min FROM m_best b",
    recursive=True))
def match_min_ce(spark, sf_dir):
    """Smallest cross-entropy over all relabelings, solved as a min-cost matching of k x k costs."""
    s = scored_vectors(spark, sf_dir)
    p = s.select("id", "label", "qs", F.col("cos"))
    from tessera.functions import vectors as V
    sm = p.select("label", "qs", V.softmax("cos").alias("p"))
    lse = F.log(V.vsum(F.transform("p", lambda x: F.exp(x))))
    cells = sm.select("label", F.explode(F.arrays_zip("qs", F.transform("p", lambda x: lse - x).alias("nl")))
                      .alias("t")).groupBy(F.col("label").alias("c"), F.col("t.qs").alias("q")) \
        .agg(F.sum("t.nl").alias("v"))
    best = assignment_total(cells, [], "c", "q", "v", mode="min", out="best")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    return best.crossJoin(n).select("n", (F.col("best") / F.col("n")).alias("ce_min"))


# ---- per-batch metrics ------------------------------------------------------------------

_HB = ("hb AS (SELECT id, label, CAST(floor((rn - 1) / 4) AS BIGINT) AS batch_id FROM "
       "(SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS rn FROM vecs))")
_BATCH = S.with_ctes(
    BASE + [_HB, "bcont AS (SELECT hb.batch_id AS g, p.pred, p.label, count(*) AS n_ij FROM pred p "
                 "JOIN hb ON hb.id = p.id GROUP BY hb.batch_id, p.pred, p.label)"]
    + S.dp_best("(SELECT g, pred AS r, label AS c, n_ij AS v FROM bcont)") + S.agreement("bcont"),
    "SELECT count(*) AS n_batches, round(avg(b.best / s.n), 6) AS acc_batch_mean, round(avg(s.ari), 6) AS ari_batch_mean, "
    "round(avg(s.nmi), 6) AS nmi_batch_mean FROM s_scores s JOIN m_best b ON b.g = s.g", recursive=True)


@query("metrics_batch_mean", _BATCH)
def metrics_batch_mean(spark, sf_dir):
    """ACC / ARI / NMI per batch (4 samples of each class, all rows), then the unweighted mean."""
    v = tables.vectors(spark, sf_dir)
    s = assign.assign_to_prototypes(v, assign.class_mean_prototypes(v)).select("id", "pred", "label")
    b = prep.batches(v.select("id", "label"), "label", "id", BATCH_SIZE).select("id", "batch_id")
    rep = metrics.clustering_report(s.join(b, "id"), ["batch_id"])
    return metrics.batch_mean(rep, ["acc", "ari", "nmi"])
