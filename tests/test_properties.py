"""Properties: DP = brute force, numpy solver = DP, relabel invariance, optimal >= greedy,
skew-safe ranking = plain row_number."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import assign, matching, metrics, prep
from tessera.sources import tables


def brute(w, mode):
    k = len(w)
    vals = [sum(w[i][p[i]] for i in range(k)) for p in itertools.permutations(range(k))]
    return max(vals) if mode == "max" else min(vals)


def cells_df(spark, mats):
    rows = [(g, i, j, float(m[i][j])) for g, m in enumerate(mats) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, "g long, r int, c int, v double")


@pytest.mark.parametrize("mode", ["max", "min"])
def test_dp_equals_brute_force(spark, mode):
    rnd = random.Random(7)
    mats = [[[rnd.randint(0, 9) for _ in range(k)] for _ in range(k)] for k in (1, 2, 3, 4, 5) for _ in range(3)]
    got = {r["g"]: r["total"] for r in matching.assignment_total(cells_df(spark, mats), ["g"], "r", "c", "v", mode).collect()}
    for g, m in enumerate(mats):
        assert got[g] == pytest.approx(brute(m, mode))


def test_large_groups_reach_a_known_optimum(spark):
    """Every size has the same solver: a hidden permutation holds the row maxima, so its sum is the optimum."""
    rnd = np.random.default_rng(3)
    mats, want = [], []
    for k in (12, 13, 14, 40):
        m, perm = rnd.integers(0, 50, size=(k, k)), rnd.permutation(k)
        m[np.arange(k), perm] += 50
        mats.append(m.tolist())
        want.append((int(m[np.arange(k), perm].sum()), {(i, int(j)) for i, j in enumerate(perm)}))
    cells = cells_df(spark, mats)
    got = {r["g"]: r["total"] for r in matching.assignment_total(cells, ["g"], "r", "c", "v", "max").collect()}
    pairs = {}
    for r in matching.assignment_pairs(cells, ["g"], "r", "c", "v", "max").collect():
        pairs.setdefault(r["g"], set()).add((r["r"], r["c"]))
    for g, (total, best) in enumerate(want):
        assert got[g] == total and pairs[g] == best


def test_padded_columns_cost_what_the_row_says(spark):
    cells = spark.createDataFrame([(0, 0, 0, 5.0, 1.0), (0, 1, 0, 4.0, 9.0), (0, 2, 0, 7.0, 2.0)],
                                  "g long, r int, c int, v double, p double")
    assert matching.assignment_total(cells, ["g"], "r", "c", "v", "min", pad="p").first()["total"] == 1.0 + 4.0 + 2.0
    pairs = matching.assignment_pairs(cells, ["g"], "r", "c", "v", "min", pad="p", padding=True).collect()
    assert {(r["r"], r["c"]) for r in pairs} == {(0, None), (1, 0), (2, None)}


def test_more_prototypes_than_one_block(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    vecs = spark.createDataFrame([(i, [float(v) for v in rnd.normal(size=3)], i % 5) for i in range(40)], "id long, x array<double>, label int")
    protos = spark.createDataFrame([(q, [float(v) for v in rnd.normal(size=3)]) for q in range(25)] + [(None, [9.0, 9.0, 9.0])],
                                   "q int, c array<double>")
    one = {r["id"]: r for r in assign.assign_to_prototypes(vecs, protos).collect()}
    monkeypatch.setattr(assign, "MAX_PROTOTYPE_VALUES", 12)
    many = {r["id"]: r for r in assign.assign_to_prototypes(vecs, protos).collect()}
    assert len(many) == 40
    for i, r in one.items():
        assert r["qs"] == many[i]["qs"] == list(range(25)) and r["pred"] == many[i]["pred"]
        assert r["cos"] == pytest.approx(many[i]["cos"])


def test_null_classes_are_kept(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id long, cls string")
    assert {(r["id"], r["rn"]) for r in prep.rank_by_id(df, ["cls"], "id").collect()} == {(1, 1), (3, 2), (2, 1), (4, 2)}
    assert prep.split_stratified(df, "cls", "id").count() == 4
    assert prep.batches(df, "cls", "id", 1).count() == 4


def test_class_lookup_does_not_shuffle_texts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.text_corpus(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan


def test_too_many_classes_fail(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_CLASSES", 2)
    with pytest.raises(ValueError):
        tables.class_names(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k")


def test_kmeans_converges(spark):
    rnd = np.random.default_rng(2)
    pts = [(i, [float(v) for v in rnd.normal(size=2) + 8 * (i % 3)], i % 2) for i in range(90)]
    v = spark.createDataFrame(pts, "id long, x array<double>, g int")
    cents = assign.kmeans_lloyd(v, 3)
    again = {r["q"]: r["c"] for r in assign.lloyd_step(v, cents).collect()}
    for r in cents.collect():
        assert r["c"] == pytest.approx(again[r["q"]])
    grouped = assign.kmeans_in_groups(v, 3, "g").collect()
    assert len(grouped) == 90 and {r["pred"] for r in grouped} == {0, 1, 2}
    with pytest.raises(RuntimeError):
        assign.kmeans_lloyd(v, 3, most_steps=1)


def test_metrics_invariant_under_relabel(spark):
    rnd = random.Random(1)
    true = [rnd.randrange(4) for _ in range(60)]
    pred = [rnd.randrange(5) for _ in range(60)]
    perm = {0: 3, 1: 0, 2: 4, 3: 1, 4: 2}
    a = metrics.clustering_report(spark.createDataFrame(list(zip(pred, true)), "pred int, label int")).first()
    b = metrics.clustering_report(spark.createDataFrame([(perm[p], t) for p, t in zip(pred, true)],
                                                        "pred int, label int")).first()
    for k in ("acc", "ari", "nmi"):
        assert a[k] == pytest.approx(b[k])
    assert a["precision_micro"] == a["recall_micro"] == a["accuracy"]


def test_optimal_at_least_greedy(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(4), rnd.randrange(4)) for i in range(80)]
    items = spark.createDataFrame(rows, "item long, pred int, label int")
    m = metrics.overlap_matrices(items)
    greedy = matching.greedy_total(m, [], "pred_order", "label_order", "recall").first()["total"]
    best = matching.assignment_total(m, [], "pred", "label", "recall", "max").first()["total"]
    assert best >= greedy - 1e-12


def test_rank_within_matches_row_number_on_skew(spark):
    # one class holds most rows; ids spread over several buckets
    rows = [(i * 7919 % 300000, 0 if i % 10 else 1 + i % 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, c int")
    a = prep.rank_within(df, ["c"], ["id"], F.shiftright("id", 12), "rn")
    b = df.withColumn("rn2", F.row_number().over(Window.partitionBy("c").orderBy("id")))
    j = a.join(b, ["id", "c"])
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0
    assert j.count() == 3000


def test_hash_shuffle_train_test_disjoint(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(200)], "doc_id long, c int")
    s = prep.split_stratified(d, "c", "doc_id")
    counts = {(r["c"], r["split"]): r["count"] for r in s.groupBy("c", "split").count().collect()}
    for c in range(3):
        n = sum(v for (cc, _), v in counts.items() if cc == c)
        assert counts[(c, "test")] == -(-3 * n // 10)
    assert s.select("doc_id").distinct().count() == 200
