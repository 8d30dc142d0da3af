"""Hand fixtures (expected values worked out by hand from the reference semantics)."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import layout as L
from tessera.functions import text as T
from tessera.operators import metrics, objectives, prep


def report(spark, true, pred):
    df = spark.createDataFrame(list(zip(pred, true)), "pred int, label int")
    return metrics.clustering_report(df).first()


def test_acc_relabeled_and_partial(spark):
    r = report(spark, [0, 0, 1, 1], [1, 1, 0, 0])
    assert r["acc"] == 1.0 and r["accuracy"] == 0.0 and r["ari"] == 1.0
    assert report(spark, [0, 0, 1, 1], [0, 0, 0, 1])["acc"] == 0.75


def test_ari_nmi_crossed(spark):
    r = report(spark, [0, 0, 1, 1], [0, 1, 0, 1])
    assert r["ari"] == pytest.approx(-0.5)
    assert r["nmi"] == 0.0


def test_nmi_single_groups(spark):
    assert report(spark, [3, 3, 3], [1, 1, 1])["nmi"] == 1.0


def test_greedy_r_p(spark):
    pred = [1, 1, 1, 2, 2, 2, 3, 3, 3]
    label = [1, 1, 1, 2, 2, 2]
    rows = [(i, pred[i], label[i] if i < len(label) else None) for i in range(len(pred))]
    items = spark.createDataFrame(rows, "item long, pred int, label int")
    g = metrics.greedy_scores(items).first()
    assert g["greedy_r"] == pytest.approx(2 / 3)
    assert g["greedy_p"] == pytest.approx(1.0)


def _protos(spark, vecs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "q int, c array<double>")


def test_center_separation(spark):
    assert objectives.center_separation(_protos(spark, [(1, 0), (-1, 0)])).first()["separation"] == pytest.approx(0.0)
    assert objectives.center_separation(_protos(spark, [(1, 0), (0, 1)])).first()["separation"] == pytest.approx(1.0)


def test_kmeans_objective(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, -1.0],)], "cos array<double>")
    assert objectives.kmeans_objective(df).first()["objective"] == pytest.approx(0.25)


def test_pair_margin_terms(spark):
    df = spark.createDataFrame([(1, 0.5), (-1, 0.5), (-1, 0.1)], "y int, c double")
    v = df.select(F.avg(objectives.margin_term(F.col("c"), F.col("y"), 0.2)).alias("l")).first()["l"]
    assert v == pytest.approx((0.5 + 0.3 + 0.0) / 3)


def test_bbox_scale_center_rect(spark):
    df = spark.createDataFrame([("[1234, 1234, 5000, 10000]",)], "b string")
    s = df.select(L.bbox_scale(L.bbox_parse("b")).alias("s"))
    assert s.first()["s"] == [370, 617, 1500, 5000]
    x, y = L.bbox_center("s")
    r = s.select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == (935, 2808)
    c = spark.createDataFrame([([[1, 2], [9, 2], [9, 8], [1, 8]],)], "c array<array<int>>")
    assert c.select(L.bbox_rect("c").alias("r")).first()["r"] == [1, 2, 9, 8]


def test_first_appearance_ids(spark):
    df = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (0, 2, "b"), (0, 3, "c")], "page long, item long, ro string")
    o = prep.first_appearance_order(df, "ro", "item", ["page"])
    ids = dict((r["ro"], r["order"]) for r in o.collect())
    assert [ids[k] for k in "babc"] == [0, 1, 0, 2]


def test_remap_compose_clean(spark):
    df = spark.createDataFrame([(c,) for c in [0, 1, 2, 3, 4]], "c int")
    out = df.where(F.col("c") != 2).select(prep.remap_two_way("c").alias("c")).collect()
    assert [r["c"] for r in out] == [1, 1, 2, 2]
    t = spark.createDataFrame([("T", "D"), (None, "D"), ("T", None)], "t string, d string")
    assert [r[0] for r in t.select(T.compose_text("t", "d")).collect()] == ["T D", "D", "T"]
    c = spark.createDataFrame([("a\\nb",)], "s string")
    assert c.select(T.clean_text("s")).first()[0] == "ab"


def test_batch_ids_and_split(spark):
    df = spark.createDataFrame([(i, 0) for i in range(5)], "id long, c int")
    b = prep.batch_rows(df, "c", "id", 2).orderBy("id").collect()
    assert [r["batch_id"] for r in b] == [0, 0, 1, 1, 2]
    d = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    s = prep.split_positional(d, "doc_id").groupBy("split").count().collect()
    assert dict((r["split"], r["count"]) for r in s) == {"train": 7, "test": 3}


def test_dictionary_remap_unknown_key_fails(spark):
    df = spark.createDataFrame([("en",), ("xx",)], "lang string")
    with pytest.raises(Exception):
        df.select(prep.remap_dict("lang", {"en": 1})).collect()


def test_token_window(spark):
    df = spark.createDataFrame([("a  b c",), ("",)], "t string")
    w, m, n = T.token_window("t", 4)
    rows = df.select(w.alias("w"), m.alias("m"), n.alias("n")).collect()
    assert rows[0]["w"] == ["a", "b", "c", T.PAD_TOKEN] and rows[0]["m"] == [1, 1, 1, 0] and rows[0]["n"] == 3
    assert rows[1]["m"] == [0, 0, 0, 0]
