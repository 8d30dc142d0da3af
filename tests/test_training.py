"""K-means starts and the training of prototypes."""
import numpy as np
import pytest

from tessera.operators import assign, kmeans, training
from tessera.plans import q_kmeans
from tessera.sources import tables

SF = "/root/testdata/sf0.01"


def points(spark, n=600, k=6, dim=3, seed=4, spread=10.0):
    rng = np.random.default_rng(seed)
    centres = spread * rng.standard_normal((k, dim))
    x = centres[rng.integers(0, k, n)] + rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def test_parallel_start_beats_the_lowest_ids(spark):
    df = points(spark)
    rows = kmeans.written(df, ["id", "x"])
    lowest = kmeans.lloyd(rows, [r["x"] for r in rows.orderBy("id").limit(6).collect()], rows=rows)
    mean = np.mean([kmeans.lloyd(rows, kmeans.parallel_start(rows, 6, seed, rows=rows), rows=rows).inertia for seed in range(10)])
    assert lowest.converged and mean <= lowest.inertia * (1 + 1e-9)


def test_parallel_start_is_deterministic_and_spread(spark):
    df = points(spark).repartition(7)
    a, b = (kmeans.parallel_start(d, 6, seed=3) for d in (df, df.coalesce(2)))
    assert np.allclose(a, b) and len(a) == 6
    few = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(50)], "id long, x array<double>")
    assert sorted(map(tuple, kmeans.parallel_start(few, 5))) == [(0.0, 1.0), (1.0, 1.0)]
    assert kmeans.parallel_start(few.where("id < 0"), 3).size == 0


def test_lloyd_stops_when_no_row_moves_and_says_so(spark):
    df = points(spark, n=200)
    fit = kmeans.lloyd(df, [[0.0, 0, 0], [1.0, 1, 1], [5.0, 5, 5]])
    again = kmeans.lloyd(df, fit.centroids)
    assert fit.converged and again.steps <= 1 and np.allclose(again.centroids, fit.centroids)
    short = kmeans.lloyd(df, [[0.0, 0, 0], [1.0, 1, 1], [5.0, 5, 5]], steps=1)
    assert not short.converged and short.steps == 1
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id long, x array<double>")
    with pytest.raises(Exception, match="unequal length"):
        kmeans.lloyd(odd, [[1.0, 2.0]])


def test_gradient_equals_finite_differences(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((40, 4)), rng.integers(0, 3, 40)
    df = spark.createDataFrame([(([float(v) for v in r]), int(t)) for r, t in zip(x, y)] + [([1.0, 0.0, 0.0, 0.0], None), ([1.0, 0.0, 0.0, 0.0], 9)],
                               "x array<double>, label int")
    c = rng.standard_normal((3, 4))

    def loss(c):
        u, _ = training._unit(c)
        return training.row_parts(x, y, u)[2] / len(x) + training.separation(c)[0]

    g, entropy, apart, _ = training.gradient(df, [0, 1, 2], c)
    assert entropy + apart == pytest.approx(loss(c))
    for q in range(3):
        for j in range(4):
            step = np.zeros_like(c)
            step[q, j] = 1e-6
            assert g[q, j] == pytest.approx((loss(c + step) - loss(c - step)) / 2e-6, abs=1e-7)


def test_training_lowers_the_loss_and_beats_the_class_means(spark):
    v = tables.vectors(spark, SF)
    protos, log = training.train(v, q_kmeans._class_means(v), 150, q_kmeans.RATE)
    assert len(log) > 100 and all(b.loss < a.loss for a, b in zip(log, log[1:]))
    assert log[-1].accuracy > log[0].accuracy == pytest.approx(204 / 500)
    again = assign.assign_to_prototypes(v, spark.createDataFrame(protos, "q int, c array<double>"), pred_only=True)
    assert again.where("pred = label").count() == round(log[-1].accuracy * 500)


def test_argmax_alone_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vecs = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(60)], "id long, x array<double>")
    protos = spark.createDataFrame([(q, [float(v) for v in rng.normal(size=3)]) for q in range(30)] + [(30, [0.0, 0.0, 0.0])], "q int, c array<double>")
    want = {r["id"]: r["pred"] for r in assign.assign_to_prototypes(vecs, protos).collect()}
    monkeypatch.setattr(assign, "SMALL_ROWS", 5)
    assert {r["id"]: r["pred"] for r in assign.assign_to_prototypes(vecs, protos).collect()} == want
    monkeypatch.setattr(assign, "MAX_PROTOTYPE_VALUES", 12)
    got = assign.assign_to_prototypes(vecs, protos, pred_only=True)
    assert got.columns == ["id", "x", "pred"] and {r["id"]: r["pred"] for r in got.collect()} == want
