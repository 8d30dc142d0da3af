import numpy as np

import __spark_entry__ as E
from tessera.llm import multiprobe


def brute(x, ids, q, own, k=10):
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    d[ids == own] = np.inf
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order if np.isfinite(d[i])]


def test_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, ids = np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows])
    found = {}
    for r in E.queries()["op3_multiprobe_lsh"](spark, sf).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 100 == 0]:
        want = brute(x, ids, x[ids == q][0], q)
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert got == sorted(got, key=lambda t: (t[2], t[1]))
        for _, v, s in got:
            assert s == float(np.sqrt(((x[ids == v][0] - x[ids == q][0]) ** 2).sum()))
        hits += len({v for v, _ in want} & {v for _, v, _ in got})
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_odd_vectors_take_no_part(spark, odd):
    rows = E.queries()["op3_multiprobe_lsh"](spark, odd).collect()
    assert {r["query_id"] for r in rows} == {0, 100}       # 300 is null, 400 has another length and stands alone
    assert {r["vec_id"] for r in rows} <= set(range(120))
    x = np.array([[i % 7, 1.0, i % 3] for i in range(120)] + [[5.0, 1.0, 2.0]])
    ids = np.array([*range(120), 5])
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == 0)
    assert [s for _, _, s in got] == [s for _, s in brute(x[:120], ids[:120], x[0], 0)]
    assert [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)         # ties go to smaller ids


def test_crowded_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "BLOCK", 16)
    monkeypatch.setattr(multiprobe, "QUERY_BLOCK", 4)
    vectors = spark.range(500).selectExpr("id as vec_id", "array(1.0D, cast(id % 2 as double)) as embedding")
    import pyspark.sql.functions as F
    rows = multiprobe.nearest(vectors, F.col("vec_id") % 50 == 0, k=3).collect()
    assert len(rows) == 30
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 50] == [0, 2, 4]


def test_probes_come_in_order_of_chance():
    h = multiprobe.Hashing(8, 1.0, 0.8, 3, 4)
    x = np.random.default_rng(2).standard_normal((20, 8))
    keys = h.probes(x, 40)
    own = h.keys(np.floor(h.places(x)).astype(np.int64))
    assert keys.shape == (20, 3, 40) and all(own[i, t] in keys[i, t] for i in range(20) for t in range(3))
    near = x + 0.8 * np.random.default_rng(3).standard_normal((20, 8)) / np.sqrt(8)
    hits = (h.keys(np.floor(h.places(near)).astype(np.int64))[:, :, None] == keys)
    assert hits[:, :, :20].sum() > hits[:, :, 20:].sum()


def mixed():
    """Vectors of spreads a factor of 100 apart, more copies (with a little noise) than other rows, one far away."""
    rng = np.random.default_rng(6)
    parts = [0.01 * rng.standard_normal((150, 12)) + 40, rng.standard_normal((200, 12)) - 40, 5 * rng.standard_normal((250, 12)),
             1e-6 * rng.standard_normal((700, 12)) + 90, np.full((1, 12), 500.0)]
    return np.concatenate(parts)


def test_recall_on_mixed_scales_and_copies(spark, monkeypatch):
    import pyspark.sql.functions as F
    x = mixed()
    ids = np.arange(len(x))
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    for scan_queries in (multiprobe.SCAN_QUERIES, 8):       # with and without tables for the other reaches
        monkeypatch.setattr(multiprobe, "SCAN_QUERIES", scan_queries)
        found = {}
        for r in multiprobe.nearest(vectors, F.col("vec_id") % 10 == 0).collect():
            found.setdefault(r["query_id"], {})[r["id"]] = r["score"]
        asked = ids[ids % 10 == 0]
        assert all(len(found[q]) == 10 for q in asked)
        for part in (asked < 150, (asked >= 150) & (asked < 350), (asked >= 350) & (asked < 600), asked >= 600):
            hits = [len({v for v, _ in brute(x, ids, x[q], q)} & found[q].keys()) for q in asked[part]]
            assert np.mean(hits) >= 9


def test_few_vectors_are_all_candidates(spark):
    import pyspark.sql.functions as F
    vectors = spark.createDataFrame([(i, [10.0 ** i, 1.0]) for i in range(7)], "vec_id long, embedding array<double>")
    rows = multiprobe.nearest(vectors, F.lit(True)).collect()
    assert sorted((r["query_id"], r["id"]) for r in rows) == [(i, j) for i in range(7) for j in range(7) if i != j]


def test_closest_by_rough_squares_is_exact():
    rng = np.random.default_rng(11)
    for n in (3, 12, 400):
        x = np.round(rng.standard_normal((n, 5)) * rng.choice([1e-6, 1.0, 1e5]), int(rng.integers(0, 7)))
        x[n // 2:] = x[rng.integers(0, n, n - n // 2)]        # copies and ties
        numbers = rng.permutation(10 * n)[:n]
        q = x[rng.integers(0, n, 6)] + rng.choice([0.0, 0.1], (6, 1))
        rough = multiprobe.rough_squares(q, x, numbers)
        for i in range(6):
            own = int(numbers[rng.integers(n)])
            d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
            want = sorted((dist, num) for dist, num in zip(d.tolist(), numbers.tolist()) if num != own)[:10]
            got = multiprobe.closest(x, numbers, q[i], own, 10, (rough[0][i], rough[1]))
            assert list(zip(got[1].tolist(), got[0].tolist())) == want
    assert multiprobe.rough_squares(q, x, np.zeros(len(x))) is None and multiprobe.rough_squares(q * 1e200, x, numbers) is None
