"""Rounds of locally dominant cells against the fold, the auction against the dense solver."""
import numpy as np
import pytest

from tessera.operators import large_matching as L
from tessera.operators import matching


def frame(spark, mats, missing=0.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(g, i, j, int(v)) for g, m in enumerate(mats) for (i, j), v in np.ndenumerate(m) if rng.random() >= missing]
    return rows, spark.createDataFrame(rows, "g int, r int, c int, v long").repartition(3)


def fold(rows):
    """Sequential greedy by its definition."""
    total, taken = {}, []
    used = set()
    for g, i, j, v in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (g, "r", i) not in used and (g, "c", j) not in used:
            used |= {(g, "r", i), (g, "c", j)}
            total[g] = total.get(g, 0) + v
            taken.append((g, i, j))
    return total, sorted(taken)


def test_greedy_rounds_equal_the_fold(spark):
    rng = np.random.default_rng(1)
    mats = [rng.integers(0, top, (int(rng.integers(1, 9)), int(rng.integers(1, 9)))) for top in (2, 4, 50) for _ in range(12)]
    rows, df = frame(spark, mats, 0.2)
    total, taken = fold(rows)
    got, sizes = L.greedy_rounds(df, ["g"], "r", "c", "v")
    assert sorted((r["g"], r["r"], r["c"]) for r in got.collect()) == taken
    assert sizes[0] == len(rows) and all(a > b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 8
    folded = {r["g"]: r["total"] for r in matching.greedy_total(df, ["g"], "r", "c", "v").collect()}
    assert {r["g"]: r["total"] for r in L.greedy_sum(df, ["g"], "r", "c", "v").collect()} == folded == total


def test_greedy_without_keys_null_rows_and_no_cells(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 2, 3.0), (None, 1, 9.0), (2, 1, None), (2, 3, float("nan"))], "r int, c int, v double")
    assert L.greedy_sum(df, [], "r", "c", "v").first()["total"] == 3.0      # (1,2) before (2,2); row 2 has no free column left
    got, sizes = L.greedy_rounds(df.where("r > 5"), [], "r", "c", "v")
    assert got.count() == 0 and sizes == []


def best_total(cells, k):
    w = np.zeros((k, k))
    for i, j, v in cells:
        w[i, j] = v
    return float(w[np.arange(k), matching._solve_dense(-w)].sum())


def test_auction_rounds_equal_the_dense_solver(spark):
    rng = np.random.default_rng(2)
    mats = [rng.integers(0, 3, (int(rng.integers(1, 4)), int(rng.integers(1, 4)))) for _ in range(12)]
    rows, df = frame(spark, mats, 0.25)
    want = {g: best_total([x[1:] for x in rows if x[0] == g], 4) for g in {x[0] for x in rows}}
    log = []
    pairs = L.auction(df, ["g"], "r", "c", "v", log).collect()
    assert len({(p["g"], p["r"]) for p in pairs}) == len({(p["g"], p["c"]) for p in pairs}) == len(pairs)
    got = dict.fromkeys(want, 0.0)
    for p in pairs:
        got[p["g"]] += p["v"]
    assert got == want
    assert [e for e, _ in log] == sorted({e for e, _ in log}, reverse=True) and log[-1][0] == 1


def test_sparse_solver_equals_the_dense_solver():
    rng = np.random.default_rng(5)
    for n in range(200):
        k, most = int(rng.integers(1, 12)), int(rng.choice([1, 3, 40, 10 ** 6]))
        cells = [(i, j, int(rng.integers(0, most + 1))) for i in range(k) for j in range(k) if rng.random() < rng.choice([0.2, 0.6, 1.0])]
        i, j, v = (np.array([c[x] for c in cells], np.int64) for x in range(3))
        match = matching._solve_sparse(i, j, v, k)
        assert sorted(match) == list(range(k))
        assert sum(c[2] for c in cells if match[c[0]] == c[1]) == best_total(cells, k)


def test_counts_of_three_thousand_groups(spark):
    """A hidden permutation holds the largest cell of each row and column, with smaller cells around it."""
    rng = np.random.default_rng(3)
    k, perm = 3000, np.random.default_rng(4).permutation(3000)
    rows = {(i, int(perm[i])): 9 for i in range(k)}
    for i in range(k):
        for j in rng.integers(0, k, 4):
            rows.setdefault((i, int(j)), int(rng.integers(1, 8)))
    df = spark.createDataFrame([(i, j, v) for (i, j), v in rows.items()], "r int, c int, v int")
    assert matching.assignment_total(df, [], "r", "c", "v").first()["total"] == 9 * k


def test_auction_odd_cells(spark):
    df = spark.createDataFrame([(None, "a", 3), ("x", "a", 3), ("x", None, 2), ("x", "a", 1), ("y", "b", 0)], "r string, c string, v int")
    assert sum(p["v"] for p in L.auction(df, [], "r", "c", "v").collect()) == 5
    assert L.auction_total(df.where("v = 0"), [], "r", "c", "v").first()["total"] == 0.0
    for v in (-1.0, 0.5, None):
        bad = spark.createDataFrame([("x", "a", v)], "r string, c string, v double")
        with pytest.raises(ValueError):
            L.auction(bad, [], "r", "c", "v")
