import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.llm import hard_negatives as hn

SF001 = "/root/testdata/sf0.001"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=5, least=80):
    """(id, label, vector) rows -> sorted result rows, by the definition."""
    held = {}
    for i, label, vec in rows:
        if i is None or label is None or vec is None or any(v is None or not math.isfinite(v) for v in vec):
            continue
        row = (label, [math.floor(256 * float(v)) for v in vec])
        held[i] = min(held.get(i, row), row)
    out = []
    for a, (label, q) in held.items():
        if not anchor(a):
            continue
        others = [(-sum(x * y for x, y in zip(q, v)), i, lab) for i, (lab, v) in held.items() if i != a and len(v) == len(q)]
        others.sort()
        for minus, p, _ in [o for o in others if o[2] == label][:positives]:
            good = [o for o in others if o[2] != label and least * -minus <= 100 * -o[0] <= 100 * -minus][:negatives]
            out += [(a, p, rank, n, -minus, -s) for rank, (s, n, _) in enumerate(good, 1)]
    return sorted(out)


def answer(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def vectors(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]


def shifted(rows):
    return [(i, (lab + 1) % 10 if lab is not None and i is not None and i % 7 == 0 else lab, v) for i, lab, v in rows]


def test_query_equals_brute_force(spark):
    df = E.queries()["op13_hard_negatives"](spark, SF001)
    assert df.dtypes == [(c, "int" if c == "rank" else "bigint") for c in COLUMNS]
    got = answer(df)
    assert got and got == brute(shifted(vectors(spark, SF001)))


def test_odd_and_empty_tables(spark, odd, empty):
    assert answer(E.queries()["op13_hard_negatives"](spark, odd)) == brute(shifted(vectors(spark, odd)))
    df = E.queries()["op13_hard_negatives"](spark, empty)
    assert df.collect() == [] and df.columns == COLUMNS


@pytest.mark.parametrize("sample,fanout,levels,block", [(40, 3, 2, 16), (400, 4, 3, 64), (5, 8, 2, 1024)])
def test_any_tree_gives_the_same_rows(spark, sample, fanout, levels, block):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    x = np.round(centres[rng.integers(0, 6, 700)] + 0.2 * rng.standard_normal((700, 8)), 1)
    x[100:250] = x[100]         # a crowded leaf of copies, ties everywhere
    rows = [(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(900 + i, 1, [1.0, float(i), 2.0]) for i in range(20)] + [(950, 1, []), (960, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("window", F.lit("clash"))
    got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, sample=sample, fanout=fanout, levels=levels, block=block)
    assert answer(got) == brute(rows, lambda i: i % 10 == 0)


def test_tree_eliminates_and_never_wrongly():
    rng = np.random.default_rng(4)
    x = np.floor(np.concatenate([c * 400 + 20 * rng.standard_normal((200, 6)) for c in np.eye(6)]))
    tree = hn.Tree(x, 6, 1)
    leaf, passed = tree.route(x)
    for node, rows, near, gaps in passed:
        for j in range(len(node.points)):
            own, norm = gaps[near == j], np.sqrt((x[rows[near == j]] ** 2).sum(axis=1))
            node.low[:, j], node.high[:, j] = own.min(axis=0), own.max(axis=0)
            node.least[j], node.most[j] = norm.min(), norm.max()
    q = x[::50]
    score = q @ x.T
    low = np.sort(score, axis=1)[:, [-10]]
    seen = np.zeros((len(q), tree.leaves), bool)
    for name, rows in tree.visits(q, low, np.full_like(low, 1e18)):
        seen[rows, name] = True
    for i in range(len(q)):
        assert seen[i, np.unique(leaf[score[i] >= low[i]])].all()
    assert seen.mean() < 0.4


def test_large_components_are_exact():
    q = np.array([[2.0 ** 31 - 1] * 4])
    assert hn.inner(q, q)[0, 0] == 4 * (2 ** 31 - 1) ** 2 if 4 * (2 ** 31 - 1) ** 2 < 1 << 62 else 1 << 62
    assert hn.inner(np.array([[3.0, -2.0]]), np.array([[2.0 ** 30, 1.0]]))[0, 0] == 3 * 2 ** 30 - 2
