import numpy as np
import pytest

import __spark_entry__ as E
from tessera.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    w = [weights[i % 3] for i in range(len(sizes))]
    full = [False] * len(sizes)
    target = [0.0] * len(sizes)
    while True:
        left = share * sum(sizes) - sum(most * s for s, f in zip(sizes, full) if f)
        free = sum(x for x, f in zip(w, full) if not f)
        target = [most * s if f else left * x / free for s, x, f in zip(sizes, w, full)]
        over = [not f and t > most * s for s, t, f in zip(sizes, target, full)]
        if not any(over):
            return target
        full = [f or o for f, o in zip(full, over)]


def test_targets(spark):
    sizes = {"b": 100, "a": 1000, "Z": 10, "é": 5000, None: 40, "c": 0}
    totals = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, docs long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    want = dict(zip(order, brute_targets([sizes[k] for k in order])))
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 50, 9)
    mass = sizes * rng.uniform(0.05, 0.95, 9)
    total, n = np.zeros(9), 20000
    for _ in range(n):
        taken, at, held = mixing.pivotal(sizes, mass, rng.random(9))
        words = (taken * sizes).astype(float)
        if at >= 0:
            words[at] = held
        assert words.sum() == pytest.approx(mass.sum())
        total += words
    assert np.abs(total / n - mass).max() < 0.02 * sizes.max()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    one = {r["doc_id"]: r for r in E.queries()["op9_mix_sources"](spark, sf).collect()}
    two = {r["doc_id"]: r for r in E.queries()["op9_mix_sources"](spark, sf).collect()}
    assert one == two
    by = {}
    for r in one.values():
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]


def test_tree_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 8)
    monkeypatch.setattr(mixing, "MERGE_WAYS", 4)
    items = spark.range(3000).selectExpr("id as item", "case when id % 3 = 0 then 'x' when id % 3 = 1 then 'y' end as source",
                                         "cast(1 + id % 91 as long) as size")
    rows = mixing.mix(items).collect()
    assert len(rows) == 3000
    for s in ("x", "y", None):
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 91


def test_documents_come_as_often_as_taken(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    taken = mixing.mix(docs.selectExpr("coalesce(doc_id, -1) as item", "source", "1L as size"))
    assert taken.count() == docs.count()


def test_a_million_like_rows_are_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 64)
    seen = []
    plain = mixing._round_bucket

    def watched(seed, level):
        seen.append(level)
        return plain(seed, level)

    monkeypatch.setattr(mixing, "_round_bucket", watched)
    items = spark.createDataFrame([(None, "s", 10)] * 3000 + [(i, "t", 5) for i in range(300)], "item long, source string, size long")
    rows = mixing.mix(items).groupBy("source").agg(mixing.F.sum(mixing.F.col("copies") * mixing.F.col("size")).alias("taken"),
                                                  mixing.F.max("target").alias("target"), mixing.F.count("*").alias("n")).collect()
    assert {r["source"]: r["n"] for r in rows} == {"s": 3000, "t": 300}
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in rows)


def test_word_count_of_a_long_run(spark):
    df = spark.createDataFrame([(" " * 1_000_000 + "a",), ("a\x0bb\x0cc d",), (None,), ("",), ("  x",)], "t string")
    assert [r[0] for r in df.select(mixing.word_count(mixing.F.col("t"))).collect()] == [1, 4, 0, 0, 2]
