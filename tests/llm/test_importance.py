import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
import helpers
from tessera.llm import importance as imp

SF001 = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, target, percent=25, least=20, buckets=10000):
    """(id, text) rows -> sorted (id, n_features, weight, score, rank)."""
    def feats(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = WORD.findall(low)
        runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        return words, [zlib.crc32(r.encode()) % buckets for r in runs]

    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for b in feats(t)[1]:
                c[b] += 1
        return c

    s, t = counts([x for _, x in docs]), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(t) + buckets) / ((a + 1) * (sum(s) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        words, f = feats(text)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def answer(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


def table(spark, folder, name):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(
        "doc_id" if name == "documents" else "item_id", "text").collect()]


def test_query_equals_brute_force(spark):
    want = brute(table(spark, SF001, "documents"), [t for _, t in table(spark, SF001, "benchmark")])
    df = E.queries()["op11_importance_resample"](spark, SF001)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert answer(df) == want


def test_odd_rows(spark, odd):
    want = brute(table(spark, odd, "documents"), [t for _, t in table(spark, odd, "benchmark")])
    assert answer(E.queries()["op11_importance_resample"](spark, odd)) == want


def test_empty_tables(spark, empty):
    df = E.queries()["op11_importance_resample"](spark, empty)
    assert df.collect() == [] and df.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_pieces_of_a_long_text_join_up(monkeypatch):
    text = ("Ab c12 é-日本 ".encode() * 50) + b" " * 100 + b"x" * 300 + b" end"
    whole = imp.features(text, 3)
    monkeypatch.setattr(imp, "PIECE_BYTES", 7)
    n, found = imp.features(text, 3)
    assert n == whole[0] and sorted(found) == sorted(whole[1])


def test_very_long_text_is_quick():
    n, found = imp.features(b" " * 3_000_000 + b"a" * 3_000_000 + b"-" * 3_000_000, 2)
    assert n == 1 and found == [zlib.crc32(b"a" * 3_000_000)]


@pytest.mark.parametrize("k", [1, 2, 50, 499, 500])
def test_quickselect_finds_every_place(spark, k):
    rows = spark.range(500).selectExpr("struct(id % 3 AS down, id AS row) AS key")
    want = sorted((i % 3, i) for i in range(500))[k - 1]
    assert tuple(imp.kth_key(rows, k, seed=k, pivots=4)) == want


def test_hot_ties_are_split_by_rank(spark, tmp_path):
    docs = [helpers.doc(1, "same words " * 15) for _ in range(300)] + [helpers.doc(i, f"other {i} " * 30) for i in range(2, 40)]
    folder = helpers.write_all(tmp_path, docs)
    rows = E.queries()["op11_importance_resample"](spark, folder).collect()
    ranks = sorted(r["rank"] for r in rows if r["rank"])
    assert ranks == list(range(1, 25 * len(docs) // 100 + 1)) and len(rows) == len(docs)


def test_gain_is_the_ratio_of_the_target_share_to_the_source_share():
    source, target = np.array([9, 0, 90, 1], np.int64), np.array([0, 4, 5, 1], np.int64)
    want = [math.floor(1000 * math.log((t + 1) * (100 + 4) / ((s + 1) * (10 + 4)))) for s, t in zip([9, 0, 90, 1], [0, 4, 5, 1])]
    assert imp.gains(source, target).tolist() == want
    shares = [math.floor(1000 * math.log(((t + 1) / 14) / ((s + 1) / 104))) for s, t in zip([9, 0, 90, 1], [0, 4, 5, 1])]
    assert max(abs(a - b) for a, b in zip(want, shares)) <= 1


def test_weights_of_unequal_tables(spark):
    docs = spark.createDataFrame([(1, "alpha beta " * 15), (2, "gamma " * 25), (3, None)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    f1 = ["alpha"] * 15 + ["beta"] * 15 + ["alpha beta"] * 15 + ["beta alpha"] * 14
    f2 = ["gamma"] * 25 + ["gamma gamma"] * 24
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = Counter(map(bucket, f1 + f2)), Counter(map(bucket, ["alpha", "beta", "alpha beta"]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (108 + 10000) / ((s[b] + 1) * (3 + 10000))))
    rows = {r["id"]: r for r in imp.resample(docs, target).collect()}
    assert {i: r["weight"] for i, r in rows.items()} == {
        1: sum(gain(bucket(w)) for w in f1) // len(f1), 2: sum(gain(bucket(w)) for w in f2) // len(f2), 3: 0}
    assert [rows[i]["n_features"] for i in (1, 2, 3)] == [59, 49, 0]
