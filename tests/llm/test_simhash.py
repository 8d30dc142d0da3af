import re

import numpy as np
import pytest
import xxhash

import __spark_entry__ as E
from helpers import odd_documents
from tessera.llm import simhash_cover as S
from tessera.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(points, ids, most=2):
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1:] ^ points[i]) <= most) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min([v for v in (least.get(r), x) if v is not None], default=None)
    return [least[find(i)] for i in range(len(points))]


@pytest.mark.parametrize("code", [S.GOLAY, S.HAMMING])
def test_codes_are_perfect(code):
    _, n, check, radius = code
    first, patterns, excess = S.error_patterns(code, 0)
    assert (np.diff(first) == 1).all() and len(patterns) == 1 << check and not excess.any()


@pytest.mark.parametrize("blocks", [S.BLOCKS, S.MORE_BLOCKS])
def test_points_within_the_threshold_meet(blocks):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 3, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    anchors = S.Anchors(blocks, 2)
    at, anchor, home = anchors.near(np.concatenate([a, b]))
    visits = [set(anchor[at == i].tolist()) for i in range(600)]
    homes = {int(i): int(x) for i, x in zip(at[home], anchor[home])}
    assert len(homes) == 600
    assert all(homes[i] in visits[i + 300] and homes[i + 300] in visits[i] for i in range(300))


@pytest.mark.parametrize("blocks", [S.BLOCKS, S.MORE_BLOCKS])
def test_links_equal_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(8):
            points.add(x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    p = np.array(sorted(points), dtype=np.uint64)
    want = {frozenset((int(p[i]), int(p[j]))) for i in range(len(p)) for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 2) if i < j}
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")
    got = [frozenset(int(np.int64(v).view(np.uint64)) for v in (r["a"], r["b"])) for r in S.links(df, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = {r["doc_id"]: r for r in E.queries()["op4_simhash_cover"](spark, sf).collect()}
    points = np.array([brute_fingerprint(d["text"] or "") for d in docs], dtype=np.uint64)
    assert [rows[d["doc_id"]]["fingerprint"] for d in docs] == [f"{int(x):016x}" for x in points]
    assert [rows[d["doc_id"]]["component_id"] for d in docs] == brute_components(points, [d["doc_id"] for d in docs])


def test_odd_rows(spark, odd):
    docs = odd_documents()
    points = np.array([brute_fingerprint(d["text"] or "") for d in docs], dtype=np.uint64)
    want = sorted(zip(map(str, [d["doc_id"] for d in docs]), [f"{int(x):016x}" for x in points],
                      map(str, brute_components(points, [d["doc_id"] for d in docs]))))
    rows = E.queries()["op4_simhash_cover"](spark, odd).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want
    out = S.near_dedup(spark.read.parquet(f"{odd}/documents.parquet"))
    assert out.count() == len(set(brute_components(points, list(range(len(docs))))))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[x] == 100 for x in range(100, 160))


def test_hot_fingerprints_and_components_are_dealt_out(spark, monkeypatch):
    from tessera.llm import common
    rows = [(i, "one text that a third of all rows hold") for i in range(200)] + [(1000 + i, f"text number {i} is another {i * 17}") for i in range(400)]
    docs = spark.createDataFrame(rows + [(None, "one text that a third of all rows hold")], "doc_id long, text string")
    want = sorted(map(str, near_rows(docs)))
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    assert sorted(map(str, near_rows(docs))) == want
    many = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0), (3, 0)], "k int, v int")
    few = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, w string")
    joined = common.salted_join(many, few, "k", hot_rows=10, salts=4)
    assert sorted(map(tuple, joined.collect())) == sorted([(1, i, "a") for i in range(100)] + [(2, 0, "b")])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_salt") >= 3


def near_rows(docs):
    return [(r["doc_id"], r["fp"], r["component_id"]) for r in S.near_groups(docs).collect()]


def test_anchors_of_many_points_take_little_memory():
    import tracemalloc
    points = np.random.default_rng(5).integers(0, 1 << 63, 4096, dtype=np.uint64)
    anchors = S.Anchors()
    tracemalloc.start()
    at, anchor, home = anchors.near(points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert home.sum() == 4096 and len(at) == len(set(zip(at.tolist(), anchor.tolist())))
    assert peak < 150 * len(at)
