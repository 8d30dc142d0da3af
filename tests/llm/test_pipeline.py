"""Stage by stage on sf0.001: each stage's decisions against a version by its definition, on what the stage before kept."""
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tessera.llm import common, toxicity
from tessera.llm.units import load_tokenizer, tokenizer_blob
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, the input first."""
    common.prepare(spark)
    docs = common.read(spark, SF, "documents")
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(common.stage(stage(spark, tables[-1], SF), "test-" + name.split()[0].lower()))
    return tables


def rows(table):
    return [r.asDict() for r in table.collect()]


def test_stages_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights",
                                        "BPE encoding and decoding"]
    for table in stages[:-1]:
        assert table.columns == stages[0].columns


def test_toxicity_keeps_what_scores_below_the_threshold(spark, stages):
    model = toxicity.train(stages[0], common.read(spark, SF, "labels"))
    scores = {r["doc_id"]: r["toxicity"] for r in toxicity.score_texts(stages[0], model, keep=["doc_id"]).collect()}
    want = sorted(i for i, s in scores.items() if s < 0.3)
    assert sorted(r["doc_id"] for r in rows(stages[1])) == want and len(want) < len(scores)
    toxic = {r["doc_id"] for r in common.read(spark, SF, "labels").where("toxic = 1").collect()}
    gone = set(scores) - set(want)
    assert len(gone & toxic) >= 0.8 * len(gone)


def test_exact_dedup_keeps_the_largest_id_of_each_text(stages):
    best = {}
    for r in rows(stages[1]):
        best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(stages[2])) == sorted(best.values())


def test_near_dedup_keeps_the_smallest_id_of_each_group(stages):
    before = rows(stages[2])
    points = np.array([brute_fingerprint(r["text"] or "") for r in before], np.uint64)
    groups = brute_components(points, [r["doc_id"] for r in before])
    assert sorted(r["doc_id"] for r in rows(stages[3])) == sorted(set(groups))


def test_mix_takes_whole_documents_near_the_targets(stages):
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows(stages[3])}
    source = {r["doc_id"]: r["source"] for r in rows(stages[3])}
    taken = Counter(r["doc_id"] for r in rows(stages[4]))
    assert set(taken) <= set(size) and max(taken.values()) <= 2
    sizes = Counter()
    for i, s in size.items():
        sizes[source[i]] += s
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights, want, full = dict(zip(names, [5, 2, 1] * len(names))), 1.5 * sum(sizes.values()), set()
    while True:
        left = want - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * weights[s] / sum(w for t, w in weights.items() if t not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        got = sum(n * size[i] for i, n in taken.items() if source[i] == s)
        assert abs(got - target[s]) <= max(v for i, v in size.items() if source[i] == s)


def test_tokens_are_those_of_the_library(stages):
    tok = load_tokenizer(tokenizer_blob(public_tokenizers.path(P.TOKENIZER)))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(stages[4])}
    out = stages[5].select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in rows(stages[4]))
    for r in out:
        ids = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_gives_the_same(spark, stages):
    got = P.run(spark, SF).select("doc_id", "ids_sha256").groupBy("doc_id", "ids_sha256").count()
    want = stages[5].select("doc_id", "ids_sha256").groupBy("doc_id", "ids_sha256").agg(F.count("*").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
