import hashlib
from collections import defaultdict

import __spark_entry__ as E
from helpers import odd_documents
from tessera.llm import exact_dedup


def test_groups_match_brute_force(spark, odd):
    groups = defaultdict(list)
    for d in odd_documents():
        groups[d["text"] or ""].append(d["doc_id"])
    rows = E.queries()["op6_exact_dedup"](spark, odd).collect()
    by_text = defaultdict(list)
    for r in rows:
        by_text[r["text_sha256"]].append(r)
    assert len(by_text) == len(groups)
    for text, ids in groups.items():
        mine = by_text[hashlib.sha256(text.encode()).hexdigest()]
        best = max((i for i in ids if i is not None), default=None)
        assert {r["keep_id"] for r in mine} == {best}
        assert {r["group_size"] for r in mine} == {len(ids)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [best]      # one row, though ids repeat


def test_dedup_keeps_columns_and_one_row_a_text(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({d["text"] or "" for d in odd_documents()})


def test_levels_merge_to_one_entry(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    rows = exact_dedup.exact_groups(docs).where("kept").collect()
    assert sorted(r["keep_id"] for r in rows) == list(range(4993, 5000))


def test_native_plan(spark, odd):
    plan = E.queries()["op6_exact_dedup"](spark, odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
