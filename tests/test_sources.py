"""Whole files, nested page annotations, shuffled shards, mergeable states, dense encoders, restartable fits."""
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import encoders
from tessera.operators import assign, kmeans, metrics, prep
from tessera.plans import q_io
from tessera.sources import files, tables

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_one_row_per_file(spark, tmp_path):
    texts = {"business/1.txt": "one\ntwo\n\nthree", "business/2.txt": "\n", "business/3.txt": "", "sport/1.txt": "ends\n", "sport/deep name.txt": "a\r\nb\r\n",
             "tech/1.txt": "é\n\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "tech" / "_hidden").write_text("no")
    rows = files.read_text_files(spark, str(tmp_path))
    got = sorted((r["folder"], r["text"]) for r in rows.collect())
    # the file of no bytes has no row
    assert got == sorted([("business", "one\ntwo\n\nthree"), ("business", ""), ("sport", "ends"), ("sport", "a\r\nb"), ("tech", "é\n")])
    ranked = tables.with_class_rank(rows, "folder", "class_rank")
    assert {(r["folder"], r["class_rank"]) for r in ranked.collect()} == {("business", 1), ("sport", 2), ("tech", 3)}


def test_text_files_are_written_by_many_tasks_and_read_once(spark, tmp_path, monkeypatch):
    reads, real = [], files.read_text_files
    monkeypatch.setattr(files, "read_text_files", lambda *a: reads.append(real(*a)) or reads[-1])
    rows = [{"doc_id": i, "text": f"text\n{i}", "lang": ["de", "en", None][i % 3], "source": "s"} for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = q_io.scan_text_dir(spark, str(tmp_path))
    assert "Format: Text" not in out._jdf.queryExecution().toString() and len(reads) == 1
    assert sorted(map(tuple, out.collect())) == [(1, "class_index=1", 20, 20 * 6 + 16), (2, "class_index=2", 20, 20 * 6 + 17)]
    names = [r["file"].rsplit("/", 1)[1] for r in reads[0].collect()]
    assert len(names) == 40 and len({n.split("-")[1] for n in names}) > 4


def test_text_files_stand_where_the_text_sink_puts_them(spark, tmp_path):
    odd = ["a/b", "c=d", "100%", "", None, "é x", "q?[1]^{2}", "back\\slash:'\"#*"]
    df = spark.createDataFrame([(c, f"t{i}") for i, c in enumerate(odd)], "c string, t string")
    files.write_text_files(df, f"file:{tmp_path}/own", "c", "t")
    files.write_text_files(df, f"file:{tmp_path}/own", "c", "t")
    df.write.partitionBy("c").text(f"{tmp_path}/sink")
    texts = lambda top: sorted((p.parent.name, p.read_bytes()) for p in (tmp_path / top).rglob("part-*.txt"))
    own, sink = texts("own"), texts("sink")
    assert {f for f, _ in own} == {f for f, _ in sink} and len(own) == len(odd)
    assert sorted(t for _, t in own) == [f"t{i}\n".encode() for i in range(len(odd))]


def test_text_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (1, None), (2, "x\n"), (2, " ")], "c int, t string")
    files.write_text_files(df, str(tmp_path / "out"), "c", "t")
    got = sorted((r["folder"], r["text"]) for r in files.read_text_files(spark, str(tmp_path / "out")).collect())
    assert got == [("c=1", ""), ("c=1", "a\nb"), ("c=2", " "), ("c=2", "x\n")]


PAGES = """<pages><page_annotations><page>1</page>
<region><item>0</item><reading_order>b</reading_order><corner><x>1</x><y>2</y></corner><corner><x>9</x><y>2</y></corner><corner><x>9</x><y>8</y></corner><corner><x>1</x><y>8</y></corner></region>
<region><item>1</item><reading_order>a</reading_order><corner><x>5</x><y>5</y></corner><corner><x>6</x><y>5</y></corner><corner><x>6</x><y>7</y></corner></region>
<region><item>2</item><reading_order>b</reading_order><corner><x>0</x><y>0</y></corner><corner><x>0</x><y>0</y></corner><corner><x>3</x><y>4</y></corner></region>
</page_annotations><page_annotations><page>2</page></page_annotations>
<page_annotations><page>3</page><region><reading_order>z</reading_order><corner><x>1</x><y>1</y></corner><corner><x>2</x><y>1</y></corner><corner><x>2</x><y>2</y></corner></region></page_annotations></pages>"""


def test_pages_of_no_one_and_many_regions(spark, tmp_path):
    (tmp_path / "p.xml").write_text(PAGES)
    pages = files.read_page_xml(spark, str(tmp_path))
    assert {r["page"]: len(r["regions"]) for r in pages.collect()} == {1: 3, 2: 0, 3: 1}
    got = sorted(tuple(r) for r in q_io.files_regions(pages).select("page", "pos", "r1", "r2", "r3", "r4", "group_id").collect())
    assert got == [(1, 0, 1, 2, 9, 8, 0), (1, 1, 5, 5, 6, 7, 1), (1, 2, 0, 0, 3, 4, 0), (3, 0, 1, 1, 2, 2, 0)]


@pytest.mark.parametrize("n,shards", [(1, 4), (10, 3), (997, 8)])
def test_shards_are_the_shuffled_order(spark, tmp_path, n, shards):
    df = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t")).repartition(5)
    files.write_shuffled(df, "doc_id", str(tmp_path / "s"), shards)
    back = files.read_shuffled(spark, str(tmp_path / "s"))
    want = {r["doc_id"]: r["pos"] for r in prep.shuffle_order(df, "doc_id").collect()}
    rows = back.collect()
    assert {r["doc_id"]: r["pos"] for r in rows} == want
    assert all(r["goal"] == ("train" if r["pos"] <= int(0.7 * n) else "test") for r in rows)
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") <= 1


def test_states_merge_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), int(rng.integers(0, 4)), float(rng.random()), i % 3) for i in range(200)] + [(200, None, 1, 0.5, 0)]
    df = spark.createDataFrame(rows, "id long, pred int, label int, loss double, part int")
    whole = metrics.clustering_report(df.select("pred", "label")).first().asDict()
    mean = float(np.mean([r[3] for r in rows[:-1]]))
    states = [metrics.metric_state(df.where(F.col("part") == p), "part", df) for p in range(3)]
    for order in ([0, 1, 2], [2, 0, 1]):
        got = metrics.report_from_state(metrics.merge_states(*[states[p] for p in order])).first().asDict()
        assert got.pop("loss") == pytest.approx(mean) and got == pytest.approx(whole)
    twice = metrics.merge_states(metrics.merge_states(states[0], states[2]), states[1])
    assert metrics.report_from_state(twice).first()["ari"] == pytest.approx(whole["ari"])
    path = str(tmp_path / "states")
    for p in (0, 1, 2, 1):          # a part written again takes its own place
        metrics.save_state(states[p], path, "part")
    assert metrics.report_from_state(metrics.merge_states(spark.read.parquet(path))).first()["n"] == 200


def test_projection_keeps_inner_products(spark):
    docs = tables.table(spark, SF, "documents").select("doc_id", "text")
    sparse = {}
    for r in encoders.encode(docs, "tfidf").collect():
        sparse.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for dim in (64, 512):
        dense = {r["doc_id"]: np.array(r["x"]) for r in encoders.embed(docs, "tfidf_projected", dim).collect()}
        assert set(dense) == set(sparse) and all(len(x) == dim for x in dense.values())
        ids = sorted(dense)
        errors = [dense[a] @ dense[b] - sum(w * sparse[b].get(t, 0.0) for t, w in sparse[a].items()) for a in ids[:40] for b in ids if a < b]
        assert abs(np.mean(errors)) < 0.3 / dim ** 0.5 and np.std(errors) <= (2 / dim) ** 0.5


def test_the_long_form_is_not_exchanged_for_frequent_terms(spark, monkeypatch):
    rows = [(1, "a a b"), (1, "b c"), (2, "b  c d\n"), (None, "a e"), (None, "a"), (3, ""), (4, None), (5, "f"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {}
    for i, t in rows:
        for w in re.split(r"\s+", t.strip(" ")) if t else []:
            counts.setdefault(i, Counter())[w] += 1
    idf = {w: math.log((len(rows) + 1) / (sum(w in c for c in counts.values()) + 1)) for c in counts.values() for w in c}
    raw = {(i, w): n * idf[w] for i, c in counts.items() if i is not None for w, n in c.items()}
    norm = {i: math.sqrt(sum(x * x for (j, _), x in raw.items() if j == i)) for i, _ in raw}
    want = {k: x / norm[k[0]] for k, x in raw.items()}

    def got():
        found = encoders.encode(docs, "tfidf")
        return found._jdf.queryExecution().optimizedPlan().toString(), {(r["doc_id"], r["term"]): r["weight"] for r in found.collect()}

    plan, all_broadcast = got()
    assert all_broadcast == pytest.approx(want)
    # terms are met by broadcast alone, and documents, not their terms, meet their norms
    assert plan.count("strategy=broadcast") >= 2 and "count(" not in plan
    monkeypatch.setattr(encoders, "FREQUENT_TERMS", 2)
    monkeypatch.setattr(encoders, "FEW_IDS", 0)
    assert got()[1] == pytest.approx(want)


def test_dense_encoders_by_name(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in encoders.embed(docs, "tf_projected", 16).collect()} == {1, 4}
    with pytest.raises(KeyError):
        encoders.embed(docs, "bert")
    encoders.register_dense("length", lambda d, dim: d.select("doc_id", F.array_repeat(F.length("text").cast("double"), dim).alias("x")))
    try:
        assert encoders.embed(docs, "length", 3).where("doc_id = 1").first()["x"] == [5.0] * 3
    finally:
        del encoders.DENSE_ENCODERS["length"]


def test_a_round_of_the_fit_does_not_make_its_batches_again(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], i % 3) for i in range(24)], "id long, x array<double>, label int")
    batched, protos = q_io._batched(v), assign.class_mean_prototypes(v)
    monkeypatch.setattr(prep, "batches", None)
    m = q_io._batch_acc(batched, protos).first()
    assert 0 < m["acc_batch_mean"] <= 1 and m["loss"] > 0


def test_nearest_compares_in_small_chunks():
    x = np.random.default_rng(1).normal(size=(20000, 64))
    tracemalloc.start()
    near, dist = kmeans.nearest(x, x[:10])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = ((x[:200, None, :] - x[None, :10]) ** 2).sum(axis=2)
    assert (near[:200] == want.argmin(axis=1)).all() and (dist[:200] == want.min(axis=1)).all()
    assert peak < 2 << 20


def test_a_fit_that_was_cut_off_goes_on(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], i % 3) for i in range(30)], "id long, x array<double>, label int")

    def evaluate(protos):
        scored = assign.assign_to_prototypes(v, protos, pred_only=True)
        first = protos.orderBy("q").first()["c"]
        return round(float(sum(first)), 9), scored.where("pred = label").count() / 30

    whole = q_io.fit_rounds(v, evaluate, lambda p, r: None)
    for broken in (0, 2):
        journal, calls = str(tmp_path / f"j{broken}"), []

        def cut(protos):
            if len(calls) == broken:
                raise RuntimeError("lost")
            calls.append(1)
            return evaluate(protos)

        with pytest.raises(RuntimeError):
            q_io.fit_rounds(v, cut, lambda p, r: None, journal=journal)
        assert len(q_io.journal_rounds(spark, journal)) == broken
        again = []
        assert q_io.fit_rounds(v, lambda p: again.append(1) or evaluate(p), lambda p, r: None, journal=journal) == whole
        assert len(again) == len(whole) - broken


def test_saved_prototypes_are_loaded_and_scored(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert q_io.gated_save(spark, SF01, path, threshold=0.0).first()["saved"]
    r = q_io.score_saved(spark, tables.vectors(spark, SF01), path).first()
    assert r["n"] == 500 and round(r["accuracy"] * 500) == 204
