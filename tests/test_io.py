"""Encoders by name, the gated save, text folders, malformed CSV rows."""
import os

import pytest

from tessera.functions.encoders import encode
from tessera.plans import q_io
from tessera.sources import files

SF = "/root/testdata/sf0.001"


def test_unknown_encoder(spark):
    with pytest.raises(KeyError):
        encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "bert")


def test_tfidf_values(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in encode(docs, "tf").collect()}
    assert got == pytest.approx({(1, "a"): 2 / 5 ** 0.5, (1, "b"): 1 / 5 ** 0.5, (2, "b"): 0.5 ** 0.5, (2, "c"): 0.5 ** 0.5})
    assert sum(r["weight"] ** 2 for r in encode(docs, "tfidf").collect()) == pytest.approx(2.0)


def test_gate_opens_and_stays_shut(spark, tmp_path):
    shut, opened = str(tmp_path / "shut"), str(tmp_path / "open")
    assert not q_io.gated_save(spark, SF, shut, threshold=1.0).first()["saved"] and not os.path.exists(shut)
    assert q_io.gated_save(spark, SF, opened, threshold=0.0).first()["saved"]
    assert spark.read.parquet(opened).count() > 0


def test_malformed_csv_row_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nnot a number,3\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "x.csv"), "a INT, b INT").collect()


def test_plateau_rule_halves_and_stops(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 3) for i in range(12)], "id long, x array<double>, label int")
    losses, kept = iter([3.0, 2.0, 2.0, 2.0, 2.0, 1.0, 1.0, 1.0, 1.0]), []
    rows = q_io.fit_rounds(v, lambda p: (next(losses), 0.9), lambda p, r: kept.append(r))
    assert [r[4] for r in rows] == [1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 0.25]
    assert kept == list(range(9))


def test_strict_concat_fails_on_null(spark):
    from tessera.functions import text as T
    df = spark.createDataFrame([("a", "b"), ("a", None)], "t string, d string")
    assert df.limit(1).select(T.compose_text_strict("t", "d").alias("x")).first()["x"] == "a b"
    with pytest.raises(Exception):
        df.select(T.compose_text_strict("t", "d").alias("x")).collect()


def test_matched_l1_terms(spark):
    from tessera.plans.q_match import filter_pred_article, matched_l1
    rows = matched_l1(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 44 and all(sum(r[c] for r in rows) > 0 for c in ("class_l1", "para_l1", "cos_l1"))
    assert filter_pred_article(spark, "/root/testdata/sf0.01").count() > 0


def test_staged_tables_are_removed_when_told(spark):
    from tessera.session import discard, materialize
    first = materialize(spark.range(10), "x")
    path = first._staged_path
    second = materialize(first.selectExpr("id * 2 AS id"), "x")
    discard(first.where("id > 3"))      # derived tables own nothing
    assert files.exists(spark, path)
    discard(first)
    discard(first)
    assert not files.exists(spark, path) and second.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
