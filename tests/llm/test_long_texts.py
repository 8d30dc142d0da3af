"""Whole texts of a million characters in one run end in seconds, for every query over documents."""
import time

import pytest

import __spark_entry__ as E
import helpers
from tessera.llm import common, language_id, toxicity
from tessera.llm.token_scores import CACHE_CHARS, TokenScores

import numpy as np

N = 1_000_000
LONG = [" " * N, "a" + "-" * N + "b", "x" * N, "ж" * (N // 2), "word " * (N // 5), "." * N, "a" + " " * N + "b", "\n" * N + "end", "a-" * (N // 2) + "#"]
QUERIES = sorted(n for n in E.queries() if n.startswith("op") and n.split("_")[0] in {"op2", "op4", "op5", "op6", "op7", "op8", "op9", "op11", "op12"})


@pytest.fixture(scope="module")
def long(tmp_path_factory):
    docs = [helpers.doc(i, t, lang=["en", "de"][i % 2]) for i, t in enumerate(LONG)]
    docs += [helpers.doc(100 + i, f"plain words {i} in a text of its own", lang=["en", "de"][i % 2]) for i in range(40)]
    labels = [{"doc_id": 100 + i, "quality": 1, "toxic": i % 2} for i in range(40)]
    return helpers.write_all(tmp_path_factory.mktemp("long"), docs, labels)


@pytest.mark.parametrize("name", QUERIES)
def test_long_runs(spark, long, name):
    start = time.time()
    assert E.queries()[name](spark, long).count() == len(LONG) + 40
    assert time.time() - start < 90


def test_signs_are_no_letters():
    for text in ("²", "½ ①", "", " ", "12 ٣", "…"):
        assert not common.has_letter(text)
    assert common.has_letter("½a") and common.letter_runs("x²y½ ab1c") == ["x", "y", "ab", "c"]


def test_query_marks_signs_as_undetermined(spark, tmp_path):
    docs = [helpers.doc(i, t) for i, t in enumerate(["²", "½", "①②", "words here"])] + [helpers.doc(50 + i, f"some words {i}") for i in range(9)]
    rows = {r["doc_id"]: r for r in E.queries()["op7_language_id"](spark, helpers.write_all(tmp_path, docs)).collect()}
    assert [rows[i]["lang_pred"] for i in range(4)] == ["und", "und", "und", "en"]


def test_edges_are_the_pattern_edges():
    import re
    for t in ("", "__a__", "¡hola!", "-a-b-", "²x½", "...", "İ_", "a"):
        assert toxicity.bare_edges(t) == re.sub(r"^[\W_]+|[\W_]+$", "", t)


def test_caches_are_bounded_in_characters():
    calls = []
    scores = TokenScores(1, lambda ts: calls.append(len(ts)) or np.array([[float(len(t))] for t in ts], np.float32))
    big = "y" * 500
    assert scores(["a", big, "a"])[:, 0].tolist() == [1, 500, 1] and scores([big])[0, 0] == 500 and calls == [2, 1]
    for i in range(CACHE_CHARS // 100 // 1000 + 3):
        scores([f"{i}-{j}".ljust(100, "z") for j in range(1000)])
        assert scores.chars <= CACHE_CHARS + 100_000


def test_another_kind_of_object_evicts_the_first():
    first = common.per_worker(("one", 1), list)
    assert common.per_worker(("one", 1), list) is first
    common.per_worker(("one", 2), list)
    assert common.per_worker(("one", 1), list) is first
    common.per_worker(("two", 1), dict)
    assert [k for k in common._WORKER if k[0] == "one"] == [] and common.per_worker(("one", 1), list) is not first
    assert language_id.has_letter is common.has_letter
