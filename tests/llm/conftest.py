import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import helpers  # noqa: E402


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    labels = [{"doc_id": i, "quality": None, "toxic": [0, None, 1, 5][i % 4]} for i in range(60)] + [
        {"doc_id": None, "quality": 1, "toxic": 1}, {"doc_id": 200, "quality": 1, "toxic": 1}]
    vectors = [{"vec_id": i, "embedding": [float(i % 7), 1.0, float(i % 3)], "label": None} for i in range(120)] + [
        {"vec_id": 300, "embedding": None, "label": 1}, {"vec_id": 301, "embedding": [0.0, 0.0, 0.0], "label": 1},
        {"vec_id": 302, "embedding": [1.0, None, 2.0], "label": 1}, {"vec_id": 303, "embedding": [1.0, float("nan"), 2.0], "label": 1},
        {"vec_id": 304, "embedding": [1.0, float("inf"), 2.0], "label": 1}, {"vec_id": 305, "embedding": [], "label": 1},
        {"vec_id": 400, "embedding": [1.0, 2.0], "label": 1}, {"vec_id": None, "embedding": [1.0, 1.0, 1.0], "label": 1},
        {"vec_id": 5, "embedding": [5.0, 1.0, 2.0], "label": 1}]
    pages = [{"page_id": i, "url": u, "html": h, "text": "old"} for i, (u, h) in enumerate([
        (None, None), ("http://a.example/x", None), ("odd url", "no markup at all"), ("http://a.example/y", ""),
        ("http://a.example/z", "<p>one<p>two & three &amp; &lt;four&gt;<br>five"), (None, "<div" * 2000), ("http://a.example/d", "<div>" * 3000 + "deep"),
        ("http://a.example/c", "<!-- never closed <p>x</p>"), ("http://a.example/q", "<p title=it's>quote</p><b>b<i>c</b>d")])]
    return helpers.write_all(tmp_path_factory.mktemp("odd"), helpers.odd_documents(), labels, vectors, pages + pages[4:6],
                             helpers.odd_turns())


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return helpers.write_all(tmp_path_factory.mktemp("empty"), [])
