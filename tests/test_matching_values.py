"""Matched pairs, gathered rows and masked L1 sums against an independent solver (subset dynamic programming) and the
definitions, page by page."""
import math

import pytest

from tessera.plans import q_match

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    rows = {}
    for r in q_match.scored_pages(spark, SF).select("page", "label", "pred", "qs", "cos").collect():
        rows.setdefault(r["page"], []).append(r)
    return rows


def costs(rows):
    """(cell costs {(q, j): (cosine, class, paragraph)}, absent costs {q: ...}, share of paragraphs predicted q)."""
    qs = rows[0]["qs"]
    labels = sorted({r["label"] for r in rows})
    soft = []
    for r in rows:
        e = [math.exp(c - max(r["cos"])) for c in r["cos"]]
        soft.append([x / sum(e) for x in e])
    cells, absent, share = {}, {}, {}
    for i, q in enumerate(qs):
        share[q] = sum(r["pred"] == q for r in rows) / len(rows)
        absent[q] = (sum(abs(r["cos"][i] + 1) for r in rows), 2 * share[q], sum(p[i] for p in soft))
        for j in labels:
            cells[q, j] = (sum(abs(r["cos"][i] - (1 if r["label"] == j else -1)) for r in rows), 2 * abs(share[q] - 1),
                           sum(abs(p[i] - (r["label"] == j)) for p, r in zip(soft, rows)))
    return qs, labels, cells, absent, share


def optimum(qs, labels, cells, absent):
    """Smallest total when each article is matched once and every other q counts as absent."""
    best = {0: 0.0}
    for q in qs:
        after = {m: c + absent[q][0] + absent[q][1] for m, c in best.items()}
        for m, c in best.items():
            for b, j in enumerate(labels):
                if not m >> b & 1:
                    total = c + cells[q, j][0] + cells[q, j][1]
                    after[m | 1 << b] = min(after.get(m | 1 << b, math.inf), total)
        best = after
    return best[(1 << len(labels)) - 1]


@pytest.fixture(scope="module")
def pairs(spark):
    found = {}
    for r in q_match.match_pairs(spark, SF).collect():
        found.setdefault(r["page"], []).append(r)
    return found


def test_pairs_are_an_optimal_matching(pages, pairs):
    assert set(pairs) == set(pages)
    for page, rows in pages.items():
        qs, labels, cells, absent, _ = costs(rows)
        mine = {r["q"]: r["j"] for r in pairs[page]}
        assert len(mine) == len(pairs[page]) and sorted(mine.values()) == labels
        total = sum(sum(cells[q, mine[q]][:2]) if q in mine else sum(absent[q][:2]) for q in qs)
        assert total == pytest.approx(optimum(qs, labels, cells, absent), abs=1e-6)
        for r in pairs[page]:
            assert r["value"] == pytest.approx(sum(cells[r["q"], r["j"]][:2]), abs=1e-6)


def test_gathered_rows_are_those_of_the_matched_article(spark, pages, pairs):
    got = {(r["page"], r["q"]): (r["j"], r["n_paras"]) for r in q_match.gather_matched(spark, SF).collect()}
    want = {(page, r["q"]): (r["j"], sum(x["label"] == r["j"] for x in pages[page])) for page, rs in pairs.items() for r in rs}
    assert got == want


def test_masked_sums_after_matching(spark, pages, pairs):
    for r in q_match.matched_l1(spark, SF).collect():
        qs, labels, cells, absent, share = costs(pages[r["page"]])
        mine = {p["q"]: p["j"] for p in pairs[r["page"]]}
        of = {q: cells[q, mine[q]] if q in mine else absent[q] for q in qs}
        assert r["class_l1"] == pytest.approx(sum(of[q][1] * (1 if q in mine else 0.1) for q in qs), abs=1e-6)
        assert r["para_l1"] == pytest.approx(sum(of[q][2] for q in qs), abs=1e-6)
        assert r["cos_l1"] == pytest.approx(sum(of[q][0] for q in qs if share[q] > 1 - share[q]), abs=1e-6)
