import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from tessera.llm import language_id, toxicity

SF = "/root/testdata/sf0.1"


def test_language_held_out(spark):
    lang = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()}
    rows = E.queries()["op7_language_id"](spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]]["lang"] for r in held]) > 0.99


def test_language_without_letters(spark, odd):
    rows = {r["doc_id"]: r for r in E.queries()["op7_language_id"](spark, odd).collect()}
    for i in (0, 1, 2, 3, 20):          # empty, null, spaces, marks
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert rows[4]["lang_pred"] in ("en", "de")


def test_kneser_ney_sums_to_one():
    words, counts = ["abba", "abc", "cab", "bca"], np.array([3, 2, 1, 4])
    models = language_id.LanguageModels({"x": (words, counts), "y": (["bbb", "acc"], np.array([1, 1]))}, order=3)
    letters = "abc" + language_id._END
    for start in ("", "a", "ab", "cb"):
        def p(c):
            word = start + c
            cut = word[:-1] if c == language_id._END else word
            chars = models.word_costs([cut])[0]
            less = models.word_costs([start])[0]
            return chars, less
        total = np.zeros(2)
        # cost of start + c less that of start, both without the closing mark
        closing = {}
        for c in "abc":
            closing[c] = open_cost(models, start + c) - open_cost(models, start)
            total += np.exp(-closing[c])
        end = models.word_costs([start])[0][:2] - open_cost(models, start)
        total += np.exp(-end)
        alphabet = len(letters) + 1     # one share is left for characters never seen
        assert (total < 1.0 + 1e-5).all() and (total > 1 - 1.5 / alphabet).all(), p


def open_cost(models, word):
    """Cost of the characters of a word without its closing mark."""
    from tessera.llm.token_scores import code_points
    if not word:
        return np.zeros(len(models.langs))
    chars, _, offset = code_points([word], "\x02", "")
    hashes = language_id.ngram_hashes(chars, models.order)
    cost = np.zeros(len(models.langs))
    for i in range(1, len(chars)):
        k = min(models.order, i + 1)
        while True:
            at = language_id._find(models.grams[k - 1], hashes[k - 1][i:i + 1])[0]
            if at >= 0:
                cost -= models.logp[k - 1][at]
                break
            if k == 1:
                cost -= models.unknown
                break
            context = language_id._find(models.context_ids[k - 1], hashes[k - 2][i - 1:i])[0]
            if context >= 0:
                cost -= models.backoff[k - 1][context]
            k -= 1
    return cost


def test_toxicity_held_out(spark):
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = E.queries()["op2_toxicity_svm"](spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    toxic = np.array([r["score"] for r in held if label[r["doc_id"]] == 1])
    clean = np.array([r["score"] for r in held if label[r["doc_id"]] == 0])
    assert (toxic[:, None] > clean[None]).mean() + 0.5 * (toxic[:, None] == clean[None]).mean() > 0.85
    assert (clean >= 0.3).mean() < 0.06


@pytest.fixture(scope="module")
def insult_model():
    rng = np.random.default_rng(9)
    syllables = ["ta", "ri", "no", "me", "lu", "ko", "sha", "ve", "pi", "den"]
    def word():
        return "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(40)]
        if i % 3 == 0:
            words[int(rng.integers(40))] = rng.choice(["blockhead", "nitwit", "dullard", "scoundrel"])
        rows.append((int(i % 3 == 0), i % 5 == 0, " ".join(words) + "."))
    return toxicity.fit(rows, 1 / 3)


def score(model, text):
    from tessera.llm.token_scores import TokenScores
    return float(model.probability(model.decisions(TokenScores(1, model.token_values), [text]))[0])


def test_insults_are_found_whole_gapped_and_with_letters_put_in(insult_model):
    for text in ("ta ri you nitwit no", "nitwit", "NITWIT!!", "a n-i-t-w-i-t here", "d u l l a r d", "nittwit", "scounddrel ta"):
        assert score(insult_model, text) >= 0.3, text
    for text in ("", None, "ta ri no me", "taridenko shave", "x"):
        assert score(insult_model, text) < 0.3, text


def test_kernel_weighs_gaps():
    k = toxicity.LandmarkKernel(["nitwit"])
    same, gap, far = k(["nitwit", "nitxwit", "shadenko"])[:, 0]
    assert same > gap > far
