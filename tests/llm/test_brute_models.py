"""The kernel, the Kneser-Ney models and the pivotal rounding against versions by their definitions."""
import itertools
import math

import numpy as np
import pytest

import __spark_entry__ as E
from tessera.llm import common, language_id, mixing, toxicity as X

SF = "/root/testdata/sf0.001"
UNITS = ["idiot", "idi0t", "i-d-i-o-t", "moron", "abba", "ab", "naïveté", "xyxyxyxy", "日本語テキスト"]


def occurrences(unit):
    """(subsequence, weight) of all places: LENGTH characters within SPAN, by nested choice of positions."""
    text = f"^{unit}$"
    for at in itertools.combinations(range(len(text)), X.LENGTH):
        span = at[-1] - at[0] + 1
        if span <= X.SPAN:
            yield "".join(text[i] for i in at), X.DECAY ** span


def length(unit):
    return math.sqrt(max(1e-12, sum(w * w for _, w in occurrences(unit))))


def kernel(a, b):
    return sum(v * w for s, v in occurrences(a) for t, w in occurrences(b) if s == t) / (length(a) * length(b))


def recursion(a, b):
    """The same sum by recursion over prefixes: K(i, j, n) adds the pairs of places that end at a[i] and b[j]."""
    a, b = f"^{a}$", f"^{b}$"
    total = 0.0
    for i0 in range(len(a)):
        for j0 in range(len(b)):
            if a[i0] != b[j0]:
                continue
            ways = {(i0, j0): 1.0}      # of the first n characters, begun at (i0, j0)
            for _ in range(X.LENGTH - 1):
                longer = {}
                for (i, j), n in ways.items():
                    for i2 in range(i + 1, min(len(a), i0 + X.SPAN)):
                        for j2 in range(j + 1, min(len(b), j0 + X.SPAN)):
                            if a[i2] == b[j2]:
                                longer[i2, j2] = longer.get((i2, j2), 0.0) + n
                ways = longer
            total += sum(n * X.DECAY ** (i - i0 + 1 + j - j0 + 1) for (i, j), n in ways.items())
    return total


def test_kernel_equals_its_definition():
    landmarks = ["idiot", "stupid", "abab", "日本語テ"]
    got = X.LandmarkKernel(landmarks)(UNITS)
    for u, row in zip(UNITS, got):
        for m, v in zip(landmarks, row):
            assert v == pytest.approx(kernel(u, m), abs=1e-6)
            assert kernel(u, m) == pytest.approx(recursion(u, m) / (length(u) * length(m)), abs=1e-9)


def test_folded_weights_are_kernel_times_weights():
    landmarks = ["idiot", "stupid", "moron", "harmless"]
    k = X.LandmarkKernel(landmarks)
    coef = np.array([1.0, -0.5, 0.7, -2.0])
    model = X.ToxicityModel(k.table.codes, k.weights @ coef, 0.25)
    want = [sum(c * kernel(u, m) for c, m in zip(coef, landmarks)) for u in UNITS]
    assert model.unit_values(UNITS) == pytest.approx(want, abs=1e-6)


def test_query_scores_are_those_of_the_worst_unit(spark):
    docs = common.read(spark, SF, "documents")
    model = X.train(docs, common.read(spark, SF, "labels"))
    weights = dict(zip(model.table.codes.tolist(), model.weights.tolist()))

    def code(s):
        out = 0
        for c in s:
            out = out << 16 | ord(c) & 0xFFFF
        return out

    def value(unit):
        return sum(w * weights.get(code(s), 0.0) for s, w in occurrences(unit)) / length(unit)

    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] and len(r["text"]) < 900}
    got = {r["doc_id"]: r["score"] for r in E.queries()["op2_toxicity_svm"](spark, SF).collect()}
    assert len(texts) > 10
    for i, text in list(texts.items())[:25]:
        units = {u for t in X.tokens(text) for u in X.token_units(t)}
        decision = max([0.0, *map(value, units)]) + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * decision + model.offset))), abs=1e-5)


class Brute:
    """Interpolated Kneser-Ney over characters of words, from dictionaries."""

    def __init__(self, words, order, alphabet):
        self.order, self.alphabet = order, alphabet
        raw, starts = {}, set()
        for word, n in words.items():
            text = language_id._BEGIN + word + language_id._END
            for k in range(1, order + 1):
                for end in range(max(1, k - 1), len(text)):
                    gram = text[end - k + 1:end + 1]
                    raw[gram] = raw.get(gram, 0) + n
                    if end == k - 1:
                        starts.add(gram)
        count = {}
        for gram in raw:
            k = len(gram)
            before = len({g for g in raw if len(g) == k + 1 and g[1:] == gram}) if k < order else 0
            count[gram] = max(1, raw[gram] if k == order or k > 1 and gram in starts else before)
        self.count, self.discount = count, {}
        for k in range(1, order + 1):
            ones, twos = (sum(1 for g, c in count.items() if len(g) == k and c == n) for n in (1, 2))
            self.discount[k] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))

    def chance(self, context, c):
        """Of ``c`` after ``context``, at most order - 1 characters."""
        k = len(context) + 1
        lower = self.chance(context[1:], c) if k > 1 else 1 / self.alphabet
        same = [n for g, n in self.count.items() if len(g) == k and g[:-1] == context]
        if not same:
            return lower
        own = self.count.get(context + c)
        return (max(0.0, own - self.discount[k]) if own else 0.0) / sum(same) + self.discount[k] * len(same) / sum(same) * lower

    def cost(self, word):
        text = language_id._BEGIN + word + language_id._END
        return -sum(math.log(self.chance(text[max(0, i - self.order + 1):i], text[i])) for i in range(1, len(text)))


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_language_models_equal_their_definition(order):
    by = {"x": {"abba": 3, "abc": 2, "cab": 1, "bca": 4, "a": 9}, "y": {"bbb": 1, "acc": 1, "dada": 6}, "z": {"é": 2}}
    models = language_id.LanguageModels({k: (sorted(w), np.array([w[v] for v in sorted(w)])) for k, w in by.items()}, order)
    alphabet = len(set("".join("".join(w) for w in by.values()))) + 2
    words = ["abba", "ab", "dad", "zzz", "é", "abcabc", "bbbb"]
    got = models.word_costs(words)
    for j, lang in enumerate(models.langs):
        brute = Brute(by[lang], order, alphabet)
        for w, row in zip(words, got):
            assert row[j] == pytest.approx(brute.cost(w), rel=1e-4)
    assert got[:, -1].tolist() == [len(w) + 1 for w in words]


def branches(sizes, mass):
    """(probability, draws) of all runs: a draw of 0 lets the held document gain, one next to 1 lets it lose."""
    def walk(i, held, cap, p, draws):
        if i == len(sizes):
            yield p, draws
            return
        if held is None:
            yield from walk(i + 1, mass[i], sizes[i], p, [*draws, 0.5])
            return
        gain, loss = min(cap - held, mass[i]), min(held, sizes[i] - mass[i])
        up = loss / (gain + loss)
        # the held one gains
        if gain < cap - held:
            after = (held + gain, cap)
        else:
            after = (None, 0) if gain == mass[i] else (mass[i] - gain, sizes[i])
        yield from walk(i + 1, *after, p * up, [*draws, 0.0])
        full = loss == sizes[i] - mass[i]
        if loss < held:
            after = (held - loss, cap)
        else:
            after = (None, 0) if full else (mass[i] + loss, sizes[i])
        yield from walk(i + 1, *after, p * (1 - up), [*draws, 1 - 1e-12])
    yield from walk(0, None, 0, 1.0, [])


def test_pivotal_rounding_enumerated():
    rng = np.random.default_rng(7)
    for _ in range(20):
        n = int(rng.integers(1, 8))
        sizes = rng.integers(1, 20, n)
        mass = sizes * rng.integers(1, 8, n) / 8.0
        mean, whole = np.zeros(n), 0.0
        for p, draws in branches(sizes.tolist(), mass.tolist()):
            taken, at, held = mixing.pivotal(sizes, mass, np.array(draws))
            words = (taken * sizes).astype(float)
            if at >= 0:
                words[at] = held
            assert words.sum() == pytest.approx(mass.sum()) and set(taken.tolist()) <= {0, 1}
            mean, whole = mean + p * words, whole + p
        assert whole == pytest.approx(1) and mean == pytest.approx(mass)
