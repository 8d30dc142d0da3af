"""Toxicity by a support vector machine on a gapped-subsequence string kernel with Nystroem landmarks.

Units are words (runs of spaced-out single letters are one unit; very long words are cut into overlapping
windows). The kernel of two units counts common subsequences of ``LENGTH`` characters that span at most
``SPAN``, each weighted by DECAY ** span on either side, so inserted characters and gaps lower a match but
do not break it. A unit's feature map is its kernel with the landmark units, whitened by the landmarks' kernel
matrix (Nystroem). A sentence is as toxic as its worst unit, a document as its worst sentence.

Training is that of a multiple-instance SVM on labelled sentences: a sentence of a toxic document is explained
by one witness unit, every unit of the other documents' sentences is a counter-example; witnesses also train with a letter put in or doubled. Rounds alternate a
squared-hinge SVM with a new choice of witnesses (sentences that show none are left out) and of the hardest
counter-examples. The decision becomes a probability by a logistic fit on documents the SVM has not seen.

As the decision is linear in the kernel, landmarks fold into one weight per subsequence: a unit's value is the
weighted sum over its own subsequences, computed once per worker and kept in a bounded cache.

Learned from at most ``DOCS_PER_CLASS`` labelled documents a class (first by a hash of the id, whole texts):
folds 0 and 1 train, fold 3 calibrates; held-out fold 2 is never read, and labels, lang, source and ids are
never inputs of a score.

Defined cases: a null or empty text, or one without a word, scores the probability of a text without any sign;
rows without a label are not learned from; without both classes every score is 0; an empty table gives an empty
result.
"""
from __future__ import annotations

import itertools
import re
import uuid
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ddl, fold, held_out, learnable, per_worker, prepare, read, slices
from tessera.llm.registry import query
from tessera.llm.token_scores import TokenScores, code_points

LENGTH, SPAN, DECAY = 4, 7, 0.8
DOCS_PER_CLASS = 2000
TOXIC_LANDMARKS, OTHER_LANDMARKS = 160, 64
ROUNDS = 5
DISGUISE_WEIGHT = 0.2       # of a disguised witness in training
COST = 10.0
HARD_UNITS, OTHER_UNITS = 3_000, 5_000      # counter-examples: hardest of each round, drawn once
THRESHOLD = 0.3
_LONG, _STRIDE = 32, 16
_SPACED = re.compile(r"(?<!\S)\w(?:[ ._*-]\w){2,}(?![^\s.,;:!?])")
_SENTENCE = re.compile(r"[.!?]+(?=\s|\Z)|\n+")
_INSIDE = re.compile(r"[\W\d_]+")
# offsets of the characters of a subsequence, and its span
_SHAPES = [(0, *rest) for rest in itertools.combinations(range(1, SPAN), LENGTH - 1)]


def tokens(text: str | None) -> list[str]:
    """White-space tokens; letters that stand alone in a row are one token."""
    return _SPACED.sub(lambda m: re.sub(r"[ ._*-]", "-", m[0]), text or "").split()


def bare_edges(token: str) -> str:
    """``token`` without the marks at its ends."""
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    return token[start:end]


def token_units(token: str) -> list[str]:
    """The units of one token; with and without marks and digits inside it."""
    unit = bare_edges(token.lower())
    if len(unit) > _LONG:
        return [unit[i:i + _LONG] for i in range(0, len(unit) - _STRIDE, _STRIDE)]
    bare = _INSIDE.sub("", unit)
    return [u for u in (unit, bare if bare != unit and len(bare) >= LENGTH else "") if u]


def subsequences(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: (unit index, code of the subsequence, weight) of all its places. Units carry edge marks."""
    chars, unit, offset = code_points(units, "^", "$")
    sizes = np.bincount(unit, minlength=len(units))
    left = sizes[unit] - offset
    c = chars.astype(np.uint64) & np.uint64(0xFFFF)
    for shape in _SHAPES:
        at = np.flatnonzero(left > shape[-1])
        code = np.zeros(len(at), np.uint64)
        for step in shape:
            code = (code << np.uint64(16)) | c[at + step]
        yield unit[at], code, DECAY ** (shape[-1] + 1)


def norms(units: list[str]) -> np.ndarray:
    """Length of each unit's feature vector, repeated subsequences taken as different."""
    sizes = np.array([len(u) + 2 for u in units], np.float64)
    square = np.zeros(len(units))
    for shape in _SHAPES:
        square += np.maximum(0, sizes - shape[-1]) * DECAY ** (2 * (shape[-1] + 1))
    return np.sqrt(np.maximum(square, 1e-12))


class SubsequenceTable:
    """Sorted subsequence codes with a bitmap that sorts out most others before the binary search."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self._slot(codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def matches(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(unit index, index of the code, weight) of the subsequences in the table."""
        for unit, code, weight in subsequences(units):
            maybe = np.flatnonzero(self.bits[self._slot(code)])
            unit, code = unit[maybe], code[maybe]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            yield unit[hit], at[hit], weight


class LandmarkKernel:
    """Kernel of units with fixed landmark units."""

    def __init__(self, landmarks: list[str]):
        found = [(u, c, np.full(len(u), w)) for u, c, w in subsequences(landmarks)]
        unit, code, weight = (np.concatenate(x) for x in zip(*found))
        self.table = SubsequenceTable(np.unique(code))
        self.weights = np.zeros((len(self.table.codes), len(landmarks)), np.float32)
        np.add.at(self.weights, (np.searchsorted(self.table.codes, code), unit), weight / norms(landmarks)[unit])

    def __call__(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.weights.shape[1]), np.float32)
        for unit, at, weight in self.table.matches(units):
            if len(unit):       # units come in order
                starts = np.flatnonzero(np.diff(unit, prepend=-1))
                out[unit[starts]] += np.add.reduceat(self.weights[at], starts, axis=0) * np.float32(weight)
        return out / norms(units)[:, None].astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (bias last, unpenalised almost) of a linear squared-hinge SVM, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    penalty = np.ones(x.shape[1])
    penalty[-1] = 1e-3
    w, margin = np.zeros(x.shape[1]), y * 0.0

    def cost(w: np.ndarray, margin: np.ndarray) -> float:
        return float(penalty @ (w * w) + weight @ np.maximum(0, 1 - margin) ** 2)

    now = cost(w, margin)
    for _ in range(100):
        active = margin < 1
        xa, wa = x[active].astype(np.float64), weight[active]
        step = np.linalg.solve(np.diag(penalty) + (xa * wa[:, None]).T @ xa, xa.T @ (wa * y[active])) - w
        along, t = y * (x @ step), 1.0
        while t > 1e-6 and (after := cost(w + t * step, margin + t * along)) > now:
            t /= 2
        if t <= 1e-6 or now - after < 1e-7 * now:
            break
        w, margin, now = w + t * step, margin + t * along, after
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit in one variable, lightly penalised."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2),
                               a.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


class Matched:
    """The matches of many units with a table, found once, for values under changing weights."""

    def __init__(self, table: SubsequenceTable, units: list[str], block: int = 20_000):
        self.parts = [(slice(first, first + block), u.astype(np.int32), a.astype(np.int32), w)
                      for first in range(0, len(units), block) for u, a, w in table.matches(units[first:first + block])]
        self.norms = norms(units)

    def values(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.norms))
        for where, unit, at, weight in self.parts:
            out[where] += weight * np.bincount(unit, weights[at], len(out[where]))
        return out / self.norms


class ToxicityModel:
    """One weight per subsequence, a bias and the logistic calibration."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float):
        self.table, self.weights, self.bias = SubsequenceTable(codes), weights, bias
        self.slope, self.offset = 1.0, 0.0

    def unit_values(self, units: list[str]) -> np.ndarray:
        out = np.zeros(len(units))
        for unit, at, weight in self.table.matches(units):
            out += weight * np.bincount(unit, self.weights[at], len(units))
        return out / norms(units)

    def token_values(self, found: list[str]) -> np.ndarray:
        """The largest unit value of each token, as a column (0 without a unit)."""
        units = [token_units(t) for t in found]
        flat = [u for us in units for u in us]
        out = np.zeros((len(found), 1), np.float32)
        if flat:
            np.maximum.at(out[:, 0], np.repeat(np.arange(len(found)), [len(u) for u in units]), self.unit_values(flat))
        return out

    def decisions(self, scores: TokenScores, texts: list[str | None]) -> np.ndarray:
        """Decision of each text's worst unit."""
        split = [tokens(t) + [""] for t in texts]
        values = scores([t for s in split for t in s])[:, 0].astype(np.float64)
        starts = np.cumsum([0] + [len(s) for s in split[:-1]])
        return np.maximum.reduceat(values, starts) + self.bias

    def probability(self, decisions: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decisions + self.offset, -30, 30)))


def disguised(unit: str, seed: int, times: int = 2) -> list[str]:
    """The unit with a letter put in or doubled, at places drawn from ``seed``."""
    rng = np.random.default_rng([seed, len(unit)])
    out = []
    for k in range(times):
        at = int(rng.integers(1, len(unit))) if len(unit) > 1 else 1
        out.append(unit[:at] + (unit[at - 1] if k % 2 else "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]) + unit[at:])
    return out


def pick_landmarks(gain: dict[str, float], clean: Counter) -> list[str]:
    """Units that mark toxic documents most, and the most common units of the others."""
    long_enough = [u for u in gain if gain[u] > 0 and len(u) >= LENGTH - 1]
    chosen = sorted(long_enough, key=lambda u: (-gain[u], u))[:TOXIC_LANDMARKS]
    common = sorted((u for u in clean if u not in set(chosen) and len(u) >= LENGTH - 1), key=lambda u: (-clean[u], u))
    return chosen + common[:OTHER_LANDMARKS]


def fit(rows: list[tuple[int, bool, str]], prior: float) -> ToxicityModel | None:
    """Model from (toxic, calibrates, text); ``prior`` is the share of toxic documents among the labelled."""
    learn = [(y, t) for y, c, t in rows if not c]
    if len({y for y, _ in learn}) < 2:
        return None
    marked, clean, sentences = Counter(), Counter(), []
    for y, text in learn:
        own = set()
        for sentence in _SENTENCE.split(text):
            units = {u for t in tokens(sentence) for u in token_units(t)}
            own |= units
            if y and units:
                sentences.append(sorted(units))
        (marked if y else clean).update(own)
    n_toxic = sum(y for y, _ in learn)
    n_clean = len(learn) - n_toxic
    gain = {u: n * np.log((n + 0.1) / (n_toxic + 1) * (n_clean + 1) / (clean[u] + 0.1)) for u, n in marked.items()}
    landmarks = pick_landmarks(gain, clean)
    if not landmarks or not clean:
        return None
    kernel = LandmarkKernel(landmarks)
    value, vector = np.linalg.eigh(kernel(landmarks).astype(np.float64))
    kept = value > 1e-3 * value.max()
    whiten = vector[:, kept] / np.sqrt(value[kept])
    seen, others = sorted(marked), sorted(clean)
    number = {u: i for i, u in enumerate(seen)}
    often = np.array([clean[u] for u in others], np.float64)
    inside = [np.array([number[u] for u in us]) for us in sentences]
    # first witnesses: units of several toxic documents and no other (copies share rare words, so one or two won't do)
    several = max(3, n_toxic // 200)
    f_seen = np.array([gain[u] if marked[u] >= several and clean[u] == 0 else 0.0 for u in seen])
    in_seen, in_others = Matched(kernel.table, seen), Matched(kernel.table, others)
    f_others = in_others.values(kernel.weights[:, :TOXIC_LANDMARKS].sum(axis=1))
    mix = np.random.default_rng(1).permutation(len(others))[:OTHER_UNITS]
    model, hard = None, np.sort(mix)
    for _ in range(ROUNDS):
        best = [us[np.argmax(f_seen[us])] for us in inside]
        witness = Counter(int(i) for i in best if f_seen[i] > 0)
        if not witness:
            break
        names = sorted(witness)
        # those of earlier rounds stay
        hard = np.union1d(hard, np.argsort(-f_others, kind="stable")[:HARD_UNITS])
        shown = [seen[i] for i in names]
        bent = [v for i in names if witness[i] >= several for v in disguised(seen[i], i) if v not in clean]
        x = kernel(shown + bent + [others[i] for i in hard]) @ whiten.astype(np.float32)
        y = np.concatenate([np.ones(len(shown) + len(bent)), -np.ones(len(hard))])
        times = np.concatenate([np.sqrt([witness[i] for i in names]), np.full(len(bent), DISGUISE_WEIGHT)])
        total = max(len(times), 0.2 * np.sqrt(often[hard]).sum())
        weight = COST * np.concatenate([times / times.sum() * total, np.sqrt(often[hard])])
        w = svm(x, y, weight)
        model = ToxicityModel(kernel.table.codes, kernel.weights @ (whiten @ w[:-1]), float(w[-1]))
        f_seen, f_others = in_seen.values(model.weights) + model.bias, in_others.values(model.weights) + model.bias
    if model is None:
        return None
    held = [(y, t) for y, c, t in rows if c] or learn
    d = model.decisions(TokenScores(1, model.token_values), [t for _, t in held])
    y = np.array([y for y, _ in held], float)
    weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
    model.slope, model.offset = logistic(d, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = DOCS_PER_CLASS) -> ToxicityModel | None:
    """Model from at most ``per_class`` labelled documents of each class."""
    known = (labels.where(learnable(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col)
             .agg(F.max(label_col).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}      # two rows
    first = F.xxhash64(F.lit(3), id_col)
    chosen = known.where("toxic = 1").orderBy(first, id_col).limit(per_class).unionByName(
        known.where("toxic = 0").orderBy(first, id_col).limit(per_class))
    texts = docs.select(id_col, F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    # of rows that repeat an id the first text counts
    rows = (texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "toxic").agg(F.min("text").alias("text"))
            .select("toxic", (fold(id_col) == 3).alias("calibrates"), "text", F.col(id_col).alias("_id"))
            .orderBy("_id").collect())
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return fit([(r["toxic"], r["calibrates"], r["text"]) for r in rows], prior)


def score_texts(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text",
                keep: list[str] | None = None, out: str = "toxicity") -> DataFrame:
    """Columns ``keep`` (all by default) and ``out``, the score of each whole text."""
    spark = docs.sparkSession
    prepare(spark)
    keep = docs.columns if keep is None else keep
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker(("toxicity", key), lambda: sent.value and (sent.value, TokenScores(1, sent.value.token_values)),
                         keep=1)
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            p = own[0].probability(own[0].decisions(own[1], texts)) if own else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(p)], [*keep, out])

    columns = [F.col(f"`{c}`") for c in keep]
    # a text that is kept goes to the workers once
    at = keep.index(text_col) if text_col in keep else len(keep)
    rows = docs.select(*columns) if at < len(keep) else docs.select(*columns, F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(run, ddl(docs, keep) + f", `{out}` double")


def drop_toxic(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    return score_texts(docs, model, out="_toxicity_score").where(F.col("_toxicity_score") < threshold).select(
        *[F.col(f"`{c}`") for c in docs.columns])


@query("op2_toxicity_svm")
def op2_toxicity_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of the other folds."""
    docs = read(spark, sf_dir, "documents")
    prepare(spark)
    scored = score_texts(docs, train(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
