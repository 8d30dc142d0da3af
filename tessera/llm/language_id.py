"""Language identification with interpolated Kneser-Ney character models.

Each language gets a character model of order ``ORDER`` over words (a word begins and ends with a mark;
contexts do not cross words, so a word's cost is the same wherever it stands and a worker computes it once).
Models live in sorted arrays of 64-bit n-gram hashes, found by binary search, with one column per language:
log probability where any language has the n-gram, back-off weight where one has the context. The language of
a text is that of the lowest cross-entropy per character over the whole text; ``rejected`` marks texts whose
cross-entropy is above what ``KEEP_SHARE`` of that language's calibration texts reach.

Learned from at most about ``DOCS_PER_LANG`` documents a language and ``TRAIN_DOCS`` of all (chosen by a hash of the id, whole texts):
folds 0 and 1 give the counts, fold 3 the rejection limits; held-out fold 2 is never read.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows without a language are not
learned from; without any learned language all are ``und``; ties go to the first language in order.
"""
from __future__ import annotations

import uuid
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ddl, fold, has_letter, held_out, learnable, letter_runs, per_worker, prepare, read, slices
from tessera.llm.registry import query
from tessera.llm.token_scores import TokenScores, code_points

ORDER = 5
DOCS_PER_LANG = 600
TRAIN_DOCS = 60_000         # of all languages together
KEEP_SHARE = 0.999
SCORE_CHARS = 50            # characters at most that sharpen the score
_BEGIN, _END = "\x02", "\x03"


def ngram_hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """For each k up to ``order``, a hash of the k characters that end at each position (valid from offset k - 1)."""
    out, h = [], np.zeros(len(chars), np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)
    c = chars.astype(np.uint64) + np.uint64(1)
    for k in range(order):
        shifted = np.zeros_like(c)
        shifted[k:] = c[:max(0, len(c) - k)]
        h = (h ^ (shifted * np.uint64(0xC2B2AE3D27D4EB4F))) * mix
        h ^= h >> np.uint64(29)
        out.append(h.copy())
    return out


class KneserNey:
    """One language: arrays per order k of n-gram hash, its context and suffix hashes, probability; and back-off by context."""

    def __init__(self, words: list[str], counts: np.ndarray, order: int, alphabet: int):
        chars, word, offset = code_points(words, _BEGIN, _END)
        hashes = ngram_hashes(chars, order)
        weight = np.asarray(counts, np.float64)[word]
        found = []
        for k in range(1, order + 1):
            at = np.flatnonzero((offset >= 1) & (offset >= k - 1))
            grams, first, inverse = np.unique(hashes[k - 1][at], return_index=True, return_inverse=True)
            found.append((grams, at[first], np.bincount(inverse, weight[at], len(grams))))
        self.grams, self.contexts, self.suffixes, self.logp, self.context_ids, self.backoff = [], [], [], [], [], []
        below = None
        for k in range(1, order + 1):
            grams, at, raw = found[k - 1]
            count = raw
            if k < order:       # distinct characters before it, but for those that begin a word
                longer = found[k][1]
                preceded = np.bincount(np.searchsorted(grams, hashes[k - 1][longer]), minlength=len(grams))
                count = np.where(offset[at] == k - 1, raw, preceded) if k > 1 else preceded.astype(float)
                count = np.maximum(count, 1.0)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            context = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(grams), np.uint64)
            ids, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, count, len(ids))
            backoff = discount * np.bincount(inverse, minlength=len(ids)) / total
            suffix = hashes[k - 2][at] if k > 1 else context
            lower = below[1][np.searchsorted(below[0], suffix)] if k > 1 else 1.0 / alphabet
            p = (count - discount) / total[inverse] + backoff[inverse] * lower
            below = (grams, p)
            self.grams.append(grams)
            self.contexts.append(context)
            self.suffixes.append(suffix)
            self.logp.append(np.log(p))
            self.context_ids.append(ids)
            self.backoff.append(np.log(backoff))


def _find(array: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, -1 where it isn't there."""
    if not len(array):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(array, values), len(array) - 1)
    return np.where(array[at] == values, at, -1)


class LanguageModels:
    """The models of all languages over shared sorted hash arrays."""

    def __init__(self, by_lang: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER):
        self.langs, self.order = sorted(by_lang), order
        alphabet = len(set().union(*[set("".join(w)) for w, _ in by_lang.values()])) + 2
        models = [KneserNey(*by_lang[x], order, alphabet) for x in self.langs]
        self.unknown = np.array([m.backoff[0][0] - np.log(alphabet) for m in models], np.float32)
        self.grams, self.logp, self.context_ids, self.backoff = [], [], [], []
        for k in range(order):
            ids = np.unique(np.concatenate([m.context_ids[k] for m in models]))
            backoff = np.zeros((len(ids), len(models)), np.float32)
            grams, first = np.unique(np.concatenate([m.grams[k] for m in models]), return_index=True)
            context = np.concatenate([m.contexts[k] for m in models])[first]
            suffix = np.concatenate([m.suffixes[k] for m in models])[first]
            logp = np.empty((len(grams), len(models)), np.float32)
            for j, m in enumerate(models):
                backoff[np.searchsorted(ids, m.context_ids[k]), j] = m.backoff[k]
            lower = self.logp[k - 1][np.searchsorted(self.grams[k - 1], suffix)] if k else self.unknown - backoff
            logp[:] = backoff[np.searchsorted(ids, context)] + lower
            for j, m in enumerate(models):
                logp[np.searchsorted(grams, m.grams[k]), j] = m.logp[k]
            for name, value in (("grams", grams), ("logp", logp), ("context_ids", ids), ("backoff", backoff)):
                getattr(self, name).append(value)

    def word_costs(self, words: list[str]) -> np.ndarray:
        """For each word: minus log probability under each language, then the number of predicted characters."""
        chars, word, offset = code_points(words, _BEGIN, _END)
        hashes = ngram_hashes(chars, self.order)
        logp = np.zeros((len(chars), len(self.langs)), np.float32)
        left = np.flatnonzero(offset >= 1)
        for k in range(self.order, 0, -1):
            can = offset[left] >= k - 1
            now = left[can]
            at = _find(self.grams[k - 1], hashes[k - 1][now])
            hit = at >= 0
            logp[now[hit]] += self.logp[k - 1][at[hit]]
            missed = now[~hit]
            if k > 1:
                context = _find(self.context_ids[k - 1], hashes[k - 2][missed - 1])
                some = context >= 0
                logp[missed[some]] += self.backoff[k - 1][context[some]]
            else:
                logp[missed] += self.unknown
            left = np.concatenate([left[~can], missed])
        out = np.zeros((len(words), len(self.langs) + 1), np.float32)
        predicted = offset >= 1
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(word[predicted], -logp[predicted, j], len(words))
        out[:, -1] = np.bincount(word[predicted], minlength=len(words))
        return out

    def token_costs(self, tokens: list[str]) -> np.ndarray:
        """``word_costs`` added up over the letter runs of each token."""
        runs = [letter_runs(t.lower()) for t in tokens]
        words = [w for r in runs for w in r]
        out = np.zeros((len(tokens), len(self.langs) + 1), np.float32)
        if words:
            np.add.at(out, np.repeat(np.arange(len(tokens)), [len(r) for r in runs]), self.word_costs(words))
        return out


def text_costs(scores: TokenScores, texts: list[str | None]) -> np.ndarray:
    """Sums of the tokens' rows for each text, whole texts."""
    split = [(t or "").split() for t in texts]
    rows = scores([t for s in split for t in s]).astype(np.float64)
    ends = np.cumsum([len(s) for s in split])
    sums = np.concatenate([np.zeros((1, scores.width)), np.cumsum(rows, axis=0)])
    return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]


def choose(models: LanguageModels, limits: np.ndarray, costs: np.ndarray, texts: list[str | None]):
    """Lists (lang_pred, score, cross-entropy, rejected) from the summed costs of each text."""
    chars = costs[:, -1]
    entropy = costs[:, :-1] / np.maximum(chars, 1)[:, None]
    best = entropy.argmin(axis=1)
    own = entropy[np.arange(len(best)), best]
    margin = (entropy - own[:, None]) * np.minimum(chars, SCORE_CHARS)[:, None]
    score = 1.0 / np.exp(-margin).sum(axis=1)
    known = np.array([t is not None and has_letter(t) for t in texts], bool)
    lang = [models.langs[b] if k else "und" for b, k in zip(best, known)]
    return lang, np.where(known, score, 0.0), own, ~known | (own > limits[best])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = DOCS_PER_LANG) -> tuple[LanguageModels, np.ndarray] | None:
    """Models and rejection limits from a sample of at most about ``per_lang`` documents a language."""
    usable = docs.where(learnable(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = usable.groupBy(lang_col).count()
    per_lang = min(per_lang, max(1, TRAIN_DOCS // max(1, sizes.count())))
    share = F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 30)) / float(1 << 30)
    sample = (usable.select(F.col(lang_col).alias("lang"), (fold(id_col) == 3).alias("calibrates"),
                            F.col(text_col).alias("text"), share.alias("share"))
              .join(F.broadcast(sizes.withColumnRenamed(lang_col, "lang")), "lang")
              .where(F.col("share") * F.col("count") < per_lang))
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = (sample.where(~F.col("calibrates")).select("lang", words.alias("word"))
               .groupBy("lang", "word").count().orderBy("lang", "word").toPandas())
    if not len(counted):
        return None
    models = LanguageModels({lang: (g["word"].tolist(), g["count"].to_numpy()) for lang, g in counted.groupby("lang")})
    scores = TokenScores(len(models.langs) + 1, models.token_costs)
    limits = np.full(len(models.langs), np.inf)
    own = [[] for _ in models.langs]
    # one partition of the sample at a time
    for row in sample.where("calibrates").select("lang", "text").toLocalIterator():
        if row["lang"] in models.langs:
            j = models.langs.index(row["lang"])
            cost = text_costs(scores, [row["text"]])[0]
            if cost[-1] > 0:
                own[j].append(cost[j] / cost[-1])
    for j, values in enumerate(own):
        if values:
            limits[j] = np.quantile(values, KEEP_SHARE) * 1.1
    return models, limits


def identify(docs: DataFrame, trained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) for each whole text."""
    spark = docs.sparkSession
    prepare(spark)
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            if sent.value is None:
                return None
            models, limits = sent.value
            return models, limits, TokenScores(len(models.langs) + 1, models.token_costs)

        own = per_worker(("language_id", key), make, keep=1)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if own is None:
                n = len(texts)
                answer = ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
            else:
                models, limits, scores = own
                answer = choose(models, limits, text_costs(scores, texts), texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, answer)],
                                             [id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(
        run, ddl(docs, [id_col]) + ", lang_pred string, score double, cross_entropy double, rejected boolean")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the other folds."""
    docs = read(spark, sf_dir, "documents")
    prepare(spark)
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
