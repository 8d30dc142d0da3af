import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.llm import suffix_tree as st

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
END = "<end>"


class Brute:
    """The suffix tree by its definition, over dictionaries."""

    def __init__(self, texts, depth, min_count, gain, prior):
        self.depth, self.prior = depth, prior
        self.runs = Counter()
        for text in texts:
            words = self.tokens(text)
            for length in range(1, depth + 2):
                self.runs.update(tuple(words[i:i + length]) for i in range(len(words) - length + 1))
        self.n = sum(c for r, c in self.runs.items() if len(r) == 1)
        self.v = sum(len(r) == 1 for r in self.runs)
        self.kept = set()
        for length in range(1, depth + 1):
            pays = {}
            for run, c in self.runs.items():
                s = run[:-1]
                if len(s) == length and self.runs[s] >= min_count:
                    p, k = self.chance(s[1:], run[-1]), self.runs[s]
                    a = k ** prior
                    pays[s] = pays.get(s, 0.0) + c * math.log((c - 1 + a * p) / (k - 1 + a) / p)
            self.kept |= {s for s, g in pays.items() if g >= gain}

    @staticmethod
    def tokens(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]

    def chance(self, history, word):
        """Of ``word`` after ``history``, whose longest kept suffix is the state."""
        if not history:
            return (self.runs[(word,)] + 1) / (self.n + self.v + 1)
        below = self.chance(history[1:], word)
        if history not in self.kept:
            return below
        a = self.runs[history] ** self.prior
        return (self.runs[(*history, word)] + a * below) / (self.runs[history] + a)

    def row(self, text):
        words = self.tokens(text)
        base = sum(math.log10(self.chance((), w)) for w in words)
        score = sum(math.log10(self.chance(tuple(words[max(i - self.depth, 0):i]), w)) for i, w in enumerate(words))
        return len(words), sum((w,) in self.runs for w in words), self.n, base, score


def check(rows, docs, model):
    """Result rows against the brute-force rows of the same (id, text) documents."""
    def key(r):
        return str(r[0]), *(round(v, 6) for v in r[1:])
    got = sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])) for r in rows)
    want = sorted(key((i, *model.row(t))) for i, t in docs)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-5)


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def documents(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_query_equals_brute_force(spark):
    docs = documents(spark, SF001)
    model = Brute([t for i, t in docs if learned(i)], st.DEPTH, st.MIN_COUNT, st.GAIN, st.PRIOR)
    assert any(len(s) == 2 for s in model.kept) and any(len(s) == 1 for s in model.kept)
    df = E.queries()["op12_suffix_tree"](spark, SF001)
    assert set(df.dtypes) >= {("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"),
                              ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")}
    rows = df.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    check(rows, docs, model)


def test_odd_rows(spark, odd):
    docs = documents(spark, odd)
    model = Brute([t for i, t in docs if learned(i)], st.DEPTH, st.MIN_COUNT, st.GAIN, st.PRIOR)
    check(E.queries()["op12_suffix_tree"](spark, odd).collect(), docs, model)


@pytest.mark.parametrize("depth,block,bucket", [(2, 1, 10), (3, 7, 40), (1, 50, 3), (0, 1000, 1000)])
def test_blocks_and_buckets_do_not_matter(spark, depth, block, bucket):
    texts = ["a b a b c", "B a\tb  a b a b a c d", None, "", "a b c d " * 30, "x", "b a b a", "c d a b unseen", "d d d d d d"] * 3
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash"))
    model = Brute([t for i, t in docs if i % 4], depth, 2, 0.5, 0.7)
    assert depth == 0 or model.kept
    rows = st.score_texts(df, F.col("doc_id") % 4 != 0, F.col("doc_id") % 4 == 0, depth=depth, min_count=2, gain=0.5, prior=0.7,
                          block_tokens=block, bucket_tokens=bucket).withColumnRenamed("id", "doc_id").collect()
    check(rows, docs, model)


def test_states_sum_to_one():
    model = Brute(["a b a c a b d", "b a b a c", "a b a b a b"] * 3, 2, 2, 0.1, 0.8)
    words = [r[0] for r in model.runs if len(r) == 1] + ["unknown"]
    assert model.kept
    for s in [(), *model.kept]:
        assert sum(model.chance(s, w) for w in words) == pytest.approx(1)


def test_no_training_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = st.score_texts(df, F.lit(False), F.lit(True)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows) == [
        (1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_empty_table(spark, empty):
    df = E.queries()["op12_suffix_tree"](spark, empty)
    assert df.collect() == [] and {"doc_id", "score"} <= set(df.columns)


def test_held_out_texts_score_above_the_base(spark):
    row = E.queries()["op12_suffix_tree"](spark, SF01).where("held_out").agg(
        F.avg(F.col("score") - F.col("base_score")).alias("gain"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).first()
    assert row["gain"] > 0 and row["better"] > 0.7


def test_pieces_of_a_long_text_join_up(monkeypatch):
    text = b"One two\tthree " + b" " * 50 + b"w" * 40 + b"\nlast"
    whole = [w for ws in st.word_lists(text) for w in ws]
    monkeypatch.setattr(st, "PIECE_BYTES", 6)
    assert [w for ws in st.word_lists(text) for w in ws] == whole == [b"one", b"two", b"three", b"w" * 40, b"last"]


def test_packing():
    import numpy as np
    for a in (np.zeros(0, np.int64), np.array([1, -5, 1 << 40]), np.array([0.5, -1e300])):
        assert (st.unpack(st.pack(a), a.dtype) == a).all()
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (st.unpack_sorted(st.pack_sorted(keys)) == keys).all()
