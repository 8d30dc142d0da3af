"""Importance resampling towards a target distribution: array-scored weights, then distributed quickselect.

Words are runs of ASCII letters and digits (A-Z in lower case) and of anything beyond ASCII; features are all runs
of 1 to ``LONGEST`` consecutive words. A feature falls into bucket crc32 modulo ``BUCKETS``. Two passes read the
texts: the first counts the buckets (one array a task, added up by bucket), the second looks every feature up in
the broadcast array of bucket gains (``BUCKETS`` integers) and keeps a handful of numbers a document.

A document's score is its weight plus a Gumbel draw from the hash of its id, so that the highest scores are a sample
without replacement with chances by weight. The k-th best composite key (score down, id up, then the row's own
number) is found by quickselect: each round draws ``PIVOTS`` random live keys, counts the live keys below, at and
between them exactly, and keeps only the gap that holds the k-th. Rows no worse than that key are the winners; they
alone are range-partitioned and sorted, and a rank is the place in the partition plus the rows of those before.

Defined cases: a null text has no words; a document without features has weight 0; a null id draws from the hash of
``<seed>:`` and comes after all ids; repeated rows are separate candidates; empty tables give an empty result (an
empty target has no counts, its gains follow from the formula).
"""
from __future__ import annotations

import math
import uuid
from itertools import repeat
from typing import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, read, slices, stage
from tessera.llm.registry import query
from tessera.session import discard

# fixed values of the resampling
BUCKETS = 10_000
LONGEST = 2
MIN_WORDS = 20
PERCENT = 25
SEED = 7

PIVOTS = 32
PIECE_BYTES = 1 << 20       # of a long text that are split into words at a time
# bytes that stand in words, A-Z in lower case; all others separate
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, piece by piece."""
    text, at = text.translate(_WORDS), 0
    while at < len(text):
        end = at + PIECE_BYTES
        end = len(text) if end >= len(text) else text.find(b" ", end)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        if words:
            yield words
        at = end


def features(text: bytes, longest: int = LONGEST) -> tuple[int, list[int]]:
    """Number of words, and the crc32 of every run of 1 to ``longest`` words joined by one space."""
    found: list[int] = []
    n_words, last = 0, {}           # last: length -> crc32 of the run that ends the piece before
    for words in word_lists(text):
        n_words += len(words)
        ends, ending = list(map(crc32, words)), {}
        found += ends
        ending[1] = ends[-1]
        for length in range(2, longest + 1):
            before = ([last[length - 1]] if length - 1 in last else []) + ends[:-1]
            ends = list(map(crc32, words[len(words) - len(before):], map(crc32, repeat(b" "), before)))
            found += ends
            if ends:
                ending[length] = ends[-1]
        last = ending
    return n_words, found


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all texts by bucket; each task adds up an array of ``buckets`` numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    total += np.bincount(np.array(features(text, longest)[1], np.int64) % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():       # at most ``buckets`` rows
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, one count added to each: the shares are
    (t + 1) / (T + buckets) and (s + 1) / (S + buckets)."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str, longest: int) -> DataFrame:
    """``docs`` (id, text) -> id, n_words, n_features, weight."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kind = dict(docs.dtypes)["id"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in slices(batches):
            n_words, sizes, weights = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = features(text or b"", longest)
                n_words.append(n)
                sizes.append(len(found))
                weights.append(int(gain[np.array(found, np.int64) % len(gain)].sum()) // len(found) if found else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, pa.int64()) for v in (n_words, sizes, weights))],
                ["id", "n_words", "n_features", "weight"])

    return docs.select("id", F.col(text_col).cast("string").cast("binary")).mapInArrow(
        weigh, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256('<seed>:<id>')."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _literal(key) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in key.asDict().items()])


def kth_key(live: DataFrame, k: int, seed: int, pivots: int = PIVOTS):
    """The ``k``-th smallest ``key`` of ``live`` (a struct that no two rows share), 1 <= k <= rows."""
    kind, level, before = dict(live.dtypes)["key"], 0, None
    while True:
        drawn = sorted((r["key"] for r in live.orderBy(F.xxhash64(F.lit(seed + level), "key")).limit(pivots).collect()),
                       key=lambda key: [(v is None, v) for v in key])
        marks = F.array(*[_literal(p).cast(kind) for p in drawn])
        below = F.size(F.filter(marks, lambda p: p < F.col("key")))
        counted = live.groupBy(below.alias("slot"), F.array_contains(marks, F.col("key")).alias("at")).count()
        counts = {(r["slot"], r["at"]): r["count"] for r in counted.collect()}      # 2 x pivots + 1 rows
        for slot in range(len(drawn) + 1):
            here = counts.get((slot, False), 0)
            if k <= here:
                break
            k -= here
            if slot < len(drawn):
                if k <= counts.get((slot, True), 0):
                    return drawn[slot]
                k -= counts.get((slot, True), 0)
        if slot > 0:
            live = live.where(F.col("key") > _literal(drawn[slot - 1]).cast(kind))
        if slot < len(drawn):
            live = live.where(F.col("key") < _literal(drawn[slot]).cast(kind))
        staged, level = stage(live, "select-live"), level + 1
        if before is not None:
            discard(before)
        live = before = staged


def ranked(winners: DataFrame, out: str) -> DataFrame:
    """``winners`` with their 1-based place in the order of ``key``: sorted by range, no task sees them all."""
    parts = int(winners.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(winners.repartitionByRange(parts, "key").sortWithinPartitions("key")
                   .withColumn("_at", F.monotonically_increasing_id()), "winners")
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    # one row for each partition
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_at") + F.col("_before") + 1).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST,
             pivots: int = PIVOTS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null unless it is drawn."""
    spark = docs.sparkSession
    prepare(spark)
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, text_col, buckets, longest))
    rows = weighed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gain, "text", longest)
    rows = rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id())
    key = F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("no_id"), "id", "n_features", "row")
    rows = stage(rows, "resample-" + uuid.uuid4().hex[:8]).withColumn("key", key)
    able = F.col("n_words") >= min_words
    n = rows.where(able).count()
    k = percent * n // 100
    columns = ["id", "n_words", "n_features", "weight", "score", "rank"]
    if k == 0:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(columns)
    edge = _literal(kth_key(rows.where(able).select("key"), k, seed, pivots)).cast(dict(rows.dtypes)["key"])
    drawn = able & (F.col("key") <= edge)
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(drawn), "rank").select(columns).unionByName(rest.select(columns))


@query("op11_importance_resample")
def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of ``documents`` drawn towards the texts of ``benchmark``; every document with its weight and score."""
    drawn = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
