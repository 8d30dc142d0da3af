"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table (piece -> number of tokens) of the most frequent pre-token pieces, built
once and broadcast; it has at most ``TABLE_PIECES`` entries of at most ``PIECE_CHARS`` characters, which
bounds its size. Tier two is a bounded cache in each Python worker; only what misses both is encoded.
No pre-token is ever shuffled: the table comes from one bounded summary per partition (counts pruned to
the heaviest pieces as they grow), merged ``MERGE_WAYS`` at a time over as many rounds as it takes. The
table only decides what is fast; each count is exact whatever it holds.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are single
tokens, as the library does by default; repeated rows are counted one by one; an empty table gives an
empty result.
"""
from __future__ import annotations

import uuid
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ddl, per_worker, prepare, read, slices, stage
from tessera.llm.registry import query
from tessera.llm.units import UnitCache, UnitEncoder, split_units, tokenizer_blob

TABLE_PIECES = 1 << 15      # entries of the broadcast table
PIECE_CHARS = 40            # longest piece in it
SUMMARY_PIECES = 1 << 17    # pieces a partition's summary holds before it is pruned to the heaviest half
CACHE_PIECES = 600_000      # entries of a worker's cache
MERGE_WAYS = 16

_SUMMARY = "node long, pieces array<string>, counts array<long>"


def _packed(counts: Counter, node: int, most: int) -> pa.RecordBatch:
    # ties by piece, so that reruns agree
    top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:most]
    return pa.RecordBatch.from_arrays(
        [pa.array([node], pa.int64()), pa.array([[p for p, _ in top]], pa.list_(pa.string())),
         pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["node", "pieces", "counts"])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    counts: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            counts.update(p for p in split_units(text or "")[1:] if len(p) <= PIECE_CHARS)
            if len(counts) > SUMMARY_PIECES:
                counts = Counter(dict(counts.most_common(SUMMARY_PIECES // 2)))
    yield _packed(counts, TaskContext.get().partitionId(), TABLE_PIECES)


def _merged(table: pa.Table) -> pa.Table:
    counts: Counter = Counter()
    for row in table.to_pylist():
        counts.update(dict(zip(row["pieces"], row["counts"])))
    return pa.Table.from_batches([_packed(counts, table["node"][0].as_py(), TABLE_PIECES)])


def frequent_pieces(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The heaviest pieces of the corpus (at most ``TABLE_PIECES``)."""
    level = stage(docs.select(text_col).mapInArrow(_summaries, _SUMMARY), "pieces")
    while (rows := level.count()) > 1:
        ways = MERGE_WAYS
        dealt = level.withColumn("node", F.floor(F.col("node") / ways))
        merged = stage(dealt.groupBy("node").applyInArrow(_merged, _SUMMARY), "pieces")
        if merged.count() == rows:      # partition numbers lie far apart: nothing met in this round
            level = merged
            continue
        level = merged
    row = level.first()
    return list(row["pieces"]) if row else []


class _Lengths:
    """piece -> tokens of " " + piece: the broadcast table, then a bounded cache of what was encoded."""

    def __init__(self, units: UnitEncoder, pieces: list[str], lengths: np.ndarray):
        self.table = dict(zip(pieces, lengths.tolist()))
        self.cache = UnitCache(units, len, CACHE_PIECES)

    def total(self, pieces: list[str]) -> int:
        found = list(map(self.table.get, pieces))
        missed = [p for p, n in zip(pieces, found) if n is None]
        return sum(filter(None, found)) + sum(self.cache.lookup(missed))


def token_counts(docs: DataFrame, blob: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row; ``blob`` is the tokenizer's JSON file."""
    spark = docs.sparkSession
    prepare(spark)
    pieces = frequent_pieces(docs, text_col)
    lengths = np.array(list(map(len, UnitEncoder(blob).many(pieces))), dtype=np.uint16)
    key = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((blob, pa.array(pieces, pa.string()), lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make():
            raw, packed, each = sent.value
            own = UnitEncoder(raw)
            return own, _Lengths(own, packed.to_pylist(), each)

        own, known = per_worker(("token_counts", key), make, keep=1)
        for batch in slices(batches):
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                units = split_units(text or "")
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(len(own.one(units[0])) + known.total(units[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                [id_col, "n_bytes", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(count, ddl(docs, [id_col]) + ", n_bytes long, n_tokens long")


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` under the byte-level BPE vocabulary."""
    import public_tokenizers

    blob = tokenizer_blob(public_tokenizers.path("byte_bpe_50k.json"))
    counted = token_counts(read(spark, sf_dir, "documents"), blob)
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
