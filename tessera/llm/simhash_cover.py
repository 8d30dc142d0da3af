"""SimHash near-dedup by anchor-point covering.

Fingerprints are 64 bits from word shingles. Equal fingerprints are one point. Anchors are the code words
of a product of perfect codes laid over blocks of the bits: two binary Golay codes (23 bits, covering radius
3 each), and for very many points a Hamming code (15 bits, radius 1) as well. A perfect code has exactly one
code word within its radius of any point, so each point has one home anchor, and each block's code word lies
at most radius away. If two points differ in at most ``most_bits`` bits, those fall on the blocks as
d1 + d2 (+ d3) <= most_bits, and the second point is within radius + d_i of the home word in each block. So a
point is replicated to every anchor whose distances exceed the radii by ``most_bits`` in sum at most (about 60
anchors of 16.8 million), and compared there with the points at home. Of two points with different homes only
the one with the smaller home need travel, which halves the copies and finds each link once.

A point has at most 2,080 others within 2 bits, so links grow in proportion to the points. Links go to
connected components; copies are never expanded into pairs.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and links like any other;
repeated rows and equal texts share a point; a null id never names a component that has another id; an empty
table gives an empty result.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import HOT_ROWS, ddl, per_worker, prepare, read, salted_join, slices, stage
from tessera.llm.components import connected_components
from tessera.llm.registry import query

SHINGLE_WORDS = 3
MOST_BITS = 2
HASH_SEED = 42
POINTS_AT_ONCE = 1024       # points whose anchors are listed at a time
MANY_POINTS = 1 << 26       # beyond this the third block makes anchors finer; results are the same

# fixed values: generator polynomials of the perfect codes, with length, check bits and covering radius
GOLAY = (0b101011100011, 23, 11, 3)
HAMMING = (0b10011, 15, 4, 1)
# (first bit, code) of each block
BLOCKS = ((0, GOLAY), (23, GOLAY))
MORE_BLOCKS = BLOCKS + ((46, HAMMING),)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of ``text`` (ASCII lower case, ASCII white space), unsigned."""
    import xxhash

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[:len(tokens) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[i:j], HASH_SEED) for i, j in zip(starts.tolist(), ends.tolist())], dtype="<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def _syndrome(x: np.ndarray, code) -> np.ndarray:
    poly, n, check, _ = code
    x = x.copy()
    for bit in range(n - 1, check - 1, -1):
        x ^= np.where((x >> np.uint64(bit)) & np.uint64(1), np.uint64(poly << (bit - check)), np.uint64(0))
    return x


def error_patterns(code, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns of weight up to radius + extra, sorted by syndrome: (first index of each syndrome, pattern, excess)."""
    _, n, check, radius = code
    all_words = [np.zeros(1, np.uint64)]
    for _ in range(radius + extra):
        last = all_words[-1]
        top = np.array([int(w).bit_length() for w in last])
        all_words.append(np.concatenate([last[top <= b] | np.uint64(1 << b) for b in range(n)]))
    patterns = np.concatenate(all_words)
    excess = np.concatenate([np.full(len(w), max(0, k - radius), np.int8) for k, w in enumerate(all_words)])
    syn = _syndrome(patterns, code).astype(np.int64)
    order = np.lexsort((excess, syn))
    first = np.searchsorted(syn[order], np.arange((1 << check) + 1))
    return first, patterns[order], excess[order]


class Anchors:
    """Home anchor and the anchors a point visits."""

    def __init__(self, blocks=BLOCKS, most_bits: int = MOST_BITS):
        self.blocks, self.most_bits = blocks, most_bits
        self.tables = {code: error_patterns(code, most_bits) for _, code in blocks}
        # code -> number of patterns of each syndrome (rows) with an excess of 0, 1, ... at most; they are sorted by it
        self.sizes = {code: np.stack([np.bincount(np.repeat(np.arange(len(first) - 1), np.diff(first))[over <= e], minlength=len(first) - 1)
                                      for e in range(most_bits + 1)], axis=1) for code, (first, _, over) in self.tables.items()}

    def near(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, anchor, is it home) for every anchor of each point; uint64 points."""
        at = np.arange(len(points))
        anchor = np.zeros(len(points), np.uint64)
        excess = np.zeros(len(points), np.int8)
        for first_bit, code in self.blocks:
            first, patterns, over = self.tables[code]
            mask = np.uint64((1 << code[1]) - 1)
            word = (points >> np.uint64(first_bit)) & mask
            syn = _syndrome(word, code).astype(np.int64)[at]
            counts = self.sizes[code][syn, self.most_bits - excess]
            rows = np.repeat(np.arange(len(at)), counts)
            into = first[syn][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            excess = excess[rows] + over[into]
            anchor = anchor[rows] | ((word[at][rows] ^ patterns[into]) << np.uint64(first_bit))
            at = at[rows]
        return at, anchor, excess == 0


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp as signed long, hash of the text) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t or "", words) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("_text"))
    return rows.mapInArrow(run, ddl(rows, ["doc_id", "text_hash"]) + ", fp long")


def links(points: DataFrame, blocks=BLOCKS, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``points.fp`` within ``most_bits`` bits, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = per_worker(("anchors", blocks, most_bits), lambda: Anchors(blocks, most_bits))
        for batch in slices(batches, POINTS_AT_ONCE):
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            at, anchor, home = anchors.near(fps.view(np.uint64))
            own = np.zeros(len(fps), np.uint64)
            own[at[home]] = anchor[home]
            go = anchor >= own[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[go].view(np.int64)), pa.array(fps[at[go]]), pa.array(home[go])],
                ["anchor", "fp", "home"])

    placed = stage(points.select("fp").mapInArrow(run, "anchor long, fp long, home boolean"), "anchors")
    at_home = placed.where("home").select("anchor", F.col("fp").alias("a"))
    here = placed.select("anchor", F.col("fp").alias("b"), "home")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = at_home.join(here, "anchor").where((differ <= most_bits) & (~F.col("home") | (F.col("a") < F.col("b"))))
    return met.select("a", "b")


def near_groups(docs: DataFrame, words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, text_hash, fp, component_id, and the (doc_id, text_hash) that stands for it."""
    prepare(docs.sparkSession)
    rows = stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"),
                     F.col("text_hash").alias("text_hash"))
    points = stage(rows.groupBy("fp").agg(F.min(first).alias("first")), "points")
    blocks = BLOCKS if points.count() <= MANY_POINTS else MORE_BLOCKS
    roots = connected_components(links(points, blocks, most_bits))
    placed = stage(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")), "placed")
    named = placed.groupBy("root").agg(F.min("first").alias("stays"))
    # a fingerprint may be that of a third of all rows, a component hold a third of all fingerprints
    groups = salted_join(placed.select("fp", "root"), named, "root", HOT_ROWS).drop("root")
    return salted_join(rows, groups, "fp", HOT_ROWS).select("doc_id", "text_hash", "fp", F.col("stays.doc_id").alias("component_id"), "stays")


def near_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group left: the smallest id (all columns kept)."""
    key = F.concat_ws(":", F.hex("text_hash"), F.col("doc_id").cast("string"))
    stays = near_groups(docs, words, most_bits, id_col, text_col).where(
        F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash")))
    stays = stays.select(key.alias("_stays_key")).distinct()
    own = F.concat_ws(":", F.hex(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))),
                      F.col(id_col).cast("string"))
    return (docs.withColumn("_stays_key", own).join(stays, "_stays_key")
            .dropDuplicates(["_stays_key"]).select(*[F.col(f"`{c}`") for c in docs.columns]))


@query("op4_simhash_cover")
def op4_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = near_groups(read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
