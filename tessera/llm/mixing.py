"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words (a water level over weights, see ``source_targets``); its
documents start with the same expected number of copies, target / source size. The whole part is taken
outright. The fractional parts are rounded by the pivotal method on words: two documents meet, and word
mass moves from one to the other, in a direction drawn so that both expectations stay, until one of them
holds none or all of its words; the other meets the next document. Mass is conserved, so the words taken
differ from the target by less than one document.

Documents are dealt to buckets of about ``BUCKET_DOCS`` within their source (a large source has many
buckets). Each bucket leaves at most one unrounded document; these residuals meet again, ``MERGE_WAYS``
buckets at a time, up a tree until one per source is left, which is drawn on its own.
All draws come from hashes of ids, so reruns agree.

Defined cases: a null text has size 0; a document of size 0 takes no words; a null source is a source
of its own, last in order; an empty table gives an empty result; repeated rows are separate items.
"""
from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ddl, prepare, read, stage
from tessera.llm.registry import query

# fixed values of the mix
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2.0

BUCKET_DOCS = 4096
MERGE_WAYS = 64
BROADCAST_SOURCES = 100_000     # more sources than this are joined by shuffle


def word_count(text: Column) -> Column:
    """Runs of anything but space and the control characters 9-13; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def source_ranks(totals: DataFrame) -> DataFrame:
    """``totals`` with the 1-based rank of its source in code point order, null last; no global sort in one task."""
    spark = totals.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = stage(totals.where(F.col("source").isNotNull()).repartitionByRange(parts, "source")
                  .withColumn("_part", F.spark_partition_id()), "source-ranges")
    # at most one row for each partition
    before = known.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy("source"))
    ranked = known.withColumn("_in", in_part).join(F.broadcast(before), "_part").withColumn(
        "rank", F.col("_in") + F.col("_before")).drop("_in", "_before", "_part")
    last = totals.where(F.col("source").isNull()).withColumn("rank", F.lit(known.count() + 1).cast("long"))
    return ranked.unionByName(last)


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> DataFrame:
    """(source, source_size, docs, target): ``share`` of all words dealt by weight, no source above
    ``most`` times its size; what is above goes to the others by weight until none is above."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = stage(source_ranks(totals).withColumn("weight", w)
                   .withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    row = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    want = share * float(row["words"] or 0)
    level, full = (want / row["weight"] if row["weight"] else 0.0), -1
    while True:     # one row per round; the level only rises, each round fills at least one more source
        is_full = F.col("weight") * F.lit(level) >= F.col("cap")
        row = ranked.agg(F.sum(F.when(is_full, 1).otherwise(0)).alias("full"),
                         F.sum(F.when(is_full, F.col("cap")).otherwise(0.0)).alias("given"),
                         F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if row["full"] == full or not row["weight"]:
            break
        full, level = row["full"], max(level, (want - row["given"]) / row["weight"])
    return ranked.select("source", "source_size", "docs",
                         F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def pivotal(sizes: np.ndarray, mass: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round the word masses of a sequence of documents, 0 < mass < size each.

    Returns the 0/1 decisions, the position of the document left unrounded (-1: none) and its mass.
    """
    taken = np.zeros(len(sizes), dtype=np.int64)
    at, held = -1, 0.0
    for i, (size, m, u) in enumerate(zip(sizes.tolist(), mass.tolist(), draws.tolist())):
        if at < 0:
            at, held = i, m
            continue
        cap = float(sizes[at])
        gain, loss = min(cap - held, m), min(held, size - m)
        if u * (gain + loss) < loss:        # the held one gains: it is full, or the new one is empty, or both
            if gain < cap - held:
                held += gain
                continue
            taken[at] = 1
            at, held = (-1, 0.0) if gain == m else (i, m - gain)
        else:                               # the held one loses: it is empty, or the new one is full, or both
            taken[i] = int(loss == size - m)
            if loss < held:
                held -= loss
            else:
                at, held = (-1, 0.0) if taken[i] else (i, m + loss)
    if at >= 0:
        size = float(sizes[at])
        if held <= 1e-9 * size or held >= size * (1 - 1e-9):
            taken[at] = int(held > size / 2)
            at, held = -1, 0.0
    return taken, at, held


def _round_bucket(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "item"], kind="stable").reset_index(drop=True)
        mark = zlib.crc32(repr((pdf["order"].iloc[0], int(pdf["bucket"].iloc[0]), len(pdf))).encode())
        draws = np.random.default_rng([seed, level, mark]).random(len(pdf))
        taken, at, held = pivotal(pdf["size"].to_numpy(), pdf["mass"].to_numpy(), draws)
        pdf["copies"] = pdf["copies"] + taken
        left = np.zeros(len(pdf))
        if at >= 0:
            left[at] = held
        pdf["mass"] = left
        return pdf
    return run


def mix(items: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_TIMES,
        seed: int = 11) -> DataFrame:
    """Copies of each row of ``items`` (columns item, source, size): item, source, size, source_size, target, copies."""
    spark = items.sparkSession
    prepare(spark)
    items = stage(items.select("item", "source", "size"), "mix-items")
    totals = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = stage(source_targets(stage(totals, "mix-totals"), weights, share, most), "mix-targets")
    small = targets.count() <= BROADCAST_SOURCES
    to_join = targets.withColumnRenamed("source", "_source")
    rows = items.join(F.broadcast(to_join) if small else to_join, F.col("source").eqNullSafe(F.col("_source")))
    # many rows of one item and size (without an id, say) would fall into one bucket: they get a number each
    crowded = stage(items.groupBy("item", "size").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BUCKET_DOCS)
                    .select(F.col("item").alias("_item"), F.col("size").alias("_size")), "crowded-items")
    order = F.xxhash64(F.lit(seed), "item", "size")
    n_crowded = crowded.count()
    if n_crowded:
        rows = rows.withColumn("_row", F.monotonically_increasing_id()).join(
            F.broadcast(crowded) if n_crowded <= BROADCAST_SOURCES else crowded, F.col("item").eqNullSafe(F.col("_item")) & (F.col("size") == F.col("_size")), "left")
        order = F.when(F.col("_size").isNull(), order).otherwise(F.xxhash64(F.lit(seed), "item", "size", "_row"))
    rows = (rows.withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
            .withColumn("copies", F.floor("_ratio").cast("long"))
            .withColumn("mass", (F.col("_ratio") - F.col("copies")) * F.col("size"))
            .withColumn("order", order)
            .withColumn("bucket", F.pmod(F.col("order"), F.ceil(F.col("docs") / BUCKET_DOCS)))
            .select("item", "source", "size", "source_size", "target", "copies", "mass", "order", "bucket"))
    rows = stage(rows, "mix-rows")
    schema = ddl(rows, rows.columns)
    open_row = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    done = [rows.where(~open_row)]
    left = rows.where(open_row)
    most_docs = targets.agg(F.max("docs")).first()[0] or 0
    buckets, level = -(-most_docs // BUCKET_DOCS), 0
    while True:
        left = stage(left.groupBy("source", "bucket").applyInPandas(_round_bucket(seed, level), schema), "mix-level")
        done.append(left.where("mass = 0"))
        left = left.where("mass > 0")
        if buckets <= 1:
            break
        buckets, level = -(-buckets // MERGE_WAYS), level + 1
        left = left.withColumn("bucket", F.floor(F.col("bucket") / MERGE_WAYS))
    # one document a source is left: drawn on its own
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "item"), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.withColumn("copies", F.col("copies") + (draw < F.col("mass") / F.col("size")).cast("long")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("item", "source", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text)),
                      F.coalesce(F.col(source_col), F.lit("-")))
    keyed = docs.withColumn("_key", key)
    items = keyed.select(F.col("_key").alias("item"), F.col(source_col).alias("source"),
                         word_count(F.col(text_col)).alias("size"))
    # rows that repeat id, text and source are one row here, with the copies of all of them
    taken = mix(items, **options).groupBy("item").agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    rows = keyed.dropDuplicates(["_key"]).join(taken.withColumnRenamed("item", "_key"), "_key")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


@query("op9_mix_sources")
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all ``documents`` to the source weights; words taken from each document."""
    docs = read(spark, sf_dir, "documents")
    taken = mix(docs.select(F.col("doc_id").alias("item"), "source", word_count(F.col("text")).alias("size")))
    return taken.select(F.col("item").alias("doc_id"), "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
