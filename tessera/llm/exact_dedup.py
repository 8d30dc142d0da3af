"""Exact dedup: a tree merge of digest runs, with DataFrame functions only.

Documents are dealt to ``runs`` runs by a hash of their id, so the copies of one text, however many,
spread over all runs. A run holds one entry per text: its SHA-256, the length and a second,
independent hash that verify a match, the largest identifier and the number of rows. ``FAN_IN`` runs
merge into one per level (each level is two binomial rounds) until one is left; every level keeps the
largest verified identifier and adds the counts, and its exchange is dealt by (run, digest), so no
task holds a whole run. The answer goes back down in two joins: root to the entries of the runs
(at most ``runs`` rows a text), then entries to documents on (run, digest) - a hot text is already
split by run. Only digests move, never texts.

Defined cases: a null text counts as empty; an empty table gives an empty result; of rows that repeat
both text and the largest id exactly one is kept (the last one in the staged order); a null id loses
against any id.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import prepare, read, stage
from tessera.llm.registry import query

# runs merged into one at each level
FAN_IN = 4
_KEY = ["text_sha256", "n_bytes", "check_hash"]


def run_count(spark: SparkSession) -> int:
    """A power of ``FAN_IN``, at least the number of shuffle partitions."""
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return FAN_IN ** math.ceil(math.log(n, FAN_IN) - 1e-9)


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text digest and its verification values, run, row number) of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check_hash"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(runs)).alias("run"),
        F.monotonically_increasing_id().alias("row"))


def merge_runs(entries: DataFrame, runs: int) -> DataFrame:
    """One entry per text: levels of ``FAN_IN``-way merges until a single run is left."""
    while runs > 1:
        runs //= FAN_IN
        entries = (entries.withColumn("run", F.floor(F.col("run") / FAN_IN))
                   .groupBy("run", *_KEY)
                   .agg(F.max("best").alias("best"), F.sum("n").alias("n")))
    return entries.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    prepare(spark)
    runs = run_count(spark)
    rows = stage(digests(docs, runs, id_col, text_col), "digests")
    entries = stage(rows.groupBy("run", *_KEY).agg(F.max(F.struct("doc_id", "row")).alias("best"),
                                                   F.count(F.lit(1)).alias("n")), "digest-runs")
    root = merge_runs(entries, runs)
    answer = entries.select("run", *_KEY).join(root, _KEY)
    return rows.join(answer, ["run", *_KEY]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per text left (all columns kept)."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(
        F.concat_ws(":", "text_sha256", F.col("doc_id").cast("string")).alias("_kept_key"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.sha2(text.cast("binary"), 256), F.col(id_col).cast("string"))
    return (docs.withColumn("_kept_key", key).join(kept, "_kept_key")
            .dropDuplicates(["_kept_key"]).select(*[F.col(f"`{c}`") for c in docs.columns]))


@query("op6_exact_dedup", sql="""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup over ``documents``; the largest doc_id of equal texts stays."""
    return exact_groups(read(spark, sf_dir, "documents"))
