"""File sources and sinks: CSV, partitioned layout, dataset catalog, text directories,
XML page annotations and list-literal manifests. Written tables go to the shared
staging folder under the session's checkpoint folder."""
from __future__ import annotations

import os
import re
from typing import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.prep import SEED, TRAIN_FRACTION, hash_bucket, hash_key

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink: header row, no index column, quotes escaped by doubling."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV scan with a fixed schema (no inference pass over the data); a malformed row is an error."""
    return spark.read.options(**CSV_OPTIONS, mode="FAILFAST").schema(schema).csv(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet laid out as ``col=value`` folders so filters on ``by`` prune folders."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


class Catalog:
    """(dataset, goal) -> path registry; unknown entries are an error."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[tuple[str, str], str] = {}

    def register(self, name: str, goal: str, path: str) -> None:
        self.paths[(name, goal)] = path

    def load(self, name: str, goal: str) -> DataFrame:
        if (name, goal) not in self.paths:
            raise KeyError(f"no dataset {name!r} for {goal!r}")
        return self.spark.read.parquet(self.paths[(name, goal)])


def write_text_dir(df: DataFrame, path: str, cls: str, text: str) -> None:
    """One folder per class holding text files (one text per line)."""
    df.select(cls, text).write.mode("overwrite").partitionBy(cls).text(path)


def read_text_dir(spark: SparkSession, path: str) -> DataFrame:
    """One row per text (a line of a file) with the name of its folder; files are split as any text file."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n").select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    folder = F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)
    return raw.withColumn("folder", F.replace(folder, F.lit("%3D"), F.lit("=")))


# fixed values: what Spark escapes in the folder of a value, and the folder of none
_FOLDER_NAME = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_text_files(df: DataFrame, path: str, cls: str, text: str) -> None:
    """One folder per class, one file per text (null as empty), line breaks kept.

    The rows are dealt out first, as creating the files is the work, and few tasks may read the table. In a mounted folder
    the tasks create the files themselves (Hadoop starts a process for the mode of each); a task that runs again writes
    the same names. Elsewhere Spark's sink does, where tasks move their own files to their place (committer algorithm 2).
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.select(cls, F.coalesce(F.col(text), F.lit("")).alias(text)).repartition(parts)
    target = urlsplit(path)
    if target.scheme not in ("", "file"):
        dealt.write.mode("overwrite").option("maxRecordsPerFile", 1).option(
            "mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy(cls).text(path)
        return
    top = unquote(target.path) if target.scheme else path
    if exists(df.sparkSession, path):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    os.makedirs(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, known = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for folder, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where = f"{top}/{cls}={_FOLDER_NAME.sub(lambda m: f'%{ord(m[0]):02X}', folder) if folder else _NO_VALUE}"
                if where not in known:
                    os.makedirs(where, exist_ok=True)
                    known.add(where)
                with open(f"{where}/part-{part:05d}-{n:07d}.txt", "wb") as out:
                    out.write(value)
                    out.write(b"\n")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt.select(F.col(cls).cast("string"), F.col(text).cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(text, folder, file): one row per FILE with its whole text, less one line break at its end.

    Small files share a task (as many as its split size holds); a large file is one row of one task. A file of no bytes
    has no row, as Spark's listing leaves it out; ``write_text_files`` writes a line break at least.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "[!._]*").text(path, wholetext=True).select(
        F.regexp_replace("value", r"\r?\n\z", "").alias("text"), F.col("_metadata.file_path").alias("file"))
    folder = F.replace(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1), F.lit("%3D"), F.lit("="))
    return raw.select("text", folder.alias("folder"), "file")


# a page of annotations: its regions in reading position, corners as they stand in the file
PAGE_XML = "page BIGINT, region ARRAY<STRUCT<item: BIGINT, reading_order: STRING, corner: ARRAY<STRUCT<x: INT, y: INT>>>>"


def write_page_xml(regions: DataFrame, path: str) -> None:
    """Pages as XML from (page, item, reading_order, corner array<struct<x, y>>): one element per page, its regions in
    item order inside it; a page's regions are few."""
    pages = regions.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("item", "reading_order", "corner"))).alias("region"))
    write_xml(pages, path, "page_annotations", "pages")


def read_page_xml(spark: SparkSession, path: str) -> DataFrame:
    """(page, regions array<struct<bbox array<array<int>>, reading_order>>); a page without regions has an empty array."""
    raw = read_xml(spark, path, "page_annotations", PAGE_XML)
    regions = F.transform(F.coalesce("region", F.array().cast(raw.schema["region"].dataType)), lambda r: F.struct(
        F.transform(r["corner"], lambda c: F.array(c["x"], c["y"])).alias("bbox"), r["reading_order"].alias("reading_order")))
    return raw.select("page", regions.alias("regions"))


def page_regions(pages: DataFrame) -> DataFrame:
    """(page, pos, bbox, reading_order): a row per region, positions as in the file."""
    return pages.select("page", F.posexplode("regions").alias("pos", "r")).select("page", "pos", "r.bbox", "r.reading_order")


def write_shuffled(df: DataFrame, id_col: str, path: str, shards: int, fraction: float = TRAIN_FRACTION, seed: int = SEED) -> None:
    """Rows in seeded shuffle order as parquet shards: folder ``goal=train`` holds the first ``int(fraction * n)`` rows,
    ``goal=test`` the rest, and the shards of a folder, by name, ARE the order. The row at the cut is found from counts
    of ranges of the hash key, then in its range alone; rows are exchanged by range and sorted inside. No window."""
    keyed = df.withColumn("_hk", hash_key(id_col, seed))
    counts = sorted((r["_b"], r["count"]) for r in keyed.groupBy(hash_bucket("_hk").alias("_b")).count().collect())     # at most 65536 ranges
    cut = int(fraction * sum(n for _, n in counts))
    train, before = F.lit(False), 0
    for b, n in counts:
        if before + n >= cut > before:
            at = keyed.where(hash_bucket("_hk") == b).select("_hk", id_col).orderBy("_hk", id_col).offset(cut - before - 1).limit(1).first()
            train = (F.col("_hk") < at["_hk"]) | ((F.col("_hk") == at["_hk"]) & (F.col(id_col) <= at[id_col]))
        before += n
    goal = F.when(train, "train").otherwise("test")
    # the folder first, so that the writer keeps the order as it is
    rows = keyed.withColumn("goal", goal).repartitionByRange(shards, "_hk", id_col).sortWithinPartitions("goal", "_hk", id_col)
    rows.drop("_hk").write.mode("overwrite").partitionBy("goal").parquet(path)


def read_shuffled(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``write_shuffled`` with ``goal`` and ``pos``, their place in the whole order, from file names and row numbers."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn("_file", F.col("_metadata.file_name")).withColumn("_at", F.col("_metadata.row_index"))
    # a row per file: shard numbers lead the names; train comes first
    sizes = rows.groupBy("goal", "_file").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(F.desc("goal"), "_file")) - F.col("_n")).drop("_n")
    return rows.join(F.broadcast(before), ["goal", "_file"]).withColumn("pos", F.col("_before") + F.col("_at") + 1).drop("_file", "_at", "_before")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_xml(df: DataFrame, path: str, row_tag: str, root_tag: str) -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: StructType | str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def parse_manifest(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """A text literal list of paths (single or double quotes) -> one row per path."""
    return lines.withColumn("path", F.explode(F.from_json(F.col(line_col), "array<string>")))
