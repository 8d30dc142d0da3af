"""Driver tables and the corpora derived from them.

The reference reads labelled CSV corpora, vectors from a language model,
paragraph-pair tables and page annotations. The driver tables stand in:

- text corpus   <- ``documents``: class_index = dense rank of ``lang`` (1-based),
                   title = ``source``, description = ``text``, id = ``doc_id``
- vectors       <- ``embeddings``: id ``vec_id``, ``embedding`` as array<double>, label 0-9
- binary labels <- ``labels``
- pages         <- ``embeddings``: runs of 300 ids make pages of 1, 2, ..., 24 paragraphs
- pairs         <- ``embeddings``: vec_id 2i with 2i+1
- annotations   <- ``conversations``: page = conv_id, item = turn, reading order = role
- bbox literals <- ``lineitem``
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import as_double_vector

# fixed values: vectors stand in for page paragraphs, ``PAGE_RUN`` ids make pages of 1, 2, ..., ``MOST_PARAS`` paragraphs
MOST_PARAS = 24
PAGE_RUN = MOST_PARAS * (MOST_PARAS + 1) // 2
# classes (languages) at most; they are ranked on the driver and looked up by broadcast
MOST_CLASSES = 10_000

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of the driver data."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def class_names(df: DataFrame, col: str) -> list[str]:
    """Distinct non-null values of ``col`` in order; more than ``MOST_CLASSES`` are an error, never cut off."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{col}: more than {MOST_CLASSES} classes")
    return sorted(r[0] for r in rows)


def with_class_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """1-based dense rank of ``col`` by a broadcast lookup: the rows of ``df`` are not shuffled."""
    names = class_names(df, col)
    ranks = df.sparkSession.createDataFrame([(n, i + 1) for i, n in enumerate(names)], f"`{col}` string, `{out}` int")
    return df.join(F.broadcast(ranks), col, "left")


def page_of(id_col: str = "id"):
    """Page of a vector id (pages of 1 to ``MOST_PARAS`` paragraphs)."""
    r = F.col(id_col) % PAGE_RUN
    return (F.floor(F.col(id_col) / PAGE_RUN) * MOST_PARAS + F.floor((F.sqrt(8 * r + 1) - 1) / 2)).cast("long")


def para_of(id_col: str = "id"):
    """Position of a vector id in its page, from 0."""
    r = F.col(id_col) % PAGE_RUN
    t = F.floor((F.sqrt(8 * r + 1) - 1) / 2)
    return (r - t * (t + 1) / 2).cast("int")


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_index, title, description) from ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    ranked = with_class_rank(docs, "lang", "class_index")
    return ranked.select("doc_id", "class_index", F.col("source").alias("title"),
                         F.col("text").alias("description"), "lang")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x array<double>, label) from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), as_double_vector("embedding").alias("x"), "label")


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors laid out as pages of unequal length."""
    return vectors(spark, sf_dir).select(page_of().alias("page"), para_of().alias("para"), "id", "x", "label")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair table: vector 2i with 2i+1, y = 1 when labels agree, else 0.

    Built by an equi-join on ``pair_id``; both sides are partitioned on it.
    """
    v = vectors(spark, sf_dir).withColumn("pair_id", (F.col("id") / 2).cast("long"))
    a = v.where(F.col("id") % 2 == 0).select("pair_id", F.col("id").alias("id_1"),
                                             F.col("x").alias("x_1"), F.col("label").alias("label_1"))
    b = v.where(F.col("id") % 2 == 1).select("pair_id", F.col("id").alias("id_2"),
                                             F.col("x").alias("x_2"), F.col("label").alias("label_2"))
    return a.join(b, "pair_id").withColumn(
        "y", F.when(F.col("label_1") == F.col("label_2"), 1).otherwise(0))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page annotation records: (page, item, reading_order)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").alias("item"), F.col("role").alias("reading_order"))


def bbox_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box literals ``[x1, y1, x2, y2]`` on the 10000 grid from ``lineitem`` numbers."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                 "l_suppkey", "l_quantity")
    x1 = F.col("l_partkey") % 10000
    y1 = F.col("l_suppkey") % 10000
    x2 = (F.col("l_partkey") * 7 + F.col("l_quantity").cast("long")) % 10000
    y2 = (F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 10000
    lit = F.concat(F.lit("["), F.concat_ws(", ", x1.cast("string"), y1.cast("string"),
                                           x2.cast("string"), y2.cast("string")), F.lit("]"))
    return li.select("l_orderkey", "l_linenumber", lit.alias("bbox"))
