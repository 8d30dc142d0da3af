"""Text -> vector encoders by name.

Sparse ones give the long form (doc_id, term, weight), one row per term of a document. Dense ones give (doc_id, x), an
``array<double>`` of fixed length that feeds prototypes and k-means: a sparse sign projection, in which every term adds
plus or minus its weight to ``SLOTS`` places found from its hash, so there is no vocabulary and nothing to fit. The
expected inner product of two projected vectors is that of the sparse ones, its standard error at most about
``sqrt(2 / dim)`` times the product of their lengths.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.vectors import bind
from tessera.session import materialize


# fixed value: most frequent terms whose figures are broadcast; rows of all other terms are joined by term
FREQUENT_TERMS = 100_000
# repeated ids up to which they are broadcast as a list
FEW_IDS = 1_000_000


def _runs(sorted_terms):
    """Array of (term, tf) of a sorted array of terms."""
    def counted(s):
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i - 1) != F.get(s, i)))
        return bind(ends, lambda e: F.transform(e, lambda end, j: F.struct(
            F.get(s, end - 1).alias("term"), (end - F.when(j > 0, F.get(e, j - 1)).otherwise(0)).cast("long").alias("tf"))))
    return bind(sorted_terms, lambda s: F.when(F.size(s) > 0, counted(s)))


def packed_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, items array<struct<term, tf>>): one row for each document that has tokens, written once.

    Texts are dealt out evenly and counted where they stand. Only rows whose id comes again are exchanged, to be counted together; rows without
    an id stay apart (no vector names them, they count as one document in the document frequencies).
    """
    dealt = docs.select("doc_id", "text").repartition(F.xxhash64("doc_id", "text"))
    rows = materialize(dealt.select("doc_id", _runs(F.sort_array(T.tokens("text"))).alias("items")), "term-counts").where("items IS NOT NULL")
    again = materialize(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                        .select("doc_id"), "repeated-ids")
    n = again.count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= FEW_IDS else again
    merged = (rows.join(again, "doc_id", "left_semi").select("doc_id", F.inline("items")).groupBy("doc_id", "term")
              .agg(F.sum("tf").alias("tf")).groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("items")))
    return materialize(rows.join(again, "doc_id", "left_anti").unionByName(merged), "term-counts")


def vocabulary(packed: DataFrame) -> DataFrame:
    """(term, df): documents that hold each term, added up in the tasks first."""
    named = packed.where("doc_id IS NOT NULL").select(F.explode("items.term").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"))
    nameless = packed.where("doc_id IS NULL").select(F.explode("items.term").alias("term")).distinct().withColumn("df", F.lit(1).cast("long"))
    return named.unionByName(nameless).groupBy("term").agg(F.sum("df").alias("df"))


def with_terms(packed: DataFrame, words: DataFrame, most: int | None = None) -> DataFrame:
    """Long form (the columns of ``packed``, term, tf, the columns of ``words``), ``words`` with ``df`` written already.

    The ``most`` most frequent terms are broadcast, so that the bulk of the rows does not move; the rest are joined by term.
    """
    most = FREQUENT_TERMS if most is None else most
    rows = packed.select(*[c for c in packed.columns if c != "items"], F.inline("items"))
    if words.count() <= most:
        return rows.join(F.broadcast(words), "term")
    # the df from which terms are frequent: few different values of df, or else the first of a top-k
    cut = words.select("df").orderBy(F.desc("df")).limit(most + 1).agg(F.min("df")).first()[0]
    frequent, rest = words.where(F.col("df") > cut), words.where(F.col("df") <= cut)
    known = F.broadcast(frequent.select("term"))
    return rows.join(F.broadcast(frequent), "term").unionByName(
        rows.join(known, "term", "left_anti").join(rest, "term"))


def _unit_weights(packed: DataFrame, words: DataFrame, weight) -> DataFrame:
    """(doc_id, term, weight, places where ``words`` has them): weights divided by the Euclidean norm of their document
    (documents without weight drop out). Norms go back to the packed documents, the long form is not exchanged for them."""
    packed = packed.where("doc_id IS NOT NULL")
    norms = with_terms(packed, words.drop("places")).groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("_n")).where("_n > 0")
    long = with_terms(packed.join(norms, "doc_id"), words)
    return long.select("doc_id", "term", (weight / F.col("_n")).alias("weight"), *[c for c in words.columns if c == "places"])


def _tf(docs: DataFrame, places=None) -> DataFrame:
    if places is None:
        # a document's own counts are all there is to know
        norm = F.sqrt(F.aggregate("items", F.lit(0.0), lambda s, x: s + x["tf"].cast("double") * x["tf"]))
        packed = packed_counts(docs).where("doc_id IS NOT NULL").withColumn("_n", norm)
        return packed.select("doc_id", "_n", F.inline("items")).select(
            "doc_id", "term", (F.col("tf").cast("double") / F.col("_n")).alias("weight"))
    packed = packed_counts(docs)
    words = materialize(vocabulary(packed).withColumn("places", places), "vocabulary")
    return _unit_weights(packed, words, F.col("tf").cast("double"))


def _tfidf(docs: DataFrame, places=None) -> DataFrame:
    packed = packed_counts(docs)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    words = vocabulary(packed).crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    words = materialize(words if places is None else words.withColumn("places", places), "vocabulary")
    return _unit_weights(packed, words, F.col("tf") * F.col("idf"))


def tf(docs: DataFrame) -> DataFrame:
    """Term frequencies, unit length."""
    return _tf(docs)


def tfidf(docs: DataFrame) -> DataFrame:
    """tf x ln((N + 1) / (df + 1)), unit length; document frequencies are never collected."""
    return _tfidf(docs)


SLOTS = 4
DIM = 64


def places(dim: int = DIM, slots: int = SLOTS):
    """The ``slots`` (place, sign) of a term, from md5('<term>:<m>')."""
    def slot(m):
        h = F.md5(F.concat(F.col("term"), F.lit(":"), m.cast("string")))
        place = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
        return F.struct(place.alias("place"), F.when(F.substring(h, 9, 1) >= "8", 1.0).otherwise(-1.0).alias("sign"))
    return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), slot)


def projected(weights: DataFrame, dim: int = DIM, slots: int = SLOTS) -> DataFrame:
    """(doc_id, x) from (doc_id, term, weight), and ``places`` if they were found already, once for each term.

    Sums are by document and place, added up in the tasks first: at most ``dim`` rows of a document move.
    """
    if "places" not in weights.columns:
        weights = weights.withColumn("places", places(dim, slots))
    put = weights.select("doc_id", "weight", F.explode("places").alias("s"))
    sums = put.groupBy("doc_id", F.col("s.place").alias("place")).agg(
        (F.sum(F.col("s.sign") * F.col("weight")) / F.sqrt(F.lit(float(slots)))).alias("v"))
    packed = sums.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return packed.select("doc_id", x.alias("x"))


ENCODERS: dict[str, Callable[[DataFrame], DataFrame]] = {"tf": tf, "tfidf": tfidf}


def encode(docs: DataFrame, encoder: str) -> DataFrame:
    """Vectors of ``docs`` (doc_id, text) under the encoder of that name; an unknown name is an error."""
    if encoder not in ENCODERS:
        raise KeyError(f"no encoder {encoder!r}; there are {sorted(ENCODERS)}")
    return ENCODERS[encoder](docs)


DENSE_ENCODERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "tf_projected": lambda docs, dim: projected(_tf(docs, places(dim)), dim),
    "tfidf_projected": lambda docs, dim: projected(_tfidf(docs, places(dim)), dim),
}


def register_dense(name: str, encoder: Callable[[DataFrame, int], DataFrame]) -> None:
    """Add an encoder: (docs with doc_id and text, length) -> (doc_id, x array<double>)."""
    DENSE_ENCODERS[name] = encoder


def embed(docs: DataFrame, encoder: str, dim: int = DIM) -> DataFrame:
    """(doc_id, x) of the documents that have a weighted term; an unknown name is an error."""
    if encoder not in DENSE_ENCODERS:
        raise KeyError(f"no dense encoder {encoder!r}; there are {sorted(DENSE_ENCODERS)}")
    return DENSE_ENCODERS[encoder](docs, dim)
