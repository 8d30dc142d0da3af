"""Corpus preparation: filters, remaps, ranking within classes, splits, sampling, zip, batches.

Ranking inside a few huge classes: a plain ``row_number() over (partition by
class)`` sends a whole class to one task. ``rank_within`` splits every class
into buckets that follow the sort order (bucket = high bits of the sort key),
ranks inside each bucket, and adds the prefix sum of the bucket sizes. A hot
class then spreads over many tasks, and the result equals the plain window.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: shuffle seed of the reference's data preparation, split ratio
SEED = 42
TRAIN_FRACTION = 0.7
TEST_FRACTION = 0.3
ID_BUCKET_BITS = 16          # ids are unique, so a bucket holds at most 65536 rows
HASH_BUCKET_HEX = 4          # 16^4 = 65536 hash buckets


def hash_key(id_col: str, seed: int = SEED) -> Column:
    """Deterministic shuffle key ``md5('<seed>:<id>')`` (same value in any SQL engine)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def id_bucket(id_col: str) -> Column:
    return F.shiftright(F.col(id_col).cast("long"), ID_BUCKET_BITS)


def hash_bucket(key_col: str) -> Column:
    return F.conv(F.substring(F.col(key_col), 1, HASH_BUCKET_HEX), 16, 10).cast("long")


def rank_within(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], bucket: Column,
                out: str = "rn") -> DataFrame:
    """1-based ``row_number`` over ``keys`` ordered by ``order_cols``, skew-safe.

    ``bucket`` must be non-decreasing in the sort order (e.g. high bits of the key).
    """
    keys = list(keys)
    d = df.withColumn("_b", bucket)
    d = d.withColumn("_lrn", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order_cols)))
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0))).drop("_cnt")
    # null classes and null sort keys are a class and a bucket of their own
    renamed = offs.select(*[F.col(k).alias(f"_o_{k}") for k in keys + ["_b"]], "_off")
    same = F.lit(True)
    for k in keys + ["_b"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return d.join(renamed, same).withColumn(out, (F.col("_off") + F.col("_lrn")).cast("long")) \
        .drop("_b", "_lrn", "_off", *[f"_o_{k}" for k in keys + ["_b"]])


def rank_by_id(df: DataFrame, keys: Sequence[str], id_col: str, out: str = "rn") -> DataFrame:
    return rank_within(df, keys, [id_col], id_bucket(id_col), out)


def rank_by_hash(df: DataFrame, keys: Sequence[str], id_col: str, out: str = "rn",
                 seed: int = SEED) -> DataFrame:
    d = df.withColumn("_hk", hash_key(id_col, seed))
    return rank_within(d, keys, ["_hk", id_col], hash_bucket("_hk"), out).drop("_hk")


def first_appearance_order(df: DataFrame, group: str, item: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., group, order): 0-based rank of each group by its first item; groups of a page are few."""
    firsts = df.groupBy(*keys, group).agg(F.min(item).alias("_first"))
    return firsts.withColumn("order", (F.dense_rank().over(
        Window.partitionBy(*keys).orderBy("_first")) - 1).cast("long")).drop("_first")


# ---- class statistics, head, zip, batches ---------------------------------------------

def class_sizes(df: DataFrame, cls: str) -> DataFrame:
    """Rows per class (null class left out) and the smallest class size on every row."""
    sizes = df.where(F.col(cls).isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.agg(F.min("n").alias("min_n"))
    return sizes.crossJoin(F.broadcast(smallest))


def class_head(df: DataFrame, cls: str, id_col: str) -> DataFrame:
    """First m rows of each class in id order, m = size of the smallest class."""
    ranked = rank_by_id(df.where(F.col(cls).isNotNull()), [cls], id_col, "rn")
    m = df.where(F.col(cls).isNotNull()).groupBy(cls).count().agg(F.min("count").alias("_m"))
    return ranked.crossJoin(F.broadcast(m)).where(F.col("rn") <= F.col("_m")).drop("_m")


def stratified_zip(df: DataFrame, cls: str, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Sample i = row i of every class (classes ascending): one packed row per sample.

    Each sample holds exactly one row per class, so a group is bounded by the
    number of classes.
    """
    head = class_head(df, cls, id_col)
    return head.groupBy(F.col("rn").alias("sample")).agg(F.array_sort(F.collect_list(
        F.struct(F.col(cls).alias("cls"), F.col(id_col).alias("id"), *[F.col(c) for c in cols]))).alias("items"))


def batch_rows(df: DataFrame, cls: str, id_col: str, batch_size: int) -> DataFrame:
    """Balanced rows with sample number and batch id ``(sample - 1) div batch_size``."""
    head = class_head(df, cls, id_col)
    return head.withColumn("sample", F.col("rn")).withColumn(
        "batch_id", F.floor((F.col("rn") - 1) / F.lit(batch_size)).cast("long"))


def batches(df: DataFrame, cls: str, id_col: str, batch_size: int) -> DataFrame:
    """Every row with its batch: ``batch_size`` rows of each class a batch, classes running out one by one."""
    ranked = rank_by_id(df, [cls], id_col, "rn")
    return ranked.withColumn("batch_id", F.floor((F.col("rn") - 1) / F.lit(batch_size)).cast("long"))


# ---- splits and sampling --------------------------------------------------------------

def shuffle_order(df: DataFrame, id_col: str, keys: Sequence[str] = (), seed: int = SEED,
                  out: str = "pos") -> DataFrame:
    """Seeded shuffle: position of each row in ``md5(seed:id), id`` order (per group)."""
    return rank_by_hash(df, keys, id_col, out, seed)


def split_positional(df: DataFrame, id_col: str, train_fraction: float = TRAIN_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """First ``int(train_fraction * n)`` shuffled rows are train, the rest test."""
    ranked = shuffle_order(df, id_col, (), seed, "pos")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.lit(train_fraction) * F.col("_n"))
    return ranked.crossJoin(F.broadcast(n)).withColumn(
        "split", F.when(F.col("pos") <= cut, F.lit("train")).otherwise(F.lit("test"))).drop("_n")


def split_stratified(df: DataFrame, cls: str, id_col: str, test_fraction: float = TEST_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """Per class: test = ceil(test_fraction * n_c) rows, train = the rest (shuffled order)."""
    ranked = shuffle_order(df, id_col, [cls], seed, "pos")
    sizes = df.groupBy(F.col(cls).alias("_cls")).agg(F.count(F.lit(1)).alias("_n"))
    n_train = F.col("_n") - F.ceil(F.lit(test_fraction) * F.col("_n"))
    return ranked.join(sizes, F.col(cls).eqNullSafe(F.col("_cls"))).withColumn(
        "split", F.when(F.col("pos") <= n_train, F.lit("train")).otherwise(F.lit("test"))).drop("_n", "_cls")


def balanced_downsample(df: DataFrame, label: str, id_col: str, seed: int = SEED) -> DataFrame:
    """Binary labels: keep min(n_1, n_0) hash-ordered rows of each label."""
    d = df.where(F.col(label).isin(0, 1))
    ranked = shuffle_order(d, id_col, [label], seed, "pos")
    m = d.groupBy(label).count().agg(F.min("count").alias("_m"))
    return ranked.crossJoin(F.broadcast(m)).where(F.col("pos") <= F.col("_m")).drop("_m")


# ---- remaps -----------------------------------------------------------------------------

def remap_two_way(c: str) -> Column:
    """Sequential remap ``< 2 -> 1`` then ``> 2 -> 2`` (class 2 is filtered before)."""
    return F.when(F.col(c) < 2, F.lit(1)).when(F.col(c) > 2, F.lit(2)).otherwise(F.col(c))


def remap_dict(c: str, mapping: dict[str, int]) -> Column:
    """Dictionary remap; a key outside the dictionary is an error."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    looked = F.try_element_at(m, F.col(c))
    return F.when(looked.isNull(), F.raise_error(F.concat(F.lit("unknown key: "), F.col(c).cast("string")))) \
        .otherwise(looked).cast("int")


def label_pm1(c: str) -> Column:
    """0 -> -1, other values unchanged."""
    return F.when(F.col(c) == 0, F.lit(-1)).otherwise(F.col(c))


def one_hot(c: str, k: int, base: int = 0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                       lambda i: F.when(i == F.col(c) - F.lit(base), 1).otherwise(0))
