"""Helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes
import gc
import re
from typing import Any, Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, materialize, ship_package

# rows turned into Python objects at a time inside a task
SLICE_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Shared folder known, package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: computed once, lineage cut, kept when executors go."""
    return materialize(df, name)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str = "doc_id") -> Column:
    """Rows of fold 2 are held out; a null id is not (and is never learned from either)."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) != 2, F.lit(False))


HOT_ROWS = 200_000          # rows of one key from which its rows are dealt to several tasks
SALTS = 32


def salted_join(many: DataFrame, few: DataFrame, key: str, hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Inner join of ``many`` (written already) with ``few``, one row a key, in which a hot key is not one task's work.

    Keys with more than ``hot_rows`` rows in ``many``, at most rows / ``hot_rows`` of them, are broadcast as a list; their
    rows carry a salt and their row of ``few`` is there once for each salt.
    """
    hot = F.broadcast(many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(
        key, F.lit(True).alias("_hot")))
    own = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))).otherwise(0).cast("int")
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = many.join(hot, key, "left").withColumn("_salt", own).drop("_hot")
    copied = few.join(hot, key, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that only a few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_WORKER: dict[Any, Any] = {}


def give_back() -> None:
    """Freed memory back to the machine, as far as the allocators let it go."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc's
    if trim is not None:
        trim(0)


def per_worker(key: Any, make: Callable[[], Any], keep: int = 4) -> Any:
    """An object made once per Python worker; the ``keep`` newest keys of one kind (``key[0]``) stay.

    Workers are used again by later stages: the first object of a kind drops those of all others, so a worker holds
    the models and caches of one operator at a time.
    """
    if key not in _WORKER:
        others = [k for k in _WORKER if k[0] != key[0]]
        for k in others:
            del _WORKER[k]
        if others:
            give_back()
        old = list(_WORKER)
        for k in old[:max(0, len(old) - keep + 1)]:
            del _WORKER[k]
        _WORKER[key] = make()
    return _WORKER[key]


def ddl(df: DataFrame, names: list[str]) -> str:
    """DDL of some columns of ``df``."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


_LETTERS = re.compile(r"[^\W\d_]+")         # letters, and signs such as ² that count neither as letters nor as digits


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters (``str.isalpha``, the Unicode categories L)."""
    found = _LETTERS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m[0])) for m in _LETTERS.finditer(text))
