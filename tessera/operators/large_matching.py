"""Matchings of cell tables of any size, as rounds of DataFrame jobs: no row and no task holds the cells of a group.

Cells are (keys..., row, col, value); one fit solves all groups together.

- ``greedy_rounds``: a cell that comes first in its row and in its column, in the greedy order (value down, row, col),
  is taken by the sequential greedy too, whatever it takes before. Each round takes all such cells and drops their rows
  and columns; what is left has the same greedy order.
- ``auction``: the best total of a one-to-one matching of rows and columns with integer values of 0 or more, where a
  missing cell is worth 0. Every free person bids for the object of the largest value less price, by what it is ahead of
  the second best plus epsilon; each object goes to the highest bid. Epsilon falls by ``FALL`` a phase, with prices kept,
  down to 1 while values are multiplied by the number of persons plus 1, which makes the last assignment optimal.
  So that missing cells need no rows, the table is doubled: every row and column has a copy that stands for staying
  alone, and the copies of the ends of a cell may pair up, each for 0; then a perfect matching always exists.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.session import materialize

FALL = 6
# fixed values: kinds of persons and objects in the doubled table
_ROW, _COL = 0, 1


def _observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """``df`` written, and figures of it from the same job."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(n) for n, c in figures.items()]), name)
    return out, seen.get


def greedy_rounds(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str) -> tuple[DataFrame, list[int]]:
    """(keys..., row, col, value, round) of the cells that the greedy takes, and the number of cells left before each
    round; a cell without a row, column or value is none. Columns ``row`` and ``col`` order the ties."""
    keys = list(keys)
    order = F.struct((-F.col("_v")).alias("nv"), "_r", "_c")
    left, seen = _observed(
        cells.where(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .select(*keys, F.col(row).alias("_r"), F.col(col).alias("_c"), F.col(value).alias("_v")), "greedy-cells", n=F.count(F.lit(1)))
    taken, sizes = None, []
    while seen["n"]:
        sizes.append(seen["n"])
        first_r = left.groupBy(*keys, "_r").agg(F.min(order).alias("_o"))
        first_c = left.groupBy(*keys, "_c").agg(F.min(order).alias("_o"))
        both = _joined(first_r.select(*keys, "_r", F.col("_o._c").alias("_c"), (-F.col("_o.nv")).alias("_v")),
                       first_c.select(*keys, F.col("_o._r").alias("_r"), "_c"), [*keys, "_r", "_c"])
        both = materialize(both.select(*keys, "_r", "_c", "_v"), "greedy-taken")
        mine = both.withColumn("round", F.lit(len(sizes) - 1))
        taken = mine if taken is None else taken.unionByName(mine)
        rest = _without(_without(left, both.select(*keys, "_r"), [*keys, "_r"]), both.select(*keys, "_c"), [*keys, "_c"])
        left, seen = _observed(rest, "greedy-cells", n=F.count(F.lit(1)))
    if taken is None:
        taken = left.withColumn("round", F.lit(0))
    return taken.select(*keys, F.col("_r").alias(row), F.col("_c").alias(col), F.col("_v").alias(value), "round"), sizes


def _match(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    """``right`` under other names, and the null-safe condition on them."""
    named = right.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & left[c].eqNullSafe(F.col(f"_o{i}"))
    return named, same


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal."""
    named, same = _match(left, right, on)
    return left.join(named, same, how).drop(*[f"_o{i}" for i in range(len(on))])


def _without(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    named, same = _match(left, right, on)
    return left.join(named, same, "left_anti")


def greedy_sum(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str, out: str = "total") -> DataFrame:
    """(keys..., out): total value of the greedy matching of each group that has a cell."""
    taken, _ = greedy_rounds(cells, keys, row, col, value)
    return taken.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias(out))


def auction(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str,
            log: list | None = None) -> DataFrame:
    """(keys..., row, col, value) of a matching of the largest total; integer values of 0 or more, others are an error.

    Cells of value 0 are never part of the result (they add nothing), null rows and columns are values like others,
    of cells that repeat a place the largest counts. With ties another solver may choose other pairs; the total is
    the same. ``log`` receives (epsilon, rounds) of each phase.
    """
    keys = list(keys)
    whole = F.col(value).cast("long")
    bad = F.coalesce((whole.cast("double") != F.col(value).cast("double")) | (whole < 0), F.lit(True))
    edges = cells.groupBy(*keys, F.col(row).alias("_r"), F.col(col).alias("_c")).agg(F.max(whole).alias("_v"), F.max(bad).alias("_bad"))
    edges, seen = _observed(edges, "auction-cells", bad=F.max(F.col("_bad").cast("int")), most=F.max("_v"))
    if seen["bad"]:
        raise ValueError(f"{value}: an auction needs integer values of 0 or more")
    edges = edges.where("_v > 0").drop("_bad")

    # persons are rows and copies of columns, objects columns and copies of rows; both as (kind, name)
    def side(kind: int, c: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(F.col(c).alias("v"))).alias("id"))

    r, c = side(_ROW, "_r"), side(_COL, "_c")
    rows, cols = edges.select(*keys, "_r").distinct(), edges.select(*keys, "_c").distinct()
    zero = F.lit(0).cast("long").alias("_v")
    options = (edges.select(*keys, r.alias("_p"), c.alias("_o"), "_v")
               .unionByName(edges.select(*keys, c.alias("_p"), r.alias("_o"), zero))
               .unionByName(rows.select(*keys, r.alias("_p"), r.alias("_o"), zero))
               .unionByName(cols.select(*keys, c.alias("_p"), c.alias("_o"), zero)))
    people = rows.groupBy(*keys).count().unionByName(cols.groupBy(*keys).count()).groupBy(*keys).agg(F.sum("count").alias("_n"))
    # values of a group times its persons plus 1
    options = materialize(_joined(options, people, keys).withColumn("_v", F.col("_v") * (F.col("_n") + 1)).drop("_n"), "auction-options")
    top = options.agg(F.max("_v")).first()[0]
    if top is None:
        return edges.select(*keys, F.col("_r").alias(row), F.col("_c").alias(col), F.col("_v").alias(value))
    objects = materialize(options.select(*keys, "_o").distinct().withColumn("price", F.lit(0).cast("long"))
                          .withColumn("owner", F.lit(None).cast(dict(options.dtypes)["_p"])), "auction-prices")
    epsilon = max(1, top // FALL)
    while True:
        objects, rounds = _phase(options, objects, keys, epsilon)
        if log is not None:
            log.append((epsilon, rounds))
        if epsilon == 1:
            break
        epsilon = max(1, epsilon // FALL)
    won = objects.where((F.col("_o.kind") == _COL) & (F.col("owner.kind") == _ROW)).select(*keys, F.col("owner").alias("_p"), "_o")
    named = edges.withColumn("_p", r).withColumn("_o", c)
    return _joined(named, won, [*keys, "_p", "_o"]).select(*keys, F.col("_r").alias(row), F.col("_c").alias(col), F.col("_v").alias(value))


def _phase(options: DataFrame, objects: DataFrame, keys: list[str], epsilon: int) -> tuple[DataFrame, int]:
    """Bids of ``epsilon`` until every person owns an object; prices go on from ``objects``."""
    best = Window.partitionBy(*keys, "_p").orderBy(F.desc("_net"), "_o")
    objects, rounds = objects.withColumn("owner", F.lit(None).cast(dict(objects.dtypes)["owner"])), 0
    while True:
        held = objects.where(F.col("owner").isNotNull()).select(*keys, F.col("owner").alias("_p"))
        free = _without(options, held, [*keys, "_p"]) if rounds else options
        priced = _joined(free, objects.select(*keys, "_o", "price"), [*keys, "_o"])
        # the two best options of a person; it always has two, its own copy and another
        two = (priced.withColumn("_net", F.col("_v") - F.col("price")).withColumn("_k", F.row_number().over(best)).where("_k <= 2")
               .groupBy(*keys, "_p").agg(F.max(F.when(F.col("_k") == 1, F.struct("_net", "_o", "price"))).alias("_1"),
                                         F.max(F.when(F.col("_k") == 2, F.col("_net"))).alias("_2")))
        bids = two.select(*keys, F.col("_1._o").alias("_o"), "_p",
                          (F.col("_1.price") + F.col("_1._net") - F.coalesce("_2", F.col("_1._net")) + epsilon).alias("bid"))
        won = bids.groupBy(*keys, "_o").agg(F.max(F.struct("bid", "_p")).alias("_w"))
        after = _joined(objects, won, [*keys, "_o"], "left").select(
            *keys, "_o", F.coalesce("_w.bid", "price").alias("price"), F.coalesce("_w._p", "owner").alias("owner"))
        objects, seen = _observed(after, "auction-prices", free=F.sum(F.col("owner").isNull().cast("long")))
        rounds += 1
        if not seen["free"]:
            return objects, rounds


def auction_total(cells: DataFrame, keys: Sequence[str], row: str, col: str, value: str, out: str = "total") -> DataFrame:
    """(keys..., out): largest total of a one-to-one matching of each group; 0 where all cells are worth nothing."""
    keys = list(keys)
    pairs = auction(cells, keys, row, col, value).groupBy(*keys).agg(F.sum(value).alias(out))
    if keys:
        pairs = _joined(cells.select(*keys).distinct(), pairs, keys, "left")
    return pairs.select(*keys, F.coalesce(out, F.lit(0)).cast("double").alias(out))
