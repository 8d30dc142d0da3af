"""Page-layout preparation: bounding boxes, position lookups, reading-order groups."""
from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import layout as L
from tessera.functions import vectors as V
from tessera.operators import prep
from tessera.plans.registry import query
from tessera.sources import tables

_LIT = ("concat('[', CAST(l_partkey % 10000 AS VARCHAR), ', ', CAST(l_suppkey % 10000 AS VARCHAR), ', ', "
        "CAST((l_partkey * 7 + CAST(trunc(l_quantity) AS BIGINT)) % 10000 AS VARCHAR), ', ', "
        "CAST((l_suppkey * 13 + l_linenumber) % 10000 AS VARCHAR), ']')")
BOX = f"bx AS (SELECT l_orderkey, l_linenumber, CAST({_LIT} AS DOUBLE[]) AS b FROM lineitem)"
SCALED = ("sb AS (SELECT l_orderkey, l_linenumber, CAST(trunc(3000 * (b[1] / 10000)) AS INTEGER) AS sx1, "
          "CAST(trunc(5000 * (b[2] / 10000)) AS INTEGER) AS sy1, CAST(trunc(3000 * (b[3] / 10000)) AS INTEGER) AS sx2, "
          "CAST(trunc(5000 * (b[4] / 10000)) AS INTEGER) AS sy2 FROM bx)")
CENTER = ("ct AS (SELECT l_orderkey, l_linenumber, least(10000, CAST(trunc((sx1 + sx2) / 2) AS INTEGER)) AS x, "
          "least(10000, CAST(trunc((sy1 + sy2) / 2) AS INTEGER)) AS y FROM sb)")


def _boxes(spark, sf_dir):
    b = tables.bbox_literals(spark, sf_dir)
    return b.select("l_orderkey", "l_linenumber", L.bbox_parse("bbox").alias("b"))


@query("bbox_parse", f"WITH {BOX} SELECT l_orderkey, l_linenumber, b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2 FROM bx")
def bbox_parse(spark, sf_dir):
    """Parse the list literal of a box."""
    b = _boxes(spark, sf_dir)
    return b.select("l_orderkey", "l_linenumber", *[F.col("b")[i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])])


def _scaled(spark, sf_dir):
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", L.bbox_scale("b").alias("s"))


@query("bbox_scale", f"WITH {BOX}, {SCALED} SELECT * FROM sb")
def bbox_scale(spark, sf_dir):
    """scale from the 10000 grid to 3000 x 5000, truncating."""
    s = _scaled(spark, sf_dir)
    return s.select("l_orderkey", "l_linenumber", *[F.col("s")[i].alias(n) for i, n in enumerate(["sx1", "sy1", "sx2", "sy2"])])


def _centers(spark, sf_dir):
    s = _scaled(spark, sf_dir)
    x, y = L.bbox_center("s")
    return s.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))


@query("bbox_center", f"WITH {BOX}, {SCALED}, {CENTER} SELECT * FROM ct")
def bbox_center(spark, sf_dir):
    """box centre int((a + b) / 2), clamped at 10000."""
    return _centers(spark, sf_dir)


@query("bbox_rect", f"WITH {BOX} SELECT l_orderkey, l_linenumber, CAST(b[1] AS INTEGER) AS r1, CAST(b[2] AS INTEGER) AS r2, "
       "CAST(b[3] AS INTEGER) AS r3, CAST(b[4] AS INTEGER) AS r4 FROM bx")
def bbox_rect(spark, sf_dir):
    """rectangle from a corner list (corner 0 ++ corner 2)."""
    b = _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("b").cast("array<int>").alias("i"))
    corners = F.array(F.array(F.col("i")[0], F.col("i")[1]), F.array(F.col("i")[2], F.col("i")[1]),
                      F.array(F.col("i")[2], F.col("i")[3]), F.array(F.col("i")[0], F.col("i")[3]))
    r = b.select("l_orderkey", "l_linenumber", L.bbox_rect(corners).alias("r"))
    return r.select("l_orderkey", "l_linenumber", *[F.col("r")[i].alias(f"r{i + 1}") for i in range(4)])


# fixed values: rows of the x and y position tables
X_ROWS, Y_ROWS = 3000, 5000

_PAIRED = ("bp AS (SELECT a.l_orderkey, a.l_linenumber, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ct a JOIN ct b "
           "ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)")
_POS = (f"px AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < {X_ROWS}), "
        f"py AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < {Y_ROWS})")


def _mean_sql(a: str, b: str) -> str:
    return f"list_transform(range(1, len({a}) + 1), lambda i: coalesce(({a}[i] + {b}[i]) / 2, 0.0))"


@query("position_lookup", f"WITH {BOX}, {SCALED}, {CENTER}, {_PAIRED}, {_POS}, lk AS (SELECT l_orderkey, l_linenumber, a.v AS vx1, b.v AS vx2, "
       "c.v AS vy1, d.v AS vy2 FROM bp LEFT JOIN px a ON a.k = x1 LEFT JOIN px b ON b.k = x2 LEFT JOIN py c ON c.k = y1 "
       "LEFT JOIN py d ON d.k = y2), mn AS (SELECT *, CASE WHEN vx1 IS NOT NULL AND vx2 IS NOT NULL THEN "
       f"{_mean_sql('vx1', 'vx2')} END AS xa, CASE WHEN vy1 IS NOT NULL AND vy2 IS NOT NULL THEN {_mean_sql('vy1', 'vy2')} END AS ya FROM lk) "
       "SELECT l_orderkey, l_linenumber, CAST((vx1 IS NULL)::INT + (vx2 IS NULL)::INT + (vy1 IS NULL)::INT + (vy2 IS NULL)::INT "
       "AS INTEGER) AS outside, round(list_sum(xa), 6) AS x_sum, round(list_sum(list_transform(xa, lambda t: t * t)), 6) AS x_square, "
       "round(list_sum(ya), 6) AS y_sum, round(list_sum(list_transform(ya, lambda t: t * t)), 6) AS y_square FROM mn")
def position_lookup(spark, sf_dir):
    """Rows of the x and y position tables looked up for every box and the next one of its order, and their mean
    vectors (their sums and squared lengths, in which every dimension takes part); ids without a row give null and are
    counted in ``outside``."""
    c = _centers(spark, sf_dir)
    one = c.select("l_orderkey", "l_linenumber", F.col("x").alias("x1"), F.col("y").alias("y1"))
    two = c.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    rows = tables.vectors(spark, sf_dir).select(F.col("id").alias("k"), F.col("x").alias("v"))
    looked = one.join(two, ["l_orderkey", "l_linenumber"])
    for name, most in (("x1", X_ROWS), ("x2", X_ROWS), ("y1", Y_ROWS), ("y2", Y_ROWS)):
        # bounded by the grid: at most X_ROWS or Y_ROWS vectors
        grid = rows.where(F.col("k") < most).select(F.col("k").alias(name), F.col("v").alias(f"v{name}"))
        looked = looked.join(F.broadcast(grid), name, "left")
    outside = sum(F.col(f"v{n}").isNull().cast("int") for n in ("x1", "x2", "y1", "y2"))
    means = {n: V.vscale(V.vadd(f"v{n}1", f"v{n}2"), 0.5) for n in "xy"}
    figures = [V.bind(m, lambda a: F.struct(V.vsum(a).alias("sum"), V.dot(a, a).alias("square"))).alias(n) for n, m in means.items()]
    d = looked.select("l_orderkey", "l_linenumber", outside.alias("outside"), *figures)
    return d.select("l_orderkey", "l_linenumber", "outside", *[F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in "xy" for f in ("sum", "square")])


@query("position_counts", f"WITH {BOX}, {SCALED}, {CENTER}, "
       "xs AS (SELECT x, count(*) AS x_count FROM ct GROUP BY x), ys AS (SELECT y, count(*) AS y_count FROM ct GROUP BY y) "
       "SELECT ct.l_orderkey, ct.l_linenumber, ct.x, ct.y, xs.x_count, ys.y_count FROM ct JOIN xs USING (x) JOIN ys USING (y)")
def position_counts(spark, sf_dir):
    """How many boxes share each centre coordinate."""
    c = _centers(spark, sf_dir)
    xs = c.groupBy("x").agg(F.count(F.lit(1)).alias("x_count"))
    ys = c.groupBy("y").agg(F.count(F.lit(1)).alias("y_count"))
    return c.join(xs, "x").join(ys, "y").select(
        "l_orderkey", "l_linenumber", "x", "y", "x_count", "y_count")


_RO = ("ro AS (SELECT a.conv_id AS page, a.turn AS item, f.grp AS group_id FROM conversations a JOIN "
       "(SELECT conv_id, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS grp "
       "FROM conversations GROUP BY conv_id, role) f ON f.conv_id = a.conv_id AND f.role IS NOT DISTINCT FROM a.role)")


def _reading_order_groups(spark, sf_dir):
    ann = tables.annotations(spark, sf_dir)
    ranked = prep.first_appearance_order(ann, "reading_order", "item", ["page"]).withColumnRenamed("order", "group_id")
    r = ranked.select(F.col("page").alias("_page"), F.col("reading_order").alias("_ro"), "group_id")
    cond = (ann["page"] == r["_page"]) & ann["reading_order"].eqNullSafe(r["_ro"])
    return ann.join(r, cond).select("page", "item", "group_id")


@query("reading_order_groups", f"WITH {_RO} SELECT page, item, group_id FROM ro")
def reading_order_groups(spark, sf_dir):
    """Same-key items of a page share an id; ids follow first appearance."""
    return _reading_order_groups(spark, sf_dir)


@query("groups_per_page", f"WITH {_RO}, g AS (SELECT page, count(DISTINCT group_id) AS n_groups FROM ro GROUP BY page) "
       "SELECT page, n_groups, (SELECT max(n_groups) FROM g) AS max_groups FROM g")
def groups_per_page(spark, sf_dir):
    """Distinct reading-order groups per page and the maximum over pages."""
    # a group is one reading-order value of a page; no numbering is needed to count them
    items = tables.annotations(spark, sf_dir)
    g = items.groupBy("page").agg((F.countDistinct("reading_order") + F.max(
        F.col("reading_order").isNull().cast("int"))).alias("n_groups"))
    mx = g.agg(F.max("n_groups").alias("max_groups"))
    return g.crossJoin(F.broadcast(mx)).orderBy("n_groups")
