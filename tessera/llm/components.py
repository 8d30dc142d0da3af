"""Connected components of an edge table, by minimum labels and pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import salted_join, stage
from tessera.session import discard


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node of its component.

    Each round takes the smallest label among the neighbours, then follows the label's own label. Rounds go on
    until no label changes; each round is written to the shared folder. The large side of a join is the edge
    table, whose degrees stay those of the input, so no key gathers a whole component there.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("_least")).select(
        F.col("a").alias("node"), F.least("a", "_least").alias("root"))
    labels = stage(labels, "labels")
    while True:
        seen = (both.join(labels.withColumnRenamed("node", "b"), "b")
                .groupBy("a").agg(F.min("root").alias("_near")))
        hooked = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("_old"), F.least("root", "_near").alias("root"))
        before, hooked = labels, stage(hooked, "labels")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        # all members of a component point at one root
        labels = stage(salted_join(hooked, jump, "root").select("node", "_old", F.col("_next").alias("root")), "labels")
        changed = labels.where("root <> _old").limit(1).count()
        # rounds before this one are not read again
        discard(before)
        discard(hooked)
        if not changed:
            discard(both)
            return labels.select("node", "root")
