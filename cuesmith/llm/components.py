"""Connected components of an edge table, with tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.scratch import Tables


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """node, label (least node of its component) for every node of edges(a, b long; any direction, repeats allowed).

    Each round hooks every node and its neighbours to the least label seen and then follows labels once
    (pointer jumping); rounds are written tables, so lineage stays short, and go when the next one stands. Ends
    when no label changes.
    """
    t = tables or Tables(edges.sparkSession)
    one = edges.filter("a <> b")
    both = t.cut(one.select("a", "b").unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = t.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        labels = held.select("node", "label")
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        # the least label around a node is also offered to the node that stood as its label
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("best"))
        offers = seen.select("node", "best").unionByName(seen.select(F.col("label").alias("node"), "best"))
        hooked = offers.groupBy("node").agg(F.min("best").alias("best"))
        up = hooked.select(F.col("node").alias("n"), F.col("best").alias("up"))
        jumped = hooked.join(up, F.col("best") == F.col("n"), "left").select("node", F.least("best", F.coalesce("up", "best")).alias("label"))
        old = labels.withColumnRenamed("label", "old")
        new = t.cut(jumped.join(old, "node").select("node", "label", (F.col("label") < F.col("old")).alias("changed")), "labels")
        t.drop(held)
        held = new
        if not new.filter("changed").limit(1).count():
            t.drop(both)
            return new.select("node", "label")
