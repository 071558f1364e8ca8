"""Connected components over an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Every round takes each node's smallest neighbouring label, then follows the
    label's own label, so paths halve. Labels are written to the shared folder
    each round; nothing is gathered on the driver but one count.
    """
    both = cut(edges.select(F.col("a"), F.col("b")).union(edges.select("b", "a")).distinct())
    # what is joined is written first: so a hub, or the root of a large component, can be split between tasks
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hopped = written(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root")))
        jump = hopped.select(F.col("node").alias("at"), F.col("root").alias("to"))
        nxt = cut(hopped.join(jump, hopped.root == jump["at"]).select("node", "old", F.least("root", "to").alias("root")))
        changed = nxt.filter("root <> old").limit(1).count()
        labels = nxt.select("node", "root")
        if not changed:
            return labels
