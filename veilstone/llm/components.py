"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) LONG links -> (node, component): the smallest node that can be reached.

    Every round a node takes the smallest label among its neighbours and itself, the node that its old
    label names takes the smallest that any of its followers took, and then each takes the label of
    its label, so that whole trees join and long chains shorten by powers of two.  Labels only fall,
    so it ends when none changes.  Each round is a written table; nothing but the number of changes
    comes to the driver.  No links, no rows.
    """
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct(), "links")
    labels = written(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("component").alias("near"))
        lower = written(labels.join(near, labels["node"] == near["src"]).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was")), "lower")
        hooks = lower.groupBy(F.col("was").alias("root")).agg(F.min("component").alias("hook"))
        hooked = written(lower.join(hooks, lower["node"] == hooks["root"], "left").select("node", F.least("component", "hook").alias("component"), "was"), "hooked")
        up = hooked.select(F.col("node").alias("at"), F.col("component").alias("of"))
        nxt = written(hooked.join(up, hooked["component"] == up["at"], "left").select("node", F.least("component", "of").alias("component"), "was"), "labels")
        labels = nxt.select("node", "component")
        if nxt.where("component != was").limit(1).count() == 0:
            return labels
