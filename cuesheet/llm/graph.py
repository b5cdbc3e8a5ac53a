"""Connected components by smallest label, with pointer jumping; links and labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import release, staged


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b), any way round and repeated: (node, label), the smallest node that a node reaches; staged.

    In a round each node takes its neighbours' smallest label, then that label's own label. Rounds end when none changes.
    """
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        hop = staged(labels.join(near, "node").select("node", F.least("label", "_near").alias("_hop"), F.col("label").alias("_old")), "hop")
        jump = hop.join(hop.select(F.col("node").alias("_hop"), F.col("_hop").alias("label")), "_hop").select("node", "label", "_old")
        old, new = labels, staged(jump, "labels")
        release(hop)
        release(old)
        labels = new.select("node", "label")
        labels.staged_path = new.staged_path
        if not new.filter("label <> _old").limit(1).count():
            release(both)
            return labels
