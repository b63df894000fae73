"""Connected components by repeated joins, each round a staged table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sevscale.llm.frames import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node reachable over links (a, b); linked nodes only.

    Each round every node takes the smallest label among its neighbours and then its label's
    own label, so chains halve.  Rounds stop when no label changes.
    """
    both = scratch.keep(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(links.select(F.col("b"), F.col("a"))), "links",
    )
    labels = scratch.keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("theirs")), "other")
            .groupBy("node").agg(F.min("theirs").alias("theirs"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("before"), F.least("label", "theirs").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        following = scratch.keep(
            lower.join(jump, "label").select("node", "before", F.least("label", "root").alias("label")), "labels"
        )
        changed = following.where(F.col("label") != F.col("before")).limit(1).count()
        labels = following.select("node", "label")
        if not changed:
            return labels
