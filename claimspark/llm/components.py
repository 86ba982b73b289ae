"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import release, stored


def connected(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b): root is the smallest node it can reach.

    Minimum labels travel over links and are then shortened by looking up the label's own label, so long
    chains halve with each round. Minima are combined before the shuffle; no neighbour list is ever collected.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                    .select("node", F.least("node", "b").alias("root")), "cc-labels")
    for _ in range(max_rounds):
        near = (both.join(labels.withColumnsRenamed({"node": "b", "root": "near"}), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near")))
        lowered = labels.join(near, "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("low"))
        jumped = lowered.join(labels.select(F.col("node").alias("low"), F.col("root").alias("via")), "low", "left")
        new = stored(jumped.select("node", "old", F.least("low", F.coalesce("via", "low")).alias("root")), "cc-labels")
        moved = new.where("root <> old").limit(1).count()
        release(labels)
        labels = new.select("node", "root")
        labels._stored_path = new._stored_path
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(both)
    return labels
