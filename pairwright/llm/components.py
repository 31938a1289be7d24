"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.shared import stored


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Every node points to the smallest node it knows. In each round a node's neighbours are told
    its pointer, pointers follow their pointers, and edges within one component are dropped. The
    rounds grow with the logarithm of the longest path, not with its length; each is written to
    the shared folder. Sums and minima are combined before they are shuffled, so a node with very
    many neighbours is no heavy row.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pointers = stored(
        both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), label
    )
    links = stored(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), label)
    while True:
        left = pointers.select(F.col("node").alias("a"), F.col("to").alias("pa"))
        right = pointers.select(F.col("node").alias("b"), F.col("to").alias("pb"))
        # Edges between the heads that two linked nodes point to.
        links = stored(
            links.join(left, "a")
            .join(right, "b")
            .where(F.col("pa") != F.col("pb"))
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct(),
            label,
        )
        # A head learns the smallest head beside it; then every pointer takes a step.
        lower = links.groupBy("a").agg(F.min("b").alias("head")).withColumnRenamed("a", "to")
        stepped = (
            pointers.join(lower, "to", "left").select("node", F.coalesce("head", "to").alias("to"))
        )
        jump = stepped.where(F.col("node") != F.col("to")).select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = stored(
            stepped.join(jump, "to", "left").select("node", "to", F.coalesce("next", "to").alias("next")), label
        )
        pointers = jumped.select("node", F.col("next").alias("to"))
        open_links = not links.isEmpty()
        moved = not jumped.where(F.col("to") != F.col("next")).isEmpty()
        if not open_links and not moved:
            return pointers.withColumnRenamed("to", "component")
