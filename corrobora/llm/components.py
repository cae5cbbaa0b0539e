"""Connected components of a link table by contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import durable


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; comparable ids); roots name components.

    Each round hooks every node to its smallest neighbour if that is smaller, then replaces
    the ends of the links by what they hang on and drops links within one node. A node that
    stays has only larger neighbours, which all go, so the number of linked nodes halves at
    least: the rounds grow with its logarithm. Each round's hooks and links are written out.
    Nodes with many links are pre-aggregated, and the joins are plain ones that adaptive
    execution can split.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = durable(ends)
    hooks: list[DataFrame] = []
    while not ends.isEmpty():
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("b"))
        up = durable(low.select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        hooks.append(up)
        first = ends.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").select("ua", "b")
        second = first.join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b").select("ua", "ub")
        ends = durable(
            second.where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct()
        )
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    # Hooks of later rounds hold the nodes that were still linked then; follow them in turn.
    found = hooks[0].select("node", F.col("up").alias("root"))
    for up in hooks[1:]:
        step = up.select(F.col("node").alias("root"), "up")
        found = found.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return durable(found)
