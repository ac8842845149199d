"""Connected components and chains by repeated joins, with the state written to the shared folder each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.scale import cut_lineage, salted_join


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node links to one smaller node, and no node linked to has a link of its own."""
    links = edges.groupBy("u").agg(F.count(F.lit(1)).alias("_n"))
    if not links.filter("_n > 1").isEmpty():
        return False
    return edges.select(F.col("v").alias("u")).distinct().join(links, "u", "left_semi").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, root)`` of every node with an edge; the root is the smallest id of the component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): O(log^2 n) rounds, and the edge list never
    grows. The minimum of a node's neighbours is an aggregate and is joined back salted, so hubs are harmless.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e, "edges")
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        e = cut_lineage(_small_star(_large_star(e)), "edges")
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    two = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        salted_join(two.filter("v > u"), low, "u", "v", "inner")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = salted_join(down, low, "u", "v", "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def follow_to_root(parents: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, root)``: where the chain ``id -> parent`` ends; roots are their own parents. Pointer doubling."""
    state = cut_lineage(parents.select("id", F.col("parent").alias("root")), "parents")
    for _ in range(max_rounds):
        hop = state.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        state_next = cut_lineage(
            salted_join(state, hop, "root", "id", "left").select("id", F.coalesce("_next", "root").alias("root")),
            "parents",
        )
        changed = state_next.join(state.withColumnRenamed("root", "_old"), "id").filter("root <> _old").isEmpty()
        state = state_next
        if changed:
            return state
    raise RuntimeError("chains did not end; parents form a cycle")
