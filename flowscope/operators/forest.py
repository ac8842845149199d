"""Forests as tables of nodes, scored by an expression over arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def forest_nodes(model: PipelineModel, path: str) -> DataFrame:
    """The nodes of a fitted two-class forest, the last stage of a pipeline, written to ``path`` and read back.

    ``(tree, node, feature, threshold, left, right, p)``: a row goes left if its feature is at most the threshold; a leaf
    has the feature -1 and the share ``p`` of class 1.
    """
    model.stages[-1].write().overwrite().save(path)
    data = F.col("nodeData")
    stats = data["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda s, x: s + x)
    leaf = data["leftChild"] < 0
    spark = SparkSession.getActiveSession()
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), data["id"].alias("node"),
        F.when(leaf, F.lit(-1)).otherwise(data["split"]["featureIndex"]).alias("feature"),
        F.when(~leaf, F.get(data["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        data["leftChild"].alias("left"), data["rightChild"].alias("right"), (F.get(stats, F.lit(1)) / total).alias("p"))


def _array(values: Sequence, kind: str) -> Column:
    """A constant array, folded once per query."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _depth(nodes: dict[int, Row]) -> int:
    deepest, level = 0, [0]
    while level:
        level = [child for n in level if nodes[n]["feature"] >= 0 for child in (nodes[n]["left"], nodes[n]["right"])]
        deepest += bool(level)
    return deepest


def forest_votes(nodes: Sequence[Row], columns: Sequence[str]) -> Column:
    """``(zero, one)``: the votes of all trees for the two classes, for rows with the feature ``columns``.

    Nodes are a model, as :func:`forest_nodes` gives them, and become constant arrays; there is no join and no function
    outside the JVM.
    """
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes:
        trees.setdefault(row["tree"], {})[row["node"]] = row
    place = {key: i for i, key in enumerate((t, n) for t in sorted(trees) for n in sorted(trees[t]))}
    flat = [(t, trees[t][n]) for t, n in place]
    feature = _array([r["feature"] for _, r in flat], "int")
    threshold = _array([repr(float(r["threshold"] or 0.0)) for _, r in flat], "double")
    left = _array([place.get((t, r["left"]), -1) for t, r in flat], "int")
    right = _array([place.get((t, r["right"]), -1) for t, r in flat], "int")
    share = _array([repr(float(r["p"] or 0.0)) for _, r in flat], "double")
    roots = _array([place[t, 0] for t in sorted(trees)], "int")
    steps = F.sequence(F.lit(1), F.lit(max(1, max(_depth(t) for t in trees.values()))))
    x = F.array(*[F.col(c).cast("double") for c in columns])

    def below(node: Column, _step: Column) -> Column:
        goes_left = F.get(x, F.get(feature, node)) <= F.get(threshold, node)
        return F.when(F.get(feature, node) < 0, node).when(goes_left, F.get(left, node)).otherwise(F.get(right, node))

    leaves = F.transform(roots, lambda root: F.get(share, F.aggregate(steps, root, below)))
    one = F.aggregate(leaves, F.lit(0.0), lambda s, p: s + p)
    zero = F.aggregate(leaves, F.lit(0.0), lambda s, p: s + (F.lit(1.0) - p))
    return F.struct(zero.alias("zero"), one.alias("one"))


def score_with_nodes(table: DataFrame, nodes: Sequence[Row], columns: Sequence[str], out: str = "web_scan", votes: str = "votes") -> DataFrame:
    """Add the share of votes for class 1 and the class with more votes, 0 if they are equal; nulls count as 0."""
    filled = table.na.fill(0.0, list(columns)).withColumn("_votes", forest_votes(nodes, columns))
    one, zero = F.col("_votes.one"), F.col("_votes.zero")
    return filled.withColumns({votes: one / (one + zero), out: (one > zero).cast("int")}).drop("_votes")
