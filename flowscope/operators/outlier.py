"""Cluster-based local outlier factor (He, Xu and Deng 2003)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.distance import euclidean
from flowscope.operators.learning import percentile


@dataclass
class OutlierModel:
    """Cluster centres, which of them are large, and the score threshold. All are of the size of k."""

    centres: list[list[float]]
    large: list[int]
    threshold: float = float("nan")

    def score(self, points: DataFrame) -> DataFrame:
        """Add ``cluster`` and ``score``: the distance to the own centre or, in a small cluster, to the nearest large one."""
        centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in self.centres])
        x = F.transform("features", lambda v: v.cast("double"))
        measured = points.withColumn("_d", F.transform(centres, lambda c: euclidean(x, c)))
        nearest = F.array_position("_d", F.array_min("_d")).cast("int") - 1
        large = F.array(*[F.lit(i) for i in self.large])
        to_large = F.array_min(F.transform(large, lambda i: F.get("_d", i)))
        own = F.when(F.array_contains(large, nearest), F.array_min("_d")).otherwise(to_large)
        return measured.select(*points.columns, nearest.alias("cluster"), own.alias("score"))

    def predict(self, points: DataFrame) -> DataFrame:
        """Scores and ``outlier``, 1 above the threshold."""
        return self.score(points).withColumn("outlier", (F.col("score") > F.lit(self.threshold)).cast("int"))


def large_clusters(sizes: dict[int, int], alpha: float = 0.9, beta: float = 5.0) -> list[int]:
    """Clusters, in falling size, up to the boundary: alpha of all points covered and a size drop by beta.

    When no boundary has both, the first with the coverage counts, then the first with the drop.
    """
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    total, covered = sum(sizes.values()), 0
    marks = []
    for i in range(1, len(order)):
        covered += sizes[order[i - 1]]
        marks.append((i, covered >= alpha * total, sizes[order[i - 1]] / max(sizes[order[i]], 1) >= beta))
    for wanted in (lambda a, b: a and b, lambda a, b: a, lambda a, b: b):
        for i, a, b in marks:
            if wanted(a, b):
                return order[:i]
    return order


def fit_outliers(
    points: DataFrame, k: int = 8, alpha: float = 0.9, beta: float = 5.0, contamination: float = 0.1, seed: int = 42
) -> OutlierModel:
    """Cluster ``(id, features)``, split the clusters by size and set the threshold at the contamination quantile."""
    vectors = points.withColumn("_v", array_to_vector(F.transform("features", lambda v: v.cast("double"))))
    fitted = KMeans(k=k, seed=seed, featuresCol="_v").fit(vectors)
    model = OutlierModel([list(map(float, c)) for c in fitted.clusterCenters()], [0])
    counts = model.score(points).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {i: 0 for i in range(len(model.centres))} | {r["cluster"]: r["n"] for r in counts}
    model.large = large_clusters(sizes, alpha, beta)
    model.threshold = percentile(model.score(points).select("score"), "score", 100.0 * (1.0 - contamination))
    return model
