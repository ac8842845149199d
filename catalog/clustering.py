"""Distances, density clustering and outliers over the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from flowscope.functions.net import ipv4_to_long
from flowscope.operators import density, distance
from flowscope.operators.clean import clean_webscan, defined_features
from flowscope.operators.components import connected_components
from flowscope.operators.dbscan import dbscan
from flowscope.operators.learning import precision_at_outliers, roc_auc, standardise
from flowscope.operators.outlier import OutlierModel, fit_outliers
from flowscope.operators.scale import cut_lineage, kth_smallest, rank_by
from flowscope.operators.tiles import distinct_points
from flowscope.plans.webscan import webscan_features

RADIUS = 1.15
BLOCK_ROWS = 128

POINTS = """p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
  e AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM p a JOIN p b ON a.id < b.id)"""
DC = ", dc AS (SELECT d AS dc FROM e WHERE d > 0 ORDER BY d LIMIT 1 OFFSET (SELECT round_even(count(*) * 0.02, 0)::BIGINT FROM p))"
TWO = """, s AS (SELECT i, j, d FROM e UNION ALL SELECT j, i, d FROM e)"""
RHO = """, rho AS (SELECT i AS id, sum(exp(-pow(d / (SELECT dc FROM dc), 2))) AS rho FROM s GROUP BY i),
  keyed AS (SELECT id, rho, printf('%.10e', rho)::DOUBLE AS k FROM rho)"""
PEAKS = """, hi AS (SELECT s.i, s.j, s.d, b.k FROM s JOIN keyed a ON a.id = s.i JOIN keyed b ON b.id = s.j
    WHERE b.k > a.k OR (b.k = a.k AND s.j < s.i)),
  near AS (SELECT i AS id, d AS delta, j AS nneigh FROM hi
    QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, k DESC, j) = 1),
  peaks AS (SELECT keyed.id, rho, coalesce(delta, (SELECT max(delta) FROM near)) AS delta, nneigh
    FROM keyed LEFT JOIN near USING (id))"""


def points(t):
    vectors = F.transform("embedding", lambda x: x.cast("double"))
    return t.read("embeddings").select(F.col("vec_id").alias("id"), vectors.alias("features"))


def triplets(t):
    """Distance triplets as a distance file would give them: the pairs within the radius."""
    return cut_lineage(distance.pairs_within(points(t), RADIUS, BLOCK_ROWS), "triplets")


@query("pairs_within_radius", "C10", f"WITH {POINTS} SELECT i, j, round(d, 6) AS d FROM e WHERE d <= {RADIUS}")
def _(t):
    return distance.pairs_within(points(t), RADIUS, BLOCK_ROWS)


@query("symmetric_distances", "A9", f"WITH {POINTS}{TWO} SELECT i, j, round(d, 6) AS d FROM s WHERE d <= {RADIUS}")
def _(t):
    return distance.symmetric(triplets(t))


@query("cutoff_distance", "F3", f"WITH {POINTS}{DC} SELECT round(dc, 6) AS dc FROM dc")
def _(t):
    unique = cut_lineage(distinct_points(points(t)))
    return unique.limit(1).select(F.lit(distance.cutoff_distance(unique, block_rows=BLOCK_ROWS)).alias("dc"))


@query("cutoff_of_triplets", "F3", f"""
WITH {POINTS}, c AS (SELECT * FROM e WHERE d <= {RADIUS})
SELECT 'pairs' AS basis, round(d, 6) AS dc FROM (SELECT d FROM c ORDER BY d LIMIT 1 OFFSET (SELECT floor(count(*) * 0.02 + 0.5)::BIGINT - 1 FROM c))
UNION ALL SELECT 'points', round(d, 6) FROM (SELECT d FROM c WHERE d > 0 ORDER BY d LIMIT 1 OFFSET (
  SELECT round_even(count(DISTINCT v) * 0.02, 0)::BIGINT FROM (SELECT i AS v FROM c UNION ALL SELECT j FROM c)))""")
def _(t):
    edges = triplets(t)
    cuts = [(b, distance.cutoff_of_edges(edges, basis=b)) for b in ("pairs", "points")]
    rows = F.array(*[F.struct(F.lit(b).alias("basis"), F.lit(v).alias("dc")) for b, v in cuts])
    return edges.limit(1).select(F.explode(rows).alias("r")).select("r.basis", "r.dc")


@query("kth_smallest_value", "F3", """
SELECT value AS v FROM events WHERE value IS NOT NULL ORDER BY value LIMIT 1 OFFSET (SELECT count(*) // 3 FROM events)""")
def _(t):
    events = t.read("events")
    v = kth_smallest(events, "value", events.count() // 3)
    return events.limit(1).select(F.lit(v).alias("v"))


@query("local_density_gaussian", "D23", f"WITH {POINTS}{DC}{TWO}{RHO} SELECT id, round(rho, 6) AS rho FROM rho")
def _(t):
    unique = cut_lineage(distinct_points(points(t)))
    return density.local_density(unique, distance.cutoff_distance(unique, block_rows=BLOCK_ROWS), block_rows=BLOCK_ROWS)


@query("local_density_cutoff", "D23", f"""
WITH {POINTS}{TWO} SELECT id, count(d)::DOUBLE AS rho FROM p LEFT JOIN (SELECT i, d FROM s WHERE d < {RADIUS}) ON i = id GROUP BY id""")
def _(t):
    unique = cut_lineage(distinct_points(points(t)))
    return density.local_density(unique, RADIUS, "cutoff", BLOCK_ROWS)


@query("nearest_denser_point", "C11", f"""
WITH {POINTS}{DC}{TWO}{RHO}{PEAKS} SELECT id, round(delta, 6) AS delta, nneigh FROM near""")
def _(t):
    unique = cut_lineage(distinct_points(points(t)))
    rho = cut_lineage(density.local_density(unique, distance.cutoff_distance(unique, block_rows=BLOCK_ROWS), block_rows=BLOCK_ROWS))
    return density.nearest_denser(unique, rho, BLOCK_ROWS)


@query("density_peaks", "J12", f"""
WITH {POINTS}{DC}{TWO}{RHO}{PEAKS} SELECT id, round(rho, 6) AS rho, round(delta, 6) AS delta, nneigh FROM peaks""")
def _(t):
    return density.density_peaks(points(t), block_rows=BLOCK_ROWS)


@query("density_peaks_of_triplets", "J12 D23 C11", f"""
WITH {POINTS.replace('a.id < b.id)', f'a.id < b.id AND list_distance(a.x, b.x) <= {RADIUS})')},
  dc AS (SELECT d AS dc FROM e ORDER BY d LIMIT 1 OFFSET (SELECT floor(count(*) * 0.02 + 0.5)::BIGINT - 1 FROM e))
{TWO}{RHO}{PEAKS.replace('(SELECT max(delta) FROM near)', '''CASE WHEN (SELECT count(*) FROM keyed) - (SELECT count(*) FROM near) > 1
    THEN (SELECT max(d) FROM e) ELSE (SELECT max(delta) FROM near) END''')}
SELECT id, round(rho, 6) AS rho, round(delta, 6) AS delta, nneigh FROM peaks""")
def _(t):
    return density.density_peaks_of_edges(triplets(t), basis="pairs")


LABELLED = f""", lab AS (SELECT id, count(d)::DOUBLE AS rho, any_value(label) + 1 AS cluster
  FROM p LEFT JOIN (SELECT i, d FROM s WHERE d < {RADIUS}) ON i = id GROUP BY id)"""
BORDER = f""", bord AS (SELECT cluster, max(m) AS border FROM (
  SELECT unnest([a.cluster, b.cluster]) AS cluster, (a.rho + b.rho) / 2 AS m
  FROM e JOIN lab a ON a.id = i JOIN lab b ON b.id = j WHERE d <= {RADIUS} AND a.cluster <> b.cluster) GROUP BY cluster)"""


def labelled(t):
    """Embedding labels as clusters, with the number of near points as density."""
    unique = cut_lineage(points(t).withColumn("weight", F.lit(1).cast("bigint")))
    rho = density.local_density(unique, RADIUS, "cutoff", BLOCK_ROWS)
    label = t.read("embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).cast("bigint").alias("cluster"))
    return cut_lineage(rho.join(label, "id"))


@query("border_density", "D24", f"WITH {POINTS}{TWO}{LABELLED}{BORDER} SELECT cluster::BIGINT AS cluster, border FROM bord")
def _(t):
    return density.border_density(points(t), labelled(t), RADIUS, BLOCK_ROWS)


@query("border_density_of_triplets", "D24", f"WITH {POINTS}{TWO}{LABELLED}{BORDER} SELECT cluster::BIGINT AS cluster, border FROM bord")
def _(t):
    return density.border_density_of_edges(triplets(t), labelled(t), RADIUS)


@query("cluster_summary", "D25", f"""
WITH {POINTS}{TWO}{LABELLED}{BORDER}
SELECT cluster::BIGINT AS cluster, arg_max(id, {{'r': rho, 'd': id % 5, 'i': -id}}) AS centre, count(*) AS elements, count(*) FILTER (rho >= coalesce(border, 0)) AS core,
  count(*) FILTER (rho < coalesce(border, 0)) AS halo FROM lab LEFT JOIN bord USING (cluster) GROUP BY cluster""")
def _(t):
    marked = labelled(t)
    borders = density.border_density(points(t), marked, RADIUS, BLOCK_ROWS)
    halo = density.mark_halo(marked.withColumn("delta", (F.col("id") % 5).cast("double")), borders)
    return density.cluster_summary(halo)


DELTA_MIN = 1.2
CLUSTERS = f""", centres AS (SELECT id, row_number() OVER (ORDER BY id) AS cluster FROM peaks WHERE rho > 0 AND delta > {DELTA_MIN}),
  up AS (SELECT id, CASE WHEN id IN (SELECT id FROM centres) THEN NULL ELSE nneigh END AS nxt FROM peaks),
  walk AS (SELECT id, id AS node FROM peaks UNION ALL SELECT walk.id, up.nxt FROM walk JOIN up ON up.id = walk.node WHERE up.nxt IS NOT NULL),
  ends AS (SELECT walk.id, coalesce(c.cluster, -1) AS cluster FROM walk JOIN up ON up.id = walk.node AND up.nxt IS NULL
    LEFT JOIN centres c ON c.id = walk.node),
  lab AS (SELECT peaks.id, rho, delta, cluster FROM peaks JOIN ends USING (id)),
  bord AS (SELECT cluster, max(m) AS border FROM (SELECT unnest([a.cluster, b.cluster]) AS cluster, (a.rho + b.rho) / 2 AS m
    FROM e JOIN lab a ON a.id = i JOIN lab b ON b.id = j WHERE d <= (SELECT dc FROM dc) AND a.cluster <> b.cluster) GROUP BY cluster)"""


@query("density_clusters", "J13 D24", f"""WITH RECURSIVE {POINTS}{DC}{TWO}{RHO}{PEAKS}{CLUSTERS}
SELECT id, cluster, CASE WHEN rho < coalesce(border, 0) THEN 0 ELSE cluster END AS halo, round(rho, 6) AS rho, round(delta, 6) AS delta
FROM lab LEFT JOIN bord USING (cluster)""")
def _(t):
    p = points(t)
    unique = cut_lineage(distinct_points(p))
    dc = distance.cutoff_distance(unique, block_rows=BLOCK_ROWS)
    scores = density.density_peaks(p, dc=dc, block_rows=BLOCK_ROWS)
    clusters = cut_lineage(density.assign_clusters(scores, 0.0, DELTA_MIN))
    return density.mark_halo(clusters, density.border_density(p, clusters, dc, BLOCK_ROWS)).select("id", "cluster", "halo", "rho", "delta")


@query("dbscan_vectors", "J11", """
WITH RECURSIVE p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
  n AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON list_distance(a.x, b.x) <= 1.15),
  core AS (SELECT u AS id FROM n GROUP BY u HAVING count(*) >= 4),
  ce AS (SELECT u, v FROM n WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core)),
  walk AS (SELECT id, id AS root FROM core UNION SELECT ce.v, walk.root FROM walk JOIN ce ON ce.u = walk.id),
  comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
  num AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM comp),
  bor AS (SELECT u AS id, min(label) AS label FROM n JOIN num ON num.id = v WHERE u NOT IN (SELECT id FROM core) GROUP BY u)
SELECT p.id, coalesce(num.label, bor.label, -1)::BIGINT AS label, p.id IN (SELECT id FROM core) AS core
FROM p LEFT JOIN num ON num.id = p.id LEFT JOIN bor ON bor.id = p.id""")
def _(t):
    return dbscan(points(t), eps=1.15, min_samples=4, block_rows=BLOCK_ROWS)


BEHAVIOUR = ("Sum_flow", "Feq_sec_flow", "Feq_404_error", "H_status", "Cls_url", "Mean_packets")


def _behaviour_sql(steps: int = 25) -> str:
    """The smallest core number spreads over neighbours step by step; enough steps for these tables."""
    from catalog.features import _webscan_sql
    from catalog.scalars import IP_TO_INT

    scaled = ", ".join(
        f'coalesce(("{c}" - avg("{c}") OVER ()) / nullif(stddev_pop("{c}") OVER (), 0), 0.0)' for c in BEHAVIOUR
    )
    order = f"{IP_TO_INT.format('src_ip')}, {IP_TO_INT.format('dest_ip')}"
    parts = [f"""WITH f AS ({_webscan_sql("source", 1)}), g AS (SELECT * FROM f WHERE "Feq_404_error" <> -1 AND "H_status" <> -1 AND "Mean_packets" <> -1),
  p AS (SELECT src_ip, dest_ip, row_number() OVER (ORDER BY {order}) AS id, [{scaled}] AS x FROM g),
  n AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON list_distance(a.x, b.x) <= 1.2),
  core AS MATERIALIZED (SELECT u AS id FROM n GROUP BY u HAVING count(*) >= 10),
  ce AS MATERIALIZED (SELECT u, v FROM n WHERE u IN (SELECT id FROM core) AND v IN (SELECT id FROM core)),
  l0 AS MATERIALIZED (SELECT id, id AS root FROM core)"""]
    for k in range(steps):
        parts.append(f"l{k + 1} AS MATERIALIZED (SELECT u AS id, min(root) AS root FROM ce JOIN l{k} ON l{k}.id = v GROUP BY u)")
    return ",\n  ".join(parts) + f""",
  num AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM l{steps}),
  bor AS (SELECT u AS id, min(label) AS label FROM n JOIN num ON num.id = v WHERE u NOT IN (SELECT id FROM core) GROUP BY u)
SELECT src_ip, dest_ip, coalesce(num.label, bor.label, -1)::BIGINT AS label, p.id IN (SELECT id FROM core) AS core
FROM p LEFT JOIN num ON num.id = p.id LEFT JOIN bor ON bor.id = p.id"""


@query("dbscan_webscan_features", "J11 J10 B8", _behaviour_sql())
def _(t):
    """Clusters of the standardised web-scan features."""
    table = defined_features(webscan_features(clean_webscan(t.flows, drop_single=False))).select(
        "src_ip", "dest_ip", *BEHAVIOUR
    )
    keyed = table.withColumns({"_s": ipv4_to_long("src_ip"), "_d": ipv4_to_long("dest_ip")})
    table = cut_lineage(rank_by(keyed, "_s", "_d", "id", descending=False).drop("_s", "_d"))
    scaled = standardise(table, BEHAVIOUR)
    vectors = scaled.select("id", F.array(*[f"{c}_scaled" for c in BEHAVIOUR]).alias("features"))
    return dbscan(vectors, 1.2, 10).join(table, "id").select("src_ip", "dest_ip", "label", "core")


@query("pair_components", "J11", f"""
WITH RECURSIVE {POINTS}{TWO}, ce AS (SELECT i, j FROM s WHERE d <= {RADIUS}),
  walk AS (SELECT DISTINCT i AS id, i AS root FROM ce UNION SELECT ce.j, walk.root FROM walk JOIN ce ON ce.i = walk.id)
SELECT id, min(root) AS root FROM walk GROUP BY id""")
def _(t):
    return connected_components(triplets(t).select(F.col("i").alias("u"), F.col("j").alias("v")))


def given_outliers(t):
    """Four given centres, two of them of large clusters."""
    rows = t.read("embeddings").filter("vec_id in (0, 1, 2, 3)").orderBy("vec_id").select("embedding").collect()
    return OutlierModel([list(map(float, r[0])) for r in rows], [0, 1], 1.3)


GIVEN_SQL = """p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings),
  c AS (SELECT id AS c, x AS y FROM p WHERE id < 4),
  d AS (SELECT id, label, c, list_distance(x, y) AS d FROM p, c),
  near AS (SELECT id, any_value(label) AS label, arg_min(c, {'d': d, 'c': c}) AS cluster, min(d) AS own, min(d) FILTER (c < 2) AS large FROM d GROUP BY id),
  scored AS (SELECT id, cluster::INTEGER AS cluster, CASE WHEN cluster < 2 THEN own ELSE large END AS score, (label = 0)::INTEGER AS y FROM near)"""


@query("outlier_scores_of_given_centres", "J15", f"""
WITH {GIVEN_SQL} SELECT id, cluster, round(score, 6) AS score, (score > 1.3)::INTEGER AS outlier FROM scored""")
def _(t):
    return given_outliers(t).predict(points(t)).select("id", "cluster", "score", "outlier")


@query("outlier_evaluation_of_given_centres", "D27", f"""
WITH {GIVEN_SQL}, r AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored)
SELECT count(*) AS n, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6)::DOUBLE AS auc,
  (SELECT round(avg(y), 6) FROM scored WHERE score > (SELECT s[k + 1] + f * (s[least(k + 2, len(s))] - s[k + 1]) FROM (
    SELECT s, floor(w)::BIGINT AS k, w - floor(w) AS f FROM (SELECT list_sort(list(score)) AS s, (count(*) - 1) * (1.0::DOUBLE - sum(y) / count(*)) AS w FROM scored)))) AS precision FROM r""")
def _(t):
    scored = given_outliers(t).score(points(t))
    truth = t.read("embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("label"))
    joined = cut_lineage(scored.join(truth, "id").select("id", "score", "label"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.lit(roc_auc(joined)).alias("auc"), F.lit(precision_at_outliers(joined)).alias("precision"))


@query("outlier_scores", "J15")
def _(t):
    return fit_outliers(points(t)).predict(points(t)).select("id", "cluster", "score", "outlier")


@query("outlier_evaluation", "D27")
def _(t):
    """Scores against one embedding label taken as the outlier class."""
    scored = fit_outliers(points(t)).score(points(t))
    truth = t.read("embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("label"))
    joined = cut_lineage(scored.join(truth, "id").select("id", "score", "label"))
    auc, precision = roc_auc(joined), precision_at_outliers(joined)
    return joined.agg(F.count(F.lit(1)).alias("n"), F.lit(auc).alias("auc"),
                      F.lit(precision).alias("precision"))
