"""File sources and sinks: data derived from the tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORACLES, QUERIES, query, with_parts
from catalog.clustering import DC, PEAKS, POINTS, RADIUS, RHO, TWO, points, triplets
from flowscope.operators.lookup import append_if_absent
from flowscope.operators.scale import cut_lineage, scratch_path
from flowscope.plans.flows import FLOW_COLUMNS
from flowscope.sources import logs, sinks

WITH_PORT = ", ".join(c for c in FLOW_COLUMNS if c not in ("src_port", "dest_port"))


def flow_log(t, broken: bool = False) -> str:
    """The flows as log files. In a broken log every 29th row has a blank where a tab should be."""
    path = scratch_path(t.spark, "flow-log")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FLOW_COLUMNS]
    line = F.concat_ws("\t", *fields)
    if broken:
        blanks = F.concat(F.concat_ws("\t", *fields[:7]), F.lit(" "), F.concat_ws("\t", *fields[7:]))
        line = F.when(F.col("seq") % 29 == 0, blanks).otherwise(line)
    t.flows.repartitionByRange("seq").sortWithinPartitions("seq").select(line.alias("value")).write.text(path)
    return path


@query("scan_flow_log", "A1", with_parts("FLOWS", f"SELECT seq, {WITH_PORT}, src_port, dest_port FROM flows"))
def _(t):
    """Written in order, so the line numbers of the scan must equal the event numbers."""
    return logs.typed_flows(logs.read_flow_log(t.spark, flow_log(t))).select("seq", *FLOW_COLUMNS)


@query("scan_broken_flow_log", "A1 A3", with_parts("FLOWS", f"""
SELECT seq, {WITH_PORT}, src_port, dest_port FROM flows WHERE seq % 29 <> 0"""))
def _(t):
    log = logs.read_flow_log(t.spark, flow_log(t, broken=True))
    return logs.typed_flows(logs.within_error_budget(log)).select("seq", *FLOW_COLUMNS)


@query("quarantined_rows", "A3", with_parts("FLOWS", """
SELECT seq, concat_ws(chr(9), timestamp, xff, protocol, method, host, params, status) || ' '
  || concat_ws(chr(9), size, src_ip, src_port::VARCHAR, dest_ip, coalesce(dest_port::VARCHAR, '')) AS _corrupt_record
FROM flows WHERE seq % 29 = 0"""))
def _(t):
    return logs.quarantined(logs.read_flow_log(t.spark, flow_log(t, broken=True)))


@query("scan_flow_log_11", "A2", with_parts("FLOWS", """
SELECT seq, timestamp, protocol, method, host, params, status, size, src_ip, src_port::VARCHAR AS src_port, dest_ip,
  coalesce(dest_port::VARCHAR, dest_ip) AS dest_port FROM flows"""))
def _(t):
    """Without a port the last field of the line is the destination address."""
    path = scratch_path(t.spark, "flow-log-11")
    fields = [F.col(c).cast("string") for c in logs.FLOW_COLUMNS_11]
    ordered = t.flows.repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select(F.concat_ws("  ", *fields).alias("value")).write.text(path)
    return logs.read_flow_log_11(t.spark, path)


@query("scan_access_log", "A4", with_parts("FLOWS", """
SELECT seq, src_ip || ' - [' || timestamp || '] ' || method || ' HTTP ' || params AS line, params AS url
FROM flows WHERE method = 'GET' AND split_part(params, '?', 2) <> ''"""))
def _(t):
    path = scratch_path(t.spark, "access-log")
    line = F.concat(F.col("src_ip"), F.lit(" - ["), "timestamp", F.lit("] "), "method", F.lit(" HTTP "), "params")
    t.flows.repartitionByRange("seq").sortWithinPartitions("seq").select(line.alias("value")).write.text(path)
    return logs.read_access_log(t.spark, path)


@query("scan_indexed_urls", "A5", """
SELECT page_id AS seq, url, replace(url[instr(url, '?') + 1:], '?', '') AS query FROM pages
WHERE split_part(url, '?', 2) <> ''""")
def _(t):
    path = scratch_path(t.spark, "urls")
    ordered = t.read("pages").repartitionByRange("page_id").sortWithinPartitions("page_id")
    ordered.select(F.col("url").alias("value")).write.text(path)
    return logs.read_indexed_urls(t.spark, path)


@query("scan_corpus", "A6", "SELECT url AS text, 0 AS label FROM pages UNION ALL SELECT url || '?x=<script>', 1 FROM pages")
def _(t):
    good, bad = scratch_path(t.spark, "good"), scratch_path(t.spark, "bad")
    pages = t.read("pages")
    pages.select(F.col("url").alias("value")).write.text(good)
    pages.select(F.concat("url", F.lit("?x=<script>")).alias("value")).write.text(bad)
    return logs.read_corpus(t.spark, good, bad)


@query("scan_domain_truth", "A7", """
SELECT 'a' || page_id AS daccount, '203.0.113.' || page_id % 7 AS dip, '80' AS dp,
  regexp_extract(url, '^https?://([^/]+)', 1) AS hostname, page_id % 3 AS sum_count, page_id % 4 AS sum_count_invalid
FROM pages""")
def _(t):
    path = scratch_path(t.spark, "truth")
    p = F.col("page_id")
    t.read("pages").select(
        F.concat(F.lit("a"), p), F.concat(F.lit("203.0.113."), p % 7), F.lit("80"),
        F.regexp_extract("url", "^https?://([^/]+)", 1), p % 3, p % 4,
    ).write.csv(path)
    return logs.read_domain_truth(t.spark, path)


@query("labelled_feature_file", "A8 A12", with_parts("FLOWS", """
SELECT src_ip, CASE WHEN src_ip LIKE '1.1.%' THEN 1 ELSE 0 END AS label,
  count(*) FILTER (contains(params, '/../../../../../../'))::DOUBLE AS "Sum_dir",
  round(count(*) FILTER (contains(params, '/../../../../../../')) / count(*), 6)::DOUBLE AS "Feq_dir"
FROM flows GROUP BY src_ip"""))
def _(t):
    from flowscope.operators.aggregate import traversal_statistics

    path = scratch_path(t.spark, "labelled")
    table = traversal_statistics(t.flows, ["src_ip"]).select("Sum_dir", "Feq_dir", "src_ip")
    scan = table.filter("src_ip like '1.1.%'")
    normal = table.filter("src_ip not like '1.1.%'")
    sinks.append_labelled(scan, normal, path)
    return logs.read_labelled_features(t.spark, path, ["Sum_dir", "Feq_dir", "src_ip", "label"])


@query("triplet_file", "A9", f"WITH {POINTS}{TWO} SELECT i, j, round(d, 6) AS d FROM s WHERE d <= {RADIUS}")
def _(t):
    from flowscope.operators.distance import symmetric

    path = scratch_path(t.spark, "triplet-file")
    triplets(t).write.csv(path, sep=" ")
    return symmetric(logs.read_triplets(t.spark, path))


@query("owner_scan", "A10", with_parts("OWNER", "SELECT ip FROM owner"))
def _(t):
    path = scratch_path(t.spark, "owner")
    t.owner.write.parquet(path)
    return logs.owner_addresses(t.spark, path)


@query("cache_append", "A11", with_parts("FLOWS OWNER", """
SELECT ip, -1::BIGINT AS seq FROM owner
UNION ALL SELECT src_ip, min(seq) FROM flows WHERE src_ip NOT IN (SELECT ip FROM owner) GROUP BY src_ip"""))
def _(t):
    path = scratch_path(t.spark, "cache")
    t.owner.select("ip", F.lit(-1).cast("bigint").alias("seq")).write.parquet(path)
    new = t.flows.select(F.col("src_ip").alias("ip"), "seq")
    append_if_absent(path, new, "ip", "seq")
    append_if_absent(path, new, "ip", "seq")
    return t.spark.read.parquet(path)


@query("attack_text_sink", "A13", with_parts("FLOWS", """
SELECT url_decode(params) AS value FROM flows WHERE seq % 19 = 0"""))
def _(t):
    """Rows marked by the way the flow table was made; a model's predictions go the same way."""
    path = scratch_path(t.spark, "attacks")
    scored = t.flows.withColumn("prediction", (F.col("seq") % 19 == 0).cast("int"))
    sinks.write_attack_lines(scored.withColumn("line", F.concat("params", F.lit("\r\n"))), path)
    return t.spark.read.text(path)


@query("decision_graph_sink", "A14", f"""
WITH {POINTS}{DC}{TWO}{RHO}{PEAKS} SELECT printf('%.2f', rho)::DOUBLE AS rho, printf('%.2f', delta)::DOUBLE AS delta FROM peaks""")
def _(t):
    from flowscope.operators.density import density_peaks

    path = scratch_path(t.spark, "decision")
    sinks.write_decision_graph(density_peaks(points(t)), path)
    return t.spark.read.csv(path, schema="rho double, delta double", sep=" ")


@query("assignment_sink", "A14 J13", "SELECT id, cluster, halo FROM (" + ORACLES["density_clusters"] + ")")
def _(t):
    path = scratch_path(t.spark, "assignment")
    sinks.write_assignment(QUERIES["density_clusters"](t.spark, t.sf_dir), path)
    return t.spark.read.csv(path, schema="id bigint, cluster bigint, halo bigint", sep=" ")


@query("cached_map", "A15", "SELECT url AS term, page_id % 80 AS cluster FROM pages")
def _(t):
    """Built once; the second call must find the stored table."""
    path = scratch_path(t.spark, "map")
    sinks.load_or_build(t.spark, path, lambda: t.read("pages").select(F.col("url").alias("term"), (F.col("page_id") % 80).alias("cluster")))
    return sinks.load_or_build(t.spark, path, lambda: cut_lineage(t.read("pages").limit(0)))
