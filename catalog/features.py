"""Aggregates, sequence operators, imputation and the behaviour feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, with_parts
from catalog.scalars import TRAVERSAL_SQL, WORDS_SQL
from flowscope.functions import text as X
from flowscope.operators import aggregate as A
from flowscope.operators import impute, sequence
from flowscope.operators import learning as L
from flowscope.operators.clean import clean_webscan, defined_features
from flowscope.operators.scale import rank_by
from flowscope.plans import domain as domain_plan
from flowscope.plans import webscan as webscan_plan
from flowscope.plans.detection import malicious_by_rule

PAIR = ["src_ip", "dest_ip"]
FW = "FLOWS WEBSCAN"
SECOND = "epoch_us(strptime(timestamp, '%m/%d/%y-%H:%M:%S.%f')) // 1000000"


@query("flow_counts", "D1", with_parts(FW, 'SELECT src_ip, dest_ip, count(*) AS "Sum_flow" FROM webscan GROUP BY ALL'))
def _(t):
    return A.flow_counts(t.webscan, PAIR)


@query("distinct_urls", "D2", with_parts(FW, 'SELECT src_ip, count(DISTINCT params) AS "Cls_url" FROM webscan GROUP BY ALL'))
def _(t):
    return A.distinct_urls(t.webscan, ["src_ip"])


@query("value_entropy", "D3", with_parts(FW, """
SELECT src_ip, round(entropy(status), 6) AS h_status FROM webscan GROUP BY src_ip"""))
def _(t):
    return A.entropy_by(t.webscan, ["src_ip"], "status", "h_status")


def _class_terms(source, key):
    share = "count(*) FILTER (c = {0}) / count(*)"
    term = "CASE WHEN {1} > 0 THEN round(-({1}) * log2({1}), 6) ELSE 0.0 END AS \"H_IP{0}\""
    terms = ", ".join(term.format(k, share.format(k)) for k in (1, 2, 3, 4))
    return f"SELECT {key}, {terms} FROM {source} GROUP BY {key}"


CLASS = """CASE WHEN {0} > 16777217 AND {0} <= 2130706432 THEN 1 WHEN {0} > 2130706432 AND {0} <= 3221225214 THEN 2
  WHEN {0} > 3221225729 AND {0} <= 3758096126 THEN 3 WHEN {0} > 3758096385 AND {0} <= 4026531838 THEN 4 ELSE 0 END"""


@query("address_class_entropy", "D4", _class_terms(
    "(SELECT l_suppkey, " + CLASS.format("((l_orderkey * 104729 + l_partkey * 7919) * 6151 % 4294967296)")
    + " AS c FROM lineitem)", "l_suppkey"))
def _(t):
    """Addresses made from order lines, since the flow table has destinations of one class only."""
    from flowscope.functions.net import long_to_ipv4

    n = (F.col("l_orderkey").cast("bigint") * 104729 + F.col("l_partkey") * 7919) * 6151 % F.lit(4294967296)
    lines = t.read("lineitem").select("l_suppkey", long_to_ipv4(n).alias("dest_ip"))
    return A.address_class_entropy(lines, ["l_suppkey"])


def _burst_sql(seconds, source, key):
    return f"""SELECT {key}, CASE WHEN sum(n) = 1 THEN 1 ELSE coalesce(sum(n) FILTER (n > 1), 0) END::BIGINT AS "Sum_sec_flow",
  round(CASE WHEN sum(n) = 1 THEN 1.0 ELSE coalesce(sum(n) FILTER (n > 1), 0) / sum(n) END, 6) AS "Feq_sec_flow"
FROM (SELECT {key}, {SECOND} // {seconds} AS s, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {key}"""


for _seconds, _name in ((1, "second"), (3600, "hour"), (86400, "day")):

    @query(f"burst_statistics_{_name}", "D5", with_parts(FW, _burst_sql(_seconds, "webscan", "src_ip, dest_ip")))
    def _(t, seconds=_seconds):
        return A.burst_statistics(t.webscan, PAIR, seconds)


STATUS_SQL = """SELECT {key},
  CASE WHEN r > 0 THEN round(e * (r + u) / r, 6) ELSE -1.0 END AS "Sum_404_error",
  CASE WHEN r > 0 THEN round(e / r, 6) ELSE -1.0 END AS "Feq_404_error",
  CASE WHEN r > 0 THEN round(h, 6) ELSE -1.0 END AS "H_status"
FROM (SELECT {key}, count(*) FILTER (status <> '-') AS r, count(*) FILTER (status = '-') AS u,
        count(*) FILTER (status = '404') AS e, entropy(status) FILTER (status <> '-') AS h
      FROM {source} GROUP BY {key})"""


@query("status_statistics", "D6", with_parts(FW, STATUS_SQL.format(key="src_ip, dest_ip", source="webscan")))
def _(t):
    return A.status_statistics(t.webscan, PAIR)


@query("plain_error_rate", "D7", with_parts(FW, """
SELECT src_ip, round(count(*) FILTER (status = '404') / count(*), 6) AS num_404, round(entropy(status), 6) AS "H_status"
FROM webscan GROUP BY src_ip"""))
def _(t):
    return A.plain_error_rate(t.webscan, ["src_ip"])


SIZE_SQL = """coalesce(sum(TRY_CAST(size AS BIGINT)), 0)::BIGINT AS "Sum_packets",
  round(coalesce(avg(TRY_CAST(size AS BIGINT)), -1.0), 6) AS "Mean_packets\""""


@query("size_statistics", "D8", with_parts("FLOWS", f"SELECT src_ip, {SIZE_SQL} FROM flows GROUP BY src_ip"))
def _(t):
    return A.size_statistics(t.flows, ["src_ip"])


def _dir_sql(source, key, condition="true"):
    return f"""SELECT {key}, count(*) FILTER ({condition} AND ({TRAVERSAL_SQL})) AS "Sum_dir",
  round(coalesce(count(*) FILTER ({condition} AND ({TRAVERSAL_SQL})) / nullif(count(*) FILTER ({condition}), 0), 0.0), 6) AS "Feq_dir"
FROM {source} GROUP BY {key}"""


@query("traversal_statistics", "D9", with_parts(FW, _dir_sql("webscan", "src_ip")))
def _(t):
    return A.traversal_statistics(t.webscan, ["src_ip"])


@query("traversal_statistics_get", "D9 B6", with_parts(FW, _dir_sql("webscan", "src_ip, dest_ip", "method = 'GET'")))
def _(t):
    return A.traversal_statistics(t.webscan, PAIR, ["GET"])


HOST_SQL = """SELECT dest_ip, host, count(*) AS "Flows", count(DISTINCT params) AS "Urls",
  round(CASE WHEN NOT regexp_matches(any_value(host), '^[0-9.]+$') AND bool_or(contains(params, host)) THEN 0.0
       ELSE avg(levenshtein(params, host)) END, 6) AS "Similar_host" FROM domain GROUP BY dest_ip, host"""


@query("host_similarity", "D11", with_parts("FLOWS DOMAIN", HOST_SQL))
def _(t):
    return A.host_similarity(t.domain)


@query("source_lists", "D12", with_parts("FLOWS DOMAIN", """
SELECT dest_ip, host, 0::BIGINT AS part, list(src_ip ORDER BY seq) AS src_ip FROM domain GROUP BY dest_ip, host"""))
def _(t):
    return A.source_lists(t.domain)


@query("source_lists_in_parts", "D12", with_parts("FLOWS DOMAIN", """
SELECT dest_ip, host, (rn - 1) // 50 AS part, list(src_ip ORDER BY seq) AS src_ip FROM (
  SELECT *, row_number() OVER (PARTITION BY dest_ip, host ORDER BY seq) AS rn FROM domain) GROUP BY 1, 2, 3"""))
def _(t):
    return A.source_lists(t.domain, 50)


TIME_SQL = """, t AS (SELECT src_ip, epoch_us(strptime(timestamp, '%m/%d/%y-%H:%M:%S.%f')) AS us, seq FROM webscan),
  g AS (SELECT src_ip, us - lag(us) OVER (PARTITION BY src_ip ORDER BY seq) AS gap FROM t),
  times AS (SELECT src_ip, CASE WHEN count(gap) = 0 THEN -1.0 ELSE round(entropy(gap) FILTER (gap IS NOT NULL), 6) END AS "H_time_interval",
    CASE WHEN count(gap) = 0 THEN -1.0 ELSE round(sum(gap) / count(gap) / 1e6, 6) END AS mean_time_interval FROM g GROUP BY src_ip)"""


@query("interval_statistics", "E1", with_parts(FW, TIME_SQL + "SELECT * FROM times"))
def _(t):
    return sequence.interval_statistics(t.webscan, ["src_ip"])


@query("layer7_vector", "D13", with_parts(FW, TIME_SQL + """
SELECT src_ip, count(*) AS flow_num, count(DISTINCT dest_ip) AS num_of_peers,
  round(count(*) / count(DISTINCT dest_ip), 6) AS mean_flows_per_peer, round(entropy(status), 6) AS "H_status",
  any_value("H_time_interval") AS "H_time_interval", any_value(mean_time_interval) AS mean_time_interval,
  round(entropy(method), 6) AS "H_method" FROM webscan JOIN times USING (src_ip) GROUP BY src_ip"""))
def _(t):
    return A.layer7_vector(t.webscan)


_SHARE = "(count(*) FILTER (c = {0}) / count(*))"
SHARES_SQL = ", ".join(
    "CASE WHEN {1} > 0 THEN round(-{1} * log2({1}), 6) ELSE 0.0 END AS \"H_IP{0}\"".format(k, _SHARE.format(k)) for k in (1, 2, 3, 4))


@query("layer4_vector", "D14", with_parts("FLOWS", """
, several AS (SELECT * REPLACE ((CASE seq % 4 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '150.0.0.' WHEN 2 THEN '203.0.113.' ELSE '230.0.0.' END)
    || split_part(dest_ip, '.', 4) AS dest_ip), (seq % 4 + 1)::INTEGER AS c FROM flows)
SELECT src_ip, count(DISTINCT dest_ip) AS num_of_peers, """ + SHARES_SQL + """,
  round(count(DISTINCT src_port) / count(DISTINCT dest_ip), 6) AS srcprts_per_peers, round(entropy(src_port), 6) AS "H_srcprt",
  round(count(DISTINCT dest_port) / count(DISTINCT dest_ip), 6) AS dstprts_per_peers,
  round(entropy(dest_port), 6) AS "H_dstprt", round(count(*) / count(DISTINCT dest_ip), 6) AS mean_flows_per_peer
FROM several GROUP BY src_ip"""))
def _(t):
    """The destinations are moved to networks of all four address classes; ports may be null."""
    net = F.element_at(F.array(*[F.lit(n) for n in ("10.0.0.", "150.0.0.", "203.0.113.", "230.0.0.")]), (F.col("seq") % 4 + 1).cast("int"))
    return A.layer4_vector(t.flows.withColumn("dest_ip", F.concat(net, F.substring_index("dest_ip", ".", -1))))


@query("source_destination_counts", "D15", with_parts("FLOWS", "SELECT src_ip, dest_ip, count(*) AS n FROM flows GROUP BY ALL"))
def _(t):
    return A.source_destination_counts(t.flows)


@query("source_destination_vectors", "D15", with_parts("FLOWS", """
SELECT src_ip, 0::BIGINT AS part, list(dest_ip ORDER BY dest_ip) AS peers, list(n ORDER BY dest_ip) AS counts
FROM (SELECT src_ip, dest_ip, count(*) AS n FROM flows GROUP BY ALL) GROUP BY src_ip"""))
def _(t):
    vectors = A.source_destination_vectors(t.flows)
    return vectors.select("src_ip", "part", F.map_keys("peers").alias("peers"), F.map_values("peers").alias("counts"))


@query("source_destination_matrix", "D15", with_parts("FLOWS", "SELECT src_ip, "
       + ", ".join(f"count(*) FILTER (dest_ip = '203.0.113.{k}') AS \"203.0.113.{k}\"" for k in range(7))
       + " FROM flows GROUP BY src_ip"))
def _(t):
    return A.source_destination_matrix(t.flows)


# A fixed linear rule over URL statistics, in hundredths, in place of a fitted model.
RULE_SQL = f"""(2 * length(params) + 25 * len(regexp_extract_all(params, '[<>,/]'))
  + 100 * len(regexp_extract_all(params, '(?i){WORDS_SQL}')) + 100 * regexp_matches(params, '(?i)https?://')::INTEGER >= 300)"""


def attack_rule():
    return (2 * F.length("params") + 25 * X.suspicious_char_count("params") + 100 * X.suspicious_word_count("params")
            + 100 * X.has_embedded_url("params")) >= 300


def _webscan_sql(scope, seconds, condition="true", lists=False):
    urls = """, l."Malics_urls", l."Malics_counts", coalesce(l.url_parts, 0)::BIGINT AS url_parts""" if lists else ""
    key = "src_ip" if scope == "source" else "src_ip, dest_ip"
    return with_parts("FLOWS WEBSCAN OWNER", f""", st AS ({STATUS_SQL.format(key='src_ip, dest_ip', source='webscan')}),
  bu AS ({_burst_sql(seconds, 'webscan', 'src_ip, dest_ip')}),
  di AS ({_dir_sql('webscan', key, condition)}),
  so AS (SELECT {key}, count(DISTINCT params) AS "Cls_url", {SIZE_SQL} FROM webscan GROUP BY {key}),
  xs AS (SELECT src_ip, dest_ip, count(*) FILTER ({RULE_SQL}) AS sx, round(count(*) FILTER ({RULE_SQL}) / count(*), 6) AS fx
    FROM webscan0 WHERE method = 'GET' GROUP BY ALL),
  l AS (SELECT src_ip, dest_ip, list(params ORDER BY seq) AS "Malics_urls", list(n ORDER BY seq) AS "Malics_counts", 1 AS url_parts
    FROM (SELECT src_ip, dest_ip, params, min(seq) AS seq, count(*) AS n FROM webscan0 WHERE method = 'GET' AND {RULE_SQL} GROUP BY ALL)
    GROUP BY src_ip, dest_ip)
SELECT n AS "Sum_flow", "Sum_sec_flow", "Feq_sec_flow", coalesce(sx, 0)::BIGINT AS "Sum_xss", coalesce(fx, 0.0)::DOUBLE AS "Feq_xss",
  "Sum_dir", "Feq_dir", "Sum_404_error", "Feq_404_error", "H_status", "Cls_url", "Sum_packets", "Mean_packets", src_ip, dest_ip,
  src_ip IN (SELECT ip FROM owner) AS is_cloud{urls}
FROM (SELECT src_ip, dest_ip, count(*) AS n FROM webscan GROUP BY ALL) JOIN st USING (src_ip, dest_ip)
  JOIN bu USING (src_ip, dest_ip) JOIN di USING ({key}) JOIN so USING ({key})
  LEFT JOIN xs USING (src_ip, dest_ip) LEFT JOIN l USING (src_ip, dest_ip)""")


@query("webscan_features", "D16 D10", _webscan_sql("source", 1))
def _(t):
    flows = clean_webscan(t.flows, drop_single=False)
    malicious, _lists = malicious_by_rule(flows, attack_rule(), PAIR)
    return webscan_plan.webscan_features(flows, t.owner, malicious).drop("Malics_urls")


@query("webscan_features_pair", "D16 D10", _webscan_sql("pair", 3600, "method = 'GET'"))
def _(t):
    flows = clean_webscan(t.flows, drop_single=False)
    malicious, _lists = malicious_by_rule(flows, attack_rule(), PAIR)
    table = webscan_plan.webscan_features(flows, t.owner, malicious, scope="pair", methods=["GET"], burst_seconds=3600)
    return table.drop("Malics_urls")


@query("webscan_features_with_urls", "D16 D10", _webscan_sql("source", 1, lists=True))
def _(t):
    """The sixteen columns with every part of the malicious URLs of each pair; the features stand on the first part."""
    flows = clean_webscan(t.flows, drop_single=False)
    malicious, lists = malicious_by_rule(flows, attack_rule(), PAIR)
    table = webscan_plan.webscan_features(flows, t.owner, malicious)
    return webscan_plan.webscan_features_with_urls(table, lists).drop("part")


@query("defined_features", "B8", "SELECT src_ip, dest_ip, \"Sum_flow\" FROM (" + _webscan_sql("source", 1)
       + ') WHERE "Feq_404_error" <> -1 AND "H_status" <> -1 AND "Mean_packets" <> -1')
def _(t):
    table = webscan_plan.webscan_features(t.webscan, t.owner)
    return defined_features(table).select("src_ip", "dest_ip", "Sum_flow")


@query("model_columns", "B7", "SELECT \"Sum_sec_flow\", \"Feq_sec_flow\", \"Feq_xss\", \"Feq_dir\", \"Feq_404_error\", \"H_status\" FROM ("
       + _webscan_sql("source", 1) + ")")
def _(t):
    malicious, _lists = malicious_by_rule(t.webscan, attack_rule(), PAIR)
    return webscan_plan.webscan_features(t.webscan, t.owner, malicious).select(*webscan_plan.MODEL_COLUMNS)


@query("domain_features", "D17", with_parts("FLOWS DOMAIN OWNER", f"""
SELECT "Flows", host AS "Hostname", "Urls", "Similar_host", dest_ip, dest_ip IN (SELECT ip FROM owner) AS is_cloud
FROM ({HOST_SQL})"""))
def _(t):
    return domain_plan.domain_features(t.domain, t.owner)


@query("domain_features_with_sources", "D17 D12", with_parts("FLOWS DOMAIN OWNER", f"""
SELECT h."Flows", h.host AS "Hostname", h."Urls", h."Similar_host", h.dest_ip, h.dest_ip IN (SELECT ip FROM owner) AS is_cloud,
  1::BIGINT AS source_parts, l.src_ip
FROM ({HOST_SQL}) h JOIN (SELECT dest_ip, host, list(src_ip ORDER BY seq) AS src_ip FROM domain GROUP BY ALL) l
  ON l.dest_ip = h.dest_ip AND l.host = h.host"""))
def _(t):
    """Every part of the source lists; the features stand on the first part of a list."""
    return domain_plan.domain_features_with_sources(t.domain, t.owner).drop("part")


def _train_sql(line):
    return with_parts(FW, f""", cut AS (SELECT *, ({line}) // 20 AS chunk FROM webscan),
  si AS (SELECT chunk, count(*) AS chunk_rows FROM cut GROUP BY chunk),
  st AS ({STATUS_SQL.format(key='chunk', source='cut')}), bu AS ({_burst_sql(3600, 'cut', 'chunk')}),
  di AS ({_dir_sql('cut', 'chunk', "method = 'GET'")})
SELECT * FROM bu JOIN st USING (chunk) JOIN di USING (chunk) JOIN si USING (chunk)""")


@query("training_features", "D18 E3", _train_sql("row_number() OVER (ORDER BY seq) - 1"))
def _(t):
    return webscan_plan.training_features(t.webscan, seconds=3600)


@query("training_features_by_line", "D18 E3", _train_sql("seq"))
def _(t):
    """Chunks by original line number; cleaned-away lines leave gaps, and no row is left out."""
    return webscan_plan.training_features(t.webscan, seconds=3600, dense=False)


@query("row_chunks", "E3", with_parts(FW, """
SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // 20 AS chunk FROM webscan"""))
def _(t):
    return sequence.chunks(t.webscan).select("seq", "chunk")


@query("similar_neighbours", "E2", with_parts(FW, """
, p AS (SELECT src_ip, lower(params) AS u, lag(lower(params)) OVER (PARTITION BY src_ip, dest_ip ORDER BY seq) AS v FROM webscan)
SELECT src_ip, CASE WHEN count(v) = 0 THEN -1 ELSE count(*) FILTER (levenshtein(u, v) < 5) END AS "C_similar_url"
FROM p GROUP BY src_ip"""))
def _(t):
    return sequence.similar_neighbours(t.webscan)


@query("basic_scan_vector", "D19 D20", with_parts("FLOWS BASIC", f"""
, p AS (SELECT *, lag(lower(params)) OVER (PARTITION BY src_ip, dest_ip ORDER BY seq) AS v FROM basic)
SELECT src_ip, round(count(*) FILTER ({RULE_SQL}) / count(*), 6) AS "P_malicious_urls",
  CASE WHEN count(v) = 0 THEN -1 ELSE count(*) FILTER (levenshtein(lower(params), v) < 5) END AS "C_similar_url",
  round(count(*) FILTER (status = '404') / count(*), 6) AS num_404, round(entropy(status), 6) AS "H_status"
FROM p GROUP BY src_ip"""))
def _(t):
    return webscan_plan.basic_scan_vector(t.basic, L.score_urls_by(t.basic, attack_rule(), ["src_ip"]))


@query("cumulative_frequency", "E4", with_parts(FW, """
SELECT src_ip, size, n, (sum(n) OVER (PARTITION BY src_ip ORDER BY size))::BIGINT AS cum
FROM (SELECT src_ip, size, count(*) AS n FROM webscan WHERE size <> '-' GROUP BY ALL)"""))
def _(t):
    return impute.cumulative_frequency(t.webscan, ["src_ip"], "size", prefix=2)


@query("density_rank", "E5", """
SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events""")
def _(t):
    return rank_by(t.read("events").select("event_id", "value"), "value", "event_id", "rank").select("event_id", "rank")


@query("expected_fill", "I1", with_parts(FW, """
, c AS (SELECT src_ip, dest_ip, status, count(*) AS n FROM webscan GROUP BY ALL),
  g AS (SELECT src_ip, dest_ip, coalesce(sum(n) FILTER (status <> '-'), 0) AS r, sum(n) AS a FROM c GROUP BY ALL)
SELECT src_ip, dest_ip, status, round(CASE WHEN r > 0 THEN n * a / r ELSE n END, 6)::DOUBLE AS weight
FROM c JOIN g USING (src_ip, dest_ip) WHERE status <> '-' OR r = 0"""))
def _(t):
    return impute.expected_frequency(t.webscan, PAIR, "status")


@query("seeded_fill", "I1", with_parts(FW, """
, d AS (SELECT src_ip, status, row_number() OVER (PARTITION BY src_ip ORDER BY seq) AS pick FROM webscan WHERE status <> '-'),
  r AS (SELECT src_ip, count(*) AS r FROM webscan WHERE status <> '-' GROUP BY src_ip),
  u AS (SELECT seq, w.src_ip, floor((seq * 2654435761 % 4294967296) / 4294967296.0::DOUBLE * r)::BIGINT + 1 AS pick
        FROM webscan w LEFT JOIN r USING (src_ip) WHERE status = '-')
SELECT seq, u.src_ip, coalesce(d.status, '-') AS status FROM u LEFT JOIN d ON d.src_ip = u.src_ip AND d.pick = u.pick
UNION ALL SELECT seq, src_ip, status FROM webscan WHERE status <> '-'"""))
def _(t):
    """A multiplicative draw which SQL can repeat; the default draw hashes the row number."""
    draw = F.col("seq") * F.lit(2654435761) % F.lit(4294967296) / F.lit(4294967296.0)
    return impute.fill_unresolved(t.webscan.select("seq", "src_ip", "status"), ["src_ip"], "status", draw=draw)


@query("hashed_fill", "I1", with_parts(FW, """
SELECT src_ip, count(*) AS n, CASE WHEN bool_or(status <> '-') THEN 0 ELSE count(*) END::BIGINT AS unresolved,
  CASE WHEN bool_or(status <> '-') THEN list_sort(list(DISTINCT status) FILTER (status <> '-')) ELSE ['-'] END AS statuses
FROM webscan GROUP BY src_ip"""))
def _(t):
    """The draw itself is free; rows, their number and the statuses of each source are not."""
    filled = impute.fill_unresolved(t.webscan.select("seq", "src_ip", "status"), ["src_ip"], "status", seed=42)
    return filled.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "-").alias("unresolved"),
                                        F.sort_array(F.collect_set("status")).alias("statuses"))


