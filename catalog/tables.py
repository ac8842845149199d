"""Filters, joins, set operations, sorts and limits over the flow table and its dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query, with_parts
from catalog.scalars import IP_TO_INT
from flowscope.operators import clean, lookup
from flowscope.operators.aggregate import flow_counts
from flowscope.plans.domain import domain_features


@query("clean_basic", "B1", with_parts("FLOWS BASIC", "SELECT * FROM basic"))
def _(t):
    return t.basic


@query("clean_webscan", "B2", with_parts("FLOWS WEBSCAN", "SELECT * FROM webscan"))
def _(t):
    return t.webscan


@query("clean_domain", "B3", with_parts("FLOWS DOMAIN", "SELECT * FROM domain"))
def _(t):
    return t.domain


@query("drop_single_sources", "C2", with_parts("FLOWS", """
SELECT seq, src_ip FROM flows WHERE src_ip IN (SELECT src_ip FROM flows GROUP BY src_ip HAVING count(*) > 1)"""))
def _(t):
    return clean.drop_single_sources(t.flows).select("seq", "src_ip")


@query("valid_ipv4_hosts", "B4", with_parts("FLOWS", """
SELECT seq, host FROM flows WHERE regexp_matches(host, '^[0-9.]+$')"""))
def _(t):
    return clean.require_ipv4(t.flows, "host").select("seq", "host")


@query("non_empty_guard", "B5", with_parts("FLOWS", "SELECT count(*) AS n FROM flows"))
def _(t):
    return clean.require_rows(t.flows).agg(F.count(F.lit(1)).alias("n"))


@query("get_only_urls", "B6", with_parts("FLOWS WEBSCAN", """
SELECT src_ip, count(*) FILTER (method = 'GET') AS gets, count(DISTINCT params) FILTER (method = 'GET') AS get_urls
FROM webscan GROUP BY src_ip"""))
def _(t):
    url = F.when(F.col("method") == "GET", F.col("params"))
    return t.webscan.groupBy("src_ip").agg(
        F.count_if(F.col("method") == "GET").alias("gets"), F.countDistinct(url).alias("get_urls")
    )


@query("digits_only_sizes", "B10", with_parts("FLOWS", """
SELECT seq, size::BIGINT AS bytes FROM flows WHERE regexp_full_match(size, '[0-9]+')"""))
def _(t):
    return clean.numeric_only(t.flows, "size", "bytes").select("seq", "bytes")


DOMAIN_TABLE = """, dom AS (
  SELECT dest_ip, host AS "Hostname", count(*) AS "Flows", count(DISTINCT params) AS "Urls",
    round(CASE WHEN NOT regexp_matches(any_value(host), '^[0-9.]+$') AND bool_or(contains(params, host)) THEN 0.0
         ELSE avg(levenshtein(params, host)) END, 6) AS "Similar_host"
  FROM domain GROUP BY dest_ip, host)"""


@query("domain_threshold_filters", "B9", with_parts("FLOWS DOMAIN", DOMAIN_TABLE + """
SELECT 'same' AS rule, dest_ip, "Hostname", "Flows", "Urls" FROM dom WHERE "Similar_host" = 0
UNION ALL SELECT 'near', dest_ip, "Hostname", "Flows", "Urls" FROM dom WHERE "Similar_host" < 10
UNION ALL SELECT 'quiet', dest_ip, "Hostname", "Flows", "Urls" FROM dom WHERE "Flows" < 50 AND "Urls" < 20"""))
def _(t):
    table = domain_features(t.domain)
    same = table.filter("Similar_host = 0").withColumn("rule", F.lit("same"))
    near = table.filter("Similar_host < 10").withColumn("rule", F.lit("near"))
    quiet = clean.quiet_domains(table).withColumn("rule", F.lit("quiet"))
    return same.unionByName(near).unionByName(quiet).select("rule", "dest_ip", "Hostname", "Flows", "Urls")


@query("owner_key_lookup", "B14", with_parts("FLOWS OWNER", f"""
SELECT ipint, ip FROM owner WHERE ipint IN (SELECT {IP_TO_INT.format('src_ip')} FROM flows WHERE method = 'POST')"""))
def _(t):
    wanted = t.flows.filter("method = 'POST'").select(F.col("src_ip").alias("ip"))
    return clean.key_lookup(t.owner, wanted)


@query("owner_range_lookup", "B15", with_parts("FLOWS OWNER", f"""
, b AS (SELECT min(k) AS low, max(k) AS high FROM (SELECT {IP_TO_INT.format('src_ip')} AS k FROM flows WHERE method = 'POST'))
SELECT ipint, ip FROM owner, b WHERE ipint BETWEEN low AND high"""))
def _(t):
    wanted = t.flows.filter("method = 'POST'").select(F.col("src_ip").alias("ip"))
    return clean.key_range_lookup(t.owner, wanted)


@query("owned_outside_split", "C1 G3 G4", with_parts("FLOWS WEBSCAN OWNER", """
SELECT src_ip, 'all' AS part, src_ip IN (SELECT ip FROM owner) AS is_cloud FROM (SELECT DISTINCT src_ip FROM webscan)
UNION ALL SELECT src_ip, 'owned', true FROM (SELECT src_ip FROM webscan INTERSECT SELECT ip FROM owner)
UNION ALL SELECT src_ip, 'outside', false FROM (SELECT src_ip FROM webscan EXCEPT SELECT ip FROM owner)"""))
def _(t):
    keys = t.webscan.select("src_ip").distinct()
    views = lookup.owned_outside_split(keys, t.owner)
    parts = [v.withColumn("part", F.lit(n)) for v, n in zip(views, ("all", "owned", "outside"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("owned_flag_on_flows", "C1", with_parts("FLOWS OWNER", """
SELECT seq, src_ip IN (SELECT ip FROM owner) AS is_cloud FROM flows"""))
def _(t):
    return lookup.mark_owned(t.flows, t.owner).select("seq", "is_cloud")


@query("residual_misses", "C3", with_parts("FLOWS OWNER", """
SELECT DISTINCT src_ip AS ip FROM flows WHERE src_ip NOT IN (SELECT ip FROM owner)"""))
def _(t):
    return lookup.missing_keys(t.flows.select(F.col("src_ip").alias("ip")), t.owner)


@query("geo_lookup", "C4", with_parts("FLOWS GEO", """
SELECT seq, src_ip, country, area FROM flows LEFT JOIN geo ON ip = src_ip"""))
def _(t):
    return lookup.geo_lookup(t.flows, t.geo, "src_ip").select("seq", "src_ip", "country", "area")


@query("owner_lookup", "C5", with_parts("FLOWS OWNER", """
SELECT ipint, ip, CASE WHEN ipint % 3 = 0 THEN 'delivered' ELSE 'cached' END AS status FROM owner
WHERE ip IN (SELECT src_ip FROM flows)"""))
def _(t):
    cache = t.owner.filter("ipint % 3 <> 0").withColumn("status", F.lit("cached"))
    delivered = t.owner.withColumn("status", F.lit("delivered"))
    return lookup.owner_lookup(t.flows.select(F.col("src_ip").alias("ip")), cache, delivered)


@query("owned_sources", "C6", with_parts("FLOWS OWNER", """
SELECT DISTINCT src_ip AS ip FROM flows WHERE src_ip IN (SELECT ip FROM owner)"""))
def _(t):
    return lookup.owned_sources(t.flows, t.owner)


@query("enrich_sources", "C7", with_parts("FLOWS GEO", """
SELECT src_ip, arg_min(src_port, seq) AS src_port, any_value(country) AS country, any_value(area) AS area
FROM flows JOIN geo ON ip = src_ip GROUP BY src_ip"""))
def _(t):
    return lookup.enrich_sources(t.flows, t.geo)


@query("enrich_flows", "C7", with_parts("FLOWS GEO", """
SELECT f.seq, f.src_ip, f.dest_ip, f.timestamp, f.dest_port, [host] AS host, [params] AS params, [status] AS status,
  [size] AS size, [method] AS method, 1 AS flow_num, country, area
FROM flows f LEFT JOIN geo ON ip = f.dest_ip
WHERE f.src_ip IN (SELECT ip FROM geo) OR f.seq NOT IN (SELECT min(seq) FROM flows GROUP BY src_ip)"""))
def _(t):
    return lookup.enrich_flows(t.flows, t.geo)


TRUTH_SQL = """, truth AS (
  SELECT ' ' || regexp_extract(url, '^https?://([^/]+)', 1) || ' ' AS hostname, page_id % 3 AS sum_count,
    page_id % 4 AS sum_count_invalid FROM pages)"""


@query("host_label_joins", "C8", with_parts("FLOWS DOMAIN", DOMAIN_TABLE + TRUTH_SQL + """
SELECT 'fake' AS label, "Hostname", dest_ip FROM dom WHERE "Similar_host" = 0 AND "Hostname" IN (
  SELECT trim(hostname) FROM truth WHERE sum_count_invalid > 0)
UNION ALL SELECT 'true', "Hostname", dest_ip FROM dom WHERE "Similar_host" = 0 AND "Hostname" IN (
  SELECT trim(hostname) FROM truth WHERE sum_count > 0)"""))
def _(t):
    same = domain_features(t.domain).filter("Similar_host = 0")
    truth = t.read("pages").select(
        F.concat(F.lit(" "), F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit(" ")).alias("hostname"),
        (F.col("page_id") % 3).alias("sum_count"),
        (F.col("page_id") % 4).alias("sum_count_invalid"),
    )
    fake = lookup.labelled_domains(same, truth, "sum_count_invalid").withColumn("label", F.lit("fake"))
    true = lookup.labelled_domains(same, truth, "sum_count").withColumn("label", F.lit("true"))
    return fake.unionByName(true).select("label", "Hostname", "dest_ip")


@query("owned_destinations", "C9", with_parts("FLOWS DOMAIN OWNER", DOMAIN_TABLE + """
SELECT dest_ip, "Hostname", "Flows" FROM dom WHERE dest_ip IN (SELECT ip FROM owner)"""))
def _(t):
    return lookup.owned_destinations(domain_features(t.domain), t.owner).select("dest_ip", "Hostname", "Flows")


@query("destination_batches", "D22", with_parts("FLOWS", f"""
SELECT (rn - 1) // 100 AS batch, list(src_ip ORDER BY src_ip) AS ips FROM (
  SELECT src_ip, row_number() OVER (ORDER BY {IP_TO_INT.format('src_ip')}) AS rn
  FROM (SELECT DISTINCT src_ip FROM flows)) GROUP BY 1"""))
def _(t):
    """Batched over the sources, of which there are more than of the destinations."""
    return lookup.key_batches(t.flows, "src_ip")


@query("named_key_batches", "D22", with_parts("FLOWS", """
SELECT count(DISTINCT host) AS n_keys, (count(DISTINCT host) + 9) // 10 AS n_batches, count(DISTINCT host) AS n_distinct
FROM flows"""))
def _(t):
    """Hosts, of which only some are IPv4 addresses: none is lost, and all batches but the last are full."""
    batches = lookup.key_batches(t.flows, "host", size=10).withColumn("ip", F.explode("ips"))
    return batches.agg(F.count("ip").alias("n_keys"), F.countDistinct("batch").alias("n_batches"), F.countDistinct("ip").alias("n_distinct"))


@query("owner_addresses", "A10", with_parts("OWNER", "SELECT ip FROM owner"))
def _(t):
    return t.owner.select("ip")


@query("insert_if_absent", "A11", with_parts("FLOWS OWNER", f"""
SELECT src_ip AS ip, arg_min(host, seq) AS host, min(seq) AS seq FROM flows WHERE src_ip NOT IN (SELECT ip FROM owner)
GROUP BY src_ip"""))
def _(t):
    new = t.flows.select(F.col("src_ip").alias("ip"), "host", "seq")
    return lookup.insert_if_absent(t.owner, new, "ip", "seq")


@query("first_flow_per_source", "E6", with_parts("FLOWS", """
SELECT * FROM flows WHERE seq IN (SELECT min(seq) FROM flows GROUP BY src_ip)"""))
def _(t):
    return lookup.first_flow_per_source(t.flows)


@query("sorted_domain_table", "F1", with_parts("FLOWS DOMAIN", DOMAIN_TABLE + """
SELECT "Hostname", dest_ip, "Flows" FROM dom ORDER BY "Flows" DESC, dest_ip, "Hostname" """))
def _(t):
    return domain_features(t.domain).select("Hostname", "dest_ip", "Flows").orderBy(F.desc("Flows"), "dest_ip", "Hostname")


@query("first_rows", "F2", with_parts("FLOWS WEBSCAN", "SELECT seq, src_ip, params FROM webscan ORDER BY seq LIMIT 100"))
def _(t):
    return t.webscan.orderBy("seq").limit(100).select("seq", "src_ip", "params")


@query("shortest_url", "F4", with_parts("FLOWS DOMAIN", """
SELECT dest_ip, host, min(length(params))::INTEGER AS length,
  arg_min(params, (length(params), params)) AS shortest FROM domain WHERE contains(params, host) GROUP BY dest_ip, host"""))
def _(t):
    inside = t.domain.filter(F.contains(F.col("params"), F.col("host")))
    return inside.groupBy("dest_ip", "host").agg(
        F.min(F.length("params")).alias("length"),
        F.min_by("params", F.struct(F.length("params"), "params")).alias("shortest"),
    )


@query("labelled_corpus_union", "A6 G1", """
SELECT url AS text, 0 AS label FROM pages UNION ALL SELECT text, 1 FROM benchmark""")
def _(t):
    good = t.read("pages").select(F.col("url").alias("text"), F.lit(0).alias("label"))
    bad = t.read("benchmark").select("text", F.lit(1).alias("label"))
    return good.unionByName(bad)


@query("feature_table_union", "G1", with_parts("FLOWS WEBSCAN OWNER", """
SELECT src_ip, count(*) AS "Sum_flow" FROM webscan GROUP BY src_ip"""))
def _(t):
    """Owned and outside tables appended give the whole table."""
    _all, owned, outside = lookup.owned_outside_split(flow_counts(t.webscan, ["src_ip"]), t.owner)
    return owned.unionByName(outside).select("src_ip", "Sum_flow")


@query("distinct_keys", "G2", with_parts("FLOWS", "SELECT DISTINCT src_ip, dest_ip FROM flows"))
def _(t):
    return t.flows.select("src_ip", "dest_ip").distinct()


@query("key_difference", "G3", with_parts("FLOWS OWNER", "SELECT src_ip AS ip FROM flows EXCEPT SELECT ip FROM owner"))
def _(t):
    return t.flows.select(F.col("src_ip").alias("ip")).subtract(t.owner.select("ip"))


@query("key_intersection", "G4", with_parts("FLOWS OWNER", "SELECT src_ip AS ip FROM flows INTERSECT SELECT ip FROM owner"))
def _(t):
    return t.flows.select(F.col("src_ip").alias("ip")).intersect(t.owner.select("ip"))
