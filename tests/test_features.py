import math

import pytest
from pyspark.sql import functions as F

from conftest import flow
from flowscope.operators import aggregate as A
from flowscope.operators import clean, impute, lookup, sequence
from flowscope.plans.domain import domain_features, domain_features_with_sources
from flowscope.plans.webscan import WEBSCAN_COLUMNS, basic_scan_vector, training_features, webscan_features


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_burst_documented_case(flows):
    got = one(A.burst_statistics(flows([flow(i, second=s) for i, s in enumerate([1, 2, 2, 3, 3])]), ["src_ip"]))
    assert (got["Sum_sec_flow"], got["Feq_sec_flow"]) == (4, 0.8)


def test_burst_of_one_flow_and_of_bad_times(flows):
    assert one(A.burst_statistics(flows([flow(0)]), ["src_ip"]))["Feq_sec_flow"] == 1.0
    rows = [flow(0, second=1), flow(1, second=1)] + [tuple("-" if j == 1 else x for j, x in enumerate(flow(2)))]
    got = one(A.burst_statistics(flows(rows), ["src_ip"]))
    assert got["Sum_sec_flow"] == 2 and got["Feq_sec_flow"] == pytest.approx(2 / 3)


def test_status_statistics(flows):
    rows = [flow(i, status=s) for i, s in enumerate(["-", "404", "200", "200", "302"])]
    got = one(A.status_statistics(flows(rows), ["src_ip"]))
    assert got["Sum_404_error"] == pytest.approx(1.25) and got["Feq_404_error"] == 0.25 and got["H_status"] == 1.5
    got = one(A.status_statistics(flows([flow(0, status="-"), flow(1, status="-")]), ["src_ip"]))
    assert (got["Sum_404_error"], got["Feq_404_error"], got["H_status"]) == (-1, -1, -1)


def test_expected_fill_weights(flows):
    rows = [flow(i, status=s) for i, s in enumerate(["-", "404", "200", "200", "302"])]
    got = {r.status: r.weight for r in impute.expected_frequency(flows(rows), ["src_ip"], "status").collect()}
    assert got == {"404": 1.25, "200": 2.5, "302": 1.25}


def test_sampled_fill_follows_the_group(flows):
    rows = [flow(i, status="-") for i in range(4000)] + [
        flow(4000 + i, status=s) for i, s in enumerate(["404", "200", "200", "302"])
    ]
    rows += [flow(5000, src="192.0.2.9", status="-")]
    df = flows(rows)
    filled = impute.fill_unresolved(df, ["src_ip"], "status", seed=3)
    got = {r.status: r["count"] for r in filled.filter("seq < 4000").groupBy("status").count().collect()}
    assert set(got) == {"404", "200", "302"}
    assert got["200"] / 4000 == pytest.approx(0.5, abs=0.03) and got["404"] / 4000 == pytest.approx(0.25, abs=0.03)
    again = impute.fill_unresolved(df.repartition(7), ["src_ip"], "status", seed=3)
    assert sorted(again.collect()) == sorted(filled.collect())
    assert filled.filter("seq = 5000").first().status == "-" and filled.count() == len(rows)


def test_sizes(flows):
    rows = [flow(0, size="10"), flow(1, size="-"), flow(2, size="20"), flow(3, src="192.0.2.2", size="-")]
    got = {r.src_ip: (r.Sum_packets, r.Mean_packets) for r in A.size_statistics(flows(rows), ["src_ip"]).collect()}
    assert got == {"192.0.2.1": (30, 15.0), "192.0.2.2": (0, -1.0)}


def test_similarity_branches(flows):
    rows = [
        flow(0, host="a.b", params="http://a.b/x"), flow(1, host="a.b", params="zzz"),
        flow(2, host="c.d", params="c.e"), flow(3, host="c.d", params="c.e"), flow(4, host="c.d", params="c.dd"),
        flow(5, host="1.2.3.4", params="1.2.3.4"), flow(6, host="1.2.3.4", params="1.2.3.45"),
    ]
    got = {r.Hostname: r for r in domain_features(flows(rows)).collect()}
    assert got["a.b"].Similar_host == 0 and got["a.b"].Urls == 2
    assert got["c.d"].Similar_host == 0 or got["c.d"].Similar_host == pytest.approx(1.0)
    assert got["1.2.3.4"].Similar_host == pytest.approx(0.5)
    lists = {r.Hostname: r.src_ip for r in domain_features_with_sources(flows(rows)).collect()}
    assert lists["c.d"] == ["192.0.2.1"] * 3


def test_cleaning_keeps_nulls_and_drops_single_sources(flows):
    rows = [flow(0, protocol=None), flow(1), flow(2, protocol="-"), flow(3, src="192.0.2.7"),
            flow(4, port=None), flow(5, method="-"), flow(6, method="CONNECT"), flow(7, host="-")]
    df = flows(rows)
    assert {r.seq for r in clean.clean_webscan(df).collect()} == {0, 1, 6, 7}
    assert {r.seq for r in clean.clean_domain(df).collect()} == {0, 1, 3}
    assert {r.seq for r in clean.clean_basic(df).collect()} == {0, 1, 4, 6, 7}


def test_address_check_modes(flows):
    df = flows([flow(0), flow(1, src="999.1.1.1")])
    assert clean.require_ipv4(df, "src_ip").count() == 1
    assert [r.is_ipv4 for r in clean.require_ipv4(df, "src_ip", "flag").orderBy("seq").collect()] == [True, False]
    with pytest.raises(Exception, match="999.1.1.1"):
        clean.require_ipv4(df, "src_ip", "error").collect()
    with pytest.raises(ValueError):
        clean.require_rows(df.filter("seq > 9"))


def test_intervals(flows):
    rows = [flow(0, second=0), flow(1, second=2), flow(2, second=3), flow(3, second=5), flow(4, src="192.0.2.2")]
    got = {r.src_ip: r for r in sequence.interval_statistics(flows(rows), ["src_ip"]).collect()}
    assert got["192.0.2.1"].mean_time_interval == pytest.approx(5 / 3)
    assert got["192.0.2.1"].H_time_interval == pytest.approx(-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))
    assert got["192.0.2.2"].H_time_interval == -1
    bad = flows([tuple("-" if j == 1 else x for j, x in enumerate(flow(0)))])
    assert one(sequence.interval_statistics(bad, ["src_ip"]))["mean_time_interval"] == -2


def test_similar_neighbours(flows):
    rows = [flow(0, params="/AAAA"), flow(1, params="/aaab"), flow(2, params="/completely/other"),
            flow(3, dest="198.51.100.2", params="/x"), flow(4, src="192.0.2.2")]
    got = {r.src_ip: r.C_similar_url for r in sequence.similar_neighbours(flows(rows)).collect()}
    assert got == {"192.0.2.1": 1, "192.0.2.2": -1}
    assert basic_scan_vector(flows(rows)).count() == 2


def test_chunks(flows):
    df = flows([flow(i) for i in range(50) if i % 10 != 3])
    got = {r.chunk: r["count"] for r in sequence.chunks(df, dense=False).groupBy("chunk").count().collect()}
    assert got == {0: 18, 1: 18, 2: 9}
    dense = {r.chunk: r["count"] for r in sequence.chunks(df).groupBy("chunk").count().collect()}
    assert dense == {0: 20, 1: 20, 2: 5}
    assert {r.chunk: r.chunk_rows for r in training_features(df).collect()} == dense


def test_webscan_scopes(flows):
    rows = [flow(0, dest="198.51.100.1", params="/a", size="10"), flow(1, dest="198.51.100.2", params="/b", size="30"),
            flow(2, dest="198.51.100.2", params="/../../../../../../x", size="-"), flow(3, src="192.0.2.5")]
    df = flows(rows)
    whole = {r.dest_ip: r for r in webscan_features(df).collect()}
    assert set(whole) == {"198.51.100.1", "198.51.100.2"}
    assert {r.Cls_url for r in whole.values()} == {3} and {r.Sum_packets for r in whole.values()} == {40}
    pair = {r.dest_ip: r for r in webscan_features(df, scope="pair").collect()}
    assert (pair["198.51.100.1"].Cls_url, pair["198.51.100.1"].Sum_dir, pair["198.51.100.2"].Sum_dir) == (1, 0, 1)
    assert webscan_features(df).columns == [*WEBSCAN_COLUMNS, "is_cloud"]
    assert all(r.Sum_xss is None for r in whole.values())


def test_entropy_bounds_and_vectors(flows):
    rows = [flow(i, src=f"192.0.2.{i % 3}", dest=f"198.51.100.{i % 4}", second=i, status=str(200 + i % 5)) for i in range(60)]
    df = flows(rows)
    for r in A.layer7_vector(df).collect():
        assert 0 <= r.H_status <= math.log2(5) + 1e-9 and r.num_of_peers == 4
    for r in A.layer4_vector(df).collect():
        assert r.H_IP3 == 0 and r.srcprts_per_peers == 5 and r.H_dstprt == 0
    matrix = A.source_destination_matrix(df)
    assert len(matrix.columns) == 5 and matrix.count() == 3
    assert A.source_destination_matrix(df, ["198.51.100.1", "198.51.100.9"]).columns == ["src_ip", "198.51.100.1", "198.51.100.9"]
    with pytest.raises(ValueError, match="source_destination_vectors"):
        A.source_destination_matrix(df, max_columns=1)
    whole = A.source_destination_vectors(df).collect()
    assert len(whole) == 3 and all(len(r.peers) == 4 and sum(r.peers.values()) == 20 for r in whole)
    parts = A.source_destination_vectors(df, list_rows=2).collect()
    assert {(r.src_ip, p, n) for r in parts for p, n in r.peers.items()} == {(r.src_ip, p, n) for r in whole for p, n in r.peers.items()}


def test_url_lists_have_one_row_per_pair_and_part(spark, flows):
    df = flows([flow(i, params=f"/bad{i}") for i in range(7)] + [flow(9, dest="198.51.100.2", params="/fine")])
    from flowscope.operators import learning as L
    from flowscope.plans.detection import malicious_by_rule
    from flowscope.plans.webscan import webscan_features_with_urls

    rule = F.contains("params", F.lit("bad"))
    statistics, lists = malicious_by_rule(df, rule, ["src_ip", "dest_ip"])
    table = webscan_features_with_urls(webscan_features(df, malicious=statistics), lists)
    got = {r.dest_ip: r for r in table.collect()}
    assert got["198.51.100.1"].Sum_xss == 7 and len(got["198.51.100.1"].Malics_urls) == 7 and got["198.51.100.1"].url_parts == 1
    assert got["198.51.100.2"].Feq_xss == 0 and got["198.51.100.2"].url_parts == 0
    short = L.malicious_urls(L.score_urls_by(df, rule, ["src_ip", "dest_ip"]), ["src_ip", "dest_ip"], list_rows=3)
    parted = webscan_features_with_urls(webscan_features(df, malicious=statistics), short).collect()
    assert sorted((r.dest_ip, r.part, r.url_parts) for r in parted) == [("198.51.100.1", k, 3) for k in range(3)] + [("198.51.100.2", 0, 0)]


def test_url_parts_hold_every_url(spark, flows):
    from flowscope.operators import learning as L
    from flowscope.plans.detection import malicious_by_rule, scored_with_urls
    from flowscope.plans.webscan import webscan_features_with_urls

    pair, rule = ["src_ip", "dest_ip"], F.contains("params", F.lit("bad"))
    df = flows([flow(i, params=f"/bad{i}") for i in range(7)] + [flow(9, dest="198.51.100.2", params="/fine")])
    statistics, _ = malicious_by_rule(df, rule, pair)
    lists = L.malicious_urls(L.score_urls_by(df, rule, pair), pair, list_rows=3)
    table = webscan_features(df, malicious=statistics)
    scored = table.withColumn("web_scan", F.lit(1))
    for got in (webscan_features_with_urls(table, lists).orderBy("dest_ip", "part").collect(), scored_with_urls(scored, lists).collect()):
        hot = [r for r in got if r.dest_ip == "198.51.100.1"]
        assert [u for r in hot for u in r.Malics_urls] == [f"/bad{i}" for i in range(7)]
        assert sum(sum(r.Malics_counts) for r in hot) == 7 and [r.Sum_xss for r in hot] == [7, None, None]
        assert [(r.part, r.url_parts, r.Sum_xss) for r in got if r.dest_ip == "198.51.100.2"] == [(0, 0, 0)]
    assert [r.web_scan for r in got] == [1, 1, 1, 1]


def test_owned_split_is_a_partition(spark, flows):
    keys = flows([flow(i, src=f"192.0.2.{i}") for i in range(9)]).select("src_ip")
    owner = spark.createDataFrame([("192.0.2.1",), ("192.0.2.1",), ("192.0.2.4",), ("203.0.113.9",)], "ip string")
    whole, owned, outside = lookup.owned_outside_split(keys, owner)
    assert (whole.count(), owned.count(), outside.count()) == (9, 2, 7)
    assert lookup.owned_outside_split(keys, None)[2].count() == 9


def test_geo_and_enrichment(spark, flows):
    geo = spark.createDataFrame([("192.0.2.1", "X"), ("198.51.100.1", "Y")], "ip string, country string")
    df = flows([flow(0), flow(1), flow(2, src="192.0.2.2"), flow(3, src="192.0.2.2")])
    got = {r.seq: r for r in lookup.enrich_flows(df, geo).collect()}
    assert set(got) == {0, 1, 3} and got[3].country == "Y" and got[3].host == ["www.example.com"] and got[0].flow_num == 1
    first = lookup.enrich_sources(df, geo).collect()
    assert [(r.src_ip, r.src_port, r.country) for r in first] == [("192.0.2.1", 1000, "X")]
    assert lookup.geo_lookup(df, geo, "src_ip").filter(F.col("country").isNull()).count() == 2


def test_batches(spark):
    keys = spark.createDataFrame([(f"10.0.{i // 250}.{i % 250}",) for i in range(251)] * 2, "dest_ip string")
    got = lookup.key_batches(keys).collect()
    assert sorted(len(r.ips) for r in got) == [51, 100, 100]
    assert len({ip for r in got for ip in r.ips}) == 251


def test_batches_keep_names(spark):
    keys = spark.createDataFrame([("::1",), ("host.example",), ("10.0.0.9",), ("10.0.0.2",), (None,), ("::1",)], "dest_ip string")
    got = sorted(lookup.key_batches(keys, size=2).collect())
    assert [len(r.ips) for r in got] == [2, 2] and got[0].ips == ["10.0.0.2", "10.0.0.9"]
    assert set(got[1].ips) == {"::1", "host.example"}


def test_domain_table_keeps_null_hosts_and_long_lists(flows):
    rows = [flow(i, src=f"192.0.2.{i}") for i in range(5)] + [flow(9, host=None, dest="198.51.100.7")]
    whole = domain_features_with_sources(flows(rows), list_rows=2).collect()
    assert {(r.Hostname, r.Flows, r.source_parts, len(r.src_ip)) for r in whole} == {
        ("www.example.com", 5, 3, 2), ("www.example.com", None, 3, 2), ("www.example.com", None, 3, 1), (None, 1, 1, 1)}


def test_domain_parts_hold_every_source(flows):
    from flowscope.plans.domain import domain_features_with_sources

    rows = [flow(i, src=f"192.0.2.{i}") for i in range(5)] + [flow(9, host=None, dest="198.51.100.7")]
    whole = domain_features_with_sources(flows(rows), list_rows=2).collect()
    hot = sorted((r for r in whole if r.Hostname), key=lambda r: r.part)
    assert [s for r in hot for s in r.src_ip] == [f"192.0.2.{i}" for i in range(5)]
    assert [(r.part, r.Flows, r.source_parts) for r in hot] == [(0, 5, 3), (1, None, 3), (2, None, 3)]
    assert [(r.Flows, r.src_ip) for r in whole if r.Hostname is None] == [(1, ["192.0.2.1"])]


def test_domain_query_returns_every_part(spark, monkeypatch):
    import __spark_entry__ as entry
    from flowscope.operators import aggregate
    from flowscope.plans import domain

    query, sf = entry.queries()["domain_features_with_sources"], "/root/testdata/sf0.001"
    want = query(spark, sf).agg(F.sum("Flows"), F.sum(F.size("src_ip"))).first()
    monkeypatch.setattr(domain, "source_lists", lambda flows, n: aggregate.source_lists(flows, 1))
    assert query(spark, sf).agg(F.sum("Flows"), F.sum(F.size("src_ip"))).first() == want


def test_cumulative_frequency_with_a_common_beginning(flows):
    from flowscope.operators.impute import cumulative_frequency

    rows = [flow(i, params=f"http://host.example/{i % 9}") for i in range(30)]
    got = {r.params: r.cum for r in cumulative_frequency(flows(rows), ["src_ip"], "params", prefix=2, block_values=3).collect()}
    assert [got[f"http://host.example/{k}"] for k in range(9)] == [4, 8, 12, 15, 18, 21, 24, 27, 30]
