import pytest
from pyspark.sql import functions as F

from conftest import flow
from flowscope.operators.lookup import append_if_absent
from flowscope.plans.flows import FLOW_COLUMNS
from flowscope.sources import logs, sinks

GOOD = "01/20/19-19:03:00.698841\t-\tHTTP/1.1\tGET\twww.example.com\t/a?q=\"x\t200\t15\t192.0.2.1\t1234\t198.51.100.1\t80"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_malformed_lines(spark, tmp_path):
    text = "\n".join([GOOD, "", GOOD.replace("200\t15", "200 15"), GOOD + "\textra", GOOD, ""])
    log = logs.typed_flows(logs.read_flow_log(spark, put(tmp_path / "http.log", text)))
    rows = log.orderBy("seq").collect()
    assert [r.seq for r in rows] == [0, 1, 2, 3]
    assert rows[0].params == '/a?q="x' and rows[0].dest_port == 80 and rows[0]._corrupt_record is None
    assert rows[1].dest_port is None and rows[1].status == "200 15" and rows[1]._corrupt_record is not None
    assert rows[2].dest_port == 80 and rows[2]._corrupt_record is not None
    assert logs.quarantined(log).count() == 2
    assert logs.within_error_budget(log).count() == 2


def test_error_budget(spark, tmp_path):
    path = put(tmp_path / "bad.log", "\n".join(["only text"] * 101 + [GOOD] * 100))
    with pytest.raises(ValueError, match="101 of 201"):
        logs.within_error_budget(logs.read_flow_log(spark, path))
    path = put(tmp_path / "fair.log", "\n".join(["only text"] * 101 + [GOOD] * 101))
    assert logs.within_error_budget(logs.read_flow_log(spark, path)).count() == 101


def test_line_numbers_over_files_and_splits(spark, tmp_path):
    for name, count in (("b", 30), ("a", 5000), ("c", 7)):
        put(tmp_path / name, "".join(f"{name}{i}?{'x' * (i % 50)}y\n" for i in range(count)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = logs.read_indexed_urls(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    names = [f"a{i}" for i in range(5000)] + [f"b{i}" for i in range(30)] + [f"c{i}" for i in range(7)]
    assert [(r.seq, r.url.split("?")[0]) for r in rows] == list(enumerate(names))


def test_eleven_fields(spark, tmp_path):
    line = "10/30/19-11:00:00.000001  HTTP/1.1 GET www.example.com /x 200 15 192.0.2.1 99 198.51.100.1 80"
    rows = logs.read_flow_log_11(spark, put(tmp_path / "old.log", f"{line}\n\n{line} extra 81\n")).orderBy("seq").collect()
    assert [(r.protocol, r.dest_ip, r.dest_port) for r in rows] == [("HTTP/1.1", "198.51.100.1", "80"), ("HTTP/1.1", "198.51.100.1", "81")]


def test_access_log_and_indexed_urls(spark, tmp_path):
    lines = ["a b c GET e /x?y=1 z", "a b c POST e /x?y=1", "a b c GET e -", "a b c GET e /x?", "a b c GET e /x", "short", "a b c GET e /k?l?m"]
    got = logs.read_access_log(spark, put(tmp_path / "access.log", "\n".join(lines))).orderBy("seq").collect()
    assert [(r.seq, r.url) for r in got] == [(0, "/x?y=1"), (6, "/k?l?m")]
    got = logs.read_indexed_urls(spark, put(tmp_path / "urls", "/a\n/b?c\n/d?\n/e??f\n")).collect()
    assert [(r.seq, r.query) for r in got] == [(1, "c")]


def test_corpus_truth_and_features(spark, tmp_path):
    good, bad = put(tmp_path / "good", "a\nb\n"), put(tmp_path / "bad", "c\n")
    assert sorted(map(tuple, logs.read_corpus(spark, good, bad).collect())) == [("a", 0), ("b", 0), ("c", 1)]
    row = logs.read_domain_truth(spark, put(tmp_path / "truth.csv", "acc,198.51.100.1,80, h.example ,3,0\n")).first()
    assert row.hostname == " h.example " and row.sum_count == 3
    table = spark.createDataFrame([(1.0, 0.5, "192.0.2.1")], "Sum_dir double, Feq_dir double, src_ip string")
    for header in (False, True):
        path = str(tmp_path / f"features-{header}")
        sinks.append_labelled(table, table, path, header)
        sinks.append_labelled(table, table.limit(0), path, header)
        rows = logs.read_labelled_features(spark, path, ["Sum_dir", "Feq_dir", "src_ip", "label"], header).collect()
        assert sorted(r.label for r in rows) == [0, 1, 1] and all(r.Sum_dir == 1.0 for r in rows)


def test_flow_log_round_trip(spark, flows, tmp_path):
    df = flows([flow(i, params=f"/p{i}\"'\\x") for i in range(20)]).withColumn("xff", F.lit("-"))
    path = str(tmp_path / "log")
    sinks.write_flow_log(df, path, FLOW_COLUMNS)
    back = logs.typed_flows(logs.read_flow_log(spark, path)).select(*FLOW_COLUMNS)
    assert sorted(back.collect()) == sorted(df.select(*FLOW_COLUMNS).collect())


def test_sinks(spark, tmp_path):
    scored = spark.createDataFrame([("/a%20b\r\n", 1), ("/c", 0), ("x%0Ay", 2)], "line string, prediction int")
    sinks.write_attack_lines(scored, str(tmp_path / "attacks"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "attacks")).collect()) == ["/a b", "xy"]
    assert sinks.result_path("/logs/day.1/http.log", "/out") == "/out/http"
    marked = spark.createDataFrame([(1, 2, 0, 1.234, 5.0)], "id bigint, cluster bigint, halo bigint, rho double, delta double")
    sinks.write_assignment(marked, str(tmp_path / "assign"))
    sinks.write_decision_graph(marked, str(tmp_path / "graph"))
    assert spark.read.text(str(tmp_path / "assign")).first().value == "1 2 0"
    assert spark.read.text(str(tmp_path / "graph")).first().value == "1.23 5.00"


def test_caches(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(4)

    path = str(tmp_path / "map")
    assert sinks.load_or_build(spark, path, build).count() == 4
    assert sinks.load_or_build(spark, path, build).count() == 4 and built == [1]
    cache = str(tmp_path / "cache")
    spark.createDataFrame([("a", 0)], "ip string, n bigint").write.parquet(cache)
    new = spark.createDataFrame([("a", 5), ("b", 7), ("b", 6)], "ip string, n bigint")
    append_if_absent(cache, new, "ip", "n")
    assert sorted(map(tuple, spark.read.parquet(cache).collect())) == [("a", 0), ("b", 6)]


def test_triplets(spark, tmp_path):
    edges = logs.read_triplets(spark, put(tmp_path / "d", "1 2 0.5\n1 3 1.5\n"))
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 0.5), (1, 3, 1.5)]
