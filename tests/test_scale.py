import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowscope.operators import scale as S


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows has one key; line numbers have gaps."""
    rng = random.Random(5)
    rows = [(i * 3, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(20)) for i in range(3000)]
    return spark.createDataFrame(rows, "seq bigint, k string, v int")


def test_lag_in_blocks(hot):
    want = hot.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("seq"))).select("seq", "p").collect()
    got = S.lag_in_blocks(hot, ["k"], "seq", F.col("v"), "p", 500).select("seq", F.col("p.v").alias("p")).collect()
    assert sorted(got) == sorted(want) or {tuple(r) for r in got} == {tuple(r) for r in want}
    assert len(got) == 3000


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(0, None, 1), (1, "a", 2), (2, None, 3), (700, None, 4), (701, "a", 5)], "seq bigint, k string, v int")
    got = {r.seq: r.n for r in S.position_in_group(df, ["k"], "seq", "n", 10).collect()}
    assert got == {0: 1, 2: 2, 700: 3, 1: 1, 701: 2}
    before = {r.seq: r.p and r.p.v for r in S.lag_in_blocks(df, ["k"], "seq", F.col("v"), "p", 10).collect()}
    assert before == {0: None, 1: None, 2: 1, 700: 3, 701: 2}


def test_rank_with_nulls_and_large_integers(spark):
    df = spark.createDataFrame([(0, 2.0), (1, None), (2, 1.0), (3, None)], "id bigint, v double")
    assert {r.id: r["rank"] for r in S.rank_by(df, "v", "id", "rank").collect()} == {0: 1, 2: 2, 1: 3, 3: 4}
    assert {r.id: r["rank"] for r in S.rank_by(df, "v", "id", "rank", descending=False).collect()} == {2: 1, 0: 2, 1: 3, 3: 4}
    big = spark.createDataFrame([(i, (1 << 53) + i) for i in range(4)], "id bigint, v bigint")
    assert {r.id: r["rank"] for r in S.rank_by(big, "v", "id", "rank", descending=False).collect()} == {0: 1, 1: 2, 2: 3, 3: 4}
    assert [S.kth_smallest(big, "v", k) for k in range(4)] == [(1 << 53) + k for k in range(4)]
    assert S.kth_smallest(big, "v", 4) is None


def test_scratch_is_released(spark, monkeypatch):
    monkeypatch.setattr(S, "_written", [])
    held = S.cut_lineage(spark.range(10).toDF("id"))
    assert held.count() == 10
    path = held.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert Path(path).exists()
    S.release_scratch(spark)
    assert not Path(path).exists()


def test_lag_keeps_null_values(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", 5), (900, "a", None), (901, "a", 7)], "seq bigint, k string, v int")
    rows = {r.seq: r.p for r in S.lag_in_blocks(df, ["k"], "seq", F.col("v"), "p", 10).collect()}
    assert rows[0] is None and rows[1] is not None and rows[1].v is None
    assert rows[900].v == 5 and rows[901].v is None


def test_position_in_group(hot):
    want = hot.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("seq"))).select("seq", "n").collect()
    got = S.position_in_group(hot, ["k"], "seq", "n", 500).select("seq", "n").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    whole = S.position_in_group(hot, [], "seq", "n", 500).select("seq", "n").collect()
    assert {tuple(r) for r in whole} == {(i * 3, i + 1) for i in range(3000)}


def test_lists_are_whole_and_bounded(hot):
    parts = S.lists_by_key(hot, ["k"], "seq", {"vs": "v"}, 64).collect()
    assert max(len(r.vs) for r in parts) == 64
    joined = {}
    for r in sorted(parts, key=lambda r: (r.k, r.part)):
        joined.setdefault(r.k, []).extend(r.vs)
    want = {}
    for r in sorted(hot.collect()):
        want.setdefault(r.k, []).append(r.v)
    assert joined == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, hot, how):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "k string, d int")
    want = hot.join(dim, "k", how)
    got = S.salted_join(hot, dim, "k", "seq", how).select(*want.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_kth_smallest(spark):
    rng = random.Random(1)
    data = [rng.choice([0.0, 1.5, -3.25, rng.random() * 1e6, rng.random() * 1e-9]) for _ in range(997)]
    df = spark.createDataFrame([(x,) for x in data], "v double")
    for k in (0, 1, 200, 500, 996):
        assert S.kth_smallest(df, "v", k, buckets=7) == sorted(data)[k]
    assert S.kth_smallest(df, "v", 997) is None
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 2), (5.0, 1)], "v double, w bigint")
    assert [S.kth_smallest(weighted, "v", k, "w") for k in range(6)] == [1.0, 1.0, 1.0, 2.0, 2.0, 5.0]


@pytest.mark.parametrize("descending", [True, False])
def test_rank_by_with_a_hot_value(spark, descending):
    rng = random.Random(2)
    data = [(i, 7.0 if i % 3 == 0 else float(rng.randrange(100))) for i in range(1200)]
    df = spark.createDataFrame(data, "id bigint, v double")
    order = sorted(data, key=lambda r: (-r[1] if descending else r[1], r[0]))
    got = {r.id: r.rank for r in S.rank_by(df, "v", "id", "rank", descending, buckets=20).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(order)}


def test_shared_dir_prefers_the_setting(spark):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "hdfs:///work"))
    assert S.shared_dir(session) == "hdfs:///work"
    assert S.shared_dir(spark)


def test_no_executor_local_lineage_is_used():
    root = Path(S.__file__).parents[1]
    text = "".join(p.read_text() for p in root.rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text and ".toPandas" not in text


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_side_that_is_broadcast_is_not_copied(spark, tmp_path, how):
    rows = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 40).alias("k"))
    spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).write.parquet(str(tmp_path / "dim"))
    dim = spark.read.parquet(str(tmp_path / "dim"))

    def planned():
        joined = S.salted_join(rows, dim, "k", "seq", how)
        return joined.count(), joined._jdf.queryExecution().executedPlan().toString()

    want = rows.join(dim, "k", how).count()
    number, plan = planned()
    assert number == want and "BroadcastHashJoin" in plan and "explode" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        number, plan = planned()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert number == want and "BroadcastHashJoin" not in plan and "explode" in plan
