from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from flowscope.sources.shared import SharedTable
from flowscope.sources.sinks import load_or_build

SCHEMA = "ip string, owner string"


@pytest.fixture
def cache(spark, tmp_path):
    return SharedTable(spark, str(tmp_path / "owners"), "ip").create(SCHEMA)


def frame(spark, who, *ips):
    return spark.createDataFrame([(ip, who) for ip in ips], SCHEMA)


def held(cache):
    return sorted((r.ip, r.owner) for r in cache.read().collect())


def test_two_interleaved_appends(spark, cache):
    one, two = cache.stage(frame(spark, "a", "1", "2", "2", None)), cache.stage(frame(spark, "b", "2", "3"))
    assert held(cache) == [], "a staged batch does not count"
    assert cache.commit(one) and not cache.commit(two)
    assert held(cache) == [("1", "a"), ("2", "a")]
    again = cache.rebase(two)
    assert cache.commit(again) and held(cache) == [("1", "a"), ("2", "a"), ("3", "b")]
    cache.append_if_absent(frame(spark, "c", "1", "3"))
    assert held(cache) == [("1", "a"), ("2", "a"), ("3", "b")]


def test_many_writers_at_once(spark, cache):
    def add(n):
        ips = [str(i) for i in range(n, n + 6)]
        SharedTable(spark, cache.path, "ip").append_if_absent(frame(spark, f"w{n}", *ips))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(0, 12, 3)))
    assert sorted(int(ip) for ip, _ in held(cache)) == list(range(15))
    assert cache.create(SCHEMA).read().count() == 15


def test_a_failed_append_leaves_nothing(spark, cache):
    cache.append_if_absent(frame(spark, "a", "1"))
    broken = frame(spark, "b", "5", "6").withColumn("owner", F.when(F.col("ip") == "6", F.raise_error(F.lit("lost"))).otherwise("b"))
    with pytest.raises(Exception, match="lost"):
        cache.append_if_absent(broken)
    assert held(cache) == [("1", "a")]


def test_an_unfinished_number_is_reported(spark, cache, tmp_path):
    (tmp_path / "owners" / "_versions" / f"{1:010d}").touch()
    with pytest.raises(RuntimeError, match="has not finished"):
        cache._name_in(1, patience=0.2)
    with pytest.raises(FileNotFoundError):
        SharedTable(spark, str(tmp_path / "none"), "ip").read()


def test_only_a_missing_table_is_built(spark, tmp_path):
    path = str(tmp_path / "built")
    assert load_or_build(spark, path, lambda: frame(spark, "a", "1")).count() == 1
    assert load_or_build(spark, path, lambda: frame(spark, "a", "1", "2")).count() == 1
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        load_or_build(spark, str(tmp_path / "other"), lambda: frame(spark, "a", "1")).count()
    assert (tmp_path / "other" / "notes.parquet").read_text() == "not parquet"
