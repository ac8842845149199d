import collections
import hashlib
import os

import pytest

from flowscope.llm import sharding as D

from .texts import SCHEMA, rows


def leaf_of(keys, limit):
    """Extendible hashing, bucket by bucket: key -> depth."""
    out = {}
    todo = [(0, list(range(len(keys))))]
    while todo:
        depth, members = todo.pop()
        if sum(keys[i][1] for i in members) <= limit or len(members) == 1:
            out |= {i: depth for i in members}
            continue
        for bit in (0, 1):
            part = [i for i in members if keys[i][0] >> (31 - depth) & 1 == bit]
            if part:
                todo.append((depth + 1, part))
    return out


@pytest.mark.parametrize("limit", [40, 300, 5000, 10**6])
def test_as_bucket_by_bucket(spark, limit):
    data = [(i, "x" * (i * 37 % 101)) for i in range(700)]
    got = {r.doc_id: r for r in D.shards(spark.createDataFrame(data, "doc_id bigint, text string").repartition(5), limit=limit).collect()}
    keys = [(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16), len(t)) for i, t in data]
    want = leaf_of(keys, limit)
    assert len(got) == len(data)
    sizes = collections.Counter()
    for i, depth in want.items():
        r = got[i]
        assert r.depth == depth and r.n_bytes == keys[i][1]
        assert r.shard == "p" + (format(keys[i][0] >> (32 - depth), f"0{depth}b") if depth else "")
        sizes[r.shard] += r.n_bytes
    for r in got.values():
        assert r.shard_bytes == sizes[r.shard] and r.oversize == (r.shard_bytes > limit)
        assert not r.oversize or r.shard_rows == 1


def test_equal_ids_are_split_by_later_bits(spark):
    data = [(5, "x" * 10)] * 400 + [(None, "y" * 10)] * 200 + [(i, "z" * 10) for i in range(100)]
    got = D.shards(spark.createDataFrame(data, "doc_id bigint, text string").repartition(6), limit=100).collect()
    assert len(got) == len(data)
    assert not any(r.oversize for r in got)
    per = collections.Counter(r.shard for r in got)
    assert max(per.values()) <= 10
    assert all(per[r.shard] == r.shard_rows for r in got)
    assert any(r.depth > 32 for r in got if r.doc_id == 5)


def test_awkward_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "'clash' AS shard", "1 AS depth")
    got = D.shards(docs, limit=500)
    assert got.count() == len(rows())
    assert got.filter("oversize and shard_rows > 1").isEmpty()
    assert set(docs.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert got.agg({"n_bytes": "sum"}).first()[0] == sum(len((r[1] or "").encode()) for r in rows())
    assert D.shards(docs.limit(0)).count() == 0
    D.write_shards(got, str(tmp_path / "out"))
    assert len([x for x in os.listdir(tmp_path / "out") if x.startswith("shard=")]) == got.select("shard").distinct().count()
