import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowscope.llm import queries

from .test_phrases import brute_force
from .test_simhash import components, fingerprint

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str(tuple(dict(zip(columns, r))[c] for c in df.columns)) for r in cur.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want


def test_every_operator_has_a_query():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns(steps):
    names = list(steps[0][0].asDict())
    for rows in steps[1:5]:
        assert list(rows[0].asDict()) == names
    assert set(names) < set(steps[5][0].asDict())


def test_near_duplicates_go(steps):
    before, after = steps[1], steps[2]
    comp = components(sorted({fingerprint(r.text) for r in before}), 3)
    low = {}
    for r in before:
        c = comp[fingerprint(r.text)]
        low[c] = min(low.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(low.values())


def test_benchmark_passages_go(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(r.doc_id for r in steps[2] if not brute_force(r.text, items, 10)[1])
    assert sorted(r.doc_id for r in steps[3]) == want


def test_mixing_loses_nothing(steps):
    assert {r.doc_id for r in steps[4]} == {r.doc_id for r in steps[3]}
    assert len(steps[4]) >= len(steps[3])


def test_shards_fit(steps):
    assert len(steps[5]) == len(steps[4])
    assert all(r.shard_bytes <= 64 << 20 for r in steps[5])


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "shard").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.shard) for r in steps[5])


def test_clean_documents_stay(spark):
    """Ordinary prose in any of the languages passes the quality stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = queries.QUERIES["op8_quality_rules"](spark, SF)
    good = judged.join(labels.filter("quality = 1"), "doc_id").filter(~F.col("base_failed"))
    assert good.filter(~F.col("kept")).isEmpty() and not good.isEmpty()
    assert docs.count() == judged.count()
