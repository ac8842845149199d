import collections
import math

import pytest
from pyspark.sql import functions as F

from flowscope.llm import mixing as M

from .texts import SCHEMA, rows


@pytest.fixture(scope="module")
def corpus(spark):
    data, n = [], 0
    for source, size in (("a", 600), ("b", 90), ("c", 30), (None, 12), ("empty", 3)):
        for _ in range(size):
            data.append((n, "" if source == "empty" else "w " * (1 + n % 7), source, n, "clash"))
            n += 1
    data += [(0, data[0][1], "a", 0, "clash")] * 2 + [(None, "w w w", "a", 0, None)]
    return data, spark.createDataFrame(data, "doc_id bigint, text string, source string, pass bigint, block string")


def tokens_of(data):
    totals = collections.Counter()
    for d in data:
        totals[d[2]] += len(d[1].split())
    return totals


def test_no_document_is_lost_and_no_source_too_often(corpus):
    data, docs = corpus
    mix = M.Mix(docs, max_repeats=2.5, block_tokens=50)
    got = mix.realise(docs).collect()
    totals, spent = tokens_of(data), collections.Counter()
    for r in got:
        spent[r.source] += len(r.text.split())
    assert {r.doc_id for r in got} == {d[0] for d in data}
    assert sum(1 for r in got if r["pass"] == 0) == len(data)
    quota = {r.source.s: r.quota for r in mix.sources.collect()}
    for s, n in totals.items():
        assert spent[s] <= max(quota[s], n) <= math.ceil(2.5 * n)
        assert spent[s] >= quota[s] - 21
    assert spent["a"] == totals["a"]
    least = min(n for n in totals.values() if n)
    best = 1 - math.log(2.5) / math.log(totals["a"] / least)
    assert mix.exponent == pytest.approx(best, abs=1e-6)
    assert mix.exponent >= best - 1e-12


def test_budget_and_weights(corpus):
    data, docs = corpus
    totals = tokens_of(data)
    total = sum(totals.values())
    mix = M.Mix(docs, max_repeats=1.2, budget=total // 2, block_tokens=40)
    weights = {r.source.s: r.weight for r in mix.sources.collect()}
    z = sum((n / total) ** mix.exponent for n in totals.values() if n)
    for s, n in totals.items():
        assert weights[s] == pytest.approx((n / total) ** mix.exponent / z if n else 0.0)
        if n:
            assert weights[s] * (total // 2) / n <= 1.2 + 1e-9
    spent = collections.Counter()
    for r in mix.realise(docs).collect():
        spent[r.source] += len(r.text.split())
    for s, n in totals.items():
        quota = math.floor(weights[s] * (total // 2))
        assert quota - 21 <= spent[s] <= quota + 1e-6


def test_target_entropy(corpus):
    data, docs = corpus
    totals = [n for n in tokens_of(data).values() if n]
    total = sum(totals)
    mix = M.Mix(docs, max_repeats=1e9, target_entropy=1.0, block_tokens=50)
    z = sum((n / total) ** mix.exponent for n in totals)
    w = [(n / total) ** mix.exponent / z for n in totals]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(1.0, abs=1e-4)


def test_passes_are_permuted_and_interleaved(corpus):
    data, docs = corpus
    mix = M.Mix(docs, max_repeats=4.0, block_tokens=10)
    starts = mix.blocks.filter("source.s = 'c'").orderBy("pass", "start").collect()
    order = collections.defaultdict(list)
    for r in starts:
        order[r["pass"]].append(r.block)
    assert len(order) >= 3 and len({tuple(x) for p, x in order.items() if p < 2}) == 2
    assert sorted(order[0]) == sorted(order[1])
    rows_ = mix.realise(docs).filter("progress < 0.5").collect()
    spent = collections.Counter()
    for r in rows_:
        spent[r.source] += len(r.text.split())
    quota = {r.source.s: r.quota for r in mix.sources.collect()}
    for s in ("a", "b", "c"):
        assert spent[s] == pytest.approx(quota[s] / 2, abs=40)


def test_awkward_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    mix = M.Mix(docs, block_tokens=100)
    got = mix.realise(docs)
    assert got.filter("pass = 0").count() == len(rows())
    assert got.drop("pass", "block", "progress").columns == docs.columns
    none = docs.limit(0)
    assert M.Mix(none).realise(none).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert M.Mix(blank).realise(blank).count() == len(rows())


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(M, "checked_broadcast", lambda df, rows, limit=0: df)
    test_awkward_rows(spark)
