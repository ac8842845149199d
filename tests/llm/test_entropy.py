import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from flowscope.llm import entropy as E
from flowscope.llm import packed

from .texts import SCHEMA, rows


def model(texts, types):
    c, pairs = collections.Counter(), collections.Counter()
    for w in texts:
        c.update(w)
        pairs.update(zip(w, w[1:]))
    n = sum(c.values())

    def single(w):
        return (c[w] + 1) / (n + types + 1)

    def loss(w):
        p = [single(x) if i == 0 else (pairs[w[i - 1], x] + E.MU * single(x)) / (c[w[i - 1]] + E.MU) for i, x in enumerate(w)]
        return -sum(map(math.log, p)) / len(w)

    return loss


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_against_counted_models(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", 900)
    monkeypatch.setattr(packed, "RANGE_BYTES", 4000)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    target = F.col("source") == "big"
    sizes = docs.agg(F.sum(F.octet_length("text")).alias("a"), F.sum(F.when(target, F.octet_length("text"))).alias("t")).first()
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1_000_000)) < int(1e6 * sizes.t / sizes.a)
    known = docs.select("doc_id", "text", F.coalesce(target, F.lit(False)).alias("t"), drawn.alias("b")).collect()
    parts = [[split(r.text) for r in known if r[k]] for k in ("t", "b")]
    types = len({w for part in parts for text in part for w in text})
    losses = [model(part, types) for part in parts]
    want = sorted(((r.doc_id or -1), len(split(r.text)), *(f(split(r.text)) if split(r.text) else -1.0 for f in losses)) for r in known)
    got = E.cross_entropy_difference(docs, target, background="drawn").collect()
    found = sorted((r.id or -1, r.n_words, *(-1.0 if x is None else x for x in (r.loss_target, r.loss_background))) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a == pytest.approx(b)
    assert all((r.difference is None) == (r.n_words == 0) for r in got)


def test_target_like_texts_score_lower(spark):
    good, bad = "the cat sat on the mat and slept ", "buy now cheap pills online today "
    data = [(i, (good if i % 2 else bad) * (3 + i % 3), i % 4 == 1) for i in range(80)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, good boolean")
    got = {r.id: r.difference for r in E.cross_entropy_difference(docs, F.col("good")).collect()}
    assert max(got[i] for i in got if i % 2) < min(got[i] for i in got if i % 2 == 0)


def scaled_model(texts, types, scale):
    c, pairs = collections.Counter(), collections.Counter()
    for w in texts:
        c.update(w)
        pairs.update(zip(w, w[1:]))
    n = sum(c.values()) * scale

    def single(w):
        return (c[w] * scale + 1) / (n + types + 1)

    def loss(w):
        p = [single(x) if i == 0 else (pairs[w[i - 1], x] * scale + E.MU * single(x)) / (c[w[i - 1]] * scale + E.MU) for i, x in enumerate(w)]
        return -sum(map(math.log, p)) / len(w)

    return loss


def test_background_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", 900)
    monkeypatch.setattr(packed, "RANGE_BYTES", 4000)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    known = [(r.doc_id, split(r.text), r.source == "big") for r in docs.collect()]
    everything, target = [w for _, w, _ in known], [w for _, w, t in known if t]
    types = len({x for w in everything for x in w})
    scale = sum(map(len, target)) / sum(map(len, everything))
    losses = scaled_model(target, types, 1.0), scaled_model(everything, types, scale)
    want = sorted((i or -1, len(w), *(f(w) if w else -1.0 for f in losses)) for i, w, _ in known)
    got = E.cross_entropy_difference(docs, F.col("source") == "big", background="all").collect()
    found = sorted((r.id or -1, r.n_words, *(-1.0 if x is None else x for x in (r.loss_target, r.loss_background))) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a == pytest.approx(b)


def test_query_scores_equal_texts_alike(spark, tmp_path):
    from flowscope.llm import queries

    docs = [(i, f"text number {i % 40} of the corpus speaks of thing{i % 40} and {i % 8}") for i in range(280)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    marked = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("good", F.col("doc_id") == 0)
    want = {r.id: round(r.loss_background, 6) for r in E.cross_entropy_difference(marked, F.col("good"), background="all").collect()}
    got = {r.doc_id: r.loss_background for r in queries.op7_lm_scoring(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)
    docs_of = collections.defaultdict(set)
    for i, text in docs:
        docs_of[text].add(got[i])
    assert all(max(s) - min(s) < 2e-6 for s in docs_of.values())


def test_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert E.cross_entropy_difference(docs.limit(0), F.lit(True)).count() == 0
    assert E.cross_entropy_difference(docs, F.lit(False)).count() == len(rows())
