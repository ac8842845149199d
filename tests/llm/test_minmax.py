import random
import re

import numpy as np
import pytest

from flowscope.llm import minmax as M
from flowscope.llm import queries as Q

from .texts import SCHEMA, rows, words


def shingles(text, size=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(data):
    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    out = []
    for i, r in enumerate(data):
        name = r[0] if not sets[i] else low.get(find(i))
        out.append((r[0], len(sets[i]), name, r[0] == name))
    return sorted(out, key=str)


def crowd(seed=2):
    """Near copies of a few texts at many distances, chains, and texts that share a passage only."""
    rng = random.Random(seed)
    data = list(rows())
    passage = words(rng, 60, 3000)
    n = 1000
    for _ in range(3):
        base = words(rng, 90, 3000).split()
        for k in range(40):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(9999)}"
            data.append((n, " ".join(w), "en", "s", 1, "x", 1))
            n += 1
        chain = list(base)
        for k in range(25):
            chain = [*chain[2:], f"more{n}", "end"]
            data.append((n, " ".join(chain), "en", "s", 1, "x", 1))
            n += 1
    for _ in range(40):
        data.append((n, words(rng, 15, 3000) + " " + passage + " " + words(rng, 12, 3000), "en", "s", 1, "x", 1))
        n += 1
    data += [(5000, "one two three", None, None, 1, "x", 1), (5001, "One  TWO\tthree", None, None, 1, "x", 1), (5002, "one two", None, None, 1, "x", 1)]
    return data


@pytest.mark.parametrize("options", [{}, {"stars": 0, "tile": 8, "sketch": 64}])
def test_components_equal_brute_force(spark, options):
    data = crowd()
    got = [tuple(r) for r in M.near_duplicates(spark.createDataFrame(data, SCHEMA), **options).collect()]
    assert sorted(got, key=str) == brute(data)


def test_clashing_ids_and_null_ids(spark):
    rng = random.Random(9)
    a, b = words(rng, 50, 3000), words(rng, 50, 3000)
    data = [(1, a, *[None] * 5), (1, b, *[None] * 5), (2, b, *[None] * 5), (None, a, *[None] * 5), (None, a + " x", *[None] * 5), (None, "alone here", *[None] * 5)]
    got = sorted((tuple(r) for r in M.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()), key=str)
    assert got == brute(data)


def test_query_kept_documents_and_empty_table(spark, tmp_path):
    data = [r for r in crowd(3) if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    frame = spark.createDataFrame(data, SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op13_minmax_near_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(data)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = M.one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if r[3])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert Q.op13_minmax_near_dedup(spark, f"{tmp_path}/none").collect() == []


def test_signatures_are_unbiased_and_vary_less():
    rng = np.random.default_rng(3)
    shared, one, two = rng.integers(0, 1 << 63, (3, 400), np.uint64)
    a, b = np.concatenate([shared, one[:100]]), np.concatenate([shared, two[:100]])
    agree = [(M._min_max([a, b], seed)[0] == M._min_max([a, b], seed)[1]).mean() for seed in range(60)]
    assert abs(np.mean(agree) - 400 / 600) < 0.015
    assert np.var(agree) <= 1.3 * (2 / 3 * 1 / 3) / (M.BANDS * M.ROWS)
