import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from flowscope.llm import simhash as S

from .texts import SCHEMA, rows


def fingerprint(text, size=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    k = min(size, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(fps, max_bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints(spark):
    data = rows()
    got = S.fingerprints(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted((r.id or -1, r.fp) for r in got) == sorted((r[0] or -1, signed(fingerprint(r[1]))) for r in data)


def crowd(seed=1):
    """Fingerprints around a few centres, up to four bits away, and strangers."""
    rng = random.Random(seed)
    out = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            f = centre
            for b in rng.sample(range(64), rng.randrange(5)):
                f ^= 1 << b
            out.add(f)
    return sorted(out | {rng.getrandbits(64) for _ in range(200)})


@pytest.mark.parametrize("max_bits,tile", [(3, 4096), (3, 16), (1, 4096), (0, 4096), (2, 4096), (5, 4096)])
def test_links_join_what_all_pairs_join(spark, max_bits, tile):
    fps = crowd()
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint").repartition(3)
    links = [(r.u, r.v) for r in S.near_links(df, max_bits, tile).collect()]
    root = {signed(f): signed(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= max_bits
        root[find(u)] = find(v)
    want = components(fps, max_bits)
    groups, mine = {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(signed(f))
        mine.setdefault(find(signed(f)), set()).add(signed(f))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates_against_brute_force(spark):
    data = rows()
    got = S.near_duplicates(spark.createDataFrame(data, SCHEMA)).select("id", S.hex_digits("fp").alias("hex"), "component_id").collect()
    fps = {fingerprint(r[1]) for r in data}
    comp = components(sorted(fps), 3)
    low = {}
    for r in data:
        if r[0] is not None:
            c = comp[fingerprint(r[1])]
            low[c] = min(low.get(c, r[0]), r[0])
    want = [(r[0], f"{fingerprint(r[1]):016x}", low.get(comp[fingerprint(r[1])])) for r in data]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_one_of_each(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = S.near_duplicates(docs).filter("id is not null").select("component_id").distinct().count()
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) == named
    assert ids.count(None) == 1
    assert 0 in ids and 8 not in ids and 9 not in ids


def test_one_of_each_with_clashing_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(4))
    data = [(1, a), (1, b), (2, b), (3, c), (3, c), (3, d), (4, a), (5, c), (2, d)]
    docs = spark.createDataFrame([(*r, None, None, None, "x", 1) for r in data], SCHEMA)
    kept = sorted((r.doc_id, r.text) for r in S.one_of_each(docs).collect())
    assert kept == sorted([(1, a), (1, b), (3, c), (2, d)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(docs).count() == 0
    assert S.one_of_each(docs).count() == 0


def test_home_is_a_codeword_and_copies_are_bounded(spark):
    df = spark.createDataFrame([(signed(f),) for f in crowd()], "fp bigint")
    per = S.anchors(df, 3).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    assert per.agg(F.max("n")).first()[0] <= 32
    assert S.block_length(2) == 31 and S.block_length(1) == 63 and S.block_length(3) == 15


def test_tables_of_an_earlier_stage_are_given_back():
    from flowscope.llm.words import release_tables, worker_store

    worker_store()["encoder", "some"] = [0] * 1000
    release_tables()
    assert ("encoder", "some") not in worker_store()
