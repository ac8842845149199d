import random
import re

import pytest

from flowscope.llm import phrases as P

from .texts import SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(4)
    items = [" ".join(f"t{rng.randrange(60)}" for _ in range(n)) for n in (25, 14, 10, 6, 1)] + ["", None]
    items += [items[1], "common common common common", "néver seen before in any text"]
    docs = []
    for i in range(60):
        w = [rng.choice(["common", f"t{rng.randrange(60)}", "é中"]) for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            t = split(items[i % 5])
            at = rng.randrange(max(1, len(t) - 5))
            w[5:5] = t[at : at + rng.randrange(4, 25)]
        docs.append((i, rng.choice([" ", "-", " \n"]).join(w).title(), "en", "s", 1, "x", 2))
    docs += [docs[0], docs[0], (None, docs[3][1], None, None, None, None, None), (None, None, None, None, None, None, None),
             (90, "", "", "", 0, "", 0), (91, None, "", "", 0, "", 0), (0, "common common common common common", "", "", 0, "", 0)]
    return docs, [(i, t) for i, t in enumerate(items)] + [(None, items[2])]


def brute_force(text, items, window):
    w = split(text)
    hit, held = set(), set()
    for item, t in items:
        t = split(t)
        for k in range(max(1, len(t) - window + 1) if t else 0):
            part = t[k : k + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    held.add(str(item))
    return len(w), len(hit), held


@pytest.mark.parametrize("window,lists", [(10, 3), (4, 2), (3, 1)])
def test_against_brute_force(spark, window, lists):
    docs, items = corpus()
    known = [x for x in items if x[0] is not None]
    d, b = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(items, "item_id bigint, text string")
    got = P.contamination(d, b.filter("item_id is not null"), window=window, lists=lists, carry=["doc_id", "text", "n_words"]).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, held = brute_force(r.text, known, window)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, sorted(held)), r
    assert any(r.n_hit for r in got)
    clean = P.without_test_passages(d, b, window=window, lists=lists)
    assert clean.columns == d.columns
    want = sorted(str(x) for x in docs if not brute_force(x[1], items, window)[1])
    assert sorted(str(tuple(r)) for r in clean.collect()) == want


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(P, "checked_broadcast", lambda df, rows, limit=0: df)
    test_against_brute_force(spark, 4, 2)


def test_matches_and_places(spark):
    d = spark.createDataFrame([(1, "x a b c y a b c"), (2, "a c b")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "a b c")], "item_id bigint, text string")
    got = P.PhraseIndex(d, b, window=10).matches().select("key.id", "start", "size", "phrase").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3, "a b c"), (1, 5, 3, "a b c")]


def test_proximity(spark):
    rng = random.Random(9)
    words = [f"t{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words + ["of"] * 8) for _ in range(80))) for i in range(30)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, "t1 t2 t3"), (2, "t4 of t5")], "item_id bigint, text string")
    index = P.PhraseIndex(d, b, lists=3)
    counts = {r.term: r.n for r in index.counts.collect()}
    got = {(r.key.id, r["item"], r.position) for r in index.near(within=4).collect()}
    want = set()
    for i, text in docs:
        w = text.split()
        for item, terms in (("1", ["t1", "t2", "t3"]), ("2", ["t4", "of", "t5"])):
            rare = sorted(terms, key=lambda t: (counts[t], t))
            for p in (k for k, x in enumerate(w) if x == rare[0]):
                if all(any(x == t and abs(k - p) <= 4 for k, x in enumerate(w)) for t in rare[1:]):
                    want.add((i, item, p))
    assert got == want and got


def test_empty_tables(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")
    assert P.contamination(d.limit(0), b).count() == 0
    assert P.contamination(d, b.limit(0)).filter("n_hit > 0").count() == 0
    assert P.without_test_passages(d, b.limit(0)).count() == len(docs)
