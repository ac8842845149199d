import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from flowscope.llm import grades as G

from .texts import SCHEMA, rows


@pytest.fixture(scope="module")
def rated(spark):
    """Texts whose words tell their grade, most of the time."""
    rng = random.Random(2)
    marks = {0: ["awful", "nasty"], 1: ["plain", "dull"], 2: ["fine", "clear"], 3: ["superb", "elegant"]}
    docs, ratings = [], []
    for i in range(1200):
        g = rng.randrange(4)
        w = [f"w{rng.randrange(200)}" for _ in range(30)] + [rng.choice(marks[g if rng.random() < 0.95 else rng.randrange(4)]) for _ in range(2)]
        rng.shuffle(w)
        docs.append((i, " ".join(w)))
        ratings.append((i, g))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(ratings, "doc_id bigint, grade int"), dict(ratings)


def test_held_out_grades(rated):
    docs, ratings, truth = rated
    model = G.train(docs, ratings.filter("doc_id < 900"), 4)
    assert (np.diff(model.thresholds) > 0).all()
    got = [r for r in G.graded(docs, model, tail=2).collect() if r.id >= 900]
    near = np.mean([abs(r.expected_grade - truth[r.id]) for r in got])
    right = np.mean([r.selected == (truth[r.id] >= 2) for r in got])
    assert near < 0.5 and right > 0.9
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 3 for r in got)


def plain_fit(grades, places, shares, k, epochs, batch, rate=0.15, decay=2e-4, seed=5):
    """The same AdaGrad steps, one document and one weight at a time."""
    rng = np.random.default_rng(seed)
    texts = Counter(p for doc in places for p in doc)
    places = [[p for p in doc if texts[p] >= G.MIN_TEXTS] for doc in places]
    n = len(grades)
    odds = []
    for j in range(k - 1):
        share = sum(g <= j for g in grades) / n
        odds.append(math.log(min(max(share, 0.01), 0.99) / min(max(1 - share, 0.01), 0.99)))
    base, gaps = odds[0], [math.log(max(b - a, 0.05)) for a, b in itertools.pairwise(odds)]
    w, v = Counter(), [0.0] * G.SHARES
    sw, sv, sb, sg = Counter(), [1e-2] * G.SHARES, 1e-2, [1e-2] * len(gaps)

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    for _ in range(epochs):
        order = rng.permutation(n)
        for low in range(0, n, batch):
            chosen = [int(i) for i in order[low : low + batch]]
            t = [base + sum(math.exp(x) for x in gaps[:j]) for j in range(k - 1)]
            gw, gv, gt = Counter(), [decay * x for x in v], [0.0] * (k - 1)
            for i in chosen:
                score, y = sum(w[p] for p in places[i]) + sum(a * b for a, b in zip(shares[i], v)), grades[i]
                up = sigmoid(t[y] - score) if y < k - 1 else 1.0
                down = sigmoid(t[y - 1] - score) if y else 0.0
                chance = max(up - down, 1e-12)
                du, dl = up * (1 - up) / chance, down * (1 - down) / chance
                for p in places[i]:
                    gw[p] += (du - dl) / len(chosen)
                gv = [g + (du - dl) / len(chosen) * x for g, x in zip(gv, shares[i])]
                if y < k - 1:
                    gt[y] -= du / len(chosen)
                if y:
                    gt[y - 1] += dl / len(chosen)
            for p in {p for i in chosen for p in places[i]}:
                g = gw[p] + decay * w[p]
                sw[p] += g * g
                w[p] -= rate * g / math.sqrt(sw[p] + 1e-2)
            for j, g in enumerate(gv):
                sv[j] += g * g
                v[j] -= rate * g / math.sqrt(sv[j])
            sb += sum(gt) ** 2
            base -= rate * sum(gt) / math.sqrt(sb)
            steps = [sum(gt[j + 1 :]) * math.exp(gaps[j]) for j in range(len(gaps))]
            for j, g in enumerate(steps):
                sg[j] += g * g
                gaps[j] -= rate * g / math.sqrt(sg[j])
    return w, v, [base + sum(math.exp(x) for x in gaps[:j]) for j in range(k - 1)]


def test_fit_and_scores_equal_plain_loops(spark):
    rng = random.Random(6)
    data = [(i, " ".join(f"w{rng.randrange(25) + 15 * (i % 4)}" for _ in range(12 + i % 5)) + "!" * (i % 3)) for i in range(90)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, i % 4) for i, _ in data], "doc_id bigint, grade int")
    held = G.rated_features(docs, ratings, "doc_id", "text", "grade", 1000).toArrow().sort_by([("hash", "ascending"), ("id", "ascending")])
    grades, places, shares = (held.column(c).to_pylist() for c in ("grade", "places", "shares"))
    model = G.fit(np.array(grades), [np.array(p, np.int64) for p in places], np.array(shares), 4, epochs=4, batch=16)
    w, v, t = plain_fit(grades, places, shares, 4, 4, 16)
    assert model.thresholds == pytest.approx(t, abs=1e-6) and model.shares == pytest.approx(v, abs=1e-6)
    assert [model.words[p] for p in sorted(w)] == pytest.approx([w[p] for p in sorted(w)], abs=1e-6)
    assert np.count_nonzero(model.words) <= len(w)
    got = {r.id: r for r in G.graded(docs, model, tail=2).collect()}
    for i, own, share in zip(held.column("id").to_pylist(), places, shares):
        score = sum(float(model.words[p]) for p in own) + sum(a * b for a, b in zip(share, model.shares))
        above = [1 / (1 + math.exp(x - score)) for x in model.thresholds]
        assert got[i].expected_grade == pytest.approx(sum(above), abs=1e-6)
        assert got[i].tail_probability == pytest.approx(above[1], abs=1e-6) and got[i].selected == (above[1] >= 0.5)


def test_sample_of_repeated_ids_is_defined(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i % 50} of {i % 5}") for i in range(500)], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i % 5, i % 3) for i in range(15)] * 2, "doc_id bigint, grade int")
    draws = [
        sorted((r.id, r.hash, r.grade) for r in G.rated_features(docs.repartition(n), ratings.repartition(n), "doc_id", "text", "grade", 7).collect())
        for n in (2, 5)
    ]
    assert draws[0] == draws[1] and len(draws[0]) == len(set(draws[0])) == 7


def test_sample_is_bounded_and_stable(rated):
    docs, ratings, _ = rated
    a = G.rated_features(docs, ratings, "doc_id", "text", "grade", 100).select("id").collect()
    b = G.rated_features(docs.repartition(7), ratings.repartition(3), "doc_id", "text", "grade", 100).select("id").collect()
    assert len(a) == 100 and {r.id for r in a} == {r.id for r in b}


def test_awkward_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    ratings = spark.createDataFrame([(0, 2), (0, 2), (1, None), (None, 1), (13, 0), (4, 1)], "doc_id bigint, grade int")
    model = G.train(docs, ratings, 3)
    got = G.graded(docs, model, tail=2).collect()
    assert len(got) == len(rows()) and all(r.expected_grade is not None and r.selected is not None for r in got)
    assert len({(r.expected_grade, r.tail_probability) for r in got if r.id in (0, 8, 9)}) == 1
    assert G.graded(docs.limit(0), model, tail=1).count() == 0
    empty = G.train(docs, ratings.limit(0), 3)
    assert G.graded(docs, empty, tail=1).count() == len(rows())
