import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flowscope.functions.text import char_ngrams, percent_decode
from flowscope.operators import forest as R
from flowscope.operators import kernel as K
from flowscope.operators import learning as L
from flowscope.operators import tfidf as T


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["id=1&x=2", "id=2", "<script>alert(1)</script>", "<script>alert(2)", "name=bob", "id=1 id=1"]
    return spark.createDataFrame([(i, s, int("script" in s)) for i, s in enumerate(texts * 4)], "doc_id bigint, text string, label int")


def test_tfidf_formula(docs):
    rows = T.tfidf(docs, F.split("text", "[^a-z0-9]+")).collect()
    texts = {r.doc_id: [w for w in __import__("re").split("[^a-z0-9]+", r.text)] for r in docs.collect()}
    n = len(texts)
    df = {w: sum(w in t for t in texts.values()) for t in texts.values() for w in t}
    for key, words in texts.items():
        raw = {w: words.count(w) * (math.log((1 + n) / (1 + df[w])) + 1) for w in set(words)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        got = {r.term: r.weight for r in rows if r.doc_id == key}
        assert got == pytest.approx({w: v / norm for w, v in raw.items()})


def test_pipeline_agrees_with_long_form(docs):
    ready = docs.withColumn("grams", char_ngrams("text"))
    stages = L.tfidf_stages(ready, "grams", 1000, "features")
    out = ready
    for stage in stages:
        out = stage.transform(out)
    words = stages[0].vocabulary
    long = {(r.doc_id, r.term): r.weight for r in T.tfidf(docs, char_ngrams("text")).collect()}
    for r in out.select("doc_id", vector_to_array("features").alias("v")).collect():
        for w, v in zip(words, r.v):
            assert v == pytest.approx(long.get((r.doc_id, w), 0.0))


def test_term_clusters_and_collapse(docs):
    weights = T.tfidf(docs, char_ngrams("text"))
    clusters = T.term_clusters(weights, k=5)
    assert clusters.count() == weights.select("term").distinct().count()
    collapsed = T.collapse_terms(weights, clusters)
    total = weights.agg(F.sum("weight")).first()[0]
    assert collapsed.agg(F.sum("weight")).first()[0] == pytest.approx(total)
    assert T.cluster_vectors(collapsed, 5).count() == docs.count()


def plain_lloyd(points, start, rounds=20):
    """Labels and cost of Lloyd rounds in NumPy, from the given rows."""
    centres, labels = points[start], None
    for _ in range(rounds):
        distance = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
        if labels is not None and (distance.round(10).argmin(axis=1) == labels).all():
            break
        labels = distance.round(10).argmin(axis=1)
        centres = np.array([points[labels == c].mean(axis=0) if (labels == c).any() else np.full(points.shape[1], 1e9) for c in range(len(centres))])
    return labels, sum(((points[labels == c] - centres[c]) ** 2).sum() for c in range(len(centres)))


def test_term_clusters_cost_that_of_plain_lloyd(spark):
    rng = np.random.default_rng(4)
    group = rng.integers(0, 4, 120)
    points = np.where(rng.random((120, 30)) < 0.25, rng.random((120, 30)), 0.0) + (np.arange(30)[None, :] % 4 == group[:, None]) * 0.8
    points[rng.random((120, 30)) < 0.3] = 0.0
    rows = [(d, f"t{i:03d}", float(w)) for i, row in enumerate(points) for d, w in enumerate(row) if w > 0]
    weights = spark.createDataFrame(rows, "doc_id bigint, term string, weight double")
    seeds = T.profile_seeds(weights, 4, rounds=2)
    assert len(set(seeds)) == 4 and seeds == T.profile_seeds(weights.repartition(7), 4, rounds=2)
    got = {r.term: r.cluster for r in T.term_clusters(weights, seeds=seeds).collect()}
    labels, cost = plain_lloyd(points, [int(s[1:]) for s in seeds])
    assert [got[f"t{i:03d}"] for i in range(120)] == labels.tolist()
    centres, lengths = T.profile_centres(weights, spark.createDataFrame(list(got.items()), "term string, cluster int"), 4)
    found = T.nearest_profile(weights, centres, lengths).agg(F.sum("distance")).first()[0]
    assert found == pytest.approx(cost, rel=0.01)


def test_only_frequent_terms_are_copied_for_the_salts(docs, monkeypatch):
    want = {(r.doc_id, r.term): r.weight for r in T.tfidf(docs, char_ngrams("text")).collect()}
    copied = []
    salted = T.salted_join
    monkeypatch.setattr(T, "FREQUENT", 8)
    monkeypatch.setattr(T, "salted_join", lambda left, right, *rest: copied.append(right.count()) or salted(left, right, *rest))
    got = {(r.doc_id, r.term): r.weight for r in T.tfidf(docs, char_ngrams("text")).collect()}
    assert got == pytest.approx(want) and 0 < sum(copied) < len({term for _, term in want})


def test_a_profile_step_equals_centres_and_distances(spark, monkeypatch):
    monkeypatch.setattr("flowscope.operators.tfidf.HELD_SUMS", 20)
    rng = np.random.default_rng(3)
    cells = [(d, f"t{t}", float(rng.random())) for d in range(25) for t in rng.choice(30, 7, replace=False).tolist()]
    weights = spark.createDataFrame(cells, "doc_id bigint, term string, weight double")
    clusters = spark.createDataFrame([(f"t{t}", t % 4) for t in range(0, 24)], "term string, cluster int")
    centres, lengths = T.profile_centres(weights, clusters, 5)
    want = {r.term: (r.cluster, pytest.approx(r.distance, abs=1e-9)) for r in T.nearest_profile(weights, centres, lengths).collect()}
    assert {r.term: (r.cluster, r.distance) for r in T.profile_step(weights, clusters, 5).collect()} == want


def ring(spark, n=240):
    """Points on a small and on a large circle, as sparse rows."""
    rng = np.random.default_rng(1)
    out, points = [], {}
    for i in range(n):
        angle, label = rng.random() * 2 * math.pi, i % 2
        radius = (0.4, 1.6)[label] + 0.1 * rng.standard_normal()
        points[i] = (radius * math.cos(angle), radius * math.sin(angle))
        out += [(i, term, x, label) for term, x in zip("xy", points[i])]
    return spark.createDataFrame(out, "doc_id bigint, term string, weight double, label int"), points


def test_fourier_features_approximate_the_kernel_and_part_a_ring(spark):
    rows, points = ring(spark)
    labels = rows.select("doc_id", "label").distinct()
    waves = K.fourier_features(rows, "doc_id", "term", 0.7, 1024)
    z = {r.doc_id: np.array(r.fourier) for r in waves.collect()}
    rng = np.random.default_rng(2)
    error = []
    for _ in range(200):
        i, j = (int(x) for x in rng.integers(0, len(points), 2))
        exact = math.exp(-0.7 * sum((a - b) ** 2 for a, b in zip(points[i], points[j])))
        error.append(float(z[i] @ z[j]) - exact)
    assert np.sqrt(np.mean(np.square(error))) < 1.5 / math.sqrt(1024) and abs(np.mean(error)) < 0.02
    again = K.fourier_features(rows.repartition(5), "doc_id", "term", 0.7, 1024).collect()
    assert all(np.allclose(z[r.doc_id], r.fourier) for r in again)
    scores = []
    linear = rows.groupBy("doc_id").pivot("term", ["x", "y"]).agg(F.first("weight")).select("doc_id", array_to_vector(F.array("x", "y")).alias("features"))
    for table in (waves.select("doc_id", array_to_vector("fourier").alias("features")), linear):
        train, test = L.split(table.join(labels, "doc_id"), 0.3, "doc_id")
        scored = L.fit_vector_classifier(train, "svm").transform(test)
        scores.append(scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
    assert scores[0] > 0.95 and scores[1] < 0.75


def test_fourier_features_move_cells_and_not_arrays(spark, capsys):
    rng = np.random.default_rng(6)
    cells = [(i, f"{chr(97 + t % 26)}\u00e9{t}", float(rng.standard_normal())) for i in range(60) for t in rng.choice(400, 40, replace=False).tolist()]
    rows = spark.createDataFrame(cells + [(60, "a", 0.0)], "doc_id bigint, term string, weight double")
    sums = {r.doc_id: np.array(r.sums) for r in K.weighted_sums(rows.filter("weight <> 0"), K.gaussian_rows(rows, "term", 96, 5), "term", "doc_id").collect()}
    sums[60] = np.zeros(96)
    shift = spark.range(96).select(K._uniform(F.lit("shift"), F.col("id").cast("int"), F.lit(5)).alias("u")).orderBy("id").collect()
    waves = K.fourier_features(rows, "doc_id", "term", 0.3, 96, 5)
    got = {r.doc_id: r.fourier for r in waves.collect()}
    assert got.keys() == sums.keys()
    for i, s in sums.items():
        want = math.sqrt(2 / 96) * np.cos(math.sqrt(0.6) * s + 2 * math.pi * np.array([r.u for r in shift]))
        assert np.allclose(got[i], want, atol=1e-12)
    waves.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Join" not in plan and "cos(" not in plan


def test_classifier_features_leave_the_grams_behind(docs):
    ready = L.bigram_features(docs)
    fitted = L.fit_url_classifier(ready, "kernel", 500, places=16)
    assert "grams" not in fitted.features(ready).columns and fitted.features(ready).count() == docs.count()


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_grams_are_counted_within_each_text(spark, capsys, n):
    texts = ["", "a", "ab", "abc", "abab" * 500, "\U0001f600\U0001f600é\U0001f600\U0001f600é%41 \n\t", "Ünï%C3%A9+%zz" * 3, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ready = L.bigram_features(docs, n=n)
    plain = docs.withColumn("grams", char_ngrams(F.lower(percent_decode("text")), n))
    assert all(len(r.grams) == len({g.term for g in r.grams}) for r in ready.collect())
    counts = T.term_counts(ready, F.col("grams"))
    assert sorted(counts.collect()) == sorted(T.term_counts(plain, F.col("grams")).collect())
    counts.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_kernel_decision_of_any_rows(spark):
    rows, points = ring(spark, 30)
    support = [(0, "x", 0.5), (0, "y", -0.5), (1, "x", -1.0), (2, "z", 1.0)]
    got = K.kernel_decision(rows, spark.createDataFrame(support, "number int, term string, weight double"), [1.0, -2.0, 0.5], "doc_id", "term", 0.9, 0.1)
    for r in got.collect():
        x, y = points[r.doc_id]
        want = sum(a * math.exp(-0.9 * ((x - s[0]) ** 2 + (y - s[1]) ** 2 + s[2] ** 2)) for a, s in zip([1.0, -2.0, 0.5], [(0.5, -0.5, 0), (-1.0, 0, 0), (0, 0, 1.0)]))
        assert r.decision == pytest.approx(want + 0.1)


def test_numbered_terms_and_sparse_vectors(docs, spark):
    weights = T.tfidf(docs, char_ngrams("text"))
    vocab = T.numbered(weights.select("term").distinct()).collect()
    assert sorted(r.number for r in vocab) == list(range(len(vocab)))
    more = docs.unionByName(spark.createDataFrame([(99, "", 0)], docs.schema))
    got = T.sparse_vectors(more, weights, spark.createDataFrame(vocab), len(vocab)).collect()
    long = {(r.doc_id, r.term): r.weight for r in weights.collect()}
    names = {r.number: r.term for r in vocab}
    assert {(r.doc_id, names[int(i)]): v for r in got for i, v in zip(r.features.indices, r.features.values)} == pytest.approx(long)
    assert len(got) == docs.count() + 1 and all(r.features.size == len(vocab) for r in got)


def test_nodes_score_like_the_forest(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, rng.random(3)), int(rng.random() < 0.5)) for i in range(300)]
    table = spark.createDataFrame(rows + [(300, None, 0.5, float("nan"), 1)], "id bigint, a double, b double, c double, label int").na.fill(0.0)
    model = L.fit_webscan_forest(table, ["a", "b", "c"], trees=15)
    nodes = R.forest_nodes(model, str(tmp_path / "forest")).collect()
    assert len({r.tree for r in nodes}) == 15 and all((r.feature < 0) == (r.left < 0) for r in nodes)
    want = {r.id: (r.probability[1], r.prediction) for r in model.transform(table).collect()}
    got = R.score_with_nodes(table, nodes, ["a", "b", "c"]).collect()
    for r in got:
        assert r.votes == pytest.approx(want[r.id][0]) and r.web_scan == want[r.id][1]


@pytest.mark.parametrize("mode", ["all", "tfidf", "statistic"])
def test_attack_classifier(docs, mode):
    train = L.attack_text(docs, "text", whole=True)
    scored = L.fit_attack_classifier(train, mode, trees=10).transform(train)
    assert scored.filter("prediction = label").count() >= 0.8 * docs.count()


@pytest.mark.parametrize("kind", ["logistic", "svm", "kernel"])
def test_url_classifier(docs, kind):
    ready = L.bigram_features(docs)
    scored = L.fit_url_classifier(ready, kind, 500).transform(ready)
    assert scored.filter("prediction = label").count() == docs.count()


def test_split_is_stable(spark):
    df = spark.range(4000)
    train, test = L.split(df, 0.2, "id")
    assert test.count() / 4000 == pytest.approx(0.2, abs=0.03) and train.count() + test.count() == 4000
    assert sorted(L.split(df.repartition(5), 0.2, "id")[1].collect()) == sorted(test.collect())


def test_standardise_handles_constants(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (3.0, 4.0)], "a double, b double")
    rows = L.standardise(df, ["a", "b"]).orderBy("a").collect()
    assert [r.a_scaled for r in rows] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert {r.b_scaled for r in rows} == {0.0}


def test_evaluation(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0), (0.1, 0), (0.05, 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([p > n for p in pos for n in neg])
    assert L.roc_auc(df) == pytest.approx(auc)
    assert L.precision_at_outliers(df) == pytest.approx(0.5)
    assert L.percentile(df, "score", 90) == pytest.approx(np.percentile([s for s, _ in rows], 90))


def test_scores_per_key(spark, docs):
    model = L.fit_attack_classifier(L.attack_text(docs, "text", whole=True), "statistic", trees=5)
    flows = spark.createDataFrame(
        [(0, "a", "/?<script>alert(1)</script>"), (1, "a", "/?<script>alert(1)</script>"), (2, "a", "/?id=1"), (3, "b", "/")],
        "seq bigint, k string, params string",
    )
    scored = L.score_urls(flows, model, ["k"])
    assert scored.count() == 3
    stats = {r.k: r for r in L.malicious_statistics(scored, ["k"]).collect()}
    lists = {r.k: r for r in L.malicious_urls(scored, ["k"]).collect()}
    assert stats["a"].Sum_xss == sum(lists["a"].Malics_counts) if "a" in lists else stats["a"].Sum_xss == 0
    assert 0 <= stats["b"].Feq_xss <= 1
