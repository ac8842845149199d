"""Classifiers and their evaluation, as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IDF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.text import (
    attack_tokens,
    counted_ngrams,
    normalise_query,
    normalise_url,
    percent_decode,
    statistic_vector,
    word_ngrams,
)
from flowscope.operators import tfidf
from flowscope.operators.kernel import fourier_features
from flowscope.operators.scale import cut_lineage, kth_smallest, lists_by_key


def split(df: DataFrame, test_share: float, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Seeded train/test split by a hash of the key, the same under every partitioning."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return df.filter(draw >= test_share), df.filter(draw < test_share)


def standardise(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """Zero mean and unit population variance; constant columns become 0."""
    stats = df.agg(*[f(c).alias(f"{n}{c}") for c in columns for n, f in (("m_", F.avg), ("s_", F.stddev_pop))]).first()
    scaled = {}
    for c in columns:
        mean, deviation = stats[f"m_{c}"], stats[f"s_{c}"]
        scaled[c + suffix] = (F.col(c) - F.lit(mean)) / F.lit(deviation if deviation else 1.0)
    return df.withColumns(scaled)


def attack_text(urls: DataFrame, column: str = "params", whole: bool = False) -> DataFrame:
    """Add the inputs of the attack model: tokens and statistics of the normalised URL or of its query."""
    text = (normalise_url if whole else normalise_query)(column)
    return urls.withColumn("_text", text).withColumns(
        {"tokens": word_ngrams(attack_tokens("_text")), "statistics": array_to_vector(statistic_vector("_text"))}
    ).drop("_text")


def tfidf_stages(train: DataFrame, tokens: str, vocab_size: int, out: str = "tfidf") -> list:
    """Fitted stages: term counts, weights tf * (ln((1+n)/(1+df)) + 1) and L2 norm.

    The vocabulary has the ``vocab_size`` most frequent terms, ties by the term, and is held by the model.
    """
    totals = train.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term")
    terms = [r["term"] for r in totals.limit(vocab_size).select("term").collect()]
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens, outputCol="_tf")
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(train)).idf
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([x + 1.0 for x in idf.toArray()]), inputCol="_tf", outputCol="_weighted"
    )
    return [counter, scale, Normalizer(p=2.0, inputCol="_weighted", outputCol=out)]


def fit_attack_classifier(
    train: DataFrame, mode: str = "tfidf", vocab_size: int = 50, trees: int = 50, label: str = "label", seed: int = 42
) -> PipelineModel:
    """Random forest over token TF-IDF (``tfidf``), string statistics (``statistic``) or both (``all``).

    ``train`` comes from :func:`attack_text` and holds a 0/1 label.
    """
    inputs = {"tfidf": ["tfidf"], "statistic": ["statistics"], "all": ["tfidf", "statistics"]}[mode]
    stages = tfidf_stages(train, "tokens", vocab_size) if "tfidf" in inputs else []
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    ready = PipelineModel(stages=stages).transform(train)
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed).fit(ready)
    return PipelineModel(stages=[*stages, forest])


def score_urls(flows: DataFrame, model: PipelineModel, keys: Sequence[str]) -> DataFrame:
    """``(keys, params, n, prediction)``: every distinct URL of a key is scored once."""
    urls = flows.groupBy(*keys, "params").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    return model.transform(attack_text(urls)).select(*keys, "params", "seq", "n", F.col("prediction").cast("int"))


def score_urls_by(flows: DataFrame, rule: Column, keys: Sequence[str]) -> DataFrame:
    """As :func:`score_urls`, but with a fixed rule over the URL instead of a fitted model."""
    urls = flows.groupBy(*keys, "params").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
    return urls.select(*keys, "params", "seq", "n", rule.cast("int").alias("prediction"))


def malicious_statistics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``Sum_xss`` and ``Feq_xss`` per key from scored distinct URLs."""
    bad = F.sum(F.when(F.col("prediction") != 0, F.col("n")).otherwise(F.lit(0)))
    return scored.groupBy(*keys).agg(bad.alias("Sum_xss"), (bad / F.sum("n")).alias("Feq_xss"))


def malicious_urls(scored: DataFrame, keys: Sequence[str], list_rows: int = 100_000) -> DataFrame:
    """The distinct malicious URLs per key and how often each occurs, in parts of bounded length."""
    values = {"Malics_urls": "params", "Malics_counts": "n"}
    return lists_by_key(scored.filter("prediction <> 0"), keys, "seq", values, list_rows)


def bigram_features(texts: DataFrame, column: str = "text", n: int = 2) -> DataFrame:
    """Character n-grams of the decoded, lower-cased text and their counts, as the vectoriser of the URL classifiers sees it.

    ``grams`` holds each distinct n-gram once: the list of all of them is many times as large as the text.
    """
    return texts.withColumn("grams", counted_ngrams(F.lower(percent_decode(column)), n))


class TermClassifier:
    """A classifier over the TF-IDF weights of the array column ``grams``, counted or not; its vocabulary is a stored table."""

    def __init__(self, vocab: DataFrame, size: int, key: str, kernel: tuple[float, int, int] | None):
        self.vocab, self.size, self.key, self.kernel, self.model = vocab, size, key, kernel, None

    def features(self, texts: DataFrame, counts: DataFrame | None = None) -> DataFrame:
        """The rows with ``features``: sparse weights of the numbered terms, or random Fourier features of them.

        ``grams`` is only counted, unless ``counts`` are given; it is not carried through the joins and not in the result.
        """
        vocab = self.vocab.select("term", "idf")
        if counts is None:
            weights = tfidf.tfidf(texts, F.col("grams"), vocab=vocab, key=self.key)
        else:
            weights = tfidf.weighted_counts(counts, vocab, self.key)
        texts = texts.drop("grams")
        if self.kernel is None:
            return tfidf.sparse_vectors(texts, weights, self.vocab, self.size, self.key)
        gamma, places, seed = self.kernel
        waves = fourier_features(weights, self.key, "term", gamma, places, seed)
        nothing = F.array_repeat(F.lit(0.0), places)
        return texts.join(waves, self.key, "left").withColumn("features", array_to_vector(F.coalesce("fourier", nothing))).drop("fourier")

    def transform(self, texts: DataFrame) -> DataFrame:
        return self.model.transform(self.features(texts))


def fit_url_classifier(
    train: DataFrame, kind: str = "logistic", vocab_size: int | None = None, label: str = "label", key: str = "doc_id", gamma: float = 1.0,
    places: int = 512, seed: int = 42,
) -> TermClassifier:
    """Logistic regression, linear SVM (``svm``) or SVM with an RBF kernel (``kernel``) over character-bigram TF-IDF.

    ``key`` is unique. All bigrams are used unless ``vocab_size`` is given; they are numbered in a table. The kernel
    ``exp(-gamma * |x - y|^2)`` is approximated by ``places`` random Fourier features.
    """
    counts = cut_lineage(tfidf.term_counts(train, F.col("grams"), key), "term-counts")
    vocab = cut_lineage(tfidf.numbered(cut_lineage(tfidf.vocabulary(counts, train.count(), vocab_size), "idf")), "vocabulary")
    fitted = TermClassifier(vocab, vocab.count(), key, (gamma, places, seed) if kind == "kernel" else None)
    ready = cut_lineage(fitted.features(train.select(key, label), counts), "features")
    fitted.model = fit_vector_classifier(ready, "logistic" if kind == "logistic" else "svm", label)
    return fitted


def fit_vector_classifier(train: DataFrame, kind: str = "logistic", label: str = "label"):
    """The same classifiers over ready feature vectors, such as cluster-collapsed TF-IDF."""
    learner = LogisticRegression(labelCol=label, maxIter=50) if kind == "logistic" else LinearSVC(labelCol=label, maxIter=50)
    return learner.fit(train)


def fit_webscan_forest(table: DataFrame, columns: Sequence[str], trees: int = 100, label: str = "label", seed: int = 42):
    """Random forest of the web-scan detector: square-root feature choice and bootstrap samples."""
    assemble = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(
        labelCol=label, numTrees=trees, featureSubsetStrategy="sqrt", bootstrap=True, seed=seed
    )
    return Pipeline(stages=[assemble, forest]).fit(table.na.fill(0.0, list(columns)))


def score_webscan(table: DataFrame, model: PipelineModel, columns: Sequence[str]) -> DataFrame:
    """Add ``web_scan`` to a feature table in one pass."""
    scored = model.transform(table.na.fill(0.0, list(columns)))
    return scored.withColumn("web_scan", F.col("prediction").cast("int")).select(*table.columns, "web_scan")


def domain_kmeans(table: DataFrame, k: int = 2, seed: int = 42, limit: float = 10.0) -> DataFrame:
    """k-means of domain rows with ``Similar_host`` below the limit, on standardised columns."""
    columns = ["Flows", "Urls", "Similar_host"]
    scaled = standardise(table.filter(F.col("Similar_host") < limit), columns)
    points = scaled.withColumn("features", F.array(*[F.col(f"{c}_scaled") for c in columns]))
    model = KMeans(k=k, seed=seed).fit(points.withColumn("features", array_to_vector("features")))
    return nearest_centre(points, [list(map(float, c)) for c in model.clusterCenters()]).drop("features")


def nearest_centre(points: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``cluster``, the number of the centre nearest to the array ``features``; the first of equally near ones."""
    squares = F.array(*[
        F.aggregate(F.zip_with("features", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        for c in centres
    ])
    return points.withColumn("_d", squares).withColumn("cluster", F.array_position("_d", F.array_min("_d")).cast("int") - 1).drop("_d")


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    ready = scored.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    return BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(ready)


def percentile(df: DataFrame, column: str, percent: float) -> float:
    """Exact percentile with linear interpolation between the two neighbouring ranks."""
    n = df.filter(F.col(column).isNotNull()).count()
    position = (n - 1) * percent / 100.0
    low = kth_smallest(df, column, int(position))
    share = position - int(position)
    if share == 0.0:
        return low
    return low + share * (kth_smallest(df, column, int(position) + 1) - low)


def precision_at_outliers(scored: DataFrame, score: str = "score", label: str = "label") -> float:
    """Precision of as many top scores as there are outliers: scores above the percentile of the inlier share."""
    n, outliers = scored.agg(F.count(F.lit(1)), F.sum(label)).first()
    threshold = percentile(scored, score, 100.0 * (1.0 - outliers / n))
    return scored.filter(F.col(score) > threshold).agg(F.avg(F.col(label).cast("double"))).first()[0]


