"""Detection runs: train, score and list."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.operators import learning as L
from flowscope.operators.clean import clean_webscan
from flowscope.operators.scale import cut_lineage
from flowscope.operators.sequence import chunks
from flowscope.plans.webscan import (
    MODEL_COLUMNS,
    training_features,
    webscan_features,
    webscan_features_with_urls,
)

PAIR = ["src_ip", "dest_ip"]


def url_attack_model(urls: DataFrame, mode: str = "tfidf", column: str = "params", seed: int = 42) -> PipelineModel:
    """The URL attack classifier from distinct URLs with a 0/1 ``label``; each is trained on once."""
    return L.fit_attack_classifier(L.attack_text(urls, column), mode, seed=seed)


def malicious_by(flows: DataFrame, model: PipelineModel, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(statistics, lists)`` of the malicious GET requests per key."""
    scored = L.score_urls(flows.filter("method = 'GET'"), model, keys)
    return L.malicious_statistics(scored, keys), L.malicious_urls(scored, keys)


def malicious_by_rule(flows: DataFrame, rule: Column, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """As :func:`malicious_by`, with a fixed rule over the URL column ``params``."""
    scored = L.score_urls_by(flows.filter("method = 'GET'"), rule, keys)
    return L.malicious_statistics(scored, keys), L.malicious_urls(scored, keys)


def labelled_behaviour(scan: DataFrame, normal: DataFrame, model: PipelineModel, burst_seconds: int = 1) -> DataFrame:
    """Training rows of the web-scan forest: chunks of a scan log with label 1, pairs of a normal log with label 0."""
    scan, normal = clean_webscan(scan), clean_webscan(normal, drop_single=False)
    per_chunk, _ = malicious_by(chunks(scan), model, ["chunk"])
    per_pair, _ = malicious_by(normal, model, PAIR)
    ones = training_features(scan, per_chunk, seconds=burst_seconds)
    zeros = webscan_features(normal, malicious=per_pair, methods=["GET"], burst_seconds=burst_seconds)
    columns = ["Sum_sec_flow", "Feq_sec_flow", "Sum_xss", "Feq_xss", "Sum_dir", "Feq_dir", "Sum_404_error",
               "Feq_404_error", "H_status"]
    return ones.select(*columns, F.lit(1).alias("label")).unionByName(zeros.select(*columns, F.lit(0).alias("label")))


def holdout_accuracy(rows: DataFrame, columns, share: float = 0.4, seed: int = 42) -> DataFrame:
    """``(n_test, accuracy)`` of a forest fitted on the other rows; the split goes by a hash of the whole row.

    Equal rows fall on the same side, so that none is tested which was trained on.
    """
    keyed = rows.withColumn("_row", F.xxhash64(*[F.col(c) for c in rows.columns]))
    train, test = L.split(keyed, share, "_row", seed)
    scored = L.score_webscan(test, L.fit_webscan_forest(train, columns), columns)
    hit = (F.col("web_scan") == F.col("label")).cast("double")
    return scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("accuracy"))


def detect_webscans(flows: DataFrame, url_model: PipelineModel, forest: PipelineModel, owner: DataFrame | None = None,
                    burst_seconds: int = 1) -> DataFrame:
    """Clean, build features, score: the web-scan table with ``web_scan`` and every malicious URL, most suspicious first."""
    cleaned = clean_webscan(flows, drop_single=False)
    malicious, urls = malicious_by(cleaned, url_model, PAIR)
    table = webscan_features(cleaned, owner, malicious, burst_seconds=burst_seconds)
    return scored_with_urls(L.score_webscan(table, forest, MODEL_COLUMNS), cut_lineage(urls, "urls"))


def scored_with_urls(scored: DataFrame, urls: DataFrame) -> DataFrame:
    """The scored table with every part of the URL lists, keyed by ``part``; ``web_scan`` stands on each part."""
    table = scored.withColumn("_xss", F.col("Sum_xss"))
    whole = webscan_features_with_urls(table, urls, each=("is_cloud", "web_scan", "_xss"))
    return whole.orderBy(F.desc("web_scan"), F.desc("_xss"), *PAIR, "part").drop("_xss")
