"""Behaviour features per (source, destination) for web-scan detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions.net import differs, time_bucket
from flowscope.functions.text import has_traversal
from flowscope.operators.aggregate import (
    _methods,
    burst_statistics,
    entropy_of,
    in_facet,
    known_in,
    numeric_size,
    plain_error_rate,
    status_statistics,
    traversal_statistics,
)
from flowscope.operators.lookup import mark_owned
from flowscope.operators.scale import cut_lineage, salted_join
from flowscope.operators.sequence import chunks, similar_neighbours

# The columns of the web-scan feature table.
WEBSCAN_COLUMNS = (
    "Sum_flow", "Sum_sec_flow", "Feq_sec_flow", "Sum_xss", "Feq_xss", "Sum_dir", "Feq_dir", "Sum_404_error",
    "Feq_404_error", "H_status", "Cls_url", "Sum_packets", "Mean_packets", "src_ip", "dest_ip", "Malics_urls",
)

# The six columns the web-scan forest looks at.
MODEL_COLUMNS = ("Sum_sec_flow", "Feq_sec_flow", "Feq_xss", "Feq_dir", "Feq_404_error", "H_status")


def facet_counts(flows: DataFrame, burst_seconds: int, methods: Sequence[str] | None = None) -> DataFrame:
    """One scan of the log: rows ``(src_ip, dest_ip, facet, value, n, used, bytes, sized)`` for status, time and URL.

    Flows are combined before the shuffle, so a hot pair arrives as its distinct values. ``used`` counts the flows of
    the wanted methods, ``bytes`` and ``sized`` sum up the numeric sizes; they are told for URLs only.
    """
    facets = F.array(*[
        F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value"))
        for name, value in (("status", F.col("status")), ("time", time_bucket("timestamp", burst_seconds)), ("url", F.col("params")))
    ])
    rows = flows.select("src_ip", "dest_ip", _methods(methods).alias("_used"), numeric_size().alias("_size"), F.explode(facets).alias("_f"))
    url = F.col("_f.facet") == "url"
    return rows.groupBy("src_ip", "dest_ip", "_f.facet", "_f.value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(url & F.col("_used")).alias("used"),
        F.sum(F.when(url, F.col("_size"))).alias("bytes"), F.count(F.when(url, F.col("_size"))).alias("sized"))


def pair_profile(counts: DataFrame) -> DataFrame:
    """Flows, bursts and statuses of each pair."""
    status = in_facet("status")
    known = status & differs("value", "-")
    total = F.sum(F.when(status, F.col("n")))
    resolved = F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))
    errors = F.coalesce(F.sum(F.when(status & (F.col("value") == "404"), F.col("n"))), F.lit(0))
    shared = F.sum(F.when(known_in("time") & (F.col("n") > 1), F.col("n")).otherwise(F.lit(0)))

    def defined(value):
        return F.when(resolved > 0, value).otherwise(F.lit(-1.0))

    return counts.groupBy("src_ip", "dest_ip").agg(
        total.alias("Sum_flow"),
        F.when(total == 1, F.lit(1)).otherwise(shared).cast("bigint").alias("Sum_sec_flow"),
        F.when(total == 1, F.lit(1.0)).otherwise(shared / total).alias("Feq_sec_flow"),
        defined(errors * total / resolved).alias("Sum_404_error"),
        defined(errors / resolved).alias("Feq_404_error"),
        defined(entropy_of("n", known)).alias("H_status"),
    )


def url_profile(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct URLs, traversal and size statistics per key; patterns are matched once per distinct URL."""
    sums = [F.sum(c).alias(c) for c in ("n", "used", "bytes", "sized")]
    urls = counts.filter(in_facet("url")).groupBy(*keys, "value").agg(*sums)
    hits = F.sum(F.when(has_traversal("value"), F.col("used")).otherwise(F.lit(0)))
    total = F.sum("used")
    return urls.groupBy(*keys).agg(
        F.sum("n").alias("_flows"),
        F.count("value").alias("Cls_url"),
        hits.alias("Sum_dir"),
        F.when(total > 0, hits / total).otherwise(F.lit(0.0)).alias("Feq_dir"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("Sum_packets"),
        F.when(F.sum("sized") > 0, F.sum("bytes") / F.sum("sized")).otherwise(F.lit(-1.0)).alias("Mean_packets"),
    )


def webscan_features(
    flows: DataFrame,
    owner: DataFrame | None = None,
    malicious: DataFrame | None = None,
    scope: str = "source",
    methods: Sequence[str] | None = None,
    burst_seconds: int = 1,
    min_source_flows: int = 2,
) -> DataFrame:
    """The 16-column table, one row per (source, destination) of cleaned flows, plus ``is_cloud``.

    ``flows`` need not be freed of single-flow sources: ``min_source_flows`` drops them after aggregation, which
    spares a join over all flows. URL and size columns describe the whole source (``scope='source'``) or the pair.
    ``malicious`` holds Sum_xss and Feq_xss per pair; they are null without it. Malics_urls stays null here, see
    :func:`webscan_features_with_urls`.
    """
    pair = ["src_ip", "dest_ip"]
    counts = cut_lineage(facet_counts(flows, burst_seconds, methods), "facets")
    source = url_profile(counts, ["src_ip"]).filter(F.col("_flows") >= min_source_flows)
    table = pair_profile(counts)
    if scope == "pair":
        kept = source.select("src_ip")
        table = table.join(url_profile(counts, pair).drop("_flows"), pair)
        table = salted_join(table, kept, "src_ip", "dest_ip", "left_semi")
    elif scope == "source":
        table = salted_join(table, source.drop("_flows"), "src_ip", "dest_ip", "inner")
    else:
        raise ValueError(f"unknown scope {scope!r}")
    if malicious is None:
        table = table.select(
            "*",
            F.lit(None).cast("bigint").alias("Sum_xss"),
            F.lit(None).cast("double").alias("Feq_xss"),
        )
    else:
        table = table.join(malicious, pair, "left").withColumns(
            {"Sum_xss": F.coalesce("Sum_xss", F.lit(0)), "Feq_xss": F.coalesce("Feq_xss", F.lit(0.0))}
        )
    table = table.withColumn("Malics_urls", F.lit(None).cast("array<string>"))
    if owner is None:
        table = table.withColumn("is_cloud", F.lit(False))
    else:
        table = mark_owned(table, owner, "src_ip", "dest_ip")
    return table.select(*WEBSCAN_COLUMNS, "is_cloud")


def webscan_features_with_urls(table: DataFrame, urls: DataFrame, each: Sequence[str] = ("is_cloud",)) -> DataFrame:
    """The table with every malicious URL of each pair and how often each was requested.

    ``urls`` comes from :func:`flowscope.operators.learning.malicious_urls`. There is one row per pair and ``part`` of
    its list, and one of part 0 for a pair without a list; ``url_parts`` is the number of parts, of which there is one
    unless the list is very long. The pair and the columns ``each`` stand on every part, the other features on part 0 only and
    are null on further parts, so that sums over the table hold.
    """
    pair = ["src_ip", "dest_ip"]
    parts = urls.groupBy(*pair).agg(F.count(F.lit(1)).alias("url_parts"))
    features = table.drop("Malics_urls")
    joined = features.join(urls, pair, "left").join(parts, pair, "left")
    once = [c for c in features.columns if c not in (*pair, *each)]
    return joined.withColumns({
        "part": F.coalesce("part", F.lit(0).cast("bigint")), "url_parts": F.coalesce("url_parts", F.lit(0)),
        **{c: F.when(F.coalesce("part", F.lit(0)) == 0, F.col(c)) for c in once}})


def training_features(flows: DataFrame, malicious: DataFrame | None = None, size: int = 20, seconds: int = 1,
                      dense: bool = True) -> DataFrame:
    """Features of fixed 20-row chunks of the cleaned log, for training; URL features look at GET only.

    Every row of the log is in a chunk; ``chunk_rows`` tells how many a chunk has. ``malicious`` may give Sum_xss and
    Feq_xss per chunk.
    """
    cut = chunks(flows, size, dense=dense)
    table = (
        burst_statistics(cut, ["chunk"], seconds)
        .join(cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("chunk_rows")), "chunk")
        .join(status_statistics(cut, ["chunk"]), "chunk")
        .join(traversal_statistics(cut, ["chunk"], ["GET"]), "chunk")
    )
    if malicious is not None:
        return table.join(malicious, "chunk", "left").na.fill(0, ["Sum_xss", "Feq_xss"])
    return table


def basic_scan_vector(flows: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Per source: similar neighbouring URLs, 404 share, status entropy and, with predictions, the attack share.

    ``scored`` has one row per source and distinct URL, with its number of requests ``n`` and ``prediction``.
    """
    from flowscope.operators.aggregate import prediction_share

    table = plain_error_rate(flows, ["src_ip"]).join(similar_neighbours(flows), "src_ip")
    if scored is None:
        table = table.withColumn("P_malicious_urls", F.lit(None).cast("double"))
    else:
        table = table.join(prediction_share(scored, ["src_ip"], weight="n"), "src_ip", "left")
    return table.select("src_ip", "P_malicious_urls", "C_similar_url", "num_404", "H_status")
