"""Behaviour features per (destination, host) for the detection of fake domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.aggregate import host_similarity, source_lists
from flowscope.operators.lookup import mark_owned
from flowscope.operators.scale import null_safe_join


def domain_features(flows: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """Flows, Hostname, Urls, Similar_host and dest_ip per (destination, host), plus ``is_cloud``."""
    table = host_similarity(flows).withColumnRenamed("host", "Hostname")
    if owner is None:
        table = table.withColumn("is_cloud", F.lit(False))
    else:
        table = mark_owned(table, owner, "dest_ip", "Hostname")
    return table.select("Flows", "Hostname", "Urls", "Similar_host", "dest_ip", "is_cloud")


def domain_features_with_sources(flows: DataFrame, owner: DataFrame | None = None, list_rows: int = 100_000) -> DataFrame:
    """The domain table with every source: one row per (destination, host) and ``part`` of its ``src_ip`` list.

    ``source_parts`` is the number of parts, of which there is one unless the list has more than ``list_rows`` sources.
    Flows, Urls and Similar_host stand on part 0 only and are null on further parts, so that sums over the table hold;
    the keys and ``is_cloud`` stand on each.
    """
    key = ["dest_ip", "Hostname"]
    lists = source_lists(flows, list_rows).withColumnRenamed("host", "Hostname")
    parts = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("source_parts"))
    features = null_safe_join(domain_features(flows, owner), parts, key)
    table = null_safe_join(lists, features, key)
    return table.withColumns({c: F.when(F.col("part") == 0, F.col(c)) for c in ("Flows", "Urls", "Similar_host")})
