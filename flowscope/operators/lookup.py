"""Joins with the owner and geographic dimensions, and the dimension caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.functions.net import ipv4_to_long
from flowscope.functions.text import trim_host
from flowscope.operators.scale import rank_by, salted_join


def mark_owned(df: DataFrame, owner: DataFrame, column: str = "src_ip", spread: str = "seq") -> DataFrame:
    """Add ``is_cloud``: whether the address is in the owner list."""
    keys = owner.select(F.col("ip").alias(column)).distinct().withColumn("is_cloud", F.lit(True))
    return salted_join(df, keys, column, spread, "left").withColumn("is_cloud", F.coalesce("is_cloud", F.lit(False)))


def owned_outside_split(keys: DataFrame, owner: DataFrame | None, column: str = "src_ip"):
    """``(all, owned, outside)`` views of a table with one row per key; without a list all is outside."""
    if owner is None:
        marked = keys.withColumn("is_cloud", F.lit(False))
    else:
        marked = mark_owned(keys, owner, column, column)
    return marked, marked.filter("is_cloud"), marked.filter(~F.col("is_cloud"))


def missing_keys(requested: DataFrame, found: DataFrame, column: str = "ip") -> DataFrame:
    """Requested keys which are not in the found rows."""
    return requested.select(column).distinct().join(found.select(column), column, "left_anti")


def geo_lookup(flows: DataFrame, geo: DataFrame, column: str = "dest_ip", spread: str = "seq") -> DataFrame:
    """Attach the geographic fields of an address; a miss gives nulls."""
    return salted_join(flows, geo.withColumnRenamed("ip", column), column, spread, "left")


def owner_lookup(addresses: DataFrame, cache: DataFrame, delivered: DataFrame, column: str = "ip") -> DataFrame:
    """Owner rows of the requested addresses: those in the cache, and delivered ones for the misses."""
    wanted = addresses.select(ipv4_to_long(column).alias("ipint")).distinct()
    hits = cache.join(wanted, "ipint", "left_semi")
    misses = wanted.join(cache.select("ipint"), "ipint", "left_anti")
    return hits.unionByName(delivered.join(misses, "ipint", "left_semi"))


def owned_sources(flows: DataFrame, owner: DataFrame) -> DataFrame:
    """Addresses of the owner list which occur as sources."""
    return flows.select(F.col("src_ip").alias("ip")).distinct().join(owner.select("ip"), "ip", "left_semi")


def first_flow_per_source(flows: DataFrame, key: str = "src_ip", order: str = "seq") -> DataFrame:
    """The first-seen row of each source, by a map-side combined aggregate instead of a window."""
    row = F.min_by(F.struct(*flows.columns), F.col(order)).alias("_first")
    return flows.groupBy(F.col(key).alias("_key")).agg(row).select("_first.*")


def enrich_sources(flows: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per located source: its geographic fields and the source port of its first flow."""
    first = first_flow_per_source(flows.select("src_ip", "src_port", "seq"))
    return first.join(geo.withColumnRenamed("ip", "src_ip"), "src_ip").drop("seq")


def enrich_flows(flows: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per flow: geographic fields of the destination, list-wrapped fields and ``flow_num`` 1.

    The first flow of a source without geographic row is left out, as no destination is looked up for it.
    """
    located = geo.select(F.col("ip").alias("src_ip"))
    skipped = (
        flows.groupBy("src_ip").agg(F.min("seq").alias("seq")).join(located, "src_ip", "left_anti").select("seq")
    )
    wrapped = [F.array(c).alias(c) for c in ("host", "params", "status", "size", "method")]
    kept = flows.join(skipped, "seq", "left_anti").select(
        "seq", "src_ip", "dest_ip", "timestamp", "dest_port", *wrapped, F.lit(1).alias("flow_num")
    )
    return geo_lookup(kept, geo)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows to append to a cache: one per new key (the first by ``order``), none for a key already there."""
    row = F.struct(*new.columns)
    chosen = (F.min_by(row, F.col(order)) if order else F.min(row)).alias("_row")
    return new.groupBy(F.col(key).alias("_key")).agg(chosen).select("_row.*").join(
        existing.select(key), key, "left_anti"
    )


def append_if_absent(path: str, new: DataFrame, key: str, order: str | None = None) -> None:
    existing = new.sparkSession.read.parquet(path)
    insert_if_absent(existing, new, key, order).select(*existing.columns).write.mode("append").parquet(path)


def labelled_domains(table: DataFrame, truth: DataFrame, count_column: str) -> DataFrame:
    """Domain rows whose host is listed with a positive count."""
    names = truth.filter(F.col(count_column) > 0).select(trim_host("hostname").alias("Hostname")).distinct()
    return salted_join(table, names, "Hostname", "dest_ip", "left_semi")


def owned_destinations(table: DataFrame, owner: DataFrame) -> DataFrame:
    """Domain rows of owned destinations."""
    return salted_join(table, owner.select(F.col("ip").alias("dest_ip")).distinct(), "dest_ip", "Hostname", "left_semi")


def key_batches(keys: DataFrame, column: str = "dest_ip", size: int = 100) -> DataFrame:
    """Distinct addresses in batches of ``size`` for services which limit a request.

    IPv4 addresses come first, in their numeric order, then names and other addresses in the order of a hash; a null
    is no address.
    """
    other = F.lit(1 << 32) + F.shiftrightunsigned(F.xxhash64(column), 3)
    distinct = keys.select(column).filter(F.col(column).isNotNull()).distinct()
    distinct = distinct.withColumn("_key", F.coalesce(ipv4_to_long(column), other))
    ranked = rank_by(distinct, "_key", "_key", "_rank", descending=False)
    batch = F.floor((F.col("_rank") - 1) / F.lit(size)).cast("bigint").alias("batch")
    return ranked.groupBy(batch).agg(F.array_sort(F.collect_list(column)).alias("ips"))
