"""Filters and cleaning rules of flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.net import UNRESOLVED, differs, ipv4_to_long, is_ipv4


def resolved(*columns: str) -> Column:
    """None of the columns holds the sensor's ``-``; nulls are kept."""
    out = F.lit(True)
    for c in columns:
        out = out & differs(c, UNRESOLVED)
    return out


def drop_single_sources(flows: DataFrame, key: str = "src_ip", spread: str = "seq") -> DataFrame:
    """Remove sources which have exactly one flow, by the unique line number ``spread`` of that flow."""
    singles = flows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(spread).alias(spread)).filter("_n = 1 and " + key + " is not null")
    return flows.join(singles.select(spread), spread, "left_anti")


def clean_basic(flows: DataFrame, drop_single: bool = True) -> DataFrame:
    """Resolved protocol, method and status; no single-flow sources."""
    kept = flows.filter(resolved("protocol", "method", "status"))
    return drop_single_sources(kept) if drop_single else kept


def clean_webscan(flows: DataFrame, drop_single: bool = True) -> DataFrame:
    """Resolved protocol and method, a destination address and port; no single-flow sources."""
    kept = flows.filter(
        resolved("protocol", "method") & F.col("dest_ip").isNotNull() & F.col("dest_port").isNotNull()
    )
    return drop_single_sources(kept) if drop_single else kept


def clean_domain(flows: DataFrame) -> DataFrame:
    """As for web scans, but without CONNECT and unresolved hosts, and with single-flow sources."""
    return flows.filter(
        resolved("protocol", "method", "host")
        & differs("method", "CONNECT")
        & F.col("dest_ip").isNotNull()
        & F.col("dest_port").isNotNull()
    )


def require_ipv4(df: DataFrame, column: str, mode: str = "filter") -> DataFrame:
    """Keep valid addresses (``filter``), mark them (``flag``) or fail on the first bad one (``error``)."""
    ok = is_ipv4(column)
    if mode == "filter":
        return df.filter(ok)
    if mode == "flag":
        return df.withColumn("is_ipv4", ok)
    if mode == "error":
        bad = F.raise_error(F.concat(F.lit("not an IPv4 address: "), F.coalesce(column, F.lit("null"))))
        return df.withColumn(column, F.when(ok, F.col(column)).otherwise(bad.cast("string")))
    raise ValueError(f"unknown mode {mode!r}")


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the flow table is empty")
    return df


def defined_features(table: DataFrame, columns=("Feq_404_error", "H_status", "Mean_packets")) -> DataFrame:
    """Rows whose features are not the ``-1`` of an undefined value."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~F.col(c).eqNullSafe(F.lit(-1.0))
    return table.filter(keep)


def quiet_domains(table: DataFrame, max_flows: int = 50, max_urls: int = 20) -> DataFrame:
    return table.filter((F.col("Flows") < max_flows) & (F.col("Urls") < max_urls))


def numeric_only(df: DataFrame, column: str, out: str) -> DataFrame:
    """Keep rows whose column is made of digits and add it as a number."""
    return df.filter(F.col(column).rlike("^[0-9]+$")).withColumn(out, F.col(column).try_cast("bigint"))


def key_lookup(dim: DataFrame, addresses: DataFrame, column: str = "ip") -> DataFrame:
    """Rows of a dimension whose ``ipint`` is one of the given addresses."""
    keys = addresses.select(ipv4_to_long(column).alias("ipint")).distinct()
    return dim.join(keys, "ipint", "left_semi")


def key_range_lookup(dim: DataFrame, addresses: DataFrame, column: str = "ip") -> DataFrame:
    """Rows of a dimension between the smallest and the largest of the given addresses."""
    bounds = addresses.agg(F.min(ipv4_to_long(column)).alias("low"), F.max(ipv4_to_long(column)).alias("high"))
    return dim.filter(
        F.col("ipint").between(bounds.select("low").scalar(), bounds.select("high").scalar())
    )
