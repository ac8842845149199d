"""Aggregates over groups of flows. All of them combine on the map side or count per (key, value) first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.net import UNRESOLVED, address_class, differs, is_ipv4, time_bucket
from flowscope.functions.text import has_traversal
from flowscope.operators.scale import lists_by_key, null_safe_join


def entropy_of(counts, keep: Column | None = None) -> Column:
    """Aggregate: Shannon entropy in bits of a column of value counts, 0 for an empty group."""
    n = F.col(counts).cast("double") if isinstance(counts, str) else counts.cast("double")
    if keep is not None:
        n = F.when(keep, n)
    total = F.sum(n)
    bits = F.log2(total) - F.sum(n * F.log2(n)) / total
    return F.coalesce(F.greatest(bits, F.lit(0.0)), F.lit(0.0))


def value_counts(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """One scan for several columns: rows (keys, facet, value, n) for each named value expression.

    Rows are combined per (key, facet, value) before the shuffle, so a hot key arrives as its distinct values.
    """
    facets = F.array(
        *[F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value")) for name, v in values.items()]
    )
    return (
        df.select(*keys, F.explode(facets).alias("_f"))
        .select(*keys, "_f.facet", "_f.value")
        .groupBy(*keys, "facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def in_facet(name: str) -> Column:
    return F.col("facet") == F.lit(name)


def known_in(name: str) -> Column:
    """Rows of a facet with a value: a missing one is no value and adds nothing to an entropy."""
    return in_facet(name) & F.col("value").isNotNull()


def entropy_by(df: DataFrame, keys: Sequence[str], column: str, out: str = "entropy") -> DataFrame:
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(entropy_of("n", F.col(column).isNotNull()).alias(out))


def flow_counts(flows: DataFrame, keys: Sequence[str], out: str = "Sum_flow") -> DataFrame:
    return flows.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def distinct_urls(flows: DataFrame, keys: Sequence[str], out: str = "Cls_url", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("params") if approximate else F.countDistinct("params")
    return flows.groupBy(*keys).agg(count.alias(out))


def class_entropy_terms(share: Column) -> Column:
    return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))


def address_class_entropy(flows: DataFrame, keys: Sequence[str], column: str = "dest_ip") -> DataFrame:
    """``H_IP1`` .. ``H_IP4``: the entropy term of the share of each address class."""
    shares = flows.withColumn("_class", address_class(column)).groupBy(*keys).agg(
        *[(F.count_if(F.col("_class") == k) / F.count(F.lit(1))).alias(f"_p{k}") for k in (1, 2, 3, 4)]
    )
    return shares.select(*keys, *[class_entropy_terms(F.col(f"_p{k}")).alias(f"H_IP{k}") for k in (1, 2, 3, 4)])


def burst_statistics(flows: DataFrame, keys: Sequence[str], seconds: int = 1) -> DataFrame:
    """``Sum_sec_flow``/``Feq_sec_flow``: flows which share their time bucket with another flow, and their share.

    A single flow counts as (1, 1). Unparsable timestamps stay in the denominator only.
    """
    buckets = (
        flows.withColumn("_t", time_bucket("timestamp", seconds))
        .groupBy(*keys, "_t")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    shared = F.sum(F.when(F.col("_t").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(F.lit(0)))
    total = F.sum("n")
    return buckets.groupBy(*keys).agg(
        F.when(total == 1, F.lit(1)).otherwise(shared).cast("bigint").alias("Sum_sec_flow"),
        F.when(total == 1, F.lit(1.0)).otherwise(shared / total).alias("Feq_sec_flow"),
    )


def status_statistics(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count and share of 404 and status entropy, with unresolved statuses spread over the resolved ones.

    Spreading keeps the group's proportions, so the expected count is the resolved count times (1 + u / r) while
    share and entropy are those of the resolved statuses. A group without resolved status gives -1.
    """
    counts = flows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(*_status_columns())


def _status_columns() -> list[Column]:
    known = differs("status", UNRESOLVED)
    total = F.sum("n")
    r = F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0))
    errors = F.coalesce(F.sum(F.when(F.col("status") == "404", F.col("n"))), F.lit(0))
    defined = r > 0
    return [
        F.when(defined, errors * total / r).otherwise(F.lit(-1.0)).alias("Sum_404_error"),
        F.when(defined, errors / r).otherwise(F.lit(-1.0)).alias("Feq_404_error"),
        F.when(defined, entropy_of("n", known)).otherwise(F.lit(-1.0)).alias("H_status"),
    ]


def plain_error_rate(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """404 share and status entropy without imputation."""
    counts = flows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    errors = F.coalesce(F.sum(F.when(F.col("status") == "404", F.col("n"))), F.lit(0))
    return counts.groupBy(*keys).agg(
        (errors / F.sum("n")).alias("num_404"), entropy_of("n").alias("H_status")
    )


def numeric_size() -> Column:
    return F.when(F.col("size").rlike("^[0-9]+$"), F.col("size").try_cast("bigint"))


def size_statistics(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum and mean of the numeric sizes; sum 0 and mean -1 without any."""
    size = numeric_size()
    return flows.groupBy(*keys).agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("Sum_packets"),
        F.coalesce(F.avg(size), F.lit(-1.0)).alias("Mean_packets"),
    )


def _methods(methods: Sequence[str] | None) -> Column:
    return F.col("method").isin(*methods) if methods else F.lit(True)


def traversal_statistics(flows: DataFrame, keys: Sequence[str], methods: Sequence[str] | None = None) -> DataFrame:
    """Count and share of URLs with directory traversal, over all or only the given methods."""
    used = _methods(methods)
    hits = F.count_if(used & has_traversal("params"))
    total = F.count_if(used)
    return flows.groupBy(*keys).agg(
        hits.alias("Sum_dir"), F.when(total > 0, hits / total).otherwise(F.lit(0.0)).alias("Feq_dir")
    )


def host_similarity(flows: DataFrame) -> DataFrame:
    """Per (destination, host): flow and URL counts and the similarity of host and URLs.

    Distances are computed once per distinct URL. ``Similar_host`` is 0 when a URL contains a host which is not an
    address, else the mean edit distance of the URLs and the host.
    """
    urls = flows.groupBy("dest_ip", "host", "params").agg(F.count(F.lit(1)).alias("n"))
    named = ~is_ipv4("host")
    inside = F.contains(F.col("params"), F.col("host"))
    distance = F.when(named & inside, F.lit(0)).otherwise(F.levenshtein("params", "host"))
    mean = F.sum(F.col("n") * distance) / F.sum(F.when(F.col("params").isNotNull(), F.col("n")))
    return urls.groupBy("dest_ip", "host").agg(
        F.sum("n").alias("Flows"),
        F.count("params").alias("Urls"),
        F.when(F.max(named & inside), F.lit(0.0)).otherwise(F.coalesce(mean, F.lit(0.0))).alias("Similar_host"),
    )


def source_lists(flows: DataFrame, list_rows: int = 100_000) -> DataFrame:
    """Sources per (destination, host) in log order, repetitions kept, in parts of bounded length."""
    return lists_by_key(flows, ["dest_ip", "host"], "seq", {"src_ip": "src_ip"}, list_rows)


def source_destination_counts(flows: DataFrame) -> DataFrame:
    """The source x destination matrix in long form, without its zeros."""
    return flows.groupBy("src_ip", "dest_ip").agg(F.count(F.lit(1)).alias("n"))


def source_destination_vectors(flows: DataFrame, list_rows: int = 100_000) -> DataFrame:
    """``(src_ip, part, peers)``: the rows of the matrix as maps from destination to count, without their zeros.

    A source with more than ``list_rows`` destinations has its map in parts, dealt by a hash of the destination.
    """
    counts = source_destination_counts(flows).filter("dest_ip is not null")
    sizes = counts.groupBy("src_ip").agg(F.ceil(F.count(F.lit(1)) / F.lit(list_rows)).alias("_parts"))
    dealt = null_safe_join(counts, sizes, ["src_ip"]).withColumn("part", F.pmod(F.xxhash64("dest_ip"), F.col("_parts")))
    entries = F.sort_array(F.collect_list(F.struct("dest_ip", "n")))
    return dealt.groupBy("src_ip", "part").agg(F.map_from_entries(entries).alias("peers"))


def source_destination_matrix(
    flows: DataFrame, destinations: Sequence[str] | None = None, max_columns: int = 10_000
) -> DataFrame:
    """The matrix with one column for each of the destinations asked for, or of all there are.

    A table has a column in every row and on the driver, so more than ``max_columns`` destinations have to be asked for by
    name; for the others there are the sparse rows of :func:`source_destination_vectors`, which hold all of them.
    """
    counts = source_destination_counts(flows)
    if destinations is None:
        found = counts.select("dest_ip").distinct().limit(max_columns + 1).collect()
        if len(found) > max_columns:
            raise ValueError(f"more than {max_columns} destinations: name some, or use source_destination_vectors")
        destinations = sorted((r[0] for r in found), key=lambda d: (d is not None, d))
    return counts.groupBy("src_ip").pivot("dest_ip", list(destinations)).agg(F.first("n")).na.fill(0)


def layer7_vector(flows: DataFrame) -> DataFrame:
    """Per source: flows, peers, status, method and inter-arrival entropies and the mean interval."""
    from flowscope.operators.sequence import interval_statistics

    counts = value_counts(
        flows, ["src_ip"], {"peer": F.col("dest_ip"), "status": F.col("status"), "method": F.col("method")}
    )
    peers = F.count(F.when(in_facet("peer"), F.col("value")))
    flow_num = F.sum(F.when(in_facet("peer"), F.col("n")))
    base = counts.groupBy("src_ip").agg(
        flow_num.alias("flow_num"),
        peers.alias("num_of_peers"),
        (flow_num / peers).alias("mean_flows_per_peer"),
        entropy_of("n", known_in("status")).alias("H_status"),
        entropy_of("n", known_in("method")).alias("H_method"),
    )
    times = interval_statistics(flows, ["src_ip"])
    return base.join(times, "src_ip").select(
        "src_ip", "flow_num", "num_of_peers", "mean_flows_per_peer", "H_status",
        "H_time_interval", "mean_time_interval", "H_method",
    )


def layer4_vector(flows: DataFrame) -> DataFrame:
    """Per source: peers, address-class entropies, port entropies and ports and flows per peer."""
    counts = value_counts(
        flows,
        ["src_ip"],
        {"peer": F.col("dest_ip"), "srcprt": F.col("src_port"), "dstprt": F.col("dest_port")},
    )

    def distinct(facet):
        return F.count(F.when(in_facet(facet), F.col("value")))

    total = F.sum(F.when(in_facet("peer"), F.col("n")))
    kind = address_class("value")

    def share(k):
        return F.sum(F.when(in_facet("peer") & (kind == k), F.col("n")).otherwise(F.lit(0))) / total

    wide = counts.groupBy("src_ip").agg(
        distinct("peer").alias("num_of_peers"),
        *[share(k).alias(f"_p{k}") for k in (1, 2, 3, 4)],
        (distinct("srcprt") / distinct("peer")).alias("srcprts_per_peers"),
        entropy_of("n", known_in("srcprt")).alias("H_srcprt"),
        (distinct("dstprt") / distinct("peer")).alias("dstprts_per_peers"),
        entropy_of("n", known_in("dstprt")).alias("H_dstprt"),
        (total / distinct("peer")).alias("mean_flows_per_peer"),
    )
    return wide.select(
        "src_ip", "num_of_peers",
        *[class_entropy_terms(F.col(f"_p{k}")).alias(f"H_IP{k}") for k in (1, 2, 3, 4)],
        "srcprts_per_peers", "H_srcprt", "dstprts_per_peers", "H_dstprt", "mean_flows_per_peer",
    )


def prediction_share(
    scored: DataFrame, keys: Sequence[str], prediction: str = "prediction", weight: str | None = None
) -> DataFrame:
    """Share of rows with an attack prediction per key; with ``weight`` a row counts so many times."""
    n = F.col(weight) if weight else F.lit(1)
    bad = F.sum(F.when(F.col(prediction) != 0, n).otherwise(F.lit(0)))
    return scored.groupBy(*keys).agg((bad / F.sum(F.when(F.col(prediction).isNotNull(), n))).alias("P_malicious_urls"))


def prediction_counts(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(prediction).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def prediction_buckets(
    scored: DataFrame, text: str, order: str, prediction: str = "prediction", list_rows: int = 100_000
) -> DataFrame:
    """The texts of each predicted class, in parts of bounded length."""
    rows = scored.withColumn("prediction", F.col(prediction).cast("int"))
    return lists_by_key(rows, ["prediction"], order, {"texts": text}, list_rows)


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return scored.agg(F.avg(hit).alias("accuracy"))
