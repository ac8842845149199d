"""Operators over neighbouring flows in log order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions.net import epoch_micros
from flowscope.operators.aggregate import entropy_of
from flowscope.operators.scale import cut_lineage, lag_in_blocks, position_in_group

BROADCAST_SPLITS = 100_000


def number_lines(lines: DataFrame, *columns, out: str = "seq") -> DataFrame:
    """The given columns of a file scan with 0-based line numbers, ordered by file name and offset.

    How a scan is cut into splits may change from job to job, for example when an executor is lost. The parsed rows
    are therefore stored once, as columns, together with their place in the split; what follows reads that copy.
    The numbers then need one count per split, and no row moves to the driver or to a single task. The table of splits,
    one row for each 128 MB or so, is ordered in one task; it is broadcast only if it is small.
    """
    marked = lines.select(
        *(columns or ("*",)),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    stored = cut_lineage(marked, "lines")
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_file", "_start")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    offsets = cut_lineage(offsets, "split-offsets")
    if offsets.count() <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return (
        stored.join(offsets, ["_file", "_start"])
        .withColumn(out, F.col("_offset") + F.col("_id") - F.col("_first"))
        .drop("_file", "_start", "_id", "_first", "_offset")
    )


def intervals(flows: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Each flow's distance to the previous flow of its group in microseconds (null for the first)."""
    timed = flows.select(*keys, order, epoch_micros("timestamp").alias("_us")).filter("_us is not null")
    lagged = lag_in_blocks(timed, keys, order, F.col("_us"), "_before")
    return lagged.select(*keys, order, "_us", (F.col("_us") - F.col("_before.v")).alias("interval_us"))


def interval_statistics(flows: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """Mean (seconds) and entropy of the inter-arrival times; one flow gives -1, no timed flow -2."""
    counts = intervals(flows, keys, order).groupBy(*keys, "interval_us").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("interval_us").isNotNull()
    gaps = F.sum(F.when(gap, F.col("n")))
    timed = counts.groupBy(*keys).agg(
        (F.sum(F.col("interval_us") * F.col("n")) / gaps / F.lit(1e6)).alias("_mean"),
        entropy_of("n", gap).alias("_entropy"),
        F.coalesce(gaps, F.lit(0)).alias("_gaps"),
    )
    groups = flows.select(*keys).distinct()

    def value(column):
        return F.when(F.col("_gaps").isNull(), F.lit(-2.0)).when(F.col("_gaps") == 0, F.lit(-1.0)).otherwise(column)

    return groups.join(timed, list(keys), "left").select(
        *keys,
        value(F.col("_entropy")).alias("H_time_interval"),
        value(F.col("_mean")).alias("mean_time_interval"),
    )


def similar_neighbours(flows: DataFrame, order: str = "seq", limit: int = 5) -> DataFrame:
    """``C_similar_url`` per source: neighbouring URLs to one destination with edit distance below ``limit``.

    Neighbours are taken per (source, destination) in log order, lower-cased; -1 when a source has no pair.
    """
    urls = flows.select("src_ip", "dest_ip", order, F.lower("params").alias("_url"))
    paired = lag_in_blocks(urls, ["src_ip", "dest_ip"], order, F.col("_url"), "_before")
    near = F.levenshtein("_url", "_before.v", limit - 1) >= 0
    pairs = F.count("_before")
    return paired.groupBy("src_ip").agg(
        F.when(pairs > 0, F.count_if(near)).otherwise(F.lit(-1)).alias("C_similar_url")
    )


def chunks(flows: DataFrame, size: int = 20, order: str = "seq", dense: bool = True) -> DataFrame:
    """Add ``chunk``, the number of the ``size``-row slice in log order; every row is in one.

    The rows are numbered anew, so that all slices but the last have ``size`` rows. Without ``dense`` slices go by the
    original line number and hold what cleaning has left of them.
    """
    if dense:
        numbered = position_in_group(flows, [], order, "_line").withColumn("_line", F.col("_line") - 1)
    else:
        numbered = flows.withColumn("_line", F.col(order))
    return numbered.withColumn("chunk", F.floor(F.col("_line") / F.lit(size)).cast("bigint")).drop("_line")
