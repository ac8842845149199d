"""Filling unresolved values from the empirical distribution of their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.functions.net import UNRESOLVED, differs
from flowscope.operators.scale import cut_lineage, null_safe_join, position_in_group, salted_join


def cumulative_frequency(
    df: DataFrame, keys: Sequence[str], column: str, prefix: int = 4, block_values: int = 1_000_000
) -> DataFrame:
    """Counts ``n`` and running counts ``cum`` of the resolved values of each group, in value order.

    The running sum is taken per value prefix and shifted by the sizes of the smaller prefixes, so a group with many
    values is not summed in one task. The prefix is made longer until no more than ``block_values`` distinct values of a
    group share one, so that values with a common beginning, such as URLs, are spread as well.
    """
    keys = list(keys)
    counts = cut_lineage(
        df.filter(differs(column, UNRESOLVED) & F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n")),
        "value-counts",
    )
    longest = counts.agg(F.max(F.length(column))).first()[0] or 0
    while prefix < longest:
        shared = counts.groupBy(*keys, F.substring(column, 1, prefix).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        if shared.filter(F.col("_n") > block_values).isEmpty():
            break
        prefix *= 2
    counts = counts.withColumn("_prefix", F.substring(column, 1, prefix))
    upto = Window.partitionBy(*keys, "_prefix").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy(*keys, "_prefix")
        .agg(F.sum("n").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    return (
        null_safe_join(counts.withColumn("_cum", F.sum("n").over(upto)), offsets, [*keys, "_prefix"])
        .select(*keys, column, "n", (F.col("_cum") + F.col("_offset")).alias("cum"))
    )


def expected_frequency(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Weights of the resolved values after filling in expectation: ``n * (1 + u / r)``; all unresolved: unchanged."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    known = differs(column, UNRESOLVED)
    totals = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("_r"), F.sum("n").alias("_all")
    )
    weighted = salted_join(counts, totals, list(keys), column, "inner")
    return weighted.filter(known | (F.col("_r") == 0)).select(
        *keys,
        column,
        F.when(F.col("_r") > 0, F.col("n") * F.col("_all") / F.col("_r")).otherwise(F.col("n")).alias("weight"),
    )


def seeded_draw(order: str, seed: int) -> Column:
    """A uniform number in [0, 1) which depends on the row only, not on its partition."""
    return F.pmod(F.xxhash64(F.col(order), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fill_unresolved(
    df: DataFrame, keys: Sequence[str], column: str, order: str = "seq", seed: int = 42, draw: Column | None = None
) -> DataFrame:
    """Replace ``-`` by the value of a random resolved row of the same group; all unresolved: unchanged.

    The resolved rows of a group are numbered; an unresolved row draws a number and fetches that row by an
    equi-join on (group, number), which spreads evenly however large the group is.
    """
    keys = list(keys)
    known = differs(column, UNRESOLVED) & F.col(column).isNotNull()
    donors = position_in_group(df.filter(known).select(*keys, order, column), keys, order, "_pick").select(
        *keys, "_pick", F.col(column).alias("_fill")
    )
    sizes = df.filter(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    u = seeded_draw(order, seed) if draw is None else draw
    open_rows = salted_join(df.filter(F.col(column) == UNRESOLVED), sizes, keys, order, "left").withColumn(
        "_pick", (F.floor(u * F.col("_r")) + 1).cast("bigint")
    )
    filled = (
        open_rows.join(donors, [*keys, "_pick"], "left")
        .withColumn(column, F.coalesce("_fill", column))
        .select(*df.columns)
    )
    return df.filter(~F.col(column).eqNullSafe(UNRESOLVED)).unionByName(filled)
