"""Building blocks which keep one hot key from landing in one task.

Conventions: a null key is a group of its own, and ``order`` is a unique, non-negative integer such as the line number
of a flow.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 1 << 20


_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the checkpoint folder, or else one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def release_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far; for use when the results made from them have been stored."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet null keys; the key columns of ``left`` are kept."""
    on = list(on)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in on])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in on])


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | str, spread: str, how: str = "left", salts: int = 16,
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join where ``left`` may hold a hot key and ``right`` has few rows per key.

    Each left row gets one of ``salts`` salts from its ``spread`` column and the right side is copied once per
    salt, so a hot key meets its partner in ``salts`` partitions. No hint is given: when the right side is under
    the broadcast threshold by its own statistics, Spark broadcasts it, otherwise the salted shuffle stands. Statistics do
    not count copies, so a side that Spark broadcasts is not copied: the driver would hold all of them.
    """
    on = [on] if isinstance(on, str) else list(on)
    if how in ("inner", "left", "left_semi", "left_anti") and _is_broadcast(right):
        return null_safe_join(left, right, on, how) if null_safe else left.join(right, on, how)
    salt = F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = left.withColumn("_salt", salt)
    if null_safe:
        return null_safe_join(salted, copies, [*on, "_salt"], how).drop("_salt")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def _is_broadcast(df: DataFrame) -> bool:
    """Whether Spark's statistics put a table under the broadcast threshold."""
    execution = df._jdf.queryExecution()
    threshold = execution.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    return execution.optimizedPlan().stats().sizeInBytes() <= threshold


def _block(order: str, block_rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(block_rows)).cast("bigint")


def lag_in_blocks(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``lag(value)`` within ``keys`` by ``order``, without sorting a whole group in one task.

    Windows run inside blocks of ``order``; the first row of a block takes its predecessor from a table of the
    last rows of the earlier blocks. The result is a struct ``(v)``, null where a row has no predecessor.
    """
    keys = list(keys)
    marked = df.withColumn("_block", _block(order, block_rows)).withColumn("_v", F.struct(value.alias("v")))
    inside = marked.withColumn("_prev", F.lag("_v").over(Window.partitionBy(*keys, "_block").orderBy(order)))
    ends = (
        marked.groupBy(*keys, "_block")
        .agg(F.max_by("_v", order).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")))
        .drop("_last")
    )
    return (
        null_safe_join(inside, ends, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_prev", "_carry"))
        .drop("_block", "_v", "_prev", "_carry")
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: str, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """1-based position of each row within ``keys`` by ``order``, counted block by block."""
    keys = list(keys)
    marked = df.withColumn("_block", _block(order, block_rows))
    local = marked.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        null_safe_join(local, offsets, [*keys, "_block"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_block", "_local", "_offset")
    )


def lists_by_key(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], list_rows: int = 100_000
) -> DataFrame:
    """All values of a group as arrays in ``order``, cut into parts of at most ``list_rows`` values.

    A group within the bound gives one row with ``part = 0``; a larger one continues in parts 1, 2, ... so that no
    row and no task ever holds an unbounded group, and nothing is dropped.
    """
    keys = list(keys)
    placed = position_in_group(df.select(*keys, order, *values.values()), keys, order, "_position")
    part = F.floor((F.col("_position") - 1) / F.lit(list_rows)).cast("bigint")
    packed = placed.groupBy(*keys, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *values.values()))).alias("_rows")
    )
    arrays = [F.col(f"_rows.{c}").alias(name) for name, c in values.items()]
    return packed.select(*keys, "part", *arrays)


def kth_smallest(df: DataFrame, value: str, k: int, weight: str | None = None, buckets: int = 10_000) -> float | None:
    """Exact k-th smallest (0-based) value, by refining a histogram.

    Each pass brings at most ``buckets`` counts to the driver and keeps the one bucket which holds rank ``k``, until
    its values are all equal. Copies are counted through ``weight``.
    """
    w = F.col(weight) if weight else F.lit(1)
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    kind = "bigint" if whole else "double"
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast(kind).alias("_v")).agg(F.sum(w).alias("_w"))
    counts = cut_lineage(counts, "ordered-values")
    low, high, total = counts.agg(F.min("_v"), F.max("_v"), F.sum("_w")).first()
    if total is None or not 0 <= k < total:
        return None
    rank, current = int(k), counts
    while low < high:
        width = (high - low) / buckets
        bucket = F.least(F.floor((F.col("_v") - F.lit(low)) / F.lit(width)), F.lit(buckets - 1))
        if width == 0.0 or not whole and low + width == low:
            bucket = F.when(F.col("_v") > F.lit(low), F.lit(1)).otherwise(F.lit(0))
        histogram = (
            current.groupBy(bucket.alias("_b"))
            .agg(F.sum("_w").alias("_w"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
            .orderBy("_b")
            .collect()
        )
        for row in histogram:
            if rank < row["_w"]:
                low, high = row["_low"], row["_high"]
                break
            rank -= row["_w"]
        current = counts.filter(F.col("_v").between(F.lit(low), F.lit(high)))
    return low


def rank_by(
    df: DataFrame, value: str, tie: str, out: str, descending: bool = True, buckets: int = 1000
) -> DataFrame:
    """1-based global rank by ``value`` and then ``tie``, nulls last, without a global window.

    Rows are counted per distinct value; the distinct values are cut into quantile ranges, ranked inside a range and
    shifted by the sizes of the ranges before it. Equal values are numbered by ``tie`` in blocks. Ranges are cut by
    the value as a double, inside a range values keep their own type.
    """
    sign = F.lit(-1.0) if descending else F.lit(1.0)
    keyed = df.withColumn("_v", F.col(value) + F.lit(0).cast(df.schema[value].dataType))
    counts = keyed.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_d", sign * F.col("_v").cast("double"))
    cuts = sorted(set(counts.approxQuantile("_d", [i / buckets for i in range(1, buckets)], 0.5 / buckets) or []))
    edges = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    last = F.lit(len(cuts) + 1)
    ranged = counts.withColumn("_range", F.when(F.col("_d").isNull(), last).otherwise(F.size(F.filter(edges, lambda e: e < F.col("_d")))))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.sum("_n").alias("_size"))
    starts = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before.orderBy("_range")), F.lit(0)).alias("_start")
    )
    inner = before.partitionBy("_range").orderBy(F.desc_nulls_last("_v") if descending else F.asc_nulls_last("_v"))
    offsets = ranged.join(starts, "_range").select(
        "_v", (F.col("_start") + F.coalesce(F.sum("_n").over(inner), F.lit(0))).alias("_before")
    )
    placed = position_in_group(keyed, ["_v"], tie, "_position")
    joined = salted_join(placed, offsets, "_v", tie, "inner", null_safe=True)
    return joined.withColumn(out, F.col("_before") + F.col("_position")).drop("_v", "_before", "_position")
