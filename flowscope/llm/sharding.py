"""Shards of bounded size by extendible hashing.

Method. A row has a key of 62 bits: 32 bits of the MD5 of its id, then 30 bits which differ between rows of equal id.
The directory starts with one bucket, the empty prefix; a bucket of more than ``limit`` bytes is split on the next bit
of the key, and only such a bucket. So a shard is the shortest prefix of a row's key whose rows fit, or hold one row.

The bytes of prefixes are summed in one pass for all depths that a directory of this size can be expected to have; the
few buckets which are still too large are opened in further passes over their own rows. The directory is a table with
some 64 entries per shard; it is broadcast only after its number of entries has been checked, and joined by a shuffle
beyond that. The keys are written out before they are summed, since equal ids are told apart by the place of the row.

Defined cases: a null or empty text has no bytes; a text above the limit stands alone in a shard marked ``oversize``;
null or repeated ids are spread by the lower bits like any others; an empty table gives an empty table; result columns
replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.scale import checked_broadcast
from flowscope.operators.scale import cut_lineage

LIMIT_BYTES = 64 << 20
ID_BITS, ROW_BITS = 32, 30
KEY_BITS = ID_BITS + ROW_BITS
SPARE_BITS, STEP_BITS = 6, 8
RESULTS = ("n_bytes", "shard", "depth", "shard_bytes", "shard_rows", "oversize")


def shard_key(id_col: str) -> Column:
    """Bits of the id above bits of the place of the row; only stable once written."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    upper = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    lower = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)
    return F.shiftleft(upper, ROW_BITS).bitwiseOR(lower)


def prefix(key: str, bits: int) -> Column:
    return F.shiftright(F.col(key), KEY_BITS - bits)


def directory(sized: DataFrame, limit: int) -> list[tuple[int, DataFrame, int]]:
    """``(bits, cells, entries)`` per pass; ``cells`` maps prefixes of so many bits to their shard."""
    total = sized.agg(F.sum("__bytes")).first()[0] or 0
    bits = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    low, waiting, found = 0, sized.select("__key", "__bytes"), []
    while True:
        cells = cut_lineage(
            waiting.groupBy(prefix("__key", bits).alias("cell")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "cells")
        above = F.explode(F.sequence(F.lit(low), F.lit(bits)))
        levels = cells.withColumn("depth", above)
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        if bits == KEY_BITS:
            fits = fits | (F.col("depth") == bits)
        chosen = levels.select("cell", "depth", "prefix").join(sums.filter(fits), ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
        chosen = cut_lineage(chosen.withColumnRenamed("cell", f"__cell{bits}").withColumnRenamed("leaf", f"__leaf{bits}"), "directory")
        entries = cells.count()
        found.append((bits, chosen, entries))
        if bits == KEY_BITS or chosen.count() == entries:
            return found
        large = cells.join(chosen, F.col("cell") == F.col(f"__cell{bits}"), "left_anti").select("cell")
        large = checked_broadcast(large, entries)
        waiting = waiting.withColumn("cell", prefix("__key", bits)).join(large, "cell", "left_semi").drop("cell")
        low, bits = bits + 1, min(KEY_BITS, bits + STEP_BITS)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES, carry: list[str] | None = None) -> DataFrame:
    """All columns (or those of ``carry``) with ``n_bytes, shard, depth, shard_bytes, shard_rows, oversize``."""
    carried = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS]
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("bigint")
    sized = cut_lineage(
        docs.withColumns({"__key": shard_key(f"`{id_col}`"), "__bytes": size}).select(*[F.col(f"`{c}`") for c in carried], "__key", "__bytes"), "sized")
    rows, leaves = sized, []
    for bits, cells, entries in directory(sized, limit):
        rows = rows.withColumn(f"__cell{bits}", prefix("__key", bits)).join(checked_broadcast(cells, entries), f"__cell{bits}", "left")
        leaves.append(F.col(f"__leaf{bits}"))
    leaf = F.coalesce(*leaves)
    bits = F.when(leaf["depth"] == 0, "").otherwise(F.lpad(F.bin(leaf["prefix"]), leaf["depth"], F.lit("0")))
    return rows.select(
        *[F.col(f"`{c}`") for c in carried], F.col("__bytes").alias("n_bytes"), F.concat(F.lit("p"), bits).alias("shard"),
        leaf["depth"].alias("depth"), leaf["shard_bytes"].alias("shard_bytes"), leaf["shard_rows"].alias("shard_rows"),
        (leaf["shard_bytes"] > limit).alias("oversize"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the rows of a shard are brought together first, so that it is one file."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
