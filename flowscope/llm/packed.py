"""Keys of text chunks, exchanged with the rest of the corpus as packed blocks instead of one row per key.

Documents are dealt into chunks of a few megabytes by a hash of the row, after equal rows have been collapsed to one. A chunk sends each range of the key space
one message with its sorted distinct keys; a range sees the messages of all chunks and answers each. However often a
key occurs, a chunk sends it once, so a frequent key weighs as much as a rare one and no group of rows with an equal
key is ever formed. Ranges and chunks grow in number with the corpus and keep their size; a message is only sent if it
holds a key, so there are never more messages than keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.scale import cut_lineage

CHUNK_BYTES = 4 << 20
RANGE_BYTES = 12 << 20


class Corpus:
    """Rows ``(chunk, id, text, hash, copies, ...)`` of a corpus in which equal rows are one row with their number.

    Rows are equal if id, text and the ``extra`` columns are, so that copies of a row, however many, weigh as much as one in
    a chunk. :meth:`given_back` hands the result of a row back to all its copies. A text longer than a chunk is a chunk of
    its own; its task needs some twenty times its bytes.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, extra: dict | None = None):
        columns = {"id": F.col(f"`{id_col}`").cast("bigint"), "text": F.col(f"`{text_col}`"), **(extra or {})}
        named = docs.select(*[c.alias(name) for name, c in columns.items()])
        self.rows = named.withColumn("hash", F.xxhash64(*columns))
        counts = self.rows.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
        self.repeated = cut_lineage(counts, "repeated")
        total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_chunks, self.ranges = max(1, math.ceil(total / CHUNK_BYTES)), max(1, math.ceil(total / RANGE_BYTES))
        chunk = F.pmod(F.col("hash"), F.lit(n_chunks)).cast("int").alias("chunk")
        self.several = not self.repeated.isEmpty()
        once = self.rows.withColumn("copies", F.lit(1).cast("bigint"))
        if self.several:
            marked = self._with_copies(self.rows, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
            once = marked.filter("copies = 1").unionByName(marked.filter("copies > 1").dropDuplicates(["id", "hash"]))
        self.chunks = once.select(chunk, *columns, "hash", "copies")

    def _with_copies(self, rows: DataFrame, how: str) -> DataFrame:
        other = self.repeated.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "copies")
        return rows.join(other, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), how).drop("_id", "_hash")

    def given_back(self, result: DataFrame) -> DataFrame:
        """A result with one row per row of ``chunks``, to one per row of the corpus; without ``hash`` and ``copies``."""
        if not self.several:
            return result.drop("hash", "copies")
        result = cut_lineage(result, "results")
        answers = result.filter("copies > 1").withColumnsRenamed({"id": "_id", "hash": "_hash"}).drop("copies")
        copies = self._with_copies(self.rows.select("id", "hash"), "inner").drop("copies")
        back = copies.join(answers, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).drop("_id", "_hash")
        return result.filter("copies = 1").drop("copies").unionByName(back).drop("hash")


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each 64-bit key, from its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of unsigned values, all first bytes before all second ones, which compresses well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def pack_sorted(values: np.ndarray, width: int) -> bytes:
    return planes(np.diff(values, prepend=np.uint64(0)), width)


def unpack_sorted(blob: bytes, width: int) -> np.ndarray:
    return np.cumsum(unplanes(blob, width), dtype=np.uint64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """First index of each run of equal values."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def by_range(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of equal range in a sorted column of ranges."""
    first = runs(owner)
    for a, b in zip(first, [*first[1:], len(owner)]):
        yield int(owner[a]), slice(int(a), int(b))


def table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
