"""Near-duplicate documents by SimHash fingerprints, compared at the anchors of a covering code.

Method. A fingerprint has 64 bits; bit ``i`` is set if it is set in over half of the XXH64 hashes of the shingles.
Equal fingerprints are collapsed first. For links of at most ``max_bits`` differing bits the fingerprint is cut into
``max_bits // 2 + 1`` blocks, in at least one of which two linked fingerprints differ by one bit or none. Each block is
covered by a perfect Hamming code of radius one: the codewords are the anchors. A fingerprint is kept at the codeword
next to its block (its home) and copied to the codewords within covering radius plus one, that is distance two; two
linked fingerprints then meet at the home of either. It is enough that they meet at the larger home, so only codewords
above the own home get a copy. With 64 bits and three differing bits these are two blocks of 31 bits, 2^26 anchors
each and 17 rows per fingerprint on average, whatever the size of the corpus.

At an anchor a fingerprint is compared over all 64 bits, and only a spanning forest of the links is returned, never all
pairs. An anchor with more than ``tile`` fingerprints is cut into blocks, whose pairs are separate tasks' work. The
forests are joined to components, which equal those of all links.

Defined cases: a null text has no words, like an empty one; its fingerprint is zero and is linked like any other; a
null id belongs to its component but does not name it (a component of null ids has a null name); repeated rows give
repeated result rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.scale import ID_ROWS, checked_broadcast
from flowscope.llm.words import Texts, pieces, release_memory, release_tables
from flowscope.operators.components import connected_components
from flowscope.operators.scale import cut_lineage

SHINGLE = 3
MAX_BITS = 3
SEED = 42
TILE = 4096
BLOCK_SHINGLES = 1 << 18
PARTITION_ROWS = 1 << 19


def _joined(texts: Texts) -> tuple[bytes, list, list]:
    """All words with one space after each, and where each word starts and ends in them."""
    data, inside = texts.data.copy(), texts.inside.copy()
    gaps = texts.ends[texts.ends < len(data)]
    gaps = gaps[~texts.inside[gaps]]
    data[gaps] = 0x20
    inside[gaps] = True
    place = np.concatenate([[0], np.cumsum(inside)])
    return data[inside].tobytes(), place[texts.starts], place[texts.ends - 1] + 1


def _fingerprints(texts: Texts, size: int, seed: int) -> np.ndarray:
    body, starts, ends = _joined(texts)
    out = np.zeros(len(texts.n_words), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in np.flatnonzero(texts.n_words):
        a, b = int(texts.first[i]), int(texts.first[i + 1])
        k = min(size, b - a)
        total, count = np.zeros(64, np.int64), b - a - k + 1
        for low in range(a, a + count, BLOCK_SHINGLES):
            high = min(low + BLOCK_SHINGLES, a + count)
            at = zip(starts[low:high].tolist(), ends[low + k - 1 : high + k - 1].tolist())
            h = np.array([xxhash.xxh64_intdigest(body[x:y], seed) for x, y in at], np.uint64)
            total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * total > count].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(id, hash, fp)`` per row: a hash of the text and the fingerprint, as signed 64-bit numbers."""

    def run(batches):
        release_tables()
        for batch in batches:
            for piece in pieces(batch, "text"):
                fp = _fingerprints(Texts(piece.column("text"), lower=True), shingle, seed)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("hash"), pa.array(fp.view(np.int64))], ["id", "hash", "fp"])
            release_memory()

    named = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), _text_hash(text_col).alias("hash"), F.col(f"`{text_col}`").alias("text"))
    return named.mapInArrow(run, "id bigint, hash bigint, fp bigint")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`"))


def block_length(blocks: int) -> int:
    """Length ``2^r - 1`` of the longest Hamming code which fits ``blocks`` times into 64 bits."""
    return (1 << int(math.log2(64 // blocks + 1))) - 1


def anchors(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(anchor, fp)``: every fingerprint at its home codewords and at those above it within distance two."""
    blocks = max_bits // 2 + 1
    length = block_length(blocks)
    width = length.bit_length()

    def run(batches):
        positions = np.arange(length, dtype=np.uint64)
        syndromes = positions + np.uint64(1)
        flips = [[] for _ in range(length + 1)]
        for i in range(length):
            for j in range(i + 1, length):
                flips[(i + 1) ^ (j + 1)].append((1 << i) | (1 << j))
        pairs = np.array(flips[1:], np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for b in range(blocks):
                word = (fp >> np.uint64(b * length)) & np.uint64((1 << length) - 1)
                s = np.bitwise_xor.reduce(((word[:, None] >> positions) & np.uint64(1)) * syndromes, axis=1)
                off = s > 0
                home = word.copy()
                home[off] ^= np.uint64(1) << (s[off] - np.uint64(1))
                visits = word[off, None] ^ pairs[s[off].astype(np.int64) - 1]
                row, column = np.nonzero(visits > home[off, None])
                anchor = np.concatenate([home, visits[row, column]])
                owner = np.concatenate([fp, fp[off][row]])
                tag = np.uint64(b << (64 - width))
                yield pa.RecordBatch.from_arrays([pa.array((anchor | tag).view(np.int64)), pa.array(owner.view(np.int64))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def _forest(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> list[tuple]:
    """Spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    sides = [left] if right is None else [left, right]
    other = 0 if right is None else 1
    waiting = [np.ones(len(x), bool) for x in sides]
    edges = []
    for start in range(len(left)):
        if not waiting[0][start]:
            continue
        waiting[0][start] = False
        queue = [(0, start)]
        while queue:
            side, i = queue.pop()
            there = side ^ other
            open_ = np.flatnonzero(waiting[there])
            if not len(open_):
                continue
            near = open_[np.bitwise_count(sides[there][open_] ^ sides[side][i]) <= max_bits]
            waiting[there][near] = False
            edges += [(sides[side][i], sides[there][j]) for j in near]
            queue += [(there, int(j)) for j in near]
    return edges


def _links(max_bits: int):
    """Streams sorted rows ``(anchor, a, b, side, fp)``; a run of equal ``(anchor, a, b)`` is one anchor or one tile."""

    def linked(anchor, a, b, side, fp):
        same = (anchor[1:] == anchor[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(first, len(anchor)))
        two = first[size == 2]
        two = two[a[two] == b[two]]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
        us, vs = [fp[near]], [fp[near + 1]]
        for f, n in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            if a[f] == b[f] and n > 2:
                edges = _forest(fp[f : f + n], None, max_bits)
            elif a[f] != b[f]:
                run, where = fp[f : f + n], side[f : f + n]
                edges = _forest(run[where == 0], run[where == 1], max_bits)
            else:
                continue
            if edges:
                u, v = zip(*edges)
                us.append(np.array(u, np.uint64))
                vs.append(np.array(v, np.uint64))
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(5)]
            columns[4] = columns[4].view(np.uint64)
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            last = np.ones(len(columns[0]), bool)
            for c in columns[:3]:
                last &= c == c[-1]
            done = int(np.flatnonzero(last)[0])
            held = [c[done:] for c in columns]
            if done:
                yield linked(*[c[:done] for c in columns])
        if held is not None:
            yield linked(*held)

    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """``(u, v)`` links of distinct fingerprints; per anchor or tile a spanning forest of all links there."""
    spark = fps.sparkSession
    rows = anchors(fps, max_bits)
    crowded = cut_lineage(rows.groupBy("anchor").count().filter(F.col("count") > tile), "crowded")
    n_crowded = crowded.count()
    plain = rows.select("anchor", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "fp")
    if n_crowded:
        blocks = crowded.select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("blocks"))
        blocks = F.broadcast(blocks) if n_crowded <= 1 << 16 else blocks
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        tiles = F.transform(
            F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
            lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"), F.when(own <= o, 0).otherwise(1).alias("side")),
        )
        plain = rows.join(blocks, "anchor", "left").select("anchor", F.explode(tiles).alias("t"), "fp").select("anchor", "t.*", "fp")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(20 * fps.count() / PARTITION_ROWS))
    dealt = plain.repartition(parts, "anchor", "a", "b").sortWithinPartitions("anchor", "a", "b")
    return dealt.mapInArrow(_links(max_bits), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
    seed: int = SEED, tile: int = TILE,
) -> DataFrame:
    """``(id, fp, component_id)`` per row: the component is named by the smallest id that can be reached."""
    return _grouped(docs, id_col, text_col, shingle, max_bits, seed, tile).select("id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """``(id, hash, fp, root, component_id)`` per row; ``root`` is a fingerprint of the component."""
    held = cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = cut_lineage(held.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    parts = connected_components(near_links(distinct, max_bits, tile)).select(F.col("id").alias("fp"), "root")
    named = distinct.join(parts, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.filter("root is not null").groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.join(lows, "root").select("fp", "root", "component_id")
    return held.join(names, "fp").select("id", "hash", "fp", "root", "component_id")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with the input columns: the one with the smallest id, of equal ids by a hash of the text.

    A row is known by its id and the hash of its text, so unlike texts that share an id are judged each on its own: one of
    each of their components stays. Of repeated rows any one stays. A row without an id stands behind all others, by the
    hash of its text, and stays if nothing else is like it.
    """
    stand_in = F.lit(1 << 62) + F.shiftrightunsigned(_text_hash(text_col), 2)
    rows = docs.withColumns({"__id": F.coalesce(F.col(f"`{id_col}`").cast("bigint"), stand_in), "__hash": _text_hash(text_col)})
    found = _grouped(rows, "__id", text_col, shingle, max_bits).groupBy("root", "id", "hash").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("root").agg(F.min(F.struct("id", "hash", "n")).alias("first"))
    best = cut_lineage(found.select(F.col("first.id").alias("__id"), F.col("first.hash").alias("__hash"), F.col("first.n").alias("n")), "kept")
    kept = rows.join(checked_broadcast(best.select("__id", "__hash"), best.count(), ID_ROWS), ["__id", "__hash"], "left_semi")
    if not best.filter("n > 1").isEmpty():
        kept = kept.dropDuplicates(["__id", "__hash"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
