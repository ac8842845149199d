"""Prefix trie of conversations, kept as tables of nodes with minimal-perfect-hash slots.

Method. A node is a distinct sequence of first turns; its digest is the XOR of 128-bit hashes of (position, turn), so
prefixes are a running XOR. Conversations are dealt into buckets by their id. Each bucket enumerates its distinct
digests and gives them the slots 0 .. n-1 of a minimal perfect hash (levels of bit tables, keys that collide go on to
the next level); the digest held at a slot is compared with every digest that is looked up, and depth and words of a
node must agree in all its rows. Counts are scattered into flat arrays by slot.

The nodes of all buckets are then summed by digest. As the members of a node include those of its descendants, a
conversation that is the smallest member of a node is so in all its descendants on its path: each node has one owner,
and a bucket adds what its own conversations own to all nodes on their paths, through the parent slots from the deepest
depth upwards. The sums of the buckets are added by digest. A node in many buckets, such as the root or a frequent
first turn, costs each bucket one row, and no round of jobs depends on the depth of the trie.

A conversation of more than ``segment`` turns is cut into segments which are groups of their own. The running XOR is
carried into a segment, and what its later segments own is added at the last node of the earlier ones.

Defined cases: a null role or text is empty; rows without an id belong to no conversation and are left out; turns are
ordered with nulls first, ties by the digest of role and text, repeated rows stay repeated turns; very long texts are
hashed and counted in the JVM and go no further; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.llm.words import mixed
from flowscope.operators.scale import cut_lineage

BUCKET_ROWS = 1 << 18
SEGMENT = 1 << 18
TURN_BITS = 16
NONE = np.iinfo(np.int64).max

NODES = pa.schema([
    ("bucket", pa.int32()), ("seg", pa.int64()), ("slot", pa.int32()), ("parent", pa.int32()), ("depth", pa.int64()),
    ("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64()), ("own_convs", pa.int64()), ("own_low", pa.int64()),
    ("ends", pa.list_(pa.int64())),
])
NODES_DDL = ("bucket int, seg bigint, slot int, parent int, depth bigint, a bigint, b bigint, words bigint, own_convs bigint, "
             "own_low bigint, ends array<bigint>")
SUMS_DDL = ("a bigint, b bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
            "n_leaves bigint, saved_tokens bigint")


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys, which also holds the keys to verify what is looked up."""

    def __init__(self, a: np.ndarray, b: np.ndarray, spread: int = 2):
        self.levels = []
        rest, start = np.arange(len(a)), 0
        self.n = len(a)
        slots = np.empty(len(a), np.int64)
        while len(rest):
            at = self._place(a[rest], b[rest], len(self.levels), spread * len(rest))
            taken = np.bincount(at, minlength=spread * len(rest)) == 1
            rank = np.cumsum(taken) - 1 + start
            alone = taken[at]
            slots[rest[alone]] = rank[at[alone]]
            self.levels.append((taken, rank))
            start += int(alone.sum())
            rest = rest[~alone]
            if len(self.levels) > 200:
                raise ValueError("keys of a slot table are not distinct")
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mixed(a + mixed(b ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & ((1 << 64) - 1))))
        return (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key, or -1 if the key is not in the table."""
        out = np.full(len(a), -1, np.int64)
        rest = np.arange(len(a))
        for level, (taken, rank) in enumerate(self.levels):
            at = self._place(a[rest], b[rest], level, len(taken))
            found = taken[at]
            out[rest[found]] = rank[at[found]]
            rest = rest[~found]
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)


def _order(turn: str) -> Column:
    return F.col(turn).asc_nulls_first()


def placed(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    turn_bits: int = TURN_BITS,
) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv, pos, mark, words)`` with their position from 1 and a digest, and ``(conv, n)``.

    Rows are numbered inside ranges of ``2^turn_bits`` turns, so that a long conversation is not one group.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("mark"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    ).filter("conv is not null").withColumn("block", F.coalesce(F.shiftright("turn", turn_bits), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("rows"))
    starts = blocks.select("conv", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv", "block").orderBy(_order("turn"), "mark")
    numbered = rows.withColumn("local", F.row_number().over(inside)).join(starts, ["conv", "block"])
    return (
        numbered.select("conv", (F.col("start") + F.col("local")).alias("pos"), "mark", "words"),
        blocks.groupBy("conv").agg(F.sum("rows").alias("n")),
    )


def branched(rows: DataFrame, convs: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on common openings, in the form of ``placed``.

    Conversation ``c`` takes its first ``h`` turns from conversation ``c - c % every`` (all if that has fewer, none if
    there is none) and goes on with its own turns after the first ``h``, where ``h`` is the CRC-32 of the decimal id
    modulo ``heads``. The remainder has the sign of the id, as in SQL.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    ids = convs.select("conv", "n", h, (F.col("conv") - F.col("conv") % every).alias("base"))
    lengths = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    info = ids.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    openings = rows.filter((F.col("pos") < heads) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "base")
    first = info.select("conv", "base", "taken").join(openings, "base").filter("pos <= taken").select("conv", "pos", "mark", "words")
    own = rows.join(info.select("conv", "h", "taken"), "conv").filter("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "mark", "words")
    return first.unionByName(own), info.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _turn_hashes(pos: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        p = mixed(pos.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        return mixed(mark[:, 0] ^ p) ^ mark[:, 1], mixed(mark[:, 1] + p) + mark[:, 0]


def _marks(column: pa.ChunkedArray) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 2)


def _xor_of(t: pa.Table) -> pa.Table:
    """XOR of the turn hashes of one segment."""
    a, b = _turn_hashes(t.column("pos").to_numpy(), _marks(t.column("mark")))
    xor = [np.bitwise_xor.reduce(x).reshape(1).view(np.int64) for x in (a, b)]
    return pa.table({"conv": t.column("conv").slice(0, 1), "seg": t.column("seg").slice(0, 1), "a": xor[0], "b": xor[1]})


def _node_table(t: pa.Table) -> pa.Table:
    """Nodes of one bucket and segment, in the order of their slots."""
    conv, pos, words = (t.column(c).to_numpy() for c in ("conv", "pos", "words"))
    order = np.lexsort((pos, conv))
    conv, pos, words, mark = conv[order], pos[order], words[order], _marks(t.column("mark"))[order]
    seg = t.column("seg")[0].as_py()
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    length = np.repeat(words[starts], np.diff(np.append(starts, len(conv))))
    words[starts] = 0
    digests = []
    for h, given in zip(_turn_hashes(pos, mark), (mark[:, 0], mark[:, 1])):
        h[starts] = given[starts]
        total = np.bitwise_xor.accumulate(h)
        carried = np.concatenate([[np.uint64(0)], total])[starts]
        digests.append(total ^ np.repeat(carried, np.diff(np.append(starts, len(conv)))))
    a, b = digests
    key = np.lexsort((b, a))
    distinct = key[np.concatenate([[True], (a[key][1:] != a[key][:-1]) | (b[key][1:] != b[key][:-1])])]
    table = SlotTable(a[distinct], b[distinct])
    slot = table.slots(a, b)
    depth, token, parent = np.empty(table.n, np.int64), np.empty(table.n, np.int64), np.full(table.n, -1, np.int64)
    depth[slot], token[slot] = pos, words
    if (slot < 0).any() or (depth[slot] != pos).any() or (token[slot] != words).any():
        raise ValueError("two prefixes share a digest")
    inner = np.ones(len(conv), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    parent[slot[at]] = slot[at - 1]
    counted = inner.copy()
    counted[starts] = seg == 0
    n_convs = np.bincount(slot[counted], minlength=table.n)
    low = np.full(table.n, NONE)
    np.minimum.at(low, slot[counted], conv[counted])
    last = counted & (pos == length)
    by_slot = np.lexsort((conv[last], slot[last]))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(slot[last], minlength=table.n))])
    ends = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(conv[last][by_slot]))
    bucket = np.full(table.n, t.column("bucket")[0].as_py(), np.int32)
    columns = [bucket, np.full(table.n, seg), np.arange(table.n, dtype=np.int32), parent.astype(np.int32), depth,
               table.a.view(np.int64), table.b.view(np.int64), token, n_convs]
    return pa.Table.from_arrays([*[pa.array(c) for c in columns], pa.array(low, mask=low == NONE), ends], schema=NODES)


def _accumulated(t: pa.Table) -> pa.Table:
    """What the conversations of a bucket add to each node on their paths."""
    t = t.take(pa.array(np.argsort(t.column("slot").to_numpy())))
    get = {c: t.column(c).to_numpy() for c in ("parent", "depth", "words", "n_convs", "n_ends", "low", "v", "l")}
    own = t.column("own_low").fill_null(NONE).to_numpy() == get["low"]
    parent, depth = get["parent"], get["depth"]
    saved = np.where(own, (get["n_convs"] - 1) * get["words"], 0) + get["v"]
    leaves = (own & (get["n_ends"] == get["n_convs"])).astype(np.int64) + get["l"]
    children = np.zeros(len(own), np.int64)
    below = own & (parent >= 0)
    np.add.at(children, parent[below], 1)
    by_depth = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in np.split(by_depth, cuts):
        level = level[parent[level] >= 0]
        np.add.at(saved, parent[level], saved[level])
        np.add.at(leaves, parent[level], leaves[level])
    entered = t.column("own_convs").to_numpy() == 0
    saved[entered] = leaves[entered] = 0
    up = np.where(parent >= 0, get["low"][parent], NONE)
    return pa.table({
        "a": t.column("a"), "b": t.column("b"), "depth": t.column("depth"), "conv_id": t.column("low"),
        "parent_conv_id": pa.array(up, mask=up == NONE), "n_convs": t.column("n_convs"), "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved,
    })


def _segment(pos: str, size: int) -> Column:
    return F.greatest(F.floor((F.col(pos) - 1) / F.lit(size)), F.lit(0)).cast("bigint")


def _both(a: str, b: str) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def prefix_trie(rows: DataFrame, convs: DataFrame, bucket_rows: int = BUCKET_ROWS, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and ``(a, b, conv)`` of the conversations that end at a node.

    Takes turns and conversations as ``placed`` gives them. A node has its digest ``(a, b)``, ``depth``, ``conv_id`` (its
    smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens``: the words that
    need not be read again below it, if each shared turn is read once.
    """
    turns, convs = cut_lineage(rows, "turns"), cut_lineage(convs, "conversations")
    buckets = max(1, math.ceil((turns.count() + convs.count()) / bucket_rows))
    bucket = F.pmod(F.xxhash64("conv"), F.lit(buckets)).cast("int").alias("bucket")
    none = F.unhex(F.lit("00" * 16))
    heads = convs.select("conv", F.lit(0).cast("bigint").alias("pos"), none.alias("mark"), F.col("n").alias("words"), F.lit(0).cast("bigint").alias("seg"))
    dealt = turns.withColumn("seg", _segment("pos", segment)).unionByName(heads)
    long = convs.filter(F.col("n") > segment)
    entries = None
    if not long.isEmpty():
        parts = turns.join(long.select("conv", "n"), "conv").withColumn("seg", _segment("pos", segment))
        xors = parts.groupBy("conv", "seg").applyInArrow(_xor_of, "conv bigint, seg bigint, a bigint, b bigint")
        upto = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = xors.select("conv", "seg", F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b"))
        entries = cut_lineage(running.join(long, "conv").filter((F.col("seg") + 1) * segment < F.col("n")), "entries")
        later = entries.select(
            "conv", ((F.col("seg") + 1) * segment).alias("pos"), _both("a", "b").alias("mark"), F.col("n").alias("words"), (F.col("seg") + 1).alias("seg"))
        dealt = dealt.unionByName(later)
    nodes = cut_lineage(dealt.withColumn("bucket", bucket).groupBy("bucket", "seg").applyInArrow(_node_table, NODES_DDL), "nodes")
    known = nodes.groupBy("a", "b").agg(
        F.sum("own_convs").alias("n_convs"), F.min("own_low").alias("low"), F.sum(F.size("ends")).alias("n_ends"),
        F.max("words").alias("node_words"), F.max("depth").alias("node_depth"))
    joined = nodes.drop("ends").join(known.drop("node_words", "node_depth"), ["a", "b"])
    if entries is None:
        joined = joined.withColumns({"v": F.lit(0).cast("bigint"), "l": F.lit(0).cast("bigint")})
    else:
        joined = joined.join(_carried(known, entries, long, bucket, segment), ["bucket", "seg", "a", "b"], "left")
        joined = joined.withColumns({c: F.when(F.col("own_convs") > 0, F.coalesce(c, F.lit(0))).otherwise(0) for c in "vl"})
    added = joined.groupBy("bucket", "seg").applyInArrow(_accumulated, SUMS_DDL)
    merged = added.groupBy("a", "b").agg(
        *[F.max(c).alias(c) for c in ("depth", "conv_id", "parent_conv_id", "n_convs")],
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    return merged, nodes.select("a", "b", F.explode("ends").alias("conv"))


def _carried(known: DataFrame, entries: DataFrame, long: DataFrame, bucket: Column, segment: int) -> DataFrame:
    """``(bucket, seg, a, b, v, l)``: what long conversations own in later segments, at the last node of each earlier one."""
    owned = known.join(long.select(F.col("conv").alias("low")), "low").groupBy(F.col("low").alias("conv"), _segment("node_depth", segment).alias("seg")).agg(
        F.sum((F.col("n_convs") - 1) * F.col("node_words")).alias("v"), F.sum(F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0)).alias("l"))
    pairs = entries.select("conv", "seg", "a", "b").join(owned.withColumnRenamed("seg", "later"), "conv").filter("later > seg")
    return pairs.groupBy(bucket, "seg", "a", "b").agg(F.sum("v").alias("v"), F.sum("l").cast("bigint").alias("l"))


def _runs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(a)]))


def _packed(batches):
    """Sorted ``(a, b, conv)`` to one row per node and batch, with the ids joined by commas."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, conv = (batch.column(i).to_numpy() for i in range(3))
        rows = [(a[i], b[i], conv[i], ",".join(map(str, conv[i:j].tolist()))) for i, j in _runs(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["a", "b", "first", "ids"])


def _hashed(batches):
    """One digest per run of rows of a node; the state of the last node waits for the next batch."""
    held, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (a, b) == held:
                state.update(b"," + ids.encode())
                continue
            if held is not None:
                done.append((*held, state.hexdigest()))
            held, state = (a, b), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["a", "b", "ends_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([state.hexdigest()])], ["a", "b", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(a, b, ends_sha256)``: SHA-256 of the ids at a node, ascending and joined by commas.

    Ids are sorted in ranges and joined batch by batch, then a task streams the batches of a node through the hash.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = ends.repartitionByRange(n, "conv").sortWithinPartitions("a", "b", "conv").mapInArrow(_packed, "a bigint, b bigint, first bigint, ids string")
    return packed.repartition(n, "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashed, "a bigint, b bigint, ends_sha256 string")


def with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes with ``ends_sha256``; a node where nothing ends has the hash of the empty string."""
    none = hashlib.sha256(b"").hexdigest()
    joined = nodes.join(ends_digests(ends), ["a", "b"], "left")
    return joined.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
