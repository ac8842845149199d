import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from flowscope.llm import prefixes as P
from flowscope.llm import queries as Q

SCHEMA = "conv_id bigint, turn bigint, role string, text string, a bigint, depth string, mark int"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def mark(row):
    role, text = (x or "" for x in row[2:4])
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def ordered(rows):
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(r)
    for c, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, mark(r)))
        convs[c] = [(r[2] or "", r[3] or "") for r in turns]
    return convs


def rebuilt(rows):
    convs = ordered(rows)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: convs.get(c - c % 20, [])[: h[c]] + turns[h[c] :] for c, turns in convs.items()}


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = own + sum(saved[x] for x in below)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items())


def talk(seed=1, n=130):
    rng = random.Random(seed)
    texts = ["hello there", "hello\tthere you", "", None, "ünï ça va", "x " * 50, "hello there"]
    rows = []
    for c in rng.sample(range(400), n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: rng.randrange(1, 8)]), 1, "x", 2))
    rows += [rows[0], rows[0], (7, None, "user", "before all", 1, "x", 2), (7, None, None, None, 1, "x", 2), (None, 1, "user", "nobody", 1, "x", 2)]
    rows += [(c, t, "user", f"copied {t}", 1, "x", 2) for c in range(1000, 1200) for t in range(6)]
    return rows


def collected(nodes):
    return sorted(tuple(-1 if r[f] is None else r[f] for f in FIELDS) for r in nodes.collect())


@pytest.mark.parametrize("bucket_rows, segment, bits", [(50, 3, 1), (200, 1, 0)])
def test_nodes_of_rebuilt_conversations(spark, bucket_rows, segment, bits):
    rows = talk()
    turns, convs = P.branched(*P.placed(spark.createDataFrame(rows, SCHEMA), turn_bits=bits))
    got = collected(P.with_ends(*P.prefix_trie(turns, convs, bucket_rows, segment)))
    assert got == brute(rebuilt(rows))


def test_query_and_empty_table(spark, tmp_path):
    rows = talk(2, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.op11_prefix_trie(spark, str(tmp_path))
    assert got.columns == list(FIELDS) and collected(got) == brute(rebuilt(rows))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert Q.op11_prefix_trie(spark, f"{tmp_path}/none").collect() == []


def test_one_long_conversation_among_short_ones(spark):
    rows = [(c, t, "user", f"w{t}" if t < 900 + c else f"w{t} own{c}", 1, "", 1) for c in (5, 6, 7) for t in range(1000)]
    rows += [(c, t, "user", f"w{t}", 1, "", 1) for c in range(8, 40) for t in range(c)]
    got = collected(P.with_ends(*P.prefix_trie(*P.placed(spark.createDataFrame(rows, SCHEMA), turn_bits=5), 500, 64)))
    assert got == brute(ordered(rows))


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 20_000), np.uint64)
    a[:1000] = a[0]
    table = P.SlotTable(a, b)
    slots = table.slots(a, b)
    assert sorted(slots) == list(range(20_000))
    assert (table.slots(b, a) == -1).all() and (table.slots(a, b + np.uint64(1)) == -1).all()
    assert P.SlotTable(a[:0], b[:0]).n == 0
