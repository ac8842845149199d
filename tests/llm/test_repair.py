import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from flowscope.llm import queries as Q
from flowscope.llm import repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv int, mark string, n bigint"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        turns = out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        turns += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)

    def key(t):
        return t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()

    return {c: sorted(turns, key=key) for c, turns in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        inked = BLANK.findall(text)
        if not inked:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("ok" if inked[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """Dijkstra-free search: all states after each turn, with every audit kept as (cost, audit, lines)."""
    def step(state, role):
        return {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(state)

    best = {0: (0, "", ())}

    def insert_all(best):
        for _ in range(2):
            for state, (cost, audit, lines) in list(best.items()):
                role = "assistant" if state == 2 else "user"
                option = (cost + 3, audit + "I", (*lines, f"{role}:"))
                to = step(state, role)
                if to not in best or option < best[to]:
                    best[to] = option
        return best

    for (_, role, text), fault in zip(turns, found):
        after = {}

        def offer(to, option):
            if to is not None and (to not in after or option < after[to]):
                after[to] = option

        for state, (cost, audit, lines) in insert_all(best).items():
            offer(state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            offer(step(state, role), (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                offer(step(state, new), (cost + 3 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = after
    ends = insert_all(best)
    return min(ends[s] for s in (0, 3) if s in ends)


def brute(rows):
    out = []
    for conv, turns in damage(rows).items():
        found = faults(turns)
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = itertools.pairwise(r[:1] for _, r, _ in turns)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, lines = cheapest(turns, found)
        out.append((-1 if conv is None else conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def talk(seed=1, n=150):
    rng = random.Random(seed)
    texts = ["Well.", "Yes!", "no end", " \t", "", None, "ends? \n", "ünd.", "Was?" * 9]
    roles = ["system", "user", "assistant", "tool", None, "", "User", "üser"]
    rows = []
    for c in range(n):
        plain = rng.random() < 0.5
        for t in range(rng.randrange(1, 9)):
            role = ("user", "assistant")[t % 2] if plain else rng.choice(roles)
            rows.append((c, t if rng.random() < 0.8 else rng.choice([None, t + 3, t + 90, -t]), role, rng.choice(texts) if rng.random() < 0.6 else f"line {c} {t}.", 1, "m", 2))
    rows += [rows[0]] * 3 + [rows[5]] * 2 + [(None, t, "user", f"text {t}", 1, "m", 2) for t in range(4)] + [(None, None, None, None, 1, "m", 2)] * 2
    return rows


def collected(df):
    return sorted(tuple(-1 if i == 0 and x is None else x for i, x in enumerate(r)) for r in df.select(*R.REPAIRED_NAMES).collect())


@pytest.mark.parametrize("bits", [16, 0])
def test_repair_is_cheapest(spark, bits):
    rows = talk()
    assert collected(R.repaired_digests(R.damaged(spark.createDataFrame(rows, SCHEMA)), bits)) == brute(rows)


def test_query_empty_table_and_turns(spark, tmp_path):
    rows = talk(3, 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Q.op12_conversation_repair(spark, str(tmp_path))
    assert got.columns == R.REPAIRED_NAMES and collected(got) == brute(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert Q.op12_conversation_repair(spark, f"{tmp_path}/none").collect() == []
    want = [(-1 if c is None else c, *line.split(":", 1)) for c, turns in damage(rows).items() for line in cheapest(turns, faults(turns))[2]]
    turns = R.repaired(R.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((-1 if r.conv_id is None else r.conv_id, r.role, r.text) for r in turns) == sorted(want)
    by_conv = {}
    for r in turns:
        by_conv.setdefault(r.conv_id, []).append(r.turn)
    assert all(sorted(x) == list(range(len(x))) for x in by_conv.values())


def test_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["same text", f"other {t}.", f"cut {t}"]), 1, "m", 2) for t in range(3000)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"fine {t}.", 1, "m", 2) for t in range(500)]
    assert collected(R.repaired_digests(R.damaged(spark.createDataFrame(rows, SCHEMA)), 6)) == brute(rows)


def test_grammar_expands_to_its_input():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 16, n) for n in (0, 1, 2, 300, 40)] + [np.zeros(100, np.int64), np.array([1, 2] * 50)]
    grammar = R.Grammar()
    parts = {v: k for k, v in grammar.rules.items()}
    got = grammar.compress(seqs)
    parts = {v: k for k, v in grammar.rules.items()}

    def expand(s):
        return [s] if s not in parts else expand(parts[s][0]) + expand(parts[s][1])

    assert [[x for s in g.tolist() for x in expand(s)] for g in got] == [s.tolist() for s in seqs]
    assert len(got[-1]) < 10 and len(got[-2]) < 10


def test_ropes_compare_like_texts():
    rng = random.Random(4)
    for _ in range(400):
        cut = ["".join(rng.choice("IK") for _ in range(rng.randrange(90))) for _ in range(4)]
        shared = "K" * rng.randrange(100)
        x, y = R.Rope(shared) + (R.Rope(cut[0]) + R.Rope(cut[1])), (R.Rope(shared) + R.Rope(cut[2])) + R.Rope(cut[3])
        a, b = shared + cut[0] + cut[1], shared + cut[2] + cut[3]
        assert (str(x), str(y)) == (a, b) and R.before(x, y) == (a > b) - (a < b)
