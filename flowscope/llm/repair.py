"""Repair of conversation structure at the least cost, by dynamic programming over a grammar of the turn sequences.

Method. Each turn becomes one of 16 symbols, its role (system, user, assistant, other) with its first fault. The symbol
sequences are compressed with Re-Pair: frequent pairs of neighbours become rules, again and again. A symbol has a
min-plus transfer matrix between the four states of the wanted order (nothing yet, after system, after user, after
assistant), each entry with its cost and the audit of edits as a rope; a rule's matrix is the product of those of its two
parts. Rules are evaluated bottom-up, once per task, and shared by all its conversations; a conversation is the product
of the few symbols left of it.

Wanted is ``(s?(ua)+)?``. Edits: keep a turn (0), change its role to user or assistant (3), delete it (4; blank and
duplicate turns must go), insert an empty user or assistant turn (3); a truncated turn that stays adds 3. Of the cheapest
edits the ASCII-least audit wins. Two audits of equal cost over the same turns are never prefixes of each other (the
longer one would have more inserts), so the least audit of a product is made of least parts.

A conversation is cut into ranges of ``2^turn_bits`` turns; ranges are evaluated as matrices on their own and only then
folded in order. Equal turns of a range are one row with a count. The repaired text is hashed in order while its sorted
turns stream by, without being held.

Defined cases: a null role or text is one space; a null id is a conversation of its own; turns are ordered with nulls
first, ties by a digest of role and text; repeated rows are repeated turns (and so duplicates); very long texts are read
once and never joined; a conversation without turns is a result row with an empty audit; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowscope.operators.scale import cut_lineage

TURN_BITS = 16
PIECE_SYMBOLS = 1 << 20
MAX_RULES = 200_000
FLAT = 64
MODULUS, BASE = (1 << 61) - 1, 1_000_003
SYMBOLS = "ABCDEFGHIJKLMNOP"
ROLES = "sua"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
INSERT, REROLE, DELETE, SHORT = 3, 3, 4, 3
STATES = range(4)
USER, ASSISTANT = [(0, 2), (1, 2), (3, 2)], [(2, 3)]
FINAL = (0, 3)
BEFORE_ALL = -(1 << 62)


class Rope:
    """A text made of two ropes, with the hash of its characters; short ones are kept flat."""

    __slots__ = ("hash", "left", "n", "right", "text")

    def __init__(self, text: str | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.n = left.n + right.n
            self.hash = (left.hash * pow(BASE, right.n, MODULUS) + right.hash) % MODULUS
        else:
            self.n, self.hash = len(text), 0
            for c in text.encode():
                self.hash = (self.hash * BASE + c) % MODULUS

    def __add__(self, other: Rope) -> Rope:
        if not self.n or not other.n:
            return other if not self.n else self
        if self.n + other.n <= FLAT:
            return Rope(str(self) + str(other))
        return Rope(None, self, other)

    def __str__(self) -> str:
        if self.text is not None:
            return self.text
        parts, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.text is not None:
                parts.append(rope.text)
            else:
                stack += [rope.right, rope.left]
        return "".join(parts)


def before(x: Rope, y: Rope) -> int:
    """-1, 0 or 1 as ``x`` stands before, at or after ``y``; equal stretches are skipped by their hashes."""
    left, right = [x], [y]
    while left and right:
        a, b = left.pop(), right.pop()
        if a is b or a.n == b.n and a.hash == b.hash:
            continue
        if a.text is None and (a.n >= b.n or b.text is not None):
            left += [a.right, a.left]
            right.append(b)
        elif b.text is None:
            left.append(a)
            right += [b.right, b.left]
        else:
            k = min(a.n, b.n)
            if a.text[:k] != b.text[:k]:
                return -1 if a.text[:k] < b.text[:k] else 1
            left += [Rope(a.text[k:])] if a.n > k else []
            right += [Rope(b.text[k:])] if b.n > k else []
    return bool(left) - bool(right)


def _best(options: list[tuple[int, Rope]]) -> tuple[int, Rope] | None:
    if not options:
        return None
    low = min(cost for cost, _ in options)
    ropes = [rope for cost, rope in options if cost == low]
    return low, ropes[0] if len(ropes) == 1 else min(ropes, key=cmp_to_key(before))


def times(x: list, y: list) -> list:
    """Min-plus product of matrices (or of a row and a matrix) with audits."""
    return [
        [_best([(a[0] + y[k][t][0], a[1] + y[k][t][1]) for k, a in enumerate(row) if a is not None and y[k][t] is not None]) for t in STATES]
        for row in x
    ]


def _matrix(moves: list[tuple[int, int, int, str]]) -> list:
    found = [[[] for _ in STATES] for _ in STATES]
    for f, t, cost, letters in moves:
        found[f][t].append((cost, Rope(letters)))
    return [[_best(cell) for cell in row] for row in found]


def inserts() -> list:
    steps = [(f, f, 0) for f in STATES] + [(f, t, 1) for f, t in USER + ASSISTANT] + [(0, 3, 2), (1, 3, 2)]
    return _matrix([(f, t, INSERT * k, "I" * k) for f, t, k in steps])


def terminal(symbol: int) -> list:
    """Transfer matrix of one turn: inserts before it, then what is done with it."""
    role, fault = divmod(symbol, 4)
    moves = [(f, f, DELETE, "D") for f in STATES]
    if fault not in (BLANK, DUPLICATE):
        extra = SHORT if fault == TRUNCATED else 0
        kept = {0: [(0, 1)], 1: USER, 2: ASSISTANT}.get(role, [])
        moves += [(f, t, extra, "K") for f, t in kept] + [(f, t, REROLE + extra, "R") for f, t in USER + ASSISTANT]
    return times(inserts(), _matrix(moves))


class Grammar:
    """Rules over the 16 terminals, each with its transfer matrix."""

    def __init__(self):
        self.rules: dict[tuple[int, int], int] = {}
        self.matrices = [terminal(s) for s in range(len(SYMBOLS))]

    def rule(self, left: int, right: int) -> int:
        if (left, right) not in self.rules:
            self.rules[left, right] = len(self.matrices)
            self.matrices.append(times(self.matrices[left], self.matrices[right]))
        return self.rules[left, right]

    def compress(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Sequences with frequent pairs replaced until no pair of neighbours occurs twice.

        A round replaces every pair that is not less frequent than the pairs it overlaps, every second one in a run of
        equal pairs.
        """
        text = np.concatenate([np.append(s, -1) for s in sequences]).astype(np.int64)
        while len(text) > 1:
            at = np.flatnonzero((text[:-1] >= 0) & (text[1:] >= 0))
            codes, pair, count = np.unique((text[at] << 32) | text[at + 1], return_inverse=True, return_counts=True)
            if not len(codes) or count.max() < 2:
                break
            rank = np.full(len(text) + 1, len(codes), np.int64)
            order = np.empty(len(codes), np.int64)
            order[np.lexsort((codes, -count))] = np.arange(len(codes))
            rank[at] = np.where(count[pair] > 1, order[pair], len(codes))
            inner = rank[:-1]
            left = np.concatenate([[len(codes)], inner[:-1]])
            run = np.flatnonzero(inner != left)
            first = np.repeat(run, np.diff(np.append(run, len(inner)))) if len(run) else np.zeros(0, np.int64)
            first = np.concatenate([np.zeros(len(inner) - len(first), np.int64), first])
            chosen = (inner < len(codes)) & (inner <= left) & (inner <= rank[1:]) & ((np.arange(len(inner)) - first) % 2 == 0)
            place = np.flatnonzero(chosen)
            code, which = np.unique((text[place] << 32) | text[place + 1], return_inverse=True)
            text[place] = np.array([self.rule(int(c >> 32), int(c & 0xFFFFFFFF)) for c in code], np.int64)[which]
            text = np.delete(text, place + 1)
        ends = np.flatnonzero(text < 0)
        return [text[a:b] for a, b in zip([0, *(ends[:-1] + 1)], ends)]

    def product(self, symbols: np.ndarray, start: list) -> list:
        for s in symbols.tolist():
            start = times(start, self.matrices[s])
        return start


def from_nothing() -> list:
    return [[(0, Rope("")), None, None, None]]


def unchanged() -> list:
    return [[(0, Rope("")) if f == t else None for t in STATES] for f in STATES]


def finished(row: list) -> tuple[int, str]:
    """Cost and audit at the end, from the one row of a product."""
    cost, rope = _best([x for x in (times(row, inserts())[0][t] for t in FINAL) if x is not None])
    return cost, str(rope)


def _tallies(codes: np.ndarray) -> tuple[int, int, int, int]:
    role, fault = codes >> 2, codes & 3
    pair = role[:-1] * 4 + role[1:]
    illegal = len(pair) - int(np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)).sum())
    return *(int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal


ENTRIES = "array<struct<cost:bigint,audit:string>>"
SOLVED = ("conv bigint, block bigint, n_blocks bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, "
          f"truncated bigint, illegal bigint, edge string, cost bigint, audit string, entries {ENTRIES}")
AUDITED = ("conv bigint, low bigint, high bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "cost bigint, audit string")
ENTRY = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _solve(batches):
    """Cost and audit of whole conversations, matrices of ranges."""
    grammar = Grammar()
    for batch in batches:
        seqs, blocks = batch.column("seq").to_pylist(), batch.column("n_blocks").to_pylist()
        size = np.cumsum([len(s) for s in seqs])
        start = 0
        while start < len(seqs):
            stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + PIECE_SYMBOLS, "right")))
            distinct = list(dict.fromkeys(zip(seqs[start:stop], [n > 1 for n in blocks[start:stop]])))
            codes = [np.frombuffer(s.encode(), np.uint8).astype(np.int64) - ord(SYMBOLS[0]) for s, _ in distinct]
            answers = {}
            for key, plain, symbols in zip(distinct, codes, grammar.compress(codes)):
                edge = key[0][:1] + key[0][-1:]
                if key[1]:
                    cells = [x for row in grammar.product(symbols, unchanged()) for x in row]
                    entries = [None if x is None else {"cost": x[0], "audit": str(x[1])} for x in cells]
                    answers[key] = (*_tallies(plain), edge, None, None, entries)
                else:
                    answers[key] = (*_tallies(plain), edge, *finished(grammar.product(symbols, from_nothing())), None)
            rows = [answers[s, n > 1] for s, n in zip(seqs[start:stop], blocks[start:stop])]
            columns = list(zip(*rows))
            part = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("conv", "block", "n_blocks", "low", "high", "turns")], *[pa.array(c, pa.int64()) for c in columns[:4]],
                 pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.string()), pa.array(columns[7], ENTRY)],
                ["conv", "block", "n_blocks", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "edge", "cost", "audit", "entries"])
            start = stop
        if len(grammar.rules) > MAX_RULES:
            grammar = Grammar()


def _fold(batches):
    """Ranges of a conversation in order, folded into one cost and audit."""
    held = None
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held is None or held["conv"] != row["conv"]:
                if held is not None:
                    done.append(_folded(held))
                held = row | {"state": from_nothing(), "edge": None} | dict.fromkeys(("low", "high")) | dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
            cells = [None if x is None else (x["cost"], Rope(x["audit"])) for x in row["entries"]]
            held["state"] = times(held["state"], [cells[4 * f : 4 * f + 4] for f in STATES])
            for c in ("turns", "blank", "duplicate", "truncated", "illegal"):
                held[c] += row[c]
            if held["edge"] is not None:
                pair = np.array([ord(held["edge"]) - ord(SYMBOLS[0]), ord(row["edge"][0]) - ord(SYMBOLS[0])])
                held["illegal"] += _tallies(pair)[3]
            held["edge"] = row["edge"][-1]
            for c, pick in (("low", min), ("high", max)):
                held[c] = pick([x for x in (held[c], row[c]) if x is not None], default=None)
        if done:
            yield _audited(done)
    if held is not None:
        yield _audited([_folded(held)])


def _folded(held: dict) -> tuple:
    return (*(held[c] for c in ("conv", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")), *finished(held["state"]))


def _audited(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    names = ["conv", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:9]], pa.array(columns[9], pa.string())], names)


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns ``(conv, turn, role, text, copies)`` damaged by ``CRC-32("conv:turn") % 20``; a dropped turn has no copies.

    0 drops a turn, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes the user its speaker.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    key = F.concat(*[F.coalesce(c.cast("string"), F.lit(" ")) if not isinstance(c, str) else F.lit(c) for c in (conv, ":", turn)])
    k = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c.cast("string"), F.lit(" ")) for c in (role, text))
    return conversations.select(
        conv.cast("bigint").alias("conv"), turn.cast("bigint").alias("turn"), F.when(k == 4, "user").otherwise(role).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def _mark() -> Column:
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).alias("mark")


def _sequences(turns: DataFrame, turn_bits: int) -> DataFrame:
    """``(conv, block, n_blocks, seq, low, high, turns)``: symbols of every range of a conversation in order."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("role_class")
    blank = (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank")
    cut = (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")
    cells = turns.filter("copies > 0").select("conv", "turn", _mark(), role, blank, cut, "copies").groupBy(
        "conv", "turn", "mark", "role_class", "blank", "cut").agg(F.sum("copies").alias("n"))
    seen = F.lag(F.lit(1)).over(Window.partitionBy("conv", "mark").orderBy(F.col("turn").asc_nulls_first())).isNotNull()
    fault = F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(OK)
    again = F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)

    def symbol(f: Column) -> Column:
        return F.substring(F.lit(SYMBOLS), (4 * F.col("role_class") + f + 1).cast("int"), F.lit(1))

    block = F.coalesce(F.shiftright("turn", turn_bits), F.lit(BEFORE_ALL + 1)).alias("block")
    symbols = F.concat(symbol(fault), F.repeat(symbol(again), (F.col("n") - 1).cast("int")))
    listed = cells.select("conv", "turn", "mark", block, symbols.alias("symbols")).groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("turn", "mark", "symbols"))).alias("rows"))
    ranges = listed.select(
        "conv", "block", F.array_join("rows.symbols", "").alias("seq"), F.array_min("rows.turn").alias("low"), F.array_max("rows.turn").alias("high"),
        F.size(F.array_distinct(F.filter("rows.turn", lambda t: t.isNotNull()))).cast("bigint").alias("turns"))
    nothing = F.lit(None).cast("bigint")
    every = turns.select("conv").distinct().select(
        "conv", F.lit(BEFORE_ALL).alias("block"), F.lit("").alias("seq"), nothing.alias("low"), nothing.alias("high"), F.lit(0).cast("bigint").alias("turns"))
    both = ranges.unionByName(every).withColumn("n_blocks", F.count(F.lit(1)).over(Window.partitionBy("conv")) - 1)
    return both.filter((F.col("block") > BEFORE_ALL) | (F.col("n_blocks") == 0))


def audits(turns: DataFrame, turn_bits: int = TURN_BITS) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation."""
    solved = cut_lineage(_sequences(turns, turn_bits).mapInArrow(_solve, SOLVED), "ranges")
    columns = [c.split()[0] for c in AUDITED.split(", ")]
    parts = solved.filter("n_blocks > 1")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = parts.repartition(n, "conv").sortWithinPartitions("conv", "block").mapInArrow(_fold, AUDITED)
    both = solved.filter("n_blocks <= 1").select(*columns).unionByName(folded)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    return both.select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")


class _Writer:
    """Lines of a repaired conversation as its turns stream by."""

    def __init__(self, audit: str, emit):
        self.audit, self.at, self.state, self.emit = audit, 0, 0, emit

    def _next_role(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = 3 if self.state == 2 else 2
        return role

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.emit(self._next_role(), "")

    def turn(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = ROLES.index(role[0]) + 1
            self.emit(role, text)
        elif edit == "R":
            self.emit(self._next_role(), text)


def _streamed(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """Turns sorted within their conversation, behind a row with its audit."""
    stats = F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("stats")
    heads = audited.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("mark"),
                           F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), stats)
    body = turns.filter("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", _mark(), "role", "text", "copies", F.lit(None).cast(heads.schema["stats"].dataType).alias("stats"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return heads.unionByName(body).repartition(n, "conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "mark")


def _digests(batches):
    conv, stats, writer, sha, lines = None, None, None, None, 0

    def emit(role: str, text: str) -> None:
        nonlocal lines
        sha.update((("\n" if lines else "") + f"{role}:{text}").encode())
        lines += 1

    def closed() -> tuple:
        writer.inserted()
        return conv, *stats.values(), writer.audit, sha.hexdigest()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:7]], *[pa.array(c, pa.string()) for c in columns[7:]]], REPAIRED_NAMES)

    for batch in batches:
        done = []
        convs, kinds, roles, texts, copies = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "copies"))
        given = batch.column("stats").to_pylist()
        for i, kind in enumerate(kinds):
            if kind == 0:
                if writer is not None:
                    done.append(closed())
                conv, stats, sha, lines = convs[i], given[i], hashlib.sha256(), 0
                writer = _Writer(texts[i], emit)
                continue
            for _ in range(copies[i]):
                writer.turn(roles[i], texts[i])
        if done:
            yield batch_of(done)
    if writer is not None:
        yield batch_of([closed()])


REPAIRED_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
REPAIRED = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
            "repaired_sha256 string")


def repaired_digests(turns: DataFrame, turn_bits: int = TURN_BITS) -> DataFrame:
    """Tallies, cost, audit and the SHA-256 of the repaired ``role:text`` lines of every conversation."""
    turns = cut_lineage(turns, "turns")
    return _streamed(turns, audits(turns, turn_bits)).mapInArrow(_digests, REPAIRED)


def _written(batches):
    conv, writer, out = None, None, []

    def emit(role: str, text: str) -> None:
        out.append((conv, len(out) + shift, role, text))

    shift = 0
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    for batch in batches:
        convs, kinds, roles, texts, copies = (batch.column(c).to_pylist() for c in ("conv", "kind", "role", "text", "copies"))
        for i, kind in enumerate(kinds):
            if kind == 0:
                if writer is not None:
                    writer.inserted()
                    if out:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                conv, out, shift, writer = convs[i], [], 0, _Writer(texts[i], emit)
                continue
            for _ in range(copies[i]):
                writer.turn(roles[i], texts[i])
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
            shift += len(out)
            out = []
    if writer is not None:
        writer.inserted()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def repaired(turns: DataFrame, turn_bits: int = TURN_BITS) -> DataFrame:
    """The repaired turns ``(conv_id, turn, role, text)``, numbered from 0."""
    turns = cut_lineage(turns, "turns")
    return _streamed(turns, audits(turns, turn_bits)).mapInArrow(_written, "conv_id bigint, turn bigint, role string, text string")
