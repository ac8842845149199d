"""Conversations in reply order, with quoted passages replaced by links to the messages they come from.

Method. A line that starts with ``>`` signs is quoted, as deep as it has signs (``> >`` and ``>>`` are alike). A message
is cut into its own text and its quoted passages: a passage is a stretch of quoted lines of at least a given level, with
that level taken off, and what is quoted deeper inside is again parsed, so that a passage has an own text of its own. Own
texts are normalised (A-Z lower-cased, runs of white space become one blank, ends trimmed) and hashed; a passage is
joined to the message with the same hash of its own text. Of several, the earliest message of the same conversation
wins, if it stands before the quoting one; else the earliest message of all others. The parent of a message is the source
of its shallowest passage that has one; among equals, of its last.

A passage that equals no whole own text is looked for among the lines: it is joined to a stretch of successive lines of an
own text which are, normalised and without empty ones, exactly its lines, so trimmed quotes and answers put between quoted
parts find their source too. Stretches are only hashed around a line that is the longest of such a passage (the first of
equals), in the lengths that such passages have, so a greeting is looked up only if a passage has nothing longer. Whole texts
come first; among stretches the same order of sources holds, but a stretch of another conversation counts only if the passage
has at least ``foreign_words`` words, since "> thanks" says nothing about where it comes from. A part of a line, or a quote whose
lines were wrapped anew and which is not a whole text, has no source.

Sources are reduced to the earliest message per hash and conversation before they are joined, so a text that was sent any
number of times is one row there; only passages without a source in their own conversation are joined by hash alone. Threads follow
the parents inside a conversation by pointer doubling, in logarithmically many rounds, each written to the shared folder.

Defined cases: a null or empty text has no lines, no own text and no passages, and is no source; a message that only
quotes has an empty own text; a very long text is parsed by one task, as one row; a passage without source stays unlinked; null conversations or turns take no part in
threads and stand for themselves; rows with equal conversation and turn are one message for links (the smallest text
first) but all are returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.scale import cut_lineage, lists_by_key, salted_join

MARK = re.compile(r"^(?:[ \t]*>)+ ?")
BLANK = re.compile(r"[ \t\n\r\f\v]+")
UPPER = {c: c + 32 for c in range(65, 91)}
PARSED = ("conv bigint, turn bigint, role string, own_text string, own_hash string, n_quotes int, max_level int, "
          "passages array<struct<level:int,place:int,hash:string,n_lines:int,n_words:int,"
          "anchor:string,offset:int,lines_hash:string>>, lines array<string>")
PASSAGE = pa.list_(pa.struct([
    ("level", pa.int32()), ("place", pa.int32()), ("hash", pa.string()),
    ("n_lines", pa.int32()), ("n_words", pa.int32()), ("anchor", pa.string()), ("offset", pa.int32()), ("lines_hash", pa.string())]))
#: Least words of a stretch that is linked to another conversation.
FOREIGN_WORDS = 5


def normal(text: str) -> str:
    return BLANK.sub(" ", text.translate(UPPER)).strip(" ")


def text_hash(normalised: str) -> str:
    return hashlib.md5(normalised.encode("utf-8", "surrogatepass")).hexdigest()


def normal_hash(text: str) -> str | None:
    """Hash of a normalised text; none for an empty one."""
    text = normal(text)
    return text_hash(text) if text else None


def normal_lines(text: str) -> list[str]:
    """The normalised lines which are not empty."""
    return [n for n in map(normal, text.split("\n")) if n]


def as_passage(level: int, place: int, content: str) -> dict:
    lines = normal_lines(content)
    offset = max(range(len(lines)), key=lambda i: len(lines[i]))
    hashes = [text_hash(n) for n in lines]
    return {
        "level": level, "place": place, "hash": normal_hash(content), "n_lines": len(lines),
        "n_words": sum(n.count(" ") + 1 for n in lines), "anchor": hashes[offset], "offset": offset,
        "lines_hash": hashlib.md5(",".join(hashes).encode()).hexdigest()}


def levels(text: str) -> list[tuple[int, str]]:
    """Quote level and content of each line."""
    out = []
    for line in (text or "").split("\n"):
        found = MARK.match(line)
        out.append((found[0].count(">"), line[found.end() :]) if found else (0, line))
    return out


def parse(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Own text, and ``(level, line, hash)`` of each passage at each level."""
    own, passages = parse_lines(text)
    return own, [(level, place, normal_hash(content)) for level, place, content in passages]


def parse_lines(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Own text, and ``(level, line, own text)`` of each passage at each level."""
    lines = levels(text)
    passages = []
    for level in range(1, max((n for n, _ in lines), default=0) + 1):
        start = None
        for i, (n, _) in enumerate([*lines, (0, "")]):
            if n >= level and start is None:
                start = i
            elif n < level and start is not None:
                own = "\n".join(c for m, c in lines[start:i] if m == level)
                if BLANK.sub(" ", own).strip(" "):
                    passages.append((level, start, own))
                start = None
    return "\n".join(c for n, c in lines if n == 0).strip("\n"), passages


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role") -> DataFrame:
    """One row per message with its own text and the hashes of its passages."""

    def run(batches):
        for batch in batches:
            found = [parse_lines(t) for t in batch.column("text").to_pylist()]
            own, quoted = [f[0] for f in found], [f[1] for f in found]
            passages = [[as_passage(*one) for one in q] for q in quoted]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("turn"), batch.column("role"), pa.array(own, pa.string()),
                 pa.array([normal_hash(t) for t in own], pa.string()), pa.array([len(q) for q in quoted], pa.int32()),
                 pa.array([max((a for a, _, _ in q), default=0) for q in quoted], pa.int32()), pa.array(passages, PASSAGE),
                 pa.array([[text_hash(n) for n in normal_lines(t)] for t in own], pa.list_(pa.string()))],
                ["conv", "turn", "role", "own_text", "own_hash", "n_quotes", "max_level", "passages", "lines"])

    return messages.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text")).mapInArrow(run, PARSED)


def stretches(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(hash, conv, turn)`` of the stretches of own lines around the anchor, and of the length, of a ``wanted`` passage."""
    lines = named.select("conv", "turn", "own_hash", F.posexplode("lines").alias("at", "anchor"))
    asked = wanted.select("anchor", "offset", "n_lines").distinct()
    cut = F.struct((F.col("at") - F.col("offset")).alias("at"), "n_lines")
    found = salted_join(lines, asked, "anchor", "conv", "inner").filter("at >= offset")
    found = found.groupBy("conv", "turn", "own_hash").agg(F.collect_set(cut).alias("cuts"))
    own = named.filter("own_hash is not null").select("conv", "turn", "own_hash", "lines").dropDuplicates(["conv", "turn", "own_hash", "lines"])
    fitting = F.filter("cuts", lambda c: c["at"] + c["n_lines"] <= F.size("lines"))
    hashes = F.transform(fitting, lambda c: F.md5(F.array_join(F.slice("lines", c["at"] + 1, c["n_lines"]), ",").cast("binary")))
    return own.join(found, ["conv", "turn", "own_hash"]).select(F.explode(F.array_distinct(hashes)).alias("hash"), "conv", "turn")


def links(held: DataFrame, foreign_words: int = FOREIGN_WORDS) -> DataFrame:
    """``(conv, turn, level, place, parent_conv, parent_turn)`` of each passage with a source."""
    named = held.filter("conv is not null and turn is not null")
    sources = named.filter("own_hash is not null").select(F.col("own_hash").alias("hash"), "conv", "turn")
    asked = named.select("conv", "turn", F.explode("passages").alias("p")).select("conv", "turn", "p.*")
    whole, left = joined_to(asked, sources)
    left = cut_lineage(left, "trimmed")
    if left.isEmpty():
        return whole
    left = left.withColumn("hash", F.col("lines_hash"))
    return whole.unionByName(joined_to(left, stretches(named, left), foreign_words)[0])


def joined_to(asked: DataFrame, sources: DataFrame, foreign_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Links of the passages ``asked`` to the ``sources`` of the same hash, and the passages without one.

    Passages of fewer than ``foreign_words`` words are linked inside their own conversation only.
    """
    near = cut_lineage(sources.groupBy("hash", "conv").agg(F.min("turn").alias("near_turn")), "sources")
    asked = cut_lineage(asked.join(near, ["hash", "conv"], "left"), "passages")
    inside = F.coalesce(F.col("near_turn") < F.col("turn"), F.lit(False))
    found = asked.filter(inside).select("conv", "turn", "level", "place", F.col("conv").alias("parent_conv"), F.col("near_turn").alias("parent_turn"))
    rest = asked.filter(~inside).drop("near_turn")
    far = rest.filter(F.col("n_words") >= foreign_words).select("hash").distinct()
    others = cut_lineage(near.join(far, "hash", "left_semi"), "elsewhere")
    first = others.groupBy("hash").agg(F.min(F.struct("conv", "near_turn")).alias("first"))
    second = others.join(first, "hash").filter("conv <> first.conv").groupBy("hash").agg(F.min(F.struct("conv", "near_turn")).alias("second"))
    met = rest.join(first.join(second, "hash", "left"), "hash", "left")
    other = F.when(F.col("first.conv") != F.col("conv"), F.col("first")).otherwise(F.col("second"))
    other = F.when(F.col("n_words") >= foreign_words, other)
    met = met.withColumns({"parent_conv": other["conv"], "parent_turn": other["near_turn"]})
    elsewhere = met.filter("parent_conv is not null").select("conv", "turn", "level", "place", "parent_conv", "parent_turn")
    return found.unionByName(elsewhere), met.filter("parent_conv is null").select(*rest.columns)


def roots(parents: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(conv, turn, root, depth)`` of messages ``(conv, turn, up)`` with a parent ``up`` in their conversation.

    Each round doubles the reach of the messages which have not come to their root; the others are left alone.
    """
    moving = cut_lineage(parents.select("conv", "turn", "up", F.lit(1).alias("depth"), F.lit(False).alias("done")), "threads")
    settled = None
    for _ in range(max_rounds):
        state = moving if settled is None else settled.unionByName(moving)
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("at_root"))
        moved = cut_lineage(moving.join(above, ["conv", "up"], "left").select(
            "conv", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("at_root", F.lit(True)).alias("done")), "threads")
        settled = moved.filter("done") if settled is None else settled.unionByName(moved.filter("done"))
        moving = moved.filter("not done")
        if moving.isEmpty():
            return settled.select("conv", "turn", F.col("up").alias("root"), "depth")
    raise RuntimeError("replies did not end")


def reply_order(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str = "role",
    foreign_words: int = FOREIGN_WORDS,
) -> DataFrame:
    """Every message with its own text, the parent it quotes and its place: thread ``root`` and ``depth``.

    Ordered by ``(conv, root, turn)`` a conversation reads thread by thread, each reply after what it replies to.
    """
    held = cut_lineage(parsed(messages, conv_col, turn_col, text_col, role_col), "parsed")
    found = links(held, foreign_words).groupBy("conv", "turn").agg(
        F.min_by(F.struct("parent_conv", "parent_turn"), F.struct("level", (-F.col("place")).alias("place"))).alias("parent"), F.count(F.lit(1)).alias("n_linked"))
    found = cut_lineage(found.select("conv", "turn", "parent.*", "n_linked"), "parents")
    inside = found.filter("parent_conv = conv").select("conv", "turn", F.col("parent_turn").alias("up"))
    placed = found.join(roots(inside), ["conv", "turn"], "left")
    return held.join(placed, ["conv", "turn"], "left").select(
        "conv", "turn", "role", "own_text", "n_quotes", "max_level", F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent_conv", "parent_turn", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def conversations(ordered: DataFrame, list_rows: int = 10_000) -> DataFrame:
    """One row per thread ``(conv, root)`` with the arrays ``roles`` and ``texts`` in reply order; long ones in parts."""
    return lists_by_key(ordered, ["conv", "root"], "turn", {"roles": "role", "texts": "own_text"}, list_rows)
