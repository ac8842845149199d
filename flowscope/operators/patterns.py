"""Hits of a large table of literal patterns in texts, found in one pass for all patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.functions.text import bound
from flowscope.operators.scale import cut_lineage, salted_join

#: Lengths of the blocks by which patterns are looked up; a pattern takes the longest that fits into it.
BLOCKS = (8, 4, 2, 1)
PIECE = 256
#: A table of anchors with no more than this many characters and rows is broadcast.
BROADCAST_CHARS, BROADCAST_ROWS = 8 << 20, 100_000


def anchors(patterns: DataFrame) -> DataFrame:
    """``(pattern, word, block, offset)``: the block of each word which the fewest other words have, the first of equals."""
    word = F.col("word")
    words = cut_lineage(patterns.select("word").filter(F.length(word) > 0).distinct(), "words")
    size = F.coalesce(*[F.when(F.length(word) >= q, F.lit(q)) for q in BLOCKS])
    at = F.explode(F.sequence(F.lit(0), F.length(word) - F.col("_size"))).alias("offset")
    blocks = words.withColumn("_size", size).select("word", "_size", at)
    blocks = blocks.select("word", "offset", F.substring(word, F.col("offset") + 1, F.col("_size")).alias("block"))
    shared = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    rated = salted_join(blocks, shared, "block", "word", "inner")
    chosen = rated.groupBy("word").agg(F.min(F.struct("_n", "offset", "block")).alias("_b")).select("word", "_b.block", "_b.offset")
    return patterns.filter(F.length(word) > 0).join(chosen, "word").select("pattern", "word", "block", "offset")


def _pieces(text: Column, size: int, around: int) -> Column:
    """Pieces of a text with their neighbourhood: array of (base, before, own, body)."""

    def with_context(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            left = F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(around))).otherwise("")
            right = F.coalesce(F.left(F.get(pieces, i + 1), F.lit(around)), F.lit(""))
            return F.struct(
                (i * size).alias("base"), F.length(left).alias("before"), F.length(piece).alias("own"),
                F.concat(left, piece, right).alias("body"))

        return F.transform(pieces, one)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), with_context)


def pattern_hits(texts: DataFrame, id_col: str, text_col: str, patterns: DataFrame) -> DataFrame:
    """``(id, end_index, pattern, word)`` of every place of every pattern ``(pattern, word)``, overlapping ones included.

    Each pattern is looked up by one block of it, the one which it shares with the fewest other patterns. All blocks of a
    text of the lengths in use meet the table of these in one join, whatever the number of patterns, and a pattern is
    compared with the text around a block that is met. Texts are cut into pieces of 256 characters (or of the longest pattern) with
    their neighbourhood, so a very long text is many small rows. Positions count characters from 0.

    Null or empty texts and patterns have no hits; equal words with different ``pattern`` each have theirs, and a repeated
    row of either table repeats its hits.
    """
    table = cut_lineage(anchors(patterns), "anchors")
    sums = table.agg(
        F.count(F.lit(1)), F.max(F.length("word")), F.sum(F.length("word") + F.length("block")),
        F.collect_set(F.length("block"))).first()
    rows, longest, chars, sizes = sums[0], sums[1] or 1, sums[2] or 0, sorted(sums[3])
    size, around = max(PIECE, longest), longest + BLOCKS[0]
    cut = texts.select(F.col(id_col).alias("id"), F.explode(_pieces(F.col(text_col), size, min(around, size))).alias("_p")).select("id", "_p.*")

    def block_at(p: Column) -> Column:
        found = [F.substring(F.col("body"), p, F.lit(q)) for q in sizes]
        return F.filter(F.array(*found), lambda b: F.length(b) > 0) if sizes else F.array().cast("array<string>")

    place = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("own"))).alias("at")
    placed = cut.select("id", "base", "before", "body", place)
    met = placed.select("id", (F.col("base") + F.col("at") - F.col("before") - 1).alias("position"), "body", "at",
                        F.explode(F.array_distinct(block_at(F.col("at")))).alias("block"))
    if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS:
        both = met.join(F.broadcast(table), "block")
    else:
        near = F.least("at", F.lit(around + 1))
        narrow = met.select("id", "position", "block", near.alias("at"),
                            F.substring(F.col("body"), F.col("at") - near + 1, F.lit(2 * around + 1)).alias("body"))
        both = salted_join(narrow, table, "block", "position", "inner")
    start = F.col("position") - F.col("offset")
    inside = (start >= 0) & (F.col("at") > F.col("offset"))
    same = F.substring(F.col("body"), F.col("at") - F.col("offset"), F.length("word")) == F.col("word")
    return both.filter(inside & same).select(
        "id", (start + F.length("word") - 1).cast("int").alias("end_index"), "pattern", "word")
