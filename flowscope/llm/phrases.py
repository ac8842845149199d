"""Test phrases in training text, found in a positional inverted index by their rarest terms.

Method. The training text is read twice. The first pass counts how often each term of the test items occurs in it. A
window of an item (``window`` consecutive words, or a whole shorter item) is then looked up by its rarest positions:
only the terms at the ``lists`` rarest positions of some window get postings ``(term, document, position)``, which the
second pass stores. The offset-adjusted list of the rarest position of a window gives places where the window may start;
these are intersected with the adjusted list of the next rarest, and so on. What is left is compared word by word with
the document, so matches are exact; only the documents with a candidate are read for that. A window with a term that the training text does not have is never looked up.

Proximity: an item is near a place of its rarest term if its next rarest terms stand within ``within`` words of it.

All steps are DataFrame operations. Test windows and their terms are broadcast only after their number has been checked;
above the limit they are joined by shuffles. Posting lists are joined on (document, position, term), so a frequent term
or a large document is spread over all tasks.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Defined cases: a null or empty text has no
words, no windows and no hits; a null id is a value of its own; rows which agree in id and text are counted on their own
but share their places; items which agree in their text are all reported; an empty table on either side gives no hits;
other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.scale import ID_ROWS, checked_broadcast
from flowscope.operators.scale import cut_lineage

WINDOW = 10
LISTS = 3
WITHIN = 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def row_key(id_col: str, text_col: str) -> Column:
    """Rows with equal id and text have the same words at the same places, so they can share a key."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, words)``: all windows of all items."""
    tokens = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return tokens.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))


class PhraseIndex:
    """Postings of the terms by which a set of test windows is looked up.

    ``windows`` has ``wid``, ``size``, ``phrase`` and, from the rarest on, ``(term, offset)`` in ``rare``.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, lists: int = LISTS):
        self.docs = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        self.of_items = cut_lineage(
            item_windows(items, item_col, item_text_col, window).distinct().select("item", F.array_join("words", " ").alias("phrase")),
            "item-windows")
        phrases = self.of_items.select("phrase").distinct().withColumn("words", F.split("phrase", " "))
        places = cut_lineage(phrases.select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term")), "places")
        vocabulary = places.select("term").distinct()
        wanted = checked_broadcast(vocabulary, vocabulary.count())
        terms = self.docs.select(F.explode(words_of(F.col("text"))).alias("term"))
        self.counts = cut_lineage(terms.join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
        ranked = (
            places.join(self.counts, "term", "left").groupBy("phrase", "size")
            .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("rare"))
            .filter(F.col("rare")[0]["n"] > 0)
        )
        self.windows = cut_lineage(ranked.select("phrase", "size", F.slice("rare", 1, lists).alias("rare")), "windows")
        self.n_windows = self.windows.count()
        self.lists = lists
        needed = self.windows.select(F.explode("rare.term").alias("term")).distinct()
        needed = checked_broadcast(needed, needed.count())
        exploded = self.docs.select("key", F.posexplode(words_of(F.col("text"))).alias("position", "term"))
        self.postings = cut_lineage(exploded.join(needed, "term").select("term", "key", "position"), "postings")

    def candidates(self) -> DataFrame:
        """``(key, start, size, phrase)``: where all looked-up positions of a window fit."""
        first = self.windows.select("phrase", "size", "rare", F.col("rare")[0]["term"].alias("term"), F.col("rare")[0]["offset"].alias("offset"))
        found = (
            self.postings.join(checked_broadcast(first, self.n_windows), "term")
            .select("key", (F.col("position") - F.col("offset")).alias("start"), "size", "phrase", "rare").filter("start >= 0")
        )
        for i in range(1, self.lists):
            asked = found.select(
                "*", F.try_element_at("rare", F.lit(i + 1))["term"].alias("term"),
                (F.col("start") + F.try_element_at("rare", F.lit(i + 1))["offset"]).alias("position"))
            have = self.postings.select("key", "term", "position").distinct()
            met = asked.filter("term is not null").join(have, ["key", "term", "position"], "left_semi")
            found = met.unionByName(asked.filter("term is null")).drop("term", "position")
        return found.select("key", "start", "size", "phrase").distinct()

    def near(self, within: int = WITHIN) -> DataFrame:
        """``(key, item, position)``: places of the rarest term of an item with its other rarest terms close by."""
        rare = self.of_items.join(self.windows, "phrase").select("item", F.explode("rare").alias("r"))
        ranked = rare.groupBy("item").agg(F.slice(F.sort_array(F.collect_set(F.struct("r.n", "r.term"))), 1, self.lists).alias("terms"))
        asked = ranked.filter(F.size("terms") > 1)
        rows = checked_broadcast(asked, asked.count())
        found = self.postings.join(
            rows.select("item", "terms", F.col("terms")[0]["term"].alias("term")), "term").select("key", "item", "terms", "position")
        cell = F.floor(F.col("position") / within)
        have = self.postings.select("key", F.col("term").alias("t"), F.col("position").alias("p"), F.floor(F.col("position") / within).alias("cell"))
        for i in range(1, self.lists):
            term = F.try_element_at("terms", F.lit(i + 1))["term"]
            spread = found.withColumns({"t": term, "cell": F.explode(F.array(cell - 1, cell, cell + 1))})
            met = spread.filter("t is not null").join(have, ["key", "t", "cell"]).filter(F.abs(F.col("p") - F.col("position")) <= within)
            met = met.select("key", "item", "terms", "position").distinct()
            found = met.unionByName(found.filter(term.isNull()))
        return found.select("key", "item", "position")

    def matches(self) -> DataFrame:
        """``(key, start, size, phrase)``: exact occurrences, each candidate compared with the words of its document."""
        by_document = cut_lineage(self.candidates().groupBy("key").agg(F.collect_set(F.struct("start", "size", "phrase")).alias("c")), "candidates")
        keys = checked_broadcast(by_document.select("key"), by_document.count(), ID_ROWS)
        held = self.docs.join(keys, "key", "left_semi").join(by_document, "key").select("key", "c", words_of(F.col("text")).alias("w"))
        return held.select("key", F.explode(_exact("c", "w")).alias("m")).select("key", "m.*").distinct()

    def holders(self) -> DataFrame:
        """``(key, n_hit, items)`` of the documents with a match."""
        found = cut_lineage(self.matches(), "matches")
        items = self.of_items.groupBy("phrase").agg(F.collect_set("item").alias("own"))
        return found.join(checked_broadcast(items, self.n_windows), "phrase").groupBy("key").agg(
            _hit_words(F.sort_array(F.collect_set(F.struct("start", "size")))).alias("n_hit"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"))


def _exact(candidates: str, words: str) -> Column:
    return F.filter(candidates, lambda c: F.array_join(F.slice(words, c["start"] + 1, c["size"]), " ") == c["phrase"])


def _hit_words(matches: Column) -> Column:
    """Number of words in the union of intervals, which are sorted by their start."""
    zero = F.struct(F.lit(0).alias("until"), F.lit(0).alias("n"))
    return F.aggregate(
        matches, zero,
        lambda a, m: F.struct(
            F.greatest(a["until"], m["start"] + m["size"]).alias("until"),
            (a["n"] + F.greatest(F.lit(0), m["start"] + m["size"] - F.greatest(a["until"], m["start"]))).alias("n")),
        lambda a: a["n"].cast("bigint"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, lists: int = LISTS, carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (default: the id) of every row with ``n_words``, ``n_hit`` and the ``items`` it holds.

    Result columns replace carried ones of the same name. ``items`` is a sorted array of item ids as text.
    """
    index = PhraseIndex(docs, items, id_col, text_col, item_col, item_text_col, window, lists)
    holders = cut_lineage(index.holders().withColumnRenamed("key", "__key"), "holders")
    carried = [c for c in (carry or [id_col]) if c not in ("n_words", "n_hit", "items")]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in carried], F.size(words_of(F.col(f"`{text_col}`"))).cast("bigint").alias("n_words"), row_key(id_col, text_col).alias("__key"))
    return rows.join(checked_broadcast(holders, holders.count()), "__key", "left").select(
        *[F.col(f"`{c}`") for c in carried], "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_test_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                          item_text_col: str = "text", window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """The rows without any occurrence of a test window, with the input columns."""
    index = PhraseIndex(docs, items, id_col, text_col, item_col, item_text_col, window, lists)
    dirty = cut_lineage(index.matches().select(F.col("key").alias("__key")).distinct(), "dirty")
    dirty = checked_broadcast(dirty, dirty.count(), ID_ROWS)
    return docs.withColumn("__key", row_key(id_col, text_col)).join(dirty, "__key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
