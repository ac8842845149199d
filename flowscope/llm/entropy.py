"""Documents scored by the difference of two language models' loss per token.

Method. Two interpolated bigram models share one vocabulary: the target model is counted on the target documents, the
background model on all documents (``background="all"``), with its counts scaled by the ratio of the tokens, so that both
models weigh a count alike. With ``c`` a model's counts, ``N`` its tokens, both after scaling, and ``V`` the types of the
whole corpus,

    p(w) = (c(w) + 1) / (N + V + 1)        p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU)

so that a word which neither model has seen has the same place in both. The score of a document is its loss under the
target model minus its loss under the background model, per token; the lower, the more it is like the target. The first
word of a document has no predecessor and takes ``p(w)``. With ``background="drawn"`` the background is counted, without
scaling, on about as many bytes as the target has, drawn by a hash of the row, and ``V`` on both training parts; the other
documents are then not counted, and a drawn document finds its own words in the background.

Counts go through the packed exchange of ``packed.py``: a chunk sends its distinct words and word pairs with their
counts from both training parts; the ranges of the key space add up all chunks and return both totals for each key. No
table of counts is ever held in one place, no pair is cut off, and a frequent word costs one key per chunk.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, held as 64-bit hashes, of which a range compares 40 bits.
Defined cases: a document without words (a null text among them) has no loss and null scores; a null id is scored like
any other; repeated rows are scored once, counted with their number and all get the score; a very long text is one chunk;
without target documents the target model is flat and the background is not scaled; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm import packed
from flowscope.llm.words import Texts, rolling, whole_windows
from flowscope.operators.scale import cut_lineage

MU = 20.0
LOCAL_BITS = 40
ASKED = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("target", pa.binary()), ("background", pa.binary())])
ASKED_DDL = "chunk int, part int, keys binary, target binary, background binary"
TOLD = pa.schema([
    ("chunk", pa.int32()), ("part", pa.int32()), ("target", pa.binary()), ("background", pa.binary()),
    ("types", pa.int64()), ("n_target", pa.int64()), ("n_background", pa.int64())])
TOLD_DDL = "chunk int, part int, target binary, background binary, types bigint, n_target bigint, n_background bigint"
SCORES = pa.schema([
    ("id", pa.int64()), ("hash", pa.int64()), ("copies", pa.int64()), ("n_words", pa.int64()), ("loss_target", pa.float64()),
    ("loss_background", pa.float64())])
SCORES_DDL = "id bigint, hash bigint, copies bigint, n_words bigint, loss_target double, loss_background double"


def _counts(values: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs; the first byte tells how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + packed.planes(values.astype(np.uint64), width)


def _uncounts(blob: bytes) -> np.ndarray:
    return packed.unplanes(blob[1:], blob[0]).astype(np.int64)


def _keys(texts: Texts, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and local key of every word and of every pair with the word before it; single words are odd."""
    h = texts.hashes()
    local = np.uint64((1 << LOCAL_BITS) - 2)

    def place(x, odd):
        return (packed.ranges_of(x, ranges) << np.uint64(LOCAL_BITS)) | (x & local) | np.uint64(odd)

    return place(h, 1), place(rolling(h, 2), 0)


def _asked(chunk_table: pa.Table, ranges: int) -> pa.Table:
    texts = Texts(chunk_table.column("text"), lower=True)
    words, pairs = _keys(texts, ranges)
    valid = whole_windows(texts.first, 2, len(texts))
    owner = texts.text_of_word()
    keys = np.concatenate([words, pairs[valid]])
    owner = np.concatenate([owner, owner[: len(valid)][valid]])
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    first = packed.runs(keys)
    counts = []
    for role in ("target", "background"):
        flag = chunk_table.column(role).to_numpy().astype(np.int64) * chunk_table.column("copies").to_numpy()
        counts.append(np.add.reduceat(flag[owner], first) if len(first) else np.empty(0, np.int64))
    keys = keys[first]
    chunk = chunk_table.column("chunk")[0].as_py()
    low = np.uint64((1 << LOCAL_BITS) - 1)
    rows = [
        (chunk, part, packed.pack_sorted(keys[at] & low, 5), _counts(counts[0][at]), _counts(counts[1][at]))
        for part, at in packed.by_range(keys >> np.uint64(LOCAL_BITS))
    ]
    return packed.table(ASKED, rows)


def _told(range_table: pa.Table) -> pa.Table:
    chunks = range_table.column("chunk").to_pylist()
    lists = [packed.unpack_sorted(b, 5) for b in range_table.column("keys").to_pylist()]
    keys = np.concatenate(lists)
    order = np.argsort(keys, kind="stable")
    first = packed.runs(keys[order])
    size = np.diff(np.append(first, len(keys)))
    single = (keys[order][first] & np.uint64(1)) > 0
    totals, returned = [], []
    for role in ("target", "background"):
        counts = np.concatenate([_uncounts(b) for b in range_table.column(role).to_pylist()])
        total = np.add.reduceat(counts[order], first)
        back = np.empty(len(keys), np.int64)
        back[order] = np.repeat(total, size)
        totals.append(total)
        returned.append(back)
    types = int((single & (totals[0] + totals[1] > 0)).sum())
    tokens = [int(t[single].sum()) for t in totals]
    part = range_table.column("part")[0].as_py()
    rows, at = [], 0
    for i, (chunk, own) in enumerate(zip(chunks, lists)):
        cut = slice(at, at + len(own))
        at += len(own)
        rows.append((chunk, part, _counts(returned[0][cut]), _counts(returned[1][cut]), *((types, *tokens) if i == 0 else (0, 0, 0))))
    return packed.table(TOLD, rows)


def _scored(chunk_table: pa.Table, told: pa.Table, ranges: int, types: int, tokens: tuple[int, int], mu: float, scales: tuple[float, float]) -> pa.Table:
    if not chunk_table.num_rows:
        return SCORES.empty_table()
    texts = Texts(chunk_table.column("text"), lower=True)
    n_texts = len(texts.n_words)
    words, pairs = _keys(texts, ranges)
    valid = whole_windows(texts.first, 2, len(texts))
    distinct, inverse = np.unique(np.concatenate([words, pairs[valid]]), return_inverse=True)
    of_word, of_pair = inverse[: len(words)], inverse[len(words) :]
    told = told.sort_by("part")
    owner = texts.text_of_word()
    second = np.flatnonzero(valid) + 1
    columns = [*[chunk_table.column(c).combine_chunks() for c in ("id", "hash", "copies")], pa.array(texts.n_words)]
    for role, n, scale in zip(("target", "background"), tokens, scales):
        blobs = told.column(role).to_pylist()
        counts = np.concatenate([_uncounts(b) for b in blobs]) if blobs else np.empty(0, np.int64)
        assert len(counts) == len(distinct), "a chunk was answered with other keys than it asked for"
        counts = counts * scale
        c = counts[of_word]
        p = (c + 1.0) / (n * scale + types + 1.0)
        p[second] = (counts[of_pair] + mu * p[second]) / (c[second - 1] + mu)
        loss = np.bincount(owner, -np.log(p), n_texts) / np.maximum(texts.n_words, 1)
        columns.append(pa.array(loss, mask=texts.n_words == 0))
    return pa.Table.from_arrays(columns, schema=SCORES)


def cross_entropy_difference(docs: DataFrame, target: Column, id_col: str = "doc_id", text_col: str = "text", mu: float = MU,
                             background: str = "all") -> DataFrame:
    """``(id, n_words, loss_target, loss_background, difference)`` per row; ``target`` marks the target documents.

    ``background`` is ``"all"`` for counts over all documents. ``"drawn"`` counts a draw of the size of the target only and
    leaves out the rest.
    """
    if background == "all":
        counted = F.lit(True)
    elif background == "drawn":
        sizes = docs.select(F.octet_length(text_col).alias("n"), F.coalesce(target, F.lit(False)).alias("t"))
        sizes = sizes.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("t"), F.col("n"))).alias("target")).first()
        rate = int(1e6 * (sizes["target"] or 0) / max(1, sizes["all"] or 0))
        counted = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(11)), F.lit(1_000_000)) < rate
    else:
        raise ValueError(f"unknown background {background!r}")
    roles = {"target": F.coalesce(target, F.lit(False)), "background": counted}
    corpus = packed.Corpus(docs, id_col, text_col, roles)
    ranges, whole = corpus.ranges, corpus.chunks.groupBy("chunk")
    asked = whole.applyInArrow(lambda t: _asked(t, ranges), ASKED_DDL)
    told = cut_lineage(asked.groupBy("part").applyInArrow(_told, TOLD_DDL), "counts")
    types, n_target, n_background = (x or 0 for x in told.agg(F.sum("types"), F.sum("n_target"), F.sum("n_background")).first())
    matched = background == "all" and n_target > 0
    scales = (1.0, n_target / n_background if matched else 1.0)
    answers = told.select("chunk", "part", "target", "background").groupBy("chunk")
    scored = whole.cogroup(answers).applyInArrow(
        lambda t, a: _scored(t, a, ranges, types, (n_target, n_background), mu, scales), SCORES_DDL)
    return corpus.given_back(scored).withColumn("difference", F.col("loss_target") - F.col("loss_background"))
