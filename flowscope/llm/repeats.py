"""Removal of word sequences which also stand in an earlier document, found through fixed-block anchors.

Method. Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words; any window of
``window`` words holds at least one whole block of its own document. All rolling windows of the block length probe the
blocks of the corpus. Where a probe meets a block of another place, the hit is extended: the full windows around it are
compared by 96-bit hashes, and the smallest document of each is found. Consecutive removed windows are joined to
maximal repeats.

Both comparisons go through the packed exchange of ``packed.py``: probes as sorted 30-bit keys within their range, of
which a few in ten thousand are false and fall out at the extension; full windows as 96-bit hashes with the smallest
document of the chunk. No pairs of documents are formed, so a passage shared by any number of documents costs one key
per chunk.

Defined cases: a null or short text has no window and keeps all its words; a null id counts as larger than all others;
rows with equal ids never remove each other's words; repeated rows are worked on once and all get the result; a very long
text is one chunk; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowscope.llm import packed
from flowscope.llm.words import STEP, Texts, covered, rolling, whole_windows
from flowscope.operators.scale import cut_lineage

WINDOW = 13
LAST = np.iinfo(np.int64).max
OTHER_STEP = 0x9FB21C651E98DF25

ASKED = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("ids", pa.binary())])
FOUND = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("keys", pa.binary())])
ASKED_DDL = "chunk int, part int, keys binary, checks binary, ids binary"
FOUND_DDL = "chunk int, part int, keys binary"
SPANS_DDL = "id bigint, hash bigint, copies bigint, n_words bigint, n_removed bigint, kept_sha256 string, repeats array<struct<first:int,words:int>>, kept string"
SPANS = pa.schema([
    ("id", pa.int64()), ("hash", pa.int64()), ("copies", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ("repeats", pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))), ("kept", pa.string()),
])


def _short_keys(h: np.ndarray, block: int, ranges: int) -> np.ndarray:
    """Range and 30-bit key of every rolling window of the block length, as one number."""
    g = rolling(h, block)
    return (packed.ranges_of(g, ranges) << np.uint64(30)) | (g & np.uint64((1 << 30) - 1))


def _probes(chunk_table: pa.Table, block: int, ranges: int) -> pa.Table:
    """Distinct probe keys of a chunk; two bits say whether a reference block and whether several places have the key."""
    texts = Texts(chunk_table.column("text"))
    key = _short_keys(texts.hashes(), block, ranges)
    valid = whole_windows(texts.first, block, len(texts))
    place = np.arange(len(texts)) - np.repeat(texts.first[:-1], texts.n_words)
    aligned = (place[: len(key)] % block == 0)[valid].astype(np.uint64)
    both = np.sort((key[valid] << np.uint64(1)) | aligned)
    first = packed.runs(both >> np.uint64(1))
    last = np.append(first[1:], len(both)) - 1 if len(first) else first
    distinct = both[first] >> np.uint64(1)
    several = (last > first).astype(np.uint64)
    flagged = (distinct << np.uint64(2)) | (several << np.uint64(1)) | (both[last] & np.uint64(1))
    chunk = chunk_table.column("chunk")[0].as_py()
    low = np.uint64((1 << 32) - 1)
    rows = [
        (chunk, part, packed.pack_sorted(flagged[at] & low, 4), None, None)
        for part, at in packed.by_range(flagged >> np.uint64(32))
    ]
    return packed.table(ASKED, rows)


def _anchored(range_table: pa.Table) -> pa.Table:
    """For each chunk, its keys which are a reference block somewhere and stand in more than one place."""
    chunks = range_table.column("chunk").to_pylist()
    lists = [packed.unpack_sorted(blob, 4) for blob in range_table.column("keys").to_pylist()]
    together = np.sort(np.concatenate(lists))
    first = packed.runs(together >> np.uint64(2))
    count = np.diff(np.append(first, len(together)))
    flags = np.bitwise_or.reduceat(together & np.uint64(3), first)
    hot = (together[first] >> np.uint64(2))[((flags & np.uint64(1)) > 0) & ((count > 1) | (flags > 1))]
    part = range_table.column("part")[0].as_py()
    rows = []
    for chunk, keys in zip(chunks, lists):
        own = keys >> np.uint64(2)
        own = own[np.isin(own, hot, assume_unique=True, kind="sort")] if len(hot) else own[:0]
        if len(own):
            rows.append((chunk, part, packed.pack_sorted(own, 4)))
    return packed.table(FOUND, rows)


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def _ids(chunk_table: pa.Table) -> np.ndarray:
    return chunk_table.column("id").fill_null(LAST).to_numpy()


def _extended(chunk_table: pa.Table, found: pa.Table, window: int, block: int, ranges: int) -> pa.Table:
    """Full windows around each hit, with a second hash and the smallest document of the chunk."""
    if not chunk_table.num_rows or not found.num_rows:
        return packed.table(ASKED, [])
    texts = Texts(chunk_table.column("text"))
    h = texts.hashes()
    hot = np.sort(np.concatenate([
        (np.uint64(part) << np.uint64(30)) | packed.unpack_sorted(blob, 4)
        for part, blob in zip(found.column("part").to_pylist(), found.column("keys").to_pylist())
    ]))
    hit = _in_sorted(_short_keys(h, block, ranges), hot) & whole_windows(texts.first, block, len(texts))
    valid = whole_windows(texts.first, window, len(texts))
    before = np.concatenate([[0], np.cumsum(hit)])
    span = window - block + 1
    n = len(valid)
    take = np.flatnonzero(valid & (before[span : span + n] > before[:n])) if n else np.empty(0, np.int64)
    full, check = rolling(h, window)[take], rolling(h, window, OTHER_STEP)[take] & np.uint64((1 << 32) - 1)
    document = _ids(chunk_table)[texts.text_of_word()[take]]
    order = np.lexsort((document, check, full))
    full, check, document = full[order], check[order], document[order]
    first = packed.runs(full * np.uint64(STEP) + check) if len(full) else np.empty(0, np.int64)
    full, check, document = full[first], check[first], document[first]
    chunk = chunk_table.column("chunk")[0].as_py()
    rows = [
        (chunk, part, packed.pack_sorted(full[at], 8), packed.planes(check[at], 4), packed.planes(document[at].view(np.uint64), 8))
        for part, at in packed.by_range(packed.ranges_of(full, ranges))
    ]
    return packed.table(ASKED, rows)


def _earlier(range_table: pa.Table) -> pa.Table:
    """For each chunk, its windows which start in a document smaller than all of the chunk that have them."""
    chunks = range_table.column("chunk").to_pylist()
    full = [packed.unpack_sorted(b, 8) for b in range_table.column("keys").to_pylist()]
    check = [packed.unplanes(b, 4) for b in range_table.column("checks").to_pylist()]
    document = [packed.unplanes(b, 8).view(np.int64) for b in range_table.column("ids").to_pylist()]
    sizes = np.array([len(x) for x in full])
    f, c, d = np.concatenate(full), np.concatenate(check), np.concatenate(document)
    source = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((c, f))
    first = packed.runs(f[order] * np.uint64(STEP) + c[order])
    low = np.minimum.reduceat(d[order], first)
    smallest = np.empty(len(f), np.int64)
    smallest[order] = np.repeat(low, np.diff(np.append(first, len(f))))
    late = smallest < d
    part = range_table.column("part")[0].as_py()
    rows = [(chunks[i], part, packed.pack_sorted(np.unique(f[late & (source == i)]), 8)) for i in np.unique(source[late])]
    return packed.table(FOUND, rows)


def _removed(chunk_table: pa.Table, found: pa.Table, window: int, with_texts: bool) -> pa.Table:
    if not chunk_table.num_rows:
        return SPANS.empty_table()
    texts = Texts(chunk_table.column("text"))
    n = len(texts)
    full, valid = rolling(texts.hashes(), window), whole_windows(texts.first, window, n)
    at = np.flatnonzero(valid)
    ids = _ids(chunk_table)
    own, document = full[at], ids[texts.text_of_word()[at]]
    order = np.argsort(own, kind="stable")
    first = packed.runs(own[order])
    late = np.zeros(len(own), bool)
    if len(first):
        low = np.minimum.reduceat(document[order], first)
        late[order] = np.repeat(low, np.diff(np.append(first, len(own)))) < document[order]
    if found.num_rows:
        earlier = np.sort(np.concatenate([packed.unpack_sorted(b, 8) for b in found.column("keys").to_pylist()]))
        late |= _in_sorted(own, earlier)
    marked = np.zeros(len(valid), bool)
    marked[at] = late
    gone = covered(marked, window, n)
    n_removed = texts.words_per_text(gone)
    digests, repeats, kept = _describe(texts, gone, n_removed, with_texts)
    return pa.Table.from_arrays(
        [*[chunk_table.column(c).combine_chunks() for c in ("id", "hash", "copies")], pa.array(texts.n_words), pa.array(n_removed), pa.array(digests, pa.string()),
         pa.array(repeats, SPANS.field("repeats").type), pa.array(kept, pa.string())], schema=SPANS)


def _describe(texts: Texts, gone: np.ndarray, n_removed: np.ndarray, with_texts: bool):
    """Digest and, on request, the removed spans and the text of the kept words, joined by one space."""
    inside = texts.inside.copy()
    data = texts.data.copy()
    dropped = np.flatnonzero(gone)
    change = np.zeros(len(data) + 1, np.int32)
    change[texts.starts[dropped]] += 1
    np.subtract.at(change, texts.ends[dropped], 1)
    inside &= np.cumsum(change[:-1]) == 0
    stay = ~gone
    ends = texts.ends[stay]
    owner = texts.text_of_word()[stay]
    followed = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.empty(0, bool)
    gaps = ends[followed]
    data[gaps] = 0x20
    inside[gaps] = True
    position = np.concatenate([[0], np.cumsum(inside)])[texts.offsets]
    joined = data[inside].tobytes()
    digests, repeats, kept = [], [], []
    for i in range(len(texts.n_words)):
        body = joined[position[i] : position[i + 1]]
        digests.append(hashlib.sha256(body).hexdigest())
        if with_texts:
            kept.append(body.decode("utf-8", "replace"))
            own = gone[texts.first[i] : texts.first[i + 1]].astype(np.int8)
            edges = np.flatnonzero(np.diff(own, prepend=0, append=0))
            repeats.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
        else:
            kept.append(None)
            repeats.append(None)
    return digests, repeats, kept


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_texts: bool = True
) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, repeats, kept)`` per document.

    ``repeats`` lists the maximal removed runs of words; it and ``kept`` are null without ``with_texts``.
    """
    block = (window + 1) // 2
    corpus = packed.Corpus(docs, id_col, text_col)
    ranges, whole = corpus.ranges, corpus.chunks.groupBy("chunk")
    probes = whole.applyInArrow(lambda t: _probes(t, block, ranges), ASKED_DDL)
    anchored = probes.select("chunk", "part", "keys").groupBy("part").applyInArrow(_anchored, FOUND_DDL)
    windows = whole.cogroup(anchored.groupBy("chunk")).applyInArrow(
        lambda t, f: _extended(t, f, window, block, ranges), ASKED_DDL)
    earlier = cut_lineage(windows.groupBy("part").applyInArrow(_earlier, FOUND_DDL), "repeats")
    left = whole.cogroup(earlier.groupBy("chunk")).applyInArrow(lambda t, f: _removed(t, f, window, with_texts), SPANS_DDL)
    return corpus.given_back(left)
