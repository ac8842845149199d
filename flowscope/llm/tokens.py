"""Exact token counts of whole texts with a byte-level BPE vocabulary, however long the text is.

Method. A text longer than ``chunk_chars`` is encoded in overlapping chunks with offsets. Each chunk gives the starts of
its pretokens (the stretches which the vocabulary's pattern splits off and which are merged on their own) and their
numbers of tokens. Two neighbouring chunks are spliced at a *stable* common boundary: a pretoken start which both have
inside the overlap, and which lies at least ``margin`` characters before the end of the left chunk. That is exact:

* the pattern has no look-behind, so two scans that start a pretoken at the same place go on alike from there;
* the left scan starts at a true boundary (by induction) and is undisturbed by the end of its chunk up to the margin,
  which exceeds the longest special token and the look-ahead of the pattern;
* the first pretoken of the right chunk is not trusted, as it may be the rest of a longer one.

If the overlap holds no such boundary, the left chunk is encoded again with twice the overlap, up to the whole text.

Encoding. The library pretokenises and merges; since a pretoken is merged on its own, the number of tokens of each
distinct pretoken is asked from the library once and kept by hash in the worker. Pretokens are cut vectorised for
characters whose classes are the same in all Unicode versions; a chunk with any other character is cut by the library
itself. Special tokens inside texts count one token each, as is the library's default.

Defined cases: a null text counts as empty, with no bytes and no tokens; rows are counted one by one, so repeated ids,
null ids and an empty table need no rule; other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.fertility import vocabulary_path
from flowscope.llm.words import hash_spans, mixed, pieces, symbol_table, worker_store

VOCABULARY = "byte_bpe_50k.json"
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
LIMIT = 1024
CACHE_PRETOKENS = 1_000_000
ENCODE_PRETOKENS = 20_000
PIECE_BYTES = 1 << 20
LETTER, NUMBER, SPACE, OTHER, BORDER = 1, 2, 3, 4, 5

#: The white space of the pattern, and blocks whose letters and numbers have not changed since they were
#: assigned.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
STABLE = ((0x0000, 0x0180), (0x0400, 0x0482), (0x2000, 0x2064), (0x20A0, 0x20AD), (0x3041, 0x3095), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    """Class of each character below 0x10000; zero where versions of Unicode may differ."""
    store = worker_store()
    if "classes" not in store:
        table = np.zeros(0x10000, np.uint8)
        for low, high in STABLE:
            for c in range(low, high):
                kind = unicodedata.category(chr(c))[0]
                table[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
        for c in WHITE_SPACE:
            table[c] = SPACE
        store["classes"] = table
    return store["classes"]


def pretoken_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Starts of pretokens; ``points`` are code points and ``kinds`` their classes, with a border after each text."""
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kinds[1:] != kinds[:-1]
    start |= kinds == BORDER
    white = kinds == SPACE
    # the last of a run of white space before a word stands alone, or in front of the word if it is a blank
    follows = np.zeros(n, bool)
    follows[1:] = white[:-1] & ~white[1:] & (kinds[1:] != BORDER)
    at = np.flatnonzero(follows)
    start[at - 1] = True
    taken = at[points[at - 1] == 0x20]
    start[taken] = False
    # contractions
    quotes = np.flatnonzero((points == 0x27) & start)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[kinds[quotes + 1] == LETTER]
    if len(quotes):
        one = points[quotes + 1]
        two = np.where(quotes + 2 < n, points[np.minimum(quotes + 2, n - 1)], 0)
        for tail in CONTRACTIONS:
            hit = quotes[(one == ord(tail[0])) & ((two == ord(tail[1])) if len(tail) == 2 else True)]
            start[hit + 1] = False
            after = hit + 1 + len(tail)
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Counter:
    """Tokens per pretoken of one vocabulary, kept in the worker."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.specials = sorted((t.content for t in self.model.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.margin = 8 + max([0, *map(len, self.specials)])
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int32)

    @classmethod
    def of(cls, vocabulary: str) -> Counter:
        store = worker_store()
        if ("counter", vocabulary) not in store:
            store["counter", vocabulary] = cls(vocabulary)
        return store["counter", vocabulary]

    def count_of(self, hashes: np.ndarray, spell) -> np.ndarray:
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_PRETOKENS:
            self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int32)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == distinct
        missing = np.flatnonzero(~known)
        if len(missing):
            counts = []
            for low in range(0, len(missing), ENCODE_PRETOKENS):
                asked = [spell(int(i)) for i in example[missing[low : low + ENCODE_PRETOKENS]]]
                counts.append(np.array([len(e) for e in self.model.encode_batch_fast(asked, add_special_tokens=False)], np.int32))
            at = np.searchsorted(self.hashes, distinct[missing])
            self.hashes = np.insert(self.hashes, at, distinct[missing])
            self.counts = np.insert(self.counts, at, np.concatenate(counts))
            at = np.searchsorted(self.hashes, distinct)
        return self.counts[at][inverse]

    def _segments(self, text: str) -> list[tuple[int, int, bool]]:
        """The text between special tokens, and these: ``(start, end, special)``."""
        found, at = [], 0
        if not any(s in text for s in self.specials):
            return [(0, len(text), False)]
        while at < len(text):
            hits = [(text.find(s, at), -len(s)) for s in self.specials if s in text[at:]]
            if not hits:
                break
            low, size = min(hits)
            found += [(at, low, False)] * (low > at) + [(low, low - size, True)]
            at = low - size
        return found + [(at, len(text), False)] * (at < len(text))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and numbers of tokens of the pretokens of each text; special tokens are pretokens of one token."""
        parts = [self._segments(t) for t in texts]
        plain = [(i, a, t[a:b]) for i, t in enumerate(texts) for a, b, special in parts[i] if not special]
        starts = [[np.array([a for a, _, special in p if special], np.int64)] for p in parts]
        counts = [[np.ones(len(s[0]), np.int64)] for s in starts]
        for (i, a, _), (s, c) in zip(plain, self._encode_plain([x for _, _, x in plain])):
            starts[i].append(s + a)
            counts[i].append(c)
        out = []
        for s, c in zip(starts, counts):
            s, c = np.concatenate(s), np.concatenate(c)
            order = np.argsort(s, kind="stable")
            out.append((s[order], c[order]))
        return out

    def _encode_plain(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not texts:
            return []
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        borders = np.cumsum(size + 1) - 1
        kinds = np.where(points < 0x10000, _classes()[points & 0xFFFF], 0).astype(np.uint8)
        kinds[borders] = BORDER
        begins = borders - size
        odd = np.unique(np.searchsorted(borders, np.flatnonzero(kinds == 0)))
        starts = pretoken_starts(points, kinds)
        starts = starts[kinds[starts] != BORDER]
        if len(odd):
            inside = np.isin(np.searchsorted(borders, starts), odd)
            own = [
                begins[i] + np.array([s for _, (s, _) in self._split(texts[i])], np.int64) for i in odd
            ]
            starts = np.sort(np.concatenate([starts[~inside], *own]))
        text = np.searchsorted(borders, starts)
        ends = np.minimum(np.append(starts[1:], len(points)), borders[text])
        symbols = symbol_table(0x10000, 3)
        folded = np.where(points < 0x10000, points, 0).astype(np.uint16)
        hashes = hash_spans(folded, starts, ends, symbols)
        wide = np.flatnonzero(points >= 0x10000)
        if len(wide):
            at = np.searchsorted(starts, wide, "right") - 1
            np.add.at(hashes, at, mixed(points[wide].astype(np.uint64) | ((wide - starts[at]).astype(np.uint64) << np.uint64(32))))
        counts = self.count_of(hashes, lambda i: joined[starts[i] : ends[i]]).astype(np.int64)
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        return [(starts[a:b] - begins[i], counts[a:b]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]

    def _split(self, text: str) -> list:
        """The library's own pretokens; byte-level offsets are in characters of the text."""
        return self.model.pre_tokenizer.pre_tokenize_str(text)


def spliced_count(counter: Counter, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
    """Tokens of one long text, the number of chunks, and how often an overlap had to be widened."""
    total, begin, chunks, widened = 0, 0, 0, 0
    end = min(len(text), chunk)
    starts, counts = counter.encode([text[:end]])[0]
    while end < len(text):
        wide = overlap
        while True:
            low, high = max(begin + 1, end - wide), min(len(text), max(end - wide, begin) + chunk)
            right_starts, right_counts = counter.encode([text[low:high]])[0]
            mine = starts + begin
            shared = np.intersect1d(mine[mine <= end - counter.margin], right_starts[1:] + low, assume_unique=True)
            if len(shared) and high > end:
                break
            widened += 1
            wide *= 2
            end = min(len(text), end + wide)
            starts, counts = counter.encode([text[begin:end]])[0]
            if end == len(text):
                break
        if end == len(text):
            break
        cut = int(shared[-1])
        total += int(counts[mine < cut].sum())
        kept = right_starts + low >= cut
        begin, end, chunks = cut, high, chunks + 1
        starts, counts = right_starts[kept] + low - cut, right_counts[kept]
    return total + int(counts.sum()), chunks + 1, widened


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, n_chunks, n_widened)`` per row."""

    def run(batches):
        counter = Counter.of(vocabulary)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                short = [t if len(t) <= chunk_chars else "" for t in texts]
                n = np.array([c.sum() for _, c in counter.encode(short)], np.int64)
                chunks, widened = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
                for i, t in enumerate(texts):
                    if len(t) > chunk_chars:
                        n[i], chunks[i], widened[i] = spliced_count(counter, t, chunk_chars, overlap_chars)
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(chunks), pa.array(widened)],
                    ["id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint, n_widened bigint")
