import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.llm import packed
from flowscope.llm.repeats import remove_repeats
from flowscope.llm.words import Texts, hash_spans, rolling, symbol_table, whole_windows

from .texts import SCHEMA, rows


def brute_force(data, window):
    """Rows by position; a null id is larger than all others."""
    split = [(float("inf") if r[0] is None else r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data]
    low = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            low[tuple(w[k : k + window])] = min(low.get(tuple(w[k : k + window]), i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if low[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == float("inf") else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [13, 4])
def test_against_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(packed, "CHUNK_BYTES", 700)
    monkeypatch.setattr(packed, "RANGE_BYTES", 5000)
    data = rows()
    got = remove_repeats(spark.createDataFrame(data, SCHEMA).repartition(5), window=window).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = sorted(brute_force(data, window), key=key)
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got], key=key) == want
    assert any(r.n_removed for r in got)
    for r in got:
        assert sum(x["words"] for x in r.repeats) == r.n_removed


def test_many_equal_rows_make_no_large_chunk(spark, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK_BYTES", 4000)
    text, other = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    docs = spark.range(20_000).selectExpr("7L AS doc_id", f"'{text}' AS text").unionByName(
        spark.createDataFrame([(i, f"{other} {text} c{i}") for i in range(5)] + [(None, text)] * 30 + [(7, other)] * 3, "doc_id bigint, text string"))
    corpus = packed.Corpus(docs, "doc_id", "text")
    sizes = corpus.chunks.selectExpr("chunk", "octet_length(text) AS n", "copies").groupBy("chunk").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 4000 and corpus.chunks.agg(F.sum("copies")).first()[0] == docs.count()
    got = remove_repeats(docs, with_texts=False).groupBy("id", "n_words", "n_removed").count().collect()
    assert {(r.id, r.n_words, r.n_removed): r["count"] for r in got} == {
        (7, 40, 40): 20_003, (None, 40, 40): 30, (0, 81, 0): 1, **{(i, 81, 80): 1 for i in range(1, 5)}}


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    texts = Texts(pa.array(["ab  cd ab", None, "", "cd\tab", "ab"]))
    h = texts.hashes()
    assert texts.n_words.tolist() == [3, 0, 0, 2, 1]
    assert h[0] == h[2] == h[4] == h[5] and h[1] == h[3] and h[0] != h[1]
    pairs = rolling(h, 2)
    assert whole_windows(texts.first, 2, len(texts)).tolist() == [True, True, False, True, False]
    assert pairs[1] == pairs[3]


def test_long_spans_in_blocks(monkeypatch):
    from flowscope.llm import words

    data = np.random.default_rng(0).integers(0, 256, 5000).astype(np.uint8)
    starts = np.arange(0, 5000, 50)
    whole = hash_spans(data, starts, starts + 50, symbol_table(256, 1))
    monkeypatch.setattr(words, "HASH_BYTES", 333)
    assert (hash_spans(data, starts, starts + 50, symbol_table(256, 1)) == whole).all()


def test_packing_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 1000).astype(np.uint64))
    assert (packed.unpack_sorted(packed.pack_sorted(values, 5), 5) == values).all()
    full = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (packed.unpack_sorted(packed.pack_sorted(full, 8), 8) == full).all()
    assert len(packed.unpack_sorted(packed.pack_sorted(full[:0], 8), 8)) == 0
