import random

import pytest

from flowscope.llm import tokens as T

from .texts import SCHEMA, rows


@pytest.fixture(scope="module")
def counter():
    return T.Counter.of(T.VOCABULARY)


def library(counter, texts):
    return [len(e) for e in counter.model.encode_batch(texts, add_special_tokens=False)]


PIECES = [*"ab  \n\t'sltrevmd1 2!?'é ñ<|>", "　", " ", "'ll", "'re", "  ", "<|endoftext|>", "endoftext", "<|end", "中文",
          "Жя", "😀", "ǅ", "́", "\r\n", "\x1c", "'S", "'ſ", "٣", "Ⅷ", "²", "\x00"]


def test_as_the_library(counter):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    assert [int(c.sum()) for _, c in counter.encode(texts)] == library(counter, texts)


def test_splices_are_exact(counter):
    rng = random.Random(2)
    widened = chunks = 0
    for _ in range(600):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) * rng.randint(1, 6)
        n, c, w = T.spliced_count(counter, text, rng.choice([60, 80, 120]), rng.choice([4, 30, 40]))
        assert n == library(counter, [text])[0]
        chunks, widened = chunks + c, widened + w
    assert widened and chunks > 700


def test_overlap_is_widened_until_it_aligns(counter):
    text = "x" * 3000 + " and then words go on " * 50
    n, chunks, widened = T.spliced_count(counter, text, 500, 32)
    assert n == library(counter, [text])[0] and widened > 1


def test_query_form(spark, counter):
    data = rows()
    got = T.token_counts(spark.createDataFrame(data, SCHEMA), limit=100, chunk_chars=300, overlap_chars=64).collect()
    texts = [r[1] or "" for r in data]
    want = [(r[0], len(t.encode()), n, n > 100) for r, t, n in zip(data, texts, library(counter, texts))]
    assert sorted(map(str, want)) == sorted(str((r.id, r.n_bytes, r.n_tokens, r.over_limit)) for r in got)
    assert max(r.n_chunks for r in got) > 10
    assert T.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
