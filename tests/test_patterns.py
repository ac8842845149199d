import random

import pytest

from flowscope.operators import patterns as P


def brute(texts, words):
    out = []
    for i, text in texts:
        for k, word in words:
            at = (text or "").find(word) if word else -1
            while at >= 0:
                out.append((i, at + len(word) - 1, k, word))
                at = text.find(word, at + 1)
    return sorted(out)


def found(spark, texts, words):
    t = spark.createDataFrame(texts, "doc long, body string").repartition(3)
    w = spark.createDataFrame(words, "pattern int, word string")
    return sorted(tuple(r) for r in P.pattern_hits(t, "doc", "body", w).collect())


CASES = [
    (0, "aaaaaaaaaa"), (1, None), (2, ""), (3, "ab"), (4, "x" * 255 + "needle" + "y" * 300 + "needle"),
    (5, "\n..\\../é😀é😀é" * 60), (6, "b" * 700), (7, "a"),
]
WORDS = [(0, "a"), (1, "aa"), (2, "aaa"), (3, "needle"), (4, "😀é"), (5, "../"), (6, "b" * 300), (7, None), (8, ""), (9, "aa"), (10, "..\\../é😀é😀é\n")]


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_hits_equal_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(P, "BROADCAST_ROWS", broadcast_rows)
    words = [(k, w) for k, w in WORDS]
    assert found(spark, CASES, words) == brute(CASES, words)


def test_ten_thousand_patterns(spark):
    draw = random.Random(5)
    texts = [(i, "".join(draw.choice("abc/.") for _ in range(draw.randrange(900)))) for i in range(60)]
    words = [(k, "".join(draw.choice("abc/.") for _ in range(draw.randrange(4, 14)))) for k in range(10_000)]
    assert found(spark, texts, words) == brute(texts, words)


def test_empty_tables(spark):
    assert found(spark, CASES[:1], []) == [] and found(spark, [], WORDS) == []


def test_equal_words_and_rows_repeat_their_hits(spark):
    assert found(spark, [(1, "aa"), (1, "aa")], [(1, "aa"), (2, "aa")]) == [(1, 1, 1, "aa"), (1, 1, 1, "aa"), (1, 1, 2, "aa"), (1, 1, 2, "aa")]
