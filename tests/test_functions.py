import base64
import math
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from flowscope.functions import net as N
from flowscope.functions import patterns as P
from flowscope.functions import text as X


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, s {kind}")
    return [r[1] for r in sorted(df.select("i", column).collect())]


def test_addresses(spark):
    rows = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "01.2.3.4", "1.2.3", "", None]
    assert values(spark, rows, N.is_ipv4("s")) == [True, True, True, False, False, False, False, False]
    assert values(spark, rows, N.ipv4_to_long("s")) == [16909060, 4294967295, 0] + [None] * 5
    back = N.long_to_ipv4(N.ipv4_to_long("s"))
    assert values(spark, rows, back) == rows[:3] + [None] * 5


def test_address_classes_are_half_open(spark):
    rows = ["1.0.0.1", "1.0.0.2", "127.0.0.0", "127.0.0.1", "191.255.255.254", "191.255.255.255", "192.0.1.1",
            "192.0.1.2", "224.0.0.1", "224.0.0.2", "239.255.255.254", "240.0.0.1"]
    assert values(spark, rows, N.address_class("s")) == [0, 1, 1, 2, 2, 0, 0, 3, 0, 4, 4, 0]


def test_timestamps(spark):
    rows = ["1/20/19-19:03:00.698841", "01/20/19-19:03:00.698841", "12/05/19-06:07:08", "-", "", None]
    assert values(spark, rows, N.epoch_micros("s")) == [1548010980698841] * 2 + [1575526028000000] + [None] * 3


@pytest.mark.parametrize("text", ["a%41b", "a+b%20c", "100%", "%zz%4", "%e4%bd%a0", "x%25y", "", "%3Cscript%3E?%3D"])
def test_percent_decode(spark, text):
    assert values(spark, [text], X.percent_decode("s")) == [unquote(text)]


def test_query_string(spark):
    rows = ["/a", "/a?b=1", "/a?b?c=2?d", "?x", "/a?", None]
    assert values(spark, rows, X.query_string("s")) == ["", "b=1", "bc=2d", "x", "", None]


def test_base64_calls(spark):
    code = base64.b64encode("wörld!".encode()).decode().rstrip("=")
    rows = [f"x=base64_decode({code})&y", "base64_decode(aGk=) base64_decode(!aG#k)", "base64_decode(a)", "plain", None]
    got = values(spark, rows, X.expand_base64_calls("s"))
    assert got == ["x=base64_decode(wörld!)&y", "base64_decode(hi) base64_decode(hi)", "base64_decode(a)", "plain", None]


def test_normalise(spark):
    rows = ["%2FPATH/123/路径?go=HTTPS://x.org/1", "\nA1b22\n"]
    assert values(spark, rows, X.normalise_url("s")) == ["/path/0/?go=https://x.org/0", "a0b0"]
    assert values(spark, ["x?u=http://a.b/c12"], X.normalise_query("s")) == ["u=http://u/c0"]


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "a😀bc", "hello world"])
def test_bigrams_drop_the_last(spark, text):
    assert values(spark, [text], X.char_ngrams("s")) == [[text[i:i + 2] for i in range(len(text) - 2)]]


def test_tokens_and_word_ngrams(spark):
    text = "id=1 <script>alert('x')</script> http://abc \"q\""
    tokens = values(spark, [text], X.attack_tokens("s"))[0]
    assert tokens == ["id=", "1", "<script>", "alert(", "'x'", ")", "</script>", "http://a", "bc", '"q"']
    grams = values(spark, [text], X.word_ngrams(X.attack_tokens("s")))[0]
    assert grams == tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]
    assert values(spark, ["!!", "one"], X.word_ngrams(X.attack_tokens("s"))) == [[], ["one"]]


def test_statistics(spark):
    text = "HTTPS://a.b/<SCRIPT>,alert(Cookie)/"
    entropy = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
    got = values(spark, [text], X.statistic_vector("s", range(6)))[0]
    words = len(re.findall("|".join(f"({w})" for w in P.SUSPICIOUS_WORDS), text, re.I))
    assert got[:5] == [len(text), 1, 7, words, 1]
    assert got[5] == pytest.approx(entropy)
    assert values(spark, ["", "aaaa"], X.char_entropy("s")) == [0.0, 0.0]
    assert values(spark, ["eval eval src=src= EVAL"], X.suspicious_word_vector("s"))[0][11:13] == [2, 2]


def test_word_hits_find_overlaps(spark):
    rows = ["aaaa", "xaba.abab", "", None, "/../../../../../../../../"]
    words = ("aa", "aba", "/../../../../../../")
    want = []
    for text in rows:
        hits = [] if text is None else [
            (i + len(w) - 1, k, w) for k, w in enumerate(words) for i in range(len(text)) if text.startswith(w, i)
        ]
        want.append(hits)
    got = values(spark, rows, X.word_hits("s", words))
    assert [sorted(map(tuple, g), key=lambda h: (h[1], h[0])) for g in got] == want


def test_traversal_words(spark):
    rows = ["/x" + w + "y" for w in P.TRAVERSAL_WORDS] + ["/../etc/passwd", "/%5C..", "/"]
    assert values(spark, rows, X.has_traversal("s")) == [True] * 17 + [False] * 3


def test_expressions_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a",)], "s string").select(
        X.normalise_url("s"), X.statistic_vector("s"), X.char_ngrams("s"), X.word_hits("s")
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ScalaUDF" not in plan
    assert df.select(F.lit(1)).count() == 1
