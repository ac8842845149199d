import base64
import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from flowscope.llm import fertility as Q

from .texts import SCHEMA, rows


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)


def test_counts_and_measures(spark):
    data = rows()
    got = Q.measure(spark.createDataFrame(data, SCHEMA), carry=["doc_id", "text"]).select("doc_id", "text", "fertility.*").collect()
    model = Q.encoder(Q.VOCABULARIES[0])[0]
    assert len(got) == len(data)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)
        ids = [t for w in model(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for t in w]
        counts = collections.Counter(ids)
        assert (r.tokens_a, r.distinct_tokens) == (len(ids), len(counts))
        bits = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()) if ids else 0.0
        most = math.log2(min(max(len(ids), 2), Q.FULL_TOKENS))
        assert r.entropy == pytest.approx(bits / most if len(ids) > 1 else 0.0)
    chinese = next(r for r in got if r.text and "中" in r.text)
    assert chinese.byte_share > 0 or chinese.tokens_a > 0


def test_verdict_and_columns(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).withColumn("kept", F.lit("clash"))
    judged = Q.judged(docs)
    assert judged.filter("kept is null or base_failed is null").isEmpty()
    assert judged.filter("base_failed and kept").isEmpty()
    good = Q.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in good.collect()) == sorted(r.doc_id or -1 for r in judged.filter("kept").collect())
    assert 12 not in [r.doc_id for r in good.collect()]


def test_bands_reject_and_fall_back_to_the_script(spark):
    prose = "The committee agreed on the following report about water and energy in the northern towns this year. " * 3
    text = " ".join(f"{w}{i}" for i, w in enumerate(prose.split()))
    noise = " ".join("�𐍈𐍉𐌰" for _ in range(80))
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "xx"), (3, noise, None), (4, text, None)], "doc_id bigint, text string, lang string")
    tight = {"latin": (0.1, 9, 0.1, 9, 0.0, 0.0), "cyrillic": (0, 9, 0, 9, 0, 0), "cjk": (0, 9, 0, 9, 0, 0), "other": (0.0, 9, 0.0, 9, 0.5, 0.0)}
    m = Q.measure(docs)
    got = {r.doc_id: r for r in m.select("doc_id", "fertility.*", Q.in_band(F.col("lang"), bands=tight).alias("ok")).collect()}
    assert got[1].ok and got[2].ok and got[4].ok and got[1].script == "latin"
    assert got[3].byte_share > 0.5 and not got[3].ok


PROSE = {
    "en": "The committee met on Tuesday to discuss how the new bridge should be paid for, and most members agreed that a small "
          "toll would be fair to residents. Some asked whether lorries could be charged more, since they wear out the road faster.",
    "de": "Der Ausschuss traf sich am Dienstag, um zu besprechen, wie die neue Brücke bezahlt werden soll, und die meisten "
          "Mitglieder waren sich einig, dass eine kleine Gebühr für die Anwohner gerecht wäre.",
    "fr": "Le comité s'est réuni mardi pour discuter de la manière dont le nouveau pont devrait être financé, et la plupart des "
          "membres ont convenu qu'un petit péage serait juste pour les habitants.",
    "es": "El comité se reunió el martes para discutir cómo se debería pagar el nuevo puente, y la mayoría de los miembros "
          "estuvo de acuerdo en que un pequeño peaje sería justo para los vecinos.",
    "vi": "Ủy ban đã họp vào thứ Ba để thảo luận về cách chi trả cho cây cầu mới, và hầu hết các thành viên đồng ý rằng một "
          "khoản phí nhỏ sẽ công bằng cho người dân.",
    "ru": "Комитет собрался во вторник, чтобы обсудить, как следует оплатить новый мост, и большинство членов согласились, что "
          "небольшая плата будет справедливой для жителей нашего города и соседних сёл.",
    "el": "Η επιτροπή συνεδρίασε την Τρίτη για να συζητήσει πώς θα πληρωθεί η νέα γέφυρα και τα περισσότερα μέλη συμφώνησαν "
          "ότι ένα μικρό τέλος θα ήταν δίκαιο.",
}


def test_production_bands(spark):
    rng = random.Random(5)

    def noise(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(n))

    small = "abcdefghijklmnopqrstuvwxyz"
    lines = "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(40))
    private = [chr(c) for c in range(0xE000, 0xF8FF)]
    han = [chr(c) for c in range(0x4E00, 0x9FA6)]
    bad = [(lang, noise(small, 300)) for lang in ("en", "de", "fr", "es")]
    bad += [(lang, lines) for lang in ("en", "es", None, "fi")]
    bad += [("en", noise(small + small.upper() + "0123456789", 25)), ("en", " ".join(rng.randbytes(8).hex() for _ in range(100)))]
    bad += [(None, noise(private, 100)), ("xx", noise(private, 100)), ("zh", noise(han, 100)), ("ja", noise(han, 100))]
    data = [(i, t, lang) for i, (lang, t) in enumerate(bad)] + [(100 + i, t, lang) for i, (lang, t) in enumerate(PROSE.items())]
    judged = Q.judged(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), carry=["doc_id", "lang"])
    rows = judged.select("doc_id", "base_failed", "kept", Q.in_band(F.col("lang")).alias("ok")).collect()
    assert len(rows) == len(data) and [r.doc_id for r in rows if r.doc_id < 100 and r.ok] == []
    assert [r.doc_id for r in rows if r.doc_id >= 100 and not r.kept] == []
    assert sum(not r.base_failed for r in rows if r.doc_id < 100) >= 10


def test_empty_table(spark):
    assert Q.judged(spark.createDataFrame([], SCHEMA)).count() == 0
