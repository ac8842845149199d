"""Small documents with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_words bigint, id string, fp int"


def words(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def rows(seed=3):
    rng = random.Random(seed)
    passage = words(rng, 30, 500)
    base = [words(rng, 60, 400) for _ in range(8)]
    texts = [*base, base[0], base[0], base[1] + " w1", base[2].upper(), "", "   \n\t ", "one two", None, None]
    texts += [words(rng, 20) + " " + passage + "\n" + words(rng, 10, 300) for _ in range(6)]
    texts += ["a b c d e f g h " * 20, "same line\nsame line\nother\n\nsame line", "# * $ é 中文 < > " * 9, words(rng, 6000, 3000), passage[:40]]
    out = [(i, t, ("en", "de", None)[i % 3], ("big", "big", "small", None)[i % 4], 7, "x", 1) for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, base[3], None, None, None, None, None), (None, "lonely text without a number", None, "", None, None, None)]
    return out
