"""Quality rules on how public tokenisers see a text, with bands per language, after a few plain counts.

Method. Each distinct word of a piece of text is encoded once per vocabulary, and the counts are carried back to all
places of the word, so that whole texts are measured at the price of their distinct words. A word stands for itself:
``fertility`` is defined on words as encoded alone, with the space in front that the vocabulary expects. Measured are
characters per token for each vocabulary, and, for the first of them, the share of byte-fallback tokens and the entropy
of the tokens, as a share of the largest entropy which a text of so many tokens, 1,024 at most, can have (beyond that
the entropy of ordinary prose no longer grows with its length).

A text is kept if it passes the base rules and each measure lies in the band of its language; a language without a band
takes that of its script (by the letters of the text), and an unknown script takes the widest. The lower limits of
characters per token are eased for texts of few tokens (``EASE``); the entropy of fewer than ``MIN_TOKENS`` tokens is not
judged. So random letters are told from prose in texts of 256 tokens or more, base64 and the like in texts of any length.

Defined cases: a null text has no words, like an empty one, and fails the base rules; a null language takes the band of
the script; repeated rows are judged alike; an empty table gives an empty table. The result is one struct column at the
end; an input column of the same name is replaced. All other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.llm.words import Texts, hash_spans, mixed, pieces, release_memory, rolling, spans, symbol_table, whole_windows, worker_store

VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_50k.json")
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_TOKENS = 64
FULL_TOKENS = 1024
CACHE_WORDS = 500_000
ENCODE_WORDS = 20_000
PIECE_BYTES = 1 << 20

#: Lowest and highest characters per token of the first vocabulary, lowest and highest of the second, highest share of
#: byte-fallback tokens, lowest relative entropy. The references are the two vocabularies themselves, not a corpus: words of
#: 3 to 10 random letters give 1.57 and 1.55 characters per token for a-z, 1.12 and 0.63 in Russian letters, 0.33 and 0.36 at
#: a byte share of 0.93 in Han signs; base64 lines give 1.23 and 1.31. Some sentences of prose gave en 4.0 and 4.0, de 2.8 and
#: 2.0, fr 3.1 and 2.6, es 2.7 and 2.3, vi 1.2 and 0.8, ru 2.3 and 0.8, zh 0.9 and 0.5, ja 0.9 and 0.6, ko 0.7 and 0.35; byte
#: shares are at most 0.16 except Khmer 0.36 and Amharic 0.83. A lower limit stands above the noise, by a few per cent.
WESTERN = (1.64, 8.0, 1.60, 8.0, 0.05, 0.45)
BANDS = {
    **dict.fromkeys(("en", "de", "fr", "es", "it", "pt", "nl"), WESTERN),
    "vi": (0.8, 8.0, 0.6, 8.0, 0.30, 0.45),
    "ru": (1.25, 8.0, 0.66, 8.0, 0.15, 0.40),
    "uk": (1.20, 8.0, 0.64, 8.0, 0.15, 0.40),
    "zh": (0.45, 4.0, 0.38, 4.0, 0.50, 0.30),
    "ja": (0.45, 4.0, 0.38, 4.0, 0.50, 0.30),
    "ko": (0.40, 4.0, 0.30, 4.0, 0.50, 0.30),
    "latin": (1.45, 8.0, 1.35, 8.0, 0.10, 0.45),
    "cyrillic": (1.15, 8.0, 0.40, 8.0, 0.30, 0.40),
    "cjk": (0.40, 4.0, 0.30, 4.0, 0.60, 0.30),
    "other": (0.33, 8.0, 0.25, 8.0, 0.90, 0.36),
}
#: A short text strays further from its language: below so many tokens, the lower limits are eased by the factor.
EASE = ((MIN_TOKENS, 0.8), (256, 0.9))
SCRIPT_OF = {"en": "latin", "de": "latin", "fr": "latin", "es": "latin", "it": "latin", "pt": "latin", "nl": "latin", "vi": "latin",
             "ru": "cyrillic", "uk": "cyrillic", "zh": "cjk", "ja": "cjk", "ko": "cjk"}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "tokens_a", "tokens_b", "byte_tokens",
            "distinct_tokens")
STRUCT = ("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES)
          + ", chars_per_token_a: double, chars_per_token_b: double, byte_share: double, entropy: double, script: string>")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary; an absolute path stands for itself."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """Encodes a list of words; and which ids are byte-fallback tokens."""
    store = worker_store()
    if ("encoder", name) not in store:
        path = vocabulary_path(name)
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
            store["encoder", name] = (lambda words: model.encode(words, num_threads=1), is_byte)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            store["encoder", name] = (
                lambda words: [e.ids for e in model.encode_batch_fast([" " + w for w in words], add_special_tokens=False)],
                np.zeros(model.get_vocab_size(), bool),
            )
    return store["encoder", name]


class WordTokens:
    """Numbers and, on request, ids of the tokens of words, kept by word hash for the life of the worker.

    Emptied when it holds ``CACHE_WORDS`` words.
    """

    def __init__(self, name: str, with_ids: bool):
        self.name, self.with_ids, self.hashes = name, with_ids, np.empty(0, np.uint64)
        self.where, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)

    @classmethod
    def of(cls, name: str, with_ids: bool = True) -> WordTokens:
        return worker_store().setdefault(("words", name, with_ids), cls(name, with_ids))

    def look_up(self, hashes: np.ndarray, word: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the tokens of each of the sorted distinct hashes; ``word(i)`` spells the i-th."""
        if len(self.hashes) > CACHE_WORDS:
            self.__init__(self.name, self.with_ids)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        missing = np.flatnonzero(~known)
        if len(missing):
            sizes, ids = [], [self.ids]
            for low in range(0, len(missing), ENCODE_WORDS):
                encoded = encoder(self.name)[0]([word(int(i)) for i in missing[low : low + ENCODE_WORDS]])
                sizes.append(np.array([len(e) for e in encoded], np.int32))
                if self.with_ids:
                    ids.append(np.fromiter((t for e in encoded for t in e), np.int32, int(sizes[-1].sum())))
            size = np.concatenate(sizes)
            where = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
            self.ids = np.concatenate(ids)
            at = np.searchsorted(self.hashes, hashes[missing])
            self.hashes = np.insert(self.hashes, at, hashes[missing])
            self.where, self.size = np.insert(self.where, at, where), np.insert(self.size, at, size)
            at = np.searchsorted(self.hashes, hashes)
        return self.where[at], self.size[at]


def _repeats(texts: Texts, h: np.ndarray, k: int) -> np.ndarray:
    """Words in windows of ``k`` words which stand twice or more in their text."""
    n = len(h)
    valid = whole_windows(texts.first, k, n)
    at = np.flatnonzero(valid)
    owner = texts.text_of_word()[at].astype(np.uint64)
    key = mixed(rolling(h, k)[at] ^ mixed(owner + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.subtract.at(change, np.minimum(at[twice] + k, n), 1)
    return texts.words_per_text(np.cumsum(change[:n]) > 0)


def _repeated_lines(texts: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends, _ = spans(texts.data, texts.offsets, texts.data != 0x0A)
    words = np.concatenate([[0], np.cumsum(texts.inside)])
    worded = words[ends] > words[starts]
    starts, ends = starts[worded], ends[worded]
    owner = np.searchsorted(texts.offsets, starts, "right") - 1
    key = mixed(hash_spans(texts.data, starts, ends, symbol_table(256, 2)) ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    again = order[1:][key[order][1:] == key[order][:-1]]
    return np.bincount(owner[again], minlength=len(texts.n_words))


def _scripts(texts: Texts) -> list[str]:
    """The script most letters of a text belong to, by the lead bytes of UTF-8."""
    data, inside = texts.data, texts.inside
    latin = texts.per_text(inside & (((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | (data >= 0xC3) & (data <= 0xCA)))
    cyrillic = texts.per_text((data >= 0xD0) & (data <= 0xD3))
    cjk = texts.per_text((data >= 0xE3) & (data <= 0xED))
    rest = texts.per_text(inside & ((data >= 0xCB) & (data <= 0xCF) | (data >= 0xD4) & (data <= 0xE2) | (data >= 0xEE)))
    counts = np.stack([latin, cyrillic, cjk, rest])
    names = ("latin", "cyrillic", "cjk", "other")
    return [names[i] if n else "other" for i, n in zip(counts.argmax(axis=0), counts.max(axis=0))]


def _measure(column: pa.Array, vocabularies: tuple[str, str]) -> pa.StructArray:
    texts = Texts(column)
    n_texts = len(texts.n_words)
    h = texts.hashes()
    codepoint = (texts.data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": texts.n_words,
        "word_chars": texts.per_text(texts.inside & codepoint),
        "n_symbols": texts.per_text(symbol[texts.data]),
        "n_dup_lines": _repeated_lines(texts),
        "n_repeat_words": _repeats(texts, h, REPEAT_WINDOW),
    }
    distinct, example, inverse = np.unique(h, return_index=True, return_inverse=True)
    body = texts.data.tobytes()
    owner = texts.text_of_word()

    def spell(i: int) -> str:
        at = example[i]
        return body[texts.starts[at] : texts.ends[at]].decode("utf-8", "replace")

    first = WordTokens.of(vocabularies[0])
    where, size = first.look_up(distinct, spell)
    is_byte = encoder(vocabularies[0])[1]
    size_of_word = size[inverse]
    out["tokens_a"] = np.bincount(owner, size_of_word, n_texts).astype(np.int64)
    total = int(size_of_word.sum())
    position = np.arange(total) - np.repeat(np.cumsum(size_of_word) - size_of_word, size_of_word)
    ids = first.ids[np.repeat(where[inverse], size_of_word) + position].astype(np.int64)
    owner_of_token = np.repeat(owner, size_of_word)
    out["tokens_b"] = np.bincount(owner, WordTokens.of(vocabularies[1], False).look_up(distinct, spell)[1][inverse], n_texts).astype(np.int64)
    out["byte_tokens"] = np.bincount(owner_of_token, is_byte[ids], n_texts).astype(np.int64)
    key = np.sort((owner_of_token << 32) | ids)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.empty(0, np.int64)
    count = np.diff(np.append(start, total))
    text = (key[start] >> 32) if total else start
    out["distinct_tokens"] = np.bincount(text, minlength=n_texts).astype(np.int64)
    n = np.maximum(out["tokens_a"], 1)
    spread = np.log2(n) - np.bincount(text, count * np.log2(count), n_texts) / n
    entropy = np.where(out["tokens_a"] > 1, spread / np.log2(np.clip(n, 2, FULL_TOKENS)), 0.0)
    chars = out["word_chars"]
    arrays = [pa.array(out[m].astype(np.int64)) for m in MEASURES] + [
        pa.array(chars / np.maximum(out["tokens_a"], 1)), pa.array(chars / np.maximum(out["tokens_b"], 1)),
        pa.array(out["byte_tokens"] / n), pa.array(entropy), pa.array(_scripts(texts), pa.string())]
    return pa.StructArray.from_arrays(arrays, [*MEASURES, "chars_per_token_a", "chars_per_token_b", "byte_share", "entropy", "script"])


def measure(docs: DataFrame, text_col: str = "text", vocabularies: tuple[str, str] = VOCABULARIES, out: str = "fertility",
            carry: list[str] | None = None) -> DataFrame:
    """The input (or its columns ``carry``) with a struct column of counts and measures of the whole text."""
    carried = [c for c in (docs.columns if carry is None else carry) if c != out]
    source = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carried) + f", `{out}` {STRUCT}"

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "__text", PIECE_BYTES):
                columns = [piece.column(i) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*columns, _measure(piece.column("__text"), vocabularies)], [*carried, out])
            release_memory()

    return source.mapInArrow(run, schema)


def base_failed(m: str = "fertility") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def in_band(lang: Column, m: str = "fertility", bands: dict = BANDS, script_of: dict = SCRIPT_OF) -> Column:
    """Whether all measures lie in the band of the language, or else of the script."""
    named = F.create_map(*[F.lit(x) for pair in {k: k if k in bands else v for k, v in script_of.items()}.items() for x in pair])
    script = F.coalesce(F.try_element_at(named, F.coalesce(lang.cast("string"), F.lit(""))), F.col(f"{m}.script"))
    a, b, share, entropy = (F.col(f"{m}.{c}") for c in ("chars_per_token_a", "chars_per_token_b", "byte_share", "entropy"))
    n = F.col(f"{m}.tokens_a")
    ease = F.lit(1.0)
    for below, factor in reversed(EASE):
        ease = F.when(n < below, factor).otherwise(ease)
    inside = F.lit(None).cast("boolean")
    for name, (low_a, high_a, low_b, high_b, most_bytes, low_entropy) in bands.items():
        held = (a >= ease * low_a) & (a <= high_a) & (b >= ease * low_b) & (b <= high_b) & (share <= most_bytes)
        held = held & ((n < MIN_TOKENS) | (entropy >= low_entropy))
        inside = F.when(script == name, held).otherwise(inside)
    return F.coalesce(inside, F.lit(True))


def judged(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", carry: list[str] | None = None,
           vocabularies: tuple[str, str] = VOCABULARIES, bands: dict = BANDS) -> DataFrame:
    """``measure`` with the verdict columns ``base_failed`` and ``kept``, which replace input columns of these names."""
    measured = measure(docs, text_col, vocabularies, carry=carry)
    verdict = ~base_failed() & in_band(F.col(f"`{lang_col}`"), bands=bands)
    return measured.withColumns({"base_failed": base_failed(), "kept": verdict})


def keep_good(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with the input columns."""
    measured = measure(docs, text_col, out="__fertility")
    verdict = ~base_failed("__fertility") & in_band(F.col(f"`{lang_col}`"), "__fertility")
    return measured.filter(verdict).select(*[F.col(f"`{c}`") for c in docs.columns])
