"""Expected grade of a text by ordinal regression with cumulative links on hashed words.

Method. Grades are ordered ``0 .. K - 1``. All thresholds share one weight vector:
``P(grade <= k) = sigmoid(t_k - x w)`` with ``t_0 < t_1 < ...``. ``x`` has one place for each hash of a word that a text
holds (presence, not number) and a few shares of the whole text. Fitting maximises the likelihood by AdaGrad over small
batches; thresholds are kept in order by fitting the logarithms of their gaps. Words in fewer than ``MIN_TEXTS`` texts
of the sample get no weight.

The model is fitted on the driver on at most ``max_sample`` rated rows, drawn by a hash of id and text; what the driver
sees are hashes of their distinct words, not texts. It is a table of ``2^BITS`` weights, whose size does not depend on the data, and is sent to the
tasks with the scoring function, which reads whole texts.

Defined cases: a null text has no words and is scored by the constant part; rows without a rating are scored but not
fitted on; different texts of an id count once each, repeated rows and repeated ratings once; without any rated row the
model predicts the middle; a tail probability equal to the threshold is selected; a very long text is one piece of work;
repeated rows are scored alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.scale import checked_broadcast
from flowscope.llm.words import Texts, pieces

BITS = 20
MIN_TEXTS = 5
MAX_SAMPLE = 20_000
SHARES = 6


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, place)`` pairs in order, and the shares of each text."""
    texts = Texts(column, "alnum")
    n = len(texts.n_words)
    place = (texts.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.sort((texts.text_of_word() << BITS) | place)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    raw = Texts(column)
    size = np.maximum(np.diff(raw.offsets), 1)
    data = raw.data
    upper = raw.per_text((data >= 0x41) & (data <= 0x5A)) / size
    digit = raw.per_text((data >= 0x30) & (data <= 0x39)) / size
    mark = raw.per_text((data > 0x20) & (data < 0x7F) & ~(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)) & ~((data >= 0x30) & (data <= 0x39))) / size
    distinct = np.bincount(key >> BITS, minlength=n) / np.maximum(texts.n_words, 1)
    length = np.log1p(raw.n_words) / 10
    word = raw.per_text(raw.inside) / np.maximum(raw.n_words, 1) / 10
    return key >> BITS, key & ((1 << BITS) - 1), np.stack([upper, digit, mark, distinct, length, word], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Weights of hashed words and of the shares, and the ordered thresholds."""

    words: np.ndarray
    shares: np.ndarray
    thresholds: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        row, place, shares = _features(column)
        return np.bincount(row, self.words[place], len(shares)) + shares @ self.shares

    def above(self, score: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each threshold."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(grades: np.ndarray, places: list[np.ndarray], shares: np.ndarray, n_grades: int, epochs: int = 12, batch: int = 256,
        rate: float = 0.15, decay: float = 2e-4, seed: int = 5) -> OrdinalModel:
    rng = np.random.default_rng(seed)
    size = np.array([len(p) for p in places], np.int64)
    flat = np.concatenate(places) if len(places) else np.empty(0, np.int64)
    often = np.bincount(flat, minlength=1 << BITS) >= MIN_TEXTS
    row = np.repeat(np.arange(len(places)), size)
    keep = often[flat]
    flat, row = flat[keep], row[keep]
    start = np.searchsorted(row, np.arange(len(places) + 1))
    at_most = np.array([np.mean(grades <= k) if len(grades) else (k + 1) / n_grades for k in range(n_grades - 1)])
    thresholds = np.log(np.clip(at_most, 0.01, 0.99) / np.clip(1 - at_most, 0.01, 0.99))
    base, gaps = thresholds[0], np.log(np.maximum(np.diff(thresholds), 0.05))
    w, v = np.zeros(1 << BITS), np.zeros(SHARES)
    gw, gv, gb, gg = np.full(1 << BITS, 1e-2), np.full(SHARES, 1e-2), 1e-2, np.full(len(gaps), 1e-2)
    for _ in range(epochs if len(places) else 0):
        order = rng.permutation(len(places))
        for low in range(0, len(order), batch):
            chosen = order[low : low + batch]
            n = size_ = start[chosen + 1] - start[chosen]
            inner = np.repeat(start[chosen] - np.concatenate([[0], np.cumsum(size_)[:-1]]), n) + np.arange(int(n.sum()))
            at, owner = flat[inner], np.repeat(np.arange(len(chosen)), n)
            score = np.bincount(owner, w[at], len(chosen)) + shares[chosen] @ v
            t = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            edge = np.concatenate([[-np.inf], t, [np.inf]])
            y = grades[chosen]
            upper, lower = _sigmoid(edge[y + 1] - score), _sigmoid(edge[y] - score)
            chance = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            slope = (du - dl) / len(chosen)
            touched, inverse = np.unique(at, return_inverse=True)
            g = np.bincount(inverse, slope[owner], len(touched)) + decay * w[touched]
            gw[touched] += g * g
            w[touched] -= rate * g / np.sqrt(gw[touched])
            g = slope @ shares[chosen] + decay * v
            gv += g * g
            v -= rate * g / np.sqrt(gv)
            dt = np.bincount(y, -du / len(chosen), n_grades)[:-1] + np.bincount(np.maximum(y - 1, 0), np.where(y > 0, dl, 0) / len(chosen), n_grades)[: n_grades - 1]
            g = dt.sum()
            gb += g * g
            base -= rate * g / np.sqrt(gb)
            if len(gaps):
                g = dt[::-1].cumsum()[::-1][1:] * np.exp(gaps)
                gg += g * g
                gaps = gaps - rate * g / np.sqrt(gg)
    return OrdinalModel(w.astype(np.float32), v, base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def rated_features(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, max_sample: int) -> DataFrame:
    """``(id, grade, places, shares)`` of at most ``max_sample`` rated rows, drawn by a hash of id and text.

    Equal rows of an id with the same grade count once, so that a draw is the same each time.
    """
    drawn = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).filter("id is not null and grade is not null")
    drawn = drawn.distinct().orderBy(F.xxhash64("id"), "id", "grade").limit(max_sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"))
    rated = texts.select("id", "hash").join(checked_broadcast(drawn, max_sample), "id").distinct()
    rows = rated.orderBy(F.xxhash64("hash", "grade"), "hash", "id", "grade").limit(max_sample)
    found = texts.join(checked_broadcast(rows.select("id", "hash").distinct(), max_sample), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    texts = found.join(checked_broadcast(rows, max_sample), ["id", "hash"])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, place, shares = _features(piece.column("text"))
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(place.astype(np.int32)))
                dense = pa.ListArray.from_arrays(pa.array((np.arange(piece.num_rows + 1) * SHARES).astype(np.int32)), pa.array(shares.reshape(-1)))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("hash"), piece.column("grade"), lists, dense], ["id", "hash", "grade", "places", "shares"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "hash", "grade", "text").mapInArrow(run, f"id {kind}, hash bigint, grade int, places array<int>, shares array<double>")


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
          max_sample: int = MAX_SAMPLE) -> OrdinalModel:
    held = rated_features(docs, ratings, id_col, text_col, grade_col, max_sample).toArrow()
    held = held.sort_by([("hash", "ascending"), ("id", "ascending"), ("grade", "ascending")])
    places = [np.asarray(x, np.int64) for x in held.column("places").to_pylist()]
    shares = np.array(held.column("shares").to_pylist(), np.float64).reshape(-1, SHARES)
    return fit(np.asarray(held.column("grade").to_pylist(), np.int64), places, shares, n_grades)


def graded(docs: DataFrame, model: OrdinalModel, tail: int, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``(id, expected_grade, tail_probability, selected)`` per row; the tail are grades of ``tail`` and more."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                above = model.above(model.scores(piece.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(above.sum(axis=1)), pa.array(above[:, tail - 1]), pa.array(above[:, tail - 1] >= least)],
                    ["id", "expected_grade", "tail_probability", "selected"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id bigint, expected_grade double, tail_probability double, selected boolean")
