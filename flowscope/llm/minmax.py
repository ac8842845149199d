"""Near-duplicate documents by min-max hashing, with every link confirmed on the whole shingle sets.

Method. A document is the set of its distinct shingles, hashed to 64 bits. Under each of ``BANDS * ROWS / 2`` permutations
both the smallest and the largest hash are kept, so a signature of ``BANDS * ROWS`` values costs half the evaluations and
varies less. Bands of ``ROWS`` values are hashed to buckets; two sets of similarity 0.8 share one of 40 bands of 4 values
but for one pair in 10^9.

Equal sets are collapsed first. Candidates come out of the buckets in rounds, so that a crowd of near copies costs a
candidate each and not one per pair:

* In a bucket the set which collides with the most others is the hub. Each set is compared with the hub it shares most
  buckets with. Buckets whose sets are all in one component are done; the others go into the next round.
* After ``STARS`` rounds the sets of the buckets that still hold several components are compared with one another,
  crowded buckets in tiles: first by signature (a link agrees in less than ``LEAST`` of the values once in 10^10 pairs),
  then by the ``SKETCH`` smallest 32-bit hashes, which are the whole set unless it is larger. A tile returns as many links
  as join what it joins; pairs of larger sets which the sketch leaves in doubt are all returned.

A pair is compared on the whole sets: the texts of both are read again and intersected. Links are joined to components,
which are named by their smallest id.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text shorter than a shingle is one
shingle; a null id belongs to its component but does not name it, and a component of null ids has a null name and keeps
all its rows; repeated rows give repeated result rows; of different texts with the same id each has its own component,
and ``kept`` is true for all rows whose id names their component; a very long text is one piece of work; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.llm.scale import ID_ROWS, checked_broadcast
from flowscope.llm.words import STEP, Texts, mixed, pieces, release_memory, rolling, whole_windows
from flowscope.operators.components import connected_components
from flowscope.operators.scale import cut_lineage

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 40, 4
STARS = 2
LEAST = 0.6
SKETCH = 1024
TILE = 2048
SEED = 13


def _sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h = texts.hashes()
    whole = rolling(h, size)
    valid = whole_windows(texts.first, size, len(texts))
    out = []
    for i, n in enumerate(texts.n_words.tolist()):
        a = int(texts.first[i])
        if n >= size:
            out.append(np.unique(whole[a : a + n - size + 1][valid[a : a + n - size + 1]]))
        else:
            out.append(rolling(h[a : a + n], n) if n else np.empty(0, np.uint64))
    return out


def _keys(sets: list[np.ndarray]) -> list[bytes]:
    """128-bit digest of each set."""
    out = []
    for s in sets:
        with np.errstate(over="ignore"):
            out.append(mixed(s).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mixed(s ^ np.uint64(STEP))).tobytes() if len(s) else bytes(16))
    return out


def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = BANDS * ROWS // 2
    return rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _min_max(sets: list[np.ndarray], seed: int) -> np.ndarray:
    """Signatures of non-empty sets: minima and maxima under each permutation, in turn."""
    joined = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    for i, (shift, factor) in enumerate(zip(*_permutations(seed))):
        x = (joined ^ shift) * factor
        x ^= x >> np.uint64(31)
        x *= factor
        out[2 * i] = np.minimum.reduceat(x, first)
        out[2 * i + 1] = np.maximum.reduceat(x, first)
    return out.T


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    values = mixed(signatures).reshape(len(signatures), BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(STEP) * np.ones((len(signatures), 1), np.uint64)
    for r in range(ROWS):
        out = mixed(out + values[:, :, r] * np.uint64(2 * r + 1))
    return out


SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
SIGNED_DDL = "id bigint, n bigint, key binary, bands array<bigint>, sig binary"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(id, n, key, bands, sig)``: set size, digest, band hashes and the last byte of each signature value."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = _sets(Texts(piece.column("text"), lower=True), shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                sig: list = [None] * len(sets)
                if full:
                    values = _min_max([sets[i] for i in full], seed)
                    last, keys = mixed(values).astype(np.uint8), _band_keys(values).view(np.int64)
                    for k, i in enumerate(full):
                        bands[i], sig[i] = keys[k], last[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_keys(sets), pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], schema=SIGNED)
            release_memory()

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, SIGNED_DDL)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, sketch: int | None = None) -> DataFrame:
    """``(key, hashes)`` of the distinct shingles of ``text``; with ``sketch`` the smallest 32-bit hashes, as bytes."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = _sets(Texts(piece.column("text"), lower=True), shingle)
                if sketch is None:
                    values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                else:
                    short = (np.unique((mixed(s) >> np.uint64(32)).astype(np.uint32)) for s in sets)
                    values = pa.array([s[:sketch].tobytes() for s in short], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_keys(sets), pa.binary()), values], ["key", "hashes"])
            release_memory()

    return docs.select("text").mapInArrow(run, f"key binary, hashes {'array<bigint>' if sketch is None else 'binary'}")


class Corpus:
    """The documents, from which the sets of single digests can be read again."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int):
        self.texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        self.shingle = shingle

    def sets_of(self, keys: DataFrame, sets: DataFrame, sketch: int | None = None) -> DataFrame:
        """``(key, hashes)`` of the wanted keys; ``sets`` has ``(key, low)``."""
        wanted = cut_lineage(keys.select("key").distinct(), "wanted")
        n = wanted.count()
        ids = sets.join(checked_broadcast(wanted, n, ID_ROWS), "key", "left_semi").select(F.col("low").alias("__low")).distinct()
        texts = self.texts.join(checked_broadcast(ids, n, ID_ROWS), F.col("__id").eqNullSafe(F.col("__low")), "left_semi")
        own = shingle_sets(texts, self.shingle, sketch).join(checked_broadcast(wanted, n, ID_ROWS), "key", "left_semi")
        return cut_lineage(own.dropDuplicates(["key"]), "whole-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` of set digests whose whole sets are similar."""
    whole = corpus.sets_of(pairs.select(F.explode(F.array("u", "v")).alias("key")), sets)
    left = whole.select(F.col("key").alias("u"), F.col("hashes").alias("left"))
    right = whole.select(F.col("key").alias("v"), F.col("hashes").alias("right"))
    both = F.size(F.array_intersect("left", "right")).cast("bigint")
    union = F.size("left") + F.size("right") - both
    return pairs.join(left, "u").join(right, "v").filter(100 * both >= percent * union).select("u", "v")


def _stars(live: DataFrame, sets: DataFrame, tested: DataFrame | None) -> DataFrame:
    """``(u, v, root_u, root_v)``: each set ``u`` with the hub of another component which shares the most buckets with it."""
    hubs = live.groupBy("bucket").agg(F.max(F.struct("weight", "key", "root")).alias("h"))
    met = live.join(hubs.select("bucket", F.col("h.key").alias("v"), F.col("h.weight").alias("hub_weight"), F.col("h.root").alias("hub_root")), "bucket")
    met = met.filter((F.col("key") != F.col("v")) & (F.col("root") != F.col("hub_root")))
    counted = met.groupBy(F.col("key").alias("u"), "v").agg(F.count(F.lit(1)).alias("n"), F.max("hub_weight").alias("w"))
    if tested is not None:
        counted = counted.join(tested, ["u", "v"], "left_anti").join(tested.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"], "left_anti")
    best = counted.groupBy("u").agg(F.max(F.struct("n", "w", "v")).alias("b"))
    return best.select("u", F.col("b.v").alias("v"))


def _similar(one: np.ndarray, n: int, others: list[np.ndarray], sizes: np.ndarray, sketch: int) -> np.ndarray:
    """Similarity of a sketch with others: exact where both are whole sets, else from the smallest hashes of the union."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    first = np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]])
    both = np.add.reduceat(one[at] == joined, first)
    out = both / (n + sizes - both)
    for k in np.flatnonzero((sizes > sketch) | (n > sketch)):
        union = np.union1d(one, others[k])[:sketch]
        out[k] = (np.isin(union, one) & np.isin(union, others[k])).mean()
    return out


def _linking(least: float, percent: int, sketch: int):
    """Likely links of the sets of one bucket or tile, as many as it takes to join what they join."""
    doubt = 5 * (percent / 100 * (1 - percent / 100) / sketch) ** 0.5
    need = math.ceil(least * BANDS * ROWS)

    def pairs(side, root, key, n, sig, hashes, tiled):
        _, number = np.unique(np.array([r.hex() for r in root]), return_inverse=True)
        n, side = np.array(n), np.array(side)
        sig = np.frombuffer(b"".join(sig), np.uint8).reshape(len(key), -1)
        hashes = [np.frombuffer(h, np.uint32) for h in hashes]
        rows = np.flatnonzero(side == 0) if tiled else np.arange(len(key))
        columns = np.flatnonzero(side == 1) if tiled else rows
        for k, i in enumerate(rows):
            others = columns if tiled else columns[k + 1 :]
            others = others[number[others] != number[i]]
            others = others[(100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            if not len(others):
                continue
            others = others[(sig[others] == sig[i]).sum(axis=1) >= need]
            if not len(others):
                continue
            alike = _similar(hashes[i], n[i], [hashes[j] for j in others], n[others], sketch)
            large = (n[others] > sketch) | (n[i] > sketch)
            certain = alike >= percent / 100 + np.where(large, doubt, 0)
            for j in others[certain]:
                if number[j] != number[i]:
                    number[number == number[j]] = number[i]
                    yield min(key[i], key[j]), max(key[i], key[j])
            for j in others[~certain & large & (alike >= percent / 100 - doubt)]:
                if number[j] != number[i]:
                    yield min(key[i], key[j]), max(key[i], key[j])

    def run(batches):
        held: list[tuple] = []
        at = None

        def told():
            found = list(pairs(*zip(*held), at[1] != at[2]))
            for low in range(0, len(found), 10_000):
                u, v = zip(*found[low : low + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

        for batch in batches:
            for *place, side, root, key, n, sig, hashes in zip(*[c.to_pylist() for c in batch.columns]):
                if at != place:
                    if len(held) > 1:
                        yield from told()
                    held, at = [], place
                held.append((side, root, key, n, sig, hashes))
        if len(held) > 1:
            yield from told()

    return run


def _rest(live: DataFrame, sets: DataFrame, corpus: Corpus, least: float, percent: int, tile: int, sketch: int) -> DataFrame:
    """Pairs ``(u, v)`` which join all similar sets of different components, bucket by bucket."""
    sizes = live.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    spread = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"), F.when(own <= o, 0).otherwise(1).alias("side")))
    described = corpus.sets_of(live, sets, sketch).join(sets.select("key", "n", "sig"), "key")
    rows = live.join(sizes, "bucket").select("bucket", F.explode(spread).alias("t"), "root", "key").join(described, "key")
    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("bucket", "t.a", "t.b", "t.side", "root", "key", "n", "sig", "hashes")
    dealt = dealt.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return dealt.mapInArrow(_linking(least, percent, sketch), "u binary, v binary").distinct()


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Buckets with sets of several components: ``(bucket, key, weight, root)``."""
    if roots is None:
        return members.withColumn("root", F.col("key"))
    placed = members.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    return cut_lineage(placed.join(several, "bucket", "left_semi"), "open-buckets")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, seed: int = SEED,
    stars: int = STARS, least: float = LEAST, tile: int = TILE, sketch: int = SKETCH,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row."""
    signed = cut_lineage(signatures(docs, id_col, text_col, shingle, seed), "signatures")
    sets = signed.filter("n > 0").groupBy("key").agg(
        F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    sets = cut_lineage(sets, "sets")
    rows = sets.select("key", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut_lineage(rows.join(shared, "bucket"), "shared-buckets")
    weights = members.groupBy("key").agg(F.sum("size").alias("weight"))
    members = cut_lineage(members.select("bucket", "key").join(weights, "key"), "members")

    corpus = Corpus(docs, id_col, text_col, shingle)
    roots = tested = links = None
    for turn in range(stars + 1):
        live = _open(members, roots)
        if turn and live.isEmpty():
            break
        pairs = _stars(live, sets, tested) if turn < stars else _rest(live, sets, corpus, least, percent, tile, sketch)
        pairs = cut_lineage(pairs, "candidates")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = confirmed(pairs, sets, corpus, percent)
        links = cut_lineage(new if links is None else links.unionByName(new), "links")
        roots = cut_lineage(connected_components(links).select(F.col("id").alias("key"), "root"), "roots")
        links = roots.filter("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v"))
    named = sets.select("key", "low")
    named = named.withColumn("root", F.col("key")) if roots is None else named.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = named.join(lows, "root").select("key", "component_id")
    found = signed.select("id", "n", "key").join(names, "key", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id names their component, with the input columns; documents without words all stay.

    Ids must be unique here; rows of equal id stay or go together.
    """
    found = near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col("id").alias("__kept_id")).distinct()
    kept = cut_lineage(found, "kept")
    return docs.join(checked_broadcast(kept, kept.count(), ID_ROWS), F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("__kept_id")), "left_semi")
