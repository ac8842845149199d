"""Kernel classifiers over sparse rows in long form: random Fourier features, and decisions by given models."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.operators.scale import salted_join


def weighted_sums(rows: DataFrame, vectors: DataFrame, on: str, key: str, weight: str = "weight") -> DataFrame:
    """``(key, sums)``: per key the sum of ``weight * v`` over its rows, where ``vectors`` holds one array ``v`` per ``on``.

    Rows are ``(key, on, weight)``; all arrays have the same length. Sums are taken before the shuffle, so a key costs
    each task one array. Keys without a partner are left out.
    """
    joined = salted_join(rows.select(key, on, weight), vectors.select(on, "v"), on, key, "inner")
    flipped = F.when(F.col(weight) < 0, F.transform("v", lambda x: -x)).otherwise(F.col("v"))
    ready = joined.select(key, array_to_vector(flipped).alias("_v"), F.abs(F.col(weight)).cast("double").alias("_w"))
    return ready.groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("_v"), F.col("_w"))).alias("sums"))


def _uniform(*seeds: Column) -> Column:
    return (F.pmod(F.xxhash64(*seeds), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def gaussian_rows(terms: DataFrame, on: str, size: int, seed: int = 42) -> DataFrame:
    """``(on, v)``: ``size`` standard normal numbers per term, drawn by hashes of term and place, the same everywhere."""

    def normal(j: Column) -> Column:
        one, two = (_uniform(F.col(on), j, F.lit(seed + k)) for k in (0, 1))
        return F.sqrt(F.lit(-2.0) * F.log(one)) * F.cos(F.lit(2 * math.pi) * two)

    return terms.select(on).distinct().withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), normal))


#: Cells of a table that are projected at once, and rows of numbers that a task keeps.
CELLS = 1 << 14
KEPT_TERMS = 1 << 14


def _hash_int(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """XXH64 of 32-bit numbers, each with its seed, as Spark chains the hashes of several columns."""
    p1, p2, p3, p4 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5 + 4))
    h = (seeds + p4) ^ (values.astype(np.uint32).astype(np.uint64) * p1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _uniform_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes & np.uint64((1 << 52) - 1)).astype(np.float64) + 0.5) / float(1 << 52)


def _normals(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The arrays of :func:`gaussian_rows` of the terms with these hashes."""
    placed = _hash_int(np.arange(size), hashes.astype(np.uint64)[:, None])
    one, two = (_uniform_of(_hash_int(np.array(seed + k), placed)) for k in (0, 1))
    return np.sqrt(-2.0 * np.log(one)) * np.cos(2 * math.pi * two)


def _projections(size: int, seed: int):
    """Sums of ``weight * normals(term)`` over the cells of each row; normals are kept from one row to the next."""
    known, rows = np.zeros(0, np.uint64), np.zeros((0, size))

    def normals(hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes in ``rows``."""
        nonlocal known, rows
        wanted = np.unique(hashes)
        new = np.setdiff1d(wanted, known, assume_unique=True)
        if len(new):
            if len(known) + len(new) > KEPT_TERMS:
                known, rows, new = known[:0], rows[:0], wanted
            made = np.concatenate([_normals(new[i : i + 1024], size, seed) for i in range(0, len(new), 1024)])
            both = np.concatenate([known, new])
            order = np.argsort(both)
            known, rows = both[order], np.concatenate([rows, made])[order]
        return np.searchsorted(known, hashes)

    def project(offsets: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(offsets) - 1, size))
        for low in range(0, len(hashes), CELLS):
            high = min(low + CELLS, len(hashes))
            at = normals(hashes[low:high])
            first, last = np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left")
            for i in range(first, last):
                a, b = max(low, int(offsets[i])), min(high, int(offsets[i + 1]))
                if a < b:
                    sums[i] += weights[a:b] @ rows[at[a - low : b - low]]
        return sums

    return project


def fourier_features(rows: DataFrame, key: str, on: str, gamma: float, size: int = 512, seed: int = 42, weight: str = "weight") -> DataFrame:
    """``(key, fourier)``: arrays whose dot products approximate ``exp(-gamma * |x - y|^2)`` of the sparse rows.

    The error of a kernel value has a standard deviation of about ``1 / sqrt(size)``. The numbers of a term are those of
    :func:`gaussian_rows`. A task makes them from the term's hash, so what is moved for a cell is its hash and weight;
    the cells of a key come together, and their number is bounded by the length of its text.
    """
    shift = rows.sparkSession.range(1).select(F.xxhash64(F.lit("shift"))).first()[0]
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        project = _projections(size, seed)
        moved = 2 * math.pi * _uniform_of(_hash_int(np.array(seed), _hash_int(np.arange(size), np.array([shift]).astype(np.uint64))))
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                cells = batch.column(1)
                inside = cells.flatten()
                hashes, weights = (inside.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                offsets = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy(zero_copy_only=False))])
                sums = project(offsets, hashes.view(np.uint64), weights)
                waves = math.sqrt(2.0 / size) * np.cos(math.sqrt(2.0 * gamma) * sums + moved)
                ends = pa.array(np.arange(0, waves.size + 1, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(waves.ravel()))], ["key", "fourier"])

    cell = F.struct(F.xxhash64(on).alias("h"), F.col(weight).cast("double").alias("w"))
    lists = rows.filter(F.col(on).isNotNull() & F.col(weight).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.collect_list(cell).alias("cells"))
    return lists.mapInArrow(run, f"key {kind}, fourier array<double>").withColumnRenamed("key", key)


def linear_decision(rows: DataFrame, coefficients: DataFrame, key: str, on: str, intercept: float = 0.0, weight: str = "weight") -> DataFrame:
    """``(key, decision)`` of a given linear model ``(on, coefficient)``; its other terms count nothing."""
    one = coefficients.select(on, F.array(F.col("coefficient").cast("double")).alias("v"))
    scored = weighted_sums(rows, one, on, key, weight)
    every = rows.select(key).distinct().join(scored, key, "left")
    return every.select(key, (F.coalesce(F.get("sums", F.lit(0)), F.lit(0.0)) + F.lit(intercept)).alias("decision"))


def kernel_decision(
    rows: DataFrame, support: DataFrame, alphas: list[float], key: str, on: str, gamma: float, intercept: float = 0.0, weight: str = "weight"
) -> DataFrame:
    """``(key, decision)`` of a given RBF model: the sum of ``alpha * exp(-gamma * |x - s|^2)`` over its support vectors.

    ``support`` holds ``(number, on, weight)`` of the support vectors, numbered from 0 as in ``alphas``; their number is
    that of the model and does not grow with the rows.
    """
    m = len(alphas)
    maps = support.groupBy(on).agg(F.map_from_entries(F.collect_list(F.struct("number", F.col(weight).cast("double")))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    lengths = dict(support.groupBy("number").agg(F.sum(F.col(weight) * F.col(weight))).collect())
    own = rows.groupBy(key).agg(F.sum(F.col(weight) * F.col(weight)).alias("_own"))
    dots = own.join(weighted_sums(rows, maps.select(on, dense.alias("v")), on, key, weight), key, "left")
    zero = F.array_repeat(F.lit(0.0), m)
    terms = F.zip_with(
        F.zip_with(F.coalesce("sums", zero), F.array(*[F.lit(float(lengths.get(i, 0.0))) for i in range(m)]), lambda d, n: F.col("_own") + n - 2.0 * d),
        F.array(*[F.lit(float(a)) for a in alphas]), lambda d2, a: a * F.exp(F.lit(-gamma) * d2))
    return dots.select(key, (F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) + F.lit(intercept)).alias("decision"))
