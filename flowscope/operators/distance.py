"""Pairwise distances: pairs in reach, cut-off distance, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.scale import cut_lineage, kth_smallest
from flowscope.operators.tiles import Tile, Tiles, apart, where

#: Pairs of a tile that leave it together.
LISTED_ROWS = 1 << 18


def euclidean(a, b):
    """Distance of two array columns."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def pairs_within(points: DataFrame, radius: float, block_rows: int = 1024) -> DataFrame:
    """Pairs ``(i, j, d)`` with ``i < j`` and distance at most ``radius``; the output is as large as the answer."""

    def pairs(tile: Tile) -> Iterator[dict]:
        left, right = tile.column("id")
        for i, j, d in _listed(tile, radius):
            a, b = left[i], right[j]
            yield {"i": np.minimum(a, b), "j": np.maximum(a, b), "d": d}

    return Tiles(points.select("id", "features"), radius, block_rows).map(pairs, "i bigint, j bigint, d double", whole=True)


def _listed(tile: Tile, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and distances of the pairs of a whole tile within ``radius``, some pieces at a time."""
    held, size = [], 0
    for rows, cols, hit in tile.hits(radius):
        i, j = where(hit)
        held.append((i + rows.start, j + cols.start))
        size += len(i)
        if size >= LISTED_ROWS:
            yield _measured(tile, held)
            held, size = [], 0
    if size:
        yield _measured(tile, held)


def _measured(tile: Tile, held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = (np.concatenate(x) for x in zip(*held))
    return i, j, apart(*tile.vectors, i, j)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    return edges.select("i", "j", "d").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def block_neighbours(tiles: Tiles, every: bool = False) -> DataFrame:
    """The nearest other point of each point inside its own block (or ``every`` other): true pairs, not always the nearest."""

    def nearest(tile: Tile) -> dict | None:
        d = tile.d.copy()
        np.fill_diagonal(d, np.inf)
        if len(d) < 2:
            return None
        ids, _ = tile.column("id")
        w, _ = tile.column("weight")
        i, j = np.triu_indices(len(d), 1) if every else (np.arange(len(d)), d.argmin(axis=1))
        low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        return {"i": low, "j": high, "d": d[i, j], "w": w[i] * w[j]}

    return tiles.map(nearest, "i bigint, j bigint, d double, w bigint", own_block=True).distinct()


def cutoff_distance(points: DataFrame, percent: float = 2.0, block_rows: int = 1024) -> float:
    """The k-th smallest positive distance with k = round(N * percent / 100) over N points (0-based).

    ``points`` are distinct and weighted by their copies. Neighbours inside blocks are true pairs, so their k-th
    smallest distance bounds the wanted one; only the pairs within that bound are then listed. If there are not
    enough nearest neighbours, all pairs inside blocks give the bound; a rank beyond those too, that is above about half
    of ``block_rows`` times the number of points, lists every pair.
    """
    n = points.agg(F.sum("weight")).first()[0]
    k = round(n * percent / 100)
    tiles = Tiles(points, 0.0, block_rows)
    bound = kth_smallest(cut_lineage(block_neighbours(tiles), "neighbours"), "d", k, "w")
    if bound is None:
        bound = kth_smallest(cut_lineage(block_neighbours(tiles, every=True), "neighbours"), "d", k, "w")
    radius = float("inf") if bound is None else bound

    def pairs(tile: Tile) -> Iterator[dict]:
        left, right = tile.column("weight")
        for i, j, d in _listed(tile, radius):
            yield {"d": d, "w": left[i] * right[j]}

    listed = Tiles(points, radius, block_rows).map(pairs, "d double, w bigint", whole=True)
    found = kth_smallest(listed, "d", k, "w")
    if found is None:
        raise ValueError("fewer positive distances than the wanted rank")
    return found


def cutoff_of_edges(edges: DataFrame, percent: float = 2.0, basis: str = "points") -> float:
    """Cut-off distance of given triplets: rank over points (0-based, positive distances) or pairs (1-based, all)."""
    if basis == "points":
        ids = edges.select(F.col("i").alias("p")).unionByName(edges.select(F.col("j").alias("p"))).distinct()
        return kth_smallest(edges.filter("d > 0"), "d", round(ids.count() * percent / 100))
    if basis == "pairs":
        return kth_smallest(edges, "d", max(0, int(edges.count() * percent / 100 + 0.5) - 1))
    raise ValueError(f"unknown basis {basis!r}")
