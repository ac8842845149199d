"""Pairs told from single precision: bounds, whole results, and how much of a tile is still done in double precision."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowscope.operators import density
from flowscope.operators.tiles import Tile, Tiles, copies_of, distances, distinct_points, where


def table(x, first=0):
    ids = np.arange(len(x)) + first
    return pa.table({"id": ids, "features": pa.array(list(x)), "weight": np.ones(len(x), np.int64), "key": -ids.astype(float)})


def tile_of(a, b=None):
    left = table(a)
    return Tile(left, left if b is None else table(b, len(a)), b is None)


def sphere(n, dims=48, seed=1):
    """Vectors far from each other, some of them near copies of one another."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[: n // 5] = x[n // 5 : 2 * (n // 5)] + rng.normal(scale=0.07, size=(n // 5, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True))[rng.permutation(n)]


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr("flowscope.operators.tiles.PIECE_ROWS", 64)


@pytest.mark.parametrize("change", [lambda x: x, lambda x: x + 1e4, lambda x: x * 1e-30, lambda x: x * 1e60, lambda x: np.vstack([x, 1e5 + x[:3]])])
def test_least_squares_are_not_above_the_squares(small_pieces, change):
    a, b = change(sphere(150)), change(sphere(130, seed=2))
    tile = tile_of(a, b)
    exact, (left, right) = distances(a, b) ** 2 * tile.scale, tile.missing()
    for rows, cols, _ in tile.pieces():
        least = tile.least(rows, cols)
        assert (least <= tile.scaled(exact[rows, cols] / tile.scale)).all()
        assert (exact[rows, cols] <= least + left[rows][:, None] + right[cols][None, :]).all()
    for radius in np.unique(distances(a, b))[[5, 900, 12000]]:
        got = np.zeros(exact.shape, bool)
        for rows, cols, hit in tile.hits(radius):
            got[rows, cols] = hit
        assert (got == (distances(a, b) <= radius)).all()
        assert [list(k) for k in where(got)] == [list(k) for k in np.nonzero(got)]


def test_few_pairs_in_reach_need_no_products_in_double_precision(small_pieces, monkeypatch):
    x = sphere(384)
    monkeypatch.setattr(Tile, "squares", lambda *_: pytest.fail("a piece was done in double precision"))
    d, tile = distances(x, x), tile_of(x)
    assert sum(int(hit.sum()) for *_, hit in tile.hits(0.5)) == np.triu(d <= 0.5, 1).sum() > 50


@pytest.mark.parametrize("dc", [0.004, 0.09, 0.3, 1.0, 30.0])
@pytest.mark.parametrize("same", [True, False])
def test_sums_of_the_kernel_are_complete(small_pieces, monkeypatch, dc, same):
    a, b = sphere(500), sphere(450, seed=2)
    tile = tile_of(a) if same else tile_of(a, b)
    nearest = tuple(next(density._nearest_in_block(tile_of(x)))["nearest"] for x in ((a, a) if same else (a, b)))
    d = distances(a, a if same else b)
    if same:
        np.fill_diagonal(d, np.inf)
        assert (nearest[0] >= d.min(axis=1) ** 2).all() and (nearest[0] <= d.min(axis=1) ** 2 * (1 + 1e-3) + 1e-4).all()
    taken, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **out: taken.append(np.size(x)) or exp(x, **out))
    weights = tuple(np.ones(t.num_rows) for t in (tile.left, tile.right))
    left, right = density._gaussian_sums(tile, weights, dc, dc * density.KERNEL_REACH, False, nearest, 950.0)
    monkeypatch.undo()
    with np.errstate(under="ignore"):
        kernel = exp(-((d / dc) ** 2))
    want = (kernel.sum(1), np.zeros(len(b))) if same else (kernel.sum(1), kernel.sum(0))
    got = (left + right, np.zeros(len(b))) if same else (left, right)
    for g, w in zip(got, want):
        # a sum over all blocks holds a part of the nearest point at least, so what is far below it does not count
        least = exp(-np.array(nearest[0] if len(g) == len(a) else nearest[1]) / dc**2)
        assert np.allclose(g, w, rtol=1e-11, atol=0) if same else (np.abs(g - w) <= 1e-11 * w + 2.0**-53 * least).all()
    if dc < 0.1:
        assert sum(taken) < 0.3 * d.size


def test_the_nearest_denser_point_is_measured_with_few_others(small_pieces, monkeypatch):
    x = sphere(500)
    tile, best, measured = tile_of(x, x), np.full(500, np.inf), 0
    monkeypatch.setattr(Tile, "squares", lambda *_: pytest.fail("a piece was done in double precision"))
    d = distances(x, x)
    for rows, cols, _ in tile.pieces():
        denser = np.arange(500)[cols][None, :] < np.arange(500)[rows][:, None]
        i, j = density._candidates(tile, rows, cols, denser, best[rows])
        measured += len(i)
        assert denser[i, j].all()
        np.minimum.at(best, i + rows.start, d[i + rows.start, j + cols.start])
    assert (best[1:] == np.where(np.tri(500, k=-1), d, np.inf).min(axis=1)[1:]).all() and best[0] == np.inf
    assert measured < 5 * 500


def test_candidates_where_single_precision_tells_nothing(small_pieces):
    """Points next to each other seen from one far away, and points with many at the same distance."""
    for x in (np.vstack([sphere(200) * 1e-5, np.full((1, 48), 1e3)]), np.random.default_rng(3).integers(0, 2, (200, 5)).astype(float)):
        tile, d, n = tile_of(x, x), distances(x, x), len(x)
        best = np.full(n, np.inf)
        for rows, cols, _ in tile.pieces():
            denser = np.arange(n)[cols][None, :] < np.arange(n)[rows][:, None]
            i, j = density._candidates(tile, rows, cols, denser, best[rows])
            np.minimum.at(best, i + rows.start, d[i + rows.start, j + cols.start])
        assert (best[1:] == np.where(np.tri(n, k=-1), d, np.inf).min(axis=1)[1:]).all()


def test_copies_are_looked_up_without_moving_vectors(spark):
    x = np.random.default_rng(4).integers(0, 4, (300, 3)).astype(float)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(900, [9.0, 9.0, 9.0]), (901, [-0.0, 0.0, 0.0]), (902, [0.0, -0.0, 0.0])]
    points = spark.createDataFrame(rows, "id bigint, features array<double>")
    copies = copies_of(points, distinct_points(points).cache())
    first = {}
    for i, v in rows:
        first.setdefault(tuple(abs(k) for k in v), i)
    assert {r.id: r.point for r in copies.collect()} == {i: first[tuple(abs(k) for k in v)] for i, v in rows}
    joins = [line for line in copies._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("features" in line for line in joins)


def test_visits_of_a_search_are_counted_in_the_task(spark):
    x = sphere(300, dims=3)
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>")
    tiles = Tiles(points, 0.0, block_rows=16)
    assert not tiles.levels and len(tiles.pivots) > 4
    listed = tiles._first_level(points, 0.4, True).groupBy("cell").count()
    counted = tiles._counted(points, 0.4)
    assert "MapInArrow" in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect()))


def test_a_search_that_meets_all_cells_moves_no_point_to_their_parts(spark, monkeypatch):
    """With further levels too, the work is counted before points are placed."""
    monkeypatch.setattr("flowscope.operators.tiles.MAX_PIVOTS", 8)
    x = sphere(400)
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>")
    tiles = Tiles(points, 0.0, block_rows=4)
    assert tiles.levels
    monkeypatch.setattr(Tiles, "_place", lambda *_: pytest.fail("points were placed"))
    assert tiles.reach(points, 1.2) == np.inf
    asked, homes, met = tiles._met(points, 1.2)
    assert asked.count() == homes.count() == 400 and met.count() == 1


def test_a_search_within_few_cells_still_visits_their_parts(spark, monkeypatch):
    monkeypatch.setattr("flowscope.operators.tiles.MAX_PIVOTS", 8)
    monkeypatch.setattr("flowscope.operators.tiles.MOVED", 1)
    x = np.random.default_rng(6).uniform(0, 50, (600, 2))
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>")
    tiles = Tiles(points, 0.0, block_rows=4)
    assert tiles.levels and tiles.reach(points, 1.0) == 1.0

    def near(tile):
        rows, cols = np.nonzero(tile.d <= 1.0)
        return {"i": tile.column("id")[0][rows], "j": tile.column("id")[1][cols]}

    got = [(r.i, r.j) for r in tiles.probe(points, 1.0, near, "i bigint, j bigint").collect()]
    i, j = np.nonzero(distances(x, x) <= 1.0)
    assert sorted(got) == sorted(zip(i.tolist(), j.tolist()))
