import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.operators import density, distance
from flowscope.operators.components import connected_components, follow_to_root
from flowscope.operators.dbscan import dbscan
from flowscope.operators.outlier import fit_outliers, large_clusters
from flowscope.operators.tiles import Tiles, copies_of, distances, distinct_points, near


@pytest.fixture(scope="module")
def cloud():
    """Two blobs, scattered points and one vector which holds a quarter of all rows."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, (70, 2)), rng.normal(3, 0.3, (60, 2)), rng.uniform(-2, 5, (30, 2))]).round(2)
    return np.concatenate([x, np.repeat(x[7:8], 50, 0)])


@pytest.fixture(scope="module")
def points(spark, cloud):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(cloud)], "id bigint, features array<double>")


def matrix(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def brute_dbscan(d, eps, min_samples):
    core, label, number = (d <= eps).sum(1) >= min_samples, np.full(len(d), -1), 0
    for start in range(len(d)):
        if label[start] != -1 or not core[start]:
            continue
        label[start], todo = number, [start]
        while todo:
            here = todo.pop()
            if core[here]:
                new = [j for j in np.nonzero(d[here] <= eps)[0] if label[j] == -1]
                label[new] = number
                todo += new
        number += 1
    return label, core


@pytest.mark.parametrize("eps,min_samples,block", [(0.25, 6, 24), (0.5, 10, 1024)])
def test_dbscan_equals_brute_force(points, cloud, eps, min_samples, block):
    label, core = brute_dbscan(matrix(cloud), eps, min_samples)
    got = {r.id: (r.label, r.core) for r in dbscan(points, eps, min_samples, block).collect()}
    assert got == {i: (label[i], core[i]) for i in range(len(cloud))}
    assert label.max() >= 1 and (label == -1).any()


def test_dbscan_of_noise_only(spark):
    df = spark.createDataFrame([(i, [float(10 * i)]) for i in range(4)], "id bigint, features array<double>")
    assert {r.label for r in dbscan(df, 1.0, 2).collect()} == {-1}


def test_pairs_meet_exactly_once(points, cloud):
    d = matrix(cloud)
    want = {(i, j) for i in range(len(d)) for j in range(i + 1, len(d)) if d[i, j] <= 0.6}
    rows = distance.pairs_within(points, 0.6, block_rows=16).collect()
    assert len(rows) == len(want) and {(r.i, r.j) for r in rows} == want


def test_guests_are_pruned(points):
    unique = distinct_points(points)
    placed = Tiles(unique, 0.05, block_rows=16).placed
    assert placed.filter("home").count() == unique.count()
    assert placed.count() < 2 * unique.count()


def test_tiles_are_bounded(points):
    sizes = []
    tiles = Tiles(distinct_points(points), float("inf"), block_rows=16)
    out = tiles.map(lambda t: {"n": [t.left.num_rows + t.right.num_rows]}, "n bigint")
    sizes = [r.n for r in out.collect()]
    assert max(sizes) < 100


def brute_peaks(x, percent=2.0):
    d, n = matrix(x), len(x)
    upper = np.sort(d[np.triu_indices(n, 1)])
    dc = upper[upper > 0][round(n * percent / 100)]
    kernel = np.exp(-((d / dc) ** 2))
    np.fill_diagonal(kernel, 0)
    rho = kernel.sum(1)
    key = np.array([float("%.10e" % v) for v in rho])
    order = np.lexsort((np.arange(n), -key))
    delta, nearest = np.zeros(n), np.full(n, -1)
    for at in range(1, n):
        i, denser = order[at], order[:at]
        nearest[i] = denser[d[i, denser].argmin()]
        delta[i] = d[i, nearest[i]]
    delta[order[0]] = delta.max()
    return dc, rho, delta, nearest


@pytest.mark.parametrize("block_rows", [1024, 32])
def test_density_peaks_equal_brute_force(points, cloud, block_rows):
    dc, rho, delta, nearest = brute_peaks(cloud)
    got = {r.id: r for r in density.density_peaks(points, block_rows=block_rows).collect()}
    for i in range(len(cloud)):
        assert got[i].rho == pytest.approx(rho[i], rel=1e-9, abs=1e-300)
        assert got[i].delta == pytest.approx(delta[i])
        assert (-1 if got[i].nneigh is None else got[i].nneigh) == nearest[i]


def test_density_peaks_of_a_full_triplet_file(spark, cloud):
    d = matrix(cloud)
    i, j = np.triu_indices(len(d), 1)
    edges = spark.createDataFrame([(int(a), int(b), float(d[a, b])) for a, b in zip(i, j)], "i bigint, j bigint, d double")
    dc, rho, delta, nearest = brute_peaks(cloud)
    assert distance.cutoff_of_edges(edges) == pytest.approx(dc)
    ranked = np.sort(d[i, j])
    assert distance.cutoff_of_edges(edges, basis="pairs") == pytest.approx(ranked[int(len(ranked) * 0.02 + 0.5) - 1])
    got = {r.id: r for r in density.density_peaks_of_edges(edges).collect()}
    assert all(got[k].delta == pytest.approx(delta[k]) for k in range(len(cloud)))
    assert all((-1 if got[k].nneigh is None else got[k].nneigh) == nearest[k] for k in range(len(cloud)))


def test_assignment_follows_denser_points(spark):
    scores = spark.createDataFrame(
        [(0, 9.0, 5.0, None), (1, 8.0, 0.1, 0), (2, 7.0, 4.0, 0), (3, 6.0, 0.1, 2), (4, 5.0, 0.2, 3), (5, 1.0, 0.3, 1)],
        "id bigint, rho double, delta double, nneigh bigint",
    )
    got = density.assign_clusters(scores, 2.0, 1.0)
    assert {r.id: r.cluster for r in got.collect()} == {0: 1, 1: 1, 5: 1, 2: 2, 3: 2, 4: 2}
    borders = spark.createDataFrame([(1, 8.5), (2, 0.0)], "cluster bigint, border double")
    marked = density.mark_halo(got, borders)
    assert {r.id: r.halo for r in marked.collect()} == {0: 1, 1: 0, 5: 0, 2: 2, 3: 2, 4: 2}
    summary = {r.cluster: (r.centre, r.elements, r.core, r.halo) for r in density.cluster_summary(marked).collect()}
    assert summary == {1: (0, 3, 1, 2), 2: (2, 3, 3, 0)}


def test_components_and_chains(spark):
    hub = [(0, i) for i in range(1, 60)]
    chain = [(100 + i, 101 + i) for i in range(40)]
    edges = spark.createDataFrame(hub + chain + [(300, 299), (300, 300)], "u bigint, v bigint")
    got = {r.id: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + i: 100 for i in range(41)}, 299: 299, 300: 299}
    parents = spark.createDataFrame([(0, 0)] + [(i, i - 1) for i in range(1, 40)], "id bigint, parent bigint")
    assert {r.root for r in follow_to_root(parents).collect()} == {0}
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "id bigint, parent bigint")
    with pytest.raises(RuntimeError):
        follow_to_root(ring, max_rounds=4)


def test_copies(points, cloud):
    unique = distinct_points(points)
    assert unique.agg(F.sum("weight")).first()[0] == len(cloud)
    assert copies_of(points, unique).filter("point = 7").count() == 51


def test_large_clusters():
    assert large_clusters({0: 95, 1: 3, 2: 2}) == [0]
    assert large_clusters({0: 50, 1: 45, 2: 5}) == [0, 1]
    assert large_clusters({0: 10, 1: 10, 2: 10}) == [0, 1, 2]


def test_outliers(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (180, 2)), rng.uniform(8, 12, (20, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>")
    model = fit_outliers(df, k=8)
    rows = model.predict(df).collect()
    assert sum(r.outlier for r in rows) == 20
    scores = np.array([r.score for r in rows])
    assert model.threshold == pytest.approx(np.percentile(scores, 90))
    centres = np.array(model.centres)
    for r in rows[:40]:
        d = np.sqrt(((centres - x[r.id]) ** 2).sum(1))
        assert r.score == pytest.approx(d.min() if d.argmin() in model.large else d[model.large].min())


def tree_of(points, radius):
    """Tiles with several levels of pivots, also for few points."""
    return Tiles(points, radius, block_rows=16, cell_rows=24, first=3, fanout=3)


@pytest.mark.parametrize("radius", [0.3, float("inf")])
def test_every_pair_meets_once_in_a_deep_tree(points, cloud, radius):
    unique = distinct_points(points).cache()
    tiles = tree_of(unique, radius)
    assert len(tiles.levels) >= 2

    def pairs(tile):
        rows, cols = np.nonzero(tile.within(radius))
        left, right = tile.column("id")
        return {"i": np.minimum(left[rows], right[cols]), "j": np.maximum(left[rows], right[cols])}

    got = [(r.i, r.j) for r in tiles.map(pairs, "i bigint, j bigint").collect()]
    ids = sorted(r.id for r in unique.collect())
    d = matrix(cloud)
    want = {(i, j) for i in ids for j in ids if i < j and d[i, j] <= radius}
    assert len(got) == len(set(got)) and set(got) == want
    homes = tiles.placed.filter("home")
    assert homes.count() == homes.select("id").distinct().count() == len(ids)
    assert max(r["count"] for r in homes.groupBy("cell").count().collect()) <= 24


def test_asking_points_meet_all_in_reach_in_a_deep_tree(points, cloud):
    unique = distinct_points(points).cache()
    tiles = tree_of(unique, 0.0)

    def near(tile):
        rows, cols = np.nonzero(tile.d <= 0.5)
        return {"i": tile.column("id")[0][rows], "j": tile.column("id")[1][cols]}

    asking = unique.filter("id % 3 = 0")
    got = [(r.i, r.j) for r in tiles.probe(asking, 0.5, near, "i bigint, j bigint", unique.select("id", F.lit(1).alias("one"))).collect()]
    ids = sorted(r.id for r in unique.collect())
    d = matrix(cloud)
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in ids for j in ids if i % 3 == 0 and d[i, j] <= 0.5}


def test_equal_points_end_the_tree(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(80)] + [(99, [5.0, 5.0])], "id bigint, features array<double>")
    tiles = tree_of(same, 0.1)
    assert sum(r.n for r in tiles.map(lambda t: {"n": [int(t.within(0.1).sum())]}, "n bigint").collect()) == 80 * 79 // 2
    empty = tree_of(same.limit(0), 0.1)
    assert empty.map(lambda t: {"n": [1]}, "n bigint").count() == 0


def test_visits_grow_with_the_points(spark):
    def grid(n):
        rng = np.random.default_rng(1)
        x = rng.uniform(0, n**0.5, (n, 2))
        return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>")

    def work(n):
        tiles = Tiles(grid(n), 0.5, block_rows=32, cell_rows=64, first=4, fanout=8)
        homes = tiles.placed.filter("home").groupBy("cell").count()
        tasks = tiles.map(lambda t: {"n": [1]}, "n bigint").count()
        assert homes.agg(F.max("count")).first()[0] <= 64
        return tiles.placed.count() / n, tasks / n

    (few_visits, few_tiles), (many_visits, many_tiles) = work(600), work(6000)
    assert many_visits < 1.5 * few_visits and many_tiles < 1.5 * few_tiles


def test_densities_within_an_error(points, cloud):
    unique = distinct_points(points).cache()
    dc = 0.05
    exact = {r.id: r.rho for r in density.local_density(unique, dc, block_rows=32).collect()}
    assert density.kernel_reach(1e12, 1e-6) < 6.5 < density.kernel_reach(1e12, 0.0) == density.KERNEL_REACH
    for error in (1e-9, 0.01):
        got = {r.id: r.rho for r in density.local_density(unique, dc, block_rows=32, error=error).collect()}
        assert got.keys() == exact.keys()
        assert all(-1e-9 <= exact[k] - got[k] <= error + 1e-9 * exact[k] for k in exact)


def test_cutoff_beyond_the_nearest_neighbours(points, cloud):
    unique = distinct_points(points).cache()
    d = matrix(cloud)
    upper = np.sort(d[np.triu_indices(len(d), 1)])
    positive = upper[upper > 0]
    for percent in (120.0, 900.0):
        assert distance.cutoff_distance(unique, percent, 16) == pytest.approx(positive[round(len(cloud) * percent / 100)])


def wide(spark, n, dims=24):
    """Small groups far from each other in many directions, where every cell is in reach of every point."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(n // 12 + 1, dims))
    x = centres[np.arange(n) % len(centres)] + rng.normal(scale=0.35, size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>"), x


def test_cells_are_left_out_where_they_save_nothing(spark, points):
    df, x = wide(spark, 300)
    tiles = Tiles(distinct_points(df), 0.9, block_rows=32)
    assert len(tiles.pivots) == 1 and not tiles.levels
    assert tiles.placed.count() == 300
    assert len(Tiles(distinct_points(points), 0.05, block_rows=32).pivots) > 1
    label, core = brute_dbscan(matrix(x), 0.9, 4)
    got = {r.id: (r.label, r.core) for r in dbscan(df, 0.9, 4, 32).collect()}
    assert got == {i: (label[i], core[i]) for i in range(300)}
    _, rho, delta, _ = brute_peaks(x)
    rows = {r.id: r for r in density.density_peaks(df, block_rows=32).collect()}
    assert [rows[i].rho for i in range(300)] == pytest.approx(list(rho), rel=1e-9)
    assert [rows[i].delta for i in range(300)] == pytest.approx(list(delta))


def test_crowded_cells_are_split_only_where_it_saves_work(spark, monkeypatch):
    monkeypatch.setattr("flowscope.operators.tiles.MAX_PIVOTS", 2)
    monkeypatch.setattr("flowscope.operators.tiles.MOVED", 8)
    rng = np.random.default_rng(4)
    flat = spark.createDataFrame(
        [(i, [float(v) for v in p]) for i, p in enumerate(rng.uniform(0, 100, (900, 2)))], "id bigint, features array<double>")
    tiles = Tiles(flat, 1.0, block_rows=8)
    assert tiles.levels and tiles.placed.count() < 2000
    rows = tiles.map(lambda t: {"n": [int(t.within(1.0).sum())]}, "n bigint").agg(F.sum("n")).first()[0]
    x = np.array([r.features for r in flat.orderBy("id").collect()])
    assert rows == np.triu(matrix(x) <= 1.0, 1).sum()
    df, y = wide(spark, 600)
    tiles = Tiles(df, 0.9, block_rows=8)
    assert not tiles.levels
    rows = tiles.map(lambda t: {"n": [int(t.within(0.9).sum())]}, "n bigint").agg(F.sum("n")).first()[0]
    assert rows == np.triu(matrix(y) <= 0.9, 1).sum()


def test_a_search_meets_all_points_at_once_where_cells_save_nothing(spark):
    df, x = wide(spark, 400)
    tiles = Tiles(df, 0.0, block_rows=16)
    assert len(tiles.pivots) > 1

    def near(tile):
        rows, cols = np.nonzero(tile.d <= 0.9)
        return {"i": tile.column("id")[0][rows], "j": tile.column("id")[1][cols]}

    extra = df.select("id", F.lit(1).alias("one"))
    d = matrix(x)
    for asking, step in ((df, 1), (df.filter("id % 3 = 0"), 3), (df.filter("id < 0"), 1000)):
        got = [(r.i, r.j) for r in tiles.probe(asking, 0.9, near, "i bigint, j bigint", extra).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i in range(0, 400, step) for j in range(400) if d[i, j] <= 0.9 and step < 1000}


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_pairs_in_reach_are_those_of_direct_differences(shift):
    rng = np.random.default_rng(5)
    a, b = rng.integers(-3, 4, (70, 5)) + shift, rng.integers(-3, 4, (50, 5)) + shift
    b[:9] = a[:9]
    for radius in (0.0, 1.0, 2.0**0.5, 3.0, 5.0**0.5, np.inf):
        assert (near(a, b, radius) == (distances(a, b) <= radius)).all()
    c = rng.normal(size=(40, 64)) + shift
    for radius in np.unique(distances(c, c))[::97]:
        assert (near(c, c, radius) == (distances(c, c) <= radius)).all()
    a[0, 0], a[1, 1], b[2, 2] = np.nan, np.inf, 1e200
    with np.errstate(all="ignore"):
        assert (near(a, b, 3.0) == (distances(a, b) <= 3.0)).all()
    assert near(a[:0], b, 1.0).shape == (0, 50)


def test_whole_tiles_give_a_row_per_point_and_the_same_results(points, cloud, monkeypatch):
    monkeypatch.setattr("flowscope.operators.tiles.PIECE_ROWS", 7)
    monkeypatch.setattr("flowscope.operators.distance.LISTED_ROWS", 5)
    d = matrix(cloud)
    label, core = brute_dbscan(d, 0.25, 6)
    assert {r.id: (r.label, r.core) for r in dbscan(points, 0.25, 6, 24).collect()} == {i: (label[i], core[i]) for i in range(len(cloud))}
    listed = [(r.i, r.j) for r in distance.pairs_within(points, 0.6, block_rows=16).collect()]
    assert sorted(listed) == [(i, j) for i in range(len(d)) for j in range(i + 1, len(d)) if d[i, j] <= 0.6]
    _, rho, delta, nearest = brute_peaks(cloud)
    for r in density.density_peaks(points, block_rows=16).collect():
        assert r.rho == pytest.approx(rho[r.id], rel=1e-9) and r.delta == pytest.approx(delta[r.id])
        assert (-1 if r.nneigh is None else r.nneigh) == nearest[r.id]
    unique = distinct_points(points)
    tiles = Tiles(unique, float("inf"), block_rows=4)
    sums = tiles.map(lambda t: iter([{"n": [t.left.num_rows]}]), "n bigint", whole=True).count()
    assert sums < tiles.map(lambda t: {"n": [1]}, "n bigint").count() / 4


def crowds():
    """Crowded boxes of 1/sqrt(2): a large blob, boxes linked only by points other than their first, and loose points."""
    rng = np.random.default_rng(6)
    blob = rng.normal(0, 0.6, (400, 2)) + [-9, 0]
    first, second = [[0.01, 0.3]] + [[0.69, 0.3 + k / 100] for k in range(9)], [[2.1, 0.3]] + [[1.45, 0.3 + k / 100] for k in range(9)]
    corner = [[5.05, 0.65]] + [[5.6, 0.05 + k / 100] for k in range(9)]
    beyond = [[5.7, 1.68]] + [[6.3, 1.5 + k / 100] for k in range(9)]
    loose = [[0.69, 1.3], [0.69, 1.5], [2.9, 0.2], [30.0, 30.0], [-40.0, 2.0], [np.nan, 0.0]]
    return np.concatenate([first, second, corner, beyond, blob, loose, np.repeat([[50.0, 50.0]], 12, 0)])


@pytest.mark.parametrize("order", [1, -1])
def test_dbscan_of_crowded_boxes_compares_one_point_of_each(spark, monkeypatch, order):
    x = crowds()[::order]
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, features array<double>")
    compared, init = [], Tiles.__init__
    monkeypatch.setattr(Tiles, "__init__", lambda self, points, *a, **k: (compared.append((points.count(), a, k)), init(self, points, *a, **k))[1])
    label, core = brute_dbscan(np.nan_to_num(matrix(x), nan=np.inf), 1.0, 10)
    got = {r.id: (r.label, r.core) for r in dbscan(df, 1.0, 10, 32).collect()}
    assert got == {i: (label[i], core[i]) for i in range(len(x))}
    assert label.max() == 4 and (label == -1).any() and ((label >= 0) & ~core).any()
    assert compared[0][0] < len(x) / 3 and compared[0][1][0] == 1.0
