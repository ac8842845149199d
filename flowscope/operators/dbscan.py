"""DBSCAN over vectors, exact, without listing the pairs of dense regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscope.operators.components import connected_components
from flowscope.operators.scale import cut_lineage, rank_by, salted_join
from flowscope.operators.tiles import Tile, Tiles, copies_of, distinct_points, matrix, one_cell


def _unite(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the components of linked rows; ``root`` holds the smallest row number of each row's component."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def neighbour_weights(tiles: Tiles, eps: float) -> DataFrame:
    """``(id, near)``: weight of the other points within ``eps``."""

    def count(tile: Tile) -> Iterator[dict]:
        ids, (wa, wb) = tile.column("id"), (w.astype(np.float64) for w in tile.column("weight"))
        left, right = np.zeros(len(wa)), np.zeros(len(wb))
        for rows, cols, hit in tile.hits(eps):
            ones = hit.astype(np.float64)
            left[rows] += ones @ wb[cols]
            right[cols] += wa[rows] @ ones
        if tile.same:
            yield {"id": ids[0], "near": (left + right).astype(np.int64)}
        else:
            yield {"id": np.concatenate(ids), "near": np.concatenate([left, right]).astype(np.int64)}

    return tiles.map(count, "id bigint, near bigint", whole=True).groupBy("id").agg(F.sum("near").alias("near"))


def core_links(tiles: Tiles, eps: float, marks: DataFrame) -> DataFrame:
    """``(u, v, border)`` within ``eps``: a spanning forest of each tile's core points, and border points with core points."""

    def links(tile: Tile) -> Iterator[dict]:
        ids, core, shift = *(np.concatenate(tile.column(n)) for n in ("id", "core")), len(tile.left)
        if tile.same:
            ids, core, shift = ids[: len(tile.left)], core[: len(tile.left)], 0
        core, root, us, vs = core.astype(bool), np.arange(len(ids)), [], []
        for rows, cols, hit in tile.hits(eps):
            sides = np.arange(len(tile.left))[rows], np.arange(len(tile.right))[cols] + shift
            ca, cb = core[sides[0]], core[sides[1]]
            i, j = np.nonzero(hit & ca[:, None] & cb[None, :] & (root[sides[0]][:, None] != root[sides[1]][None, :]))
            _unite(root, sides[0][i], sides[1][j])
            for (a, b), part, inner, outer in (((0, 1), hit, ca, cb), ((1, 0), hit.T, cb, ca)):
                lone, met = np.flatnonzero(~inner), np.flatnonzero(outer)
                i, j = np.nonzero(part[np.ix_(lone, met)])
                us.append(sides[a][lone[i]])
                vs.append(sides[b][met[j]])
        moved = np.flatnonzero(root != np.arange(len(root)))
        u, v = (np.concatenate([x, *y]) for x, y in ((moved, us), (root[moved], vs)))
        yield {"u": ids[u], "v": ids[v], "border": np.arange(len(u)) >= len(moved)}

    return cut_lineage(tiles.map(links, "u bigint, v bigint, border boolean", extra=marks, whole=True), "links")


def dbscan(points: DataFrame, eps: float = 1.2, min_samples: int = 10, block_rows: int = 1024) -> DataFrame:
    """``(id, label, core)`` of points ``(id, features)``: clusters 0, 1, ... by their smallest core id, noise -1.

    A point counts itself. Each tile returns a spanning forest of its core points, so dense regions cost as many
    edges as points. A border point joins the lowest-numbered cluster in reach. Where most points are in crowded boxes,
    only one of each box is compared with the others, see :func:`_by_boxes`.
    """
    unique = cut_lineage(distinct_points(points), "distinct")
    members = _boxed(unique, eps, min_samples)
    if members is not None:
        core_roots, marks, border = _by_boxes(unique, members, eps, min_samples, block_rows)
    else:
        tiles = Tiles(unique, eps, block_rows)
        near = neighbour_weights(tiles, eps)
        total = F.col("weight") + F.coalesce("near", F.lit(0))
        marks = cut_lineage(unique.join(near, "id", "left").select("id", (total >= min_samples).alias("core")), "core")
        edges = core_links(tiles, eps, marks)
        core_roots = _rooted(marks.filter("core").select("id"), edges.filter("not border"))
        border = edges.filter("border").select("u", "v")
    numbered = rank_by(core_roots.select(F.col("root").alias("id")).distinct(), "id", "id", "_rank", descending=False)
    numbers = numbered.select(F.col("id").alias("root"), (F.col("_rank") - 1).alias("label"))
    core_labels = cut_lineage(salted_join(core_roots, numbers, "root", "id", "inner").select("id", "label"), "labels")
    border = salted_join(
        border, core_labels.withColumnRenamed("id", "v"), "v", "u", "inner"
    ).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("label"))
    known = core_labels.unionByName(border)
    labels = marks.join(known, "id", "left").select(
        F.col("id").alias("point"), F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"), "core"
    )
    return salted_join(copies_of(points, unique), labels, "point", "id", "inner").select("id", "label", "core")


def _rooted(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, root)`` of all ``ids``; one without a link is its own root."""
    roots = connected_components(links.select("u", "v"))
    return cut_lineage(ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")


def _boxed(unique: DataFrame, eps: float, min_samples: int) -> DataFrame | None:
    """The points with ``node``, ``crowded``, ``low`` and ``high``, or None if fewer than half are in crowded boxes.

    A grid box is so small that its points are within ``eps`` of each other, as the extent ``low`` to ``high`` of its points
    confirms. Crowded are boxes of ``min_samples`` points and more; their node is the point of the smallest id. Other
    points are nodes by themselves.
    """
    first = unique.select(F.size("features").alias("n")).first()
    if first is None or first["n"] < 1 or not 0 < eps < math.inf:
        return None
    places = range(first["n"])
    side = eps / math.sqrt(len(places)) * (1 - 1e-6)
    placed = unique.withColumn("_box", F.transform("features", lambda x: F.floor(x / F.lit(side))))
    size = placed.groupBy("_box").agg(F.sum("weight").alias("_weight"), F.count(F.lit(1)).alias("_n"))
    inside, count = size.agg(F.sum(F.when(F.col("_weight") >= min_samples, F.col("_n"))), F.sum("_n")).first()
    if 2 * (inside or 0) < count:
        return None
    low, high = (F.array(*[f(F.get("features", F.lit(i))) for i in places]) for f in (F.min, F.max))
    extents = placed.groupBy("_box").agg(
        F.min("id").alias("node"), F.sum("weight").alias("_weight"), F.count(F.lit(1)).alias("_n"), low.alias("low"), high.alias("high"))
    width = F.sqrt(F.aggregate(F.zip_with("low", "high", lambda a, b: (b - a) * (b - a)), F.lit(0.0), lambda s, x: s + x))
    crowded = extents.filter((F.col("_weight") >= min_samples) & ((F.col("_n") == 1) | (width <= eps))).select("_box", "node", "low", "high")
    known = salted_join(placed, cut_lineage(crowded, "boxes"), "_box", "id", "left")
    return cut_lineage(known.select(
        "id", "features", "weight", F.coalesce("node", "id").alias("node"), F.col("node").isNotNull().alias("crowded"),
        *[F.coalesce(c, "features").alias(c) for c in ("low", "high")]), "boxed")


def _by_boxes(
    unique: DataFrame, members: DataFrame, eps: float, min_samples: int, block_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, root)`` of core points, ``(id, core)`` of all and the pairs ``(u, v)`` of border points with others in reach.

    All points of a crowded box are core and linked. So only nodes are compared with each other; what they leave open is
    settled by whole sets: a point without enough nodes in reach is counted among all points, and of components that
    nodes do not link, the points of those boxes are compared that come within ``eps`` of a box of another component.
    """
    nodes = cut_lineage(members.filter("id = node").select("id", "features", "weight", "crowded", "low", "high"), "nodes")
    tiles = Tiles(nodes.select("id", "features", "weight"), eps, block_rows)
    enough = F.col("crowded") | (F.col("weight") + F.coalesce("near", F.lit(0)) >= min_samples)
    sure = cut_lineage(nodes.join(neighbour_weights(tiles, eps), "id", "left").select("id", enough.alias("core")), "sure")
    everything = one_cell(unique, block_rows)

    def weigh(tile: Tile) -> Iterator[dict]:
        weight, sums = np.asarray(tile.right.column("weight")).astype(np.float64), np.zeros(tile.left.num_rows)
        for rows, cols, hit in tile.hits(eps):
            sums[rows] += hit.astype(np.float64) @ weight[cols]
        yield {"id": np.asarray(tile.left.column("id")), "near": sums.astype(np.int64)}

    unsure = cut_lineage(unique.join(sure.filter("not core"), "id", "left_semi"), "unsure")
    near = everything.probe(unsure, eps, weigh, "id bigint, near bigint", whole=True).groupBy("id").agg(F.sum("near").alias("near"))
    counted = unsure.join(near, "id", "left").select("id", (F.greatest("weight", F.coalesce("near", F.lit(0))) >= min_samples).alias("core"))
    marks = cut_lineage(sure.filter("core").unionByName(counted), "core")

    roots = _rooted(marks.filter("core").select("id"), core_links(tiles, eps, marks).filter("not border"))
    roots = _bridged(members, nodes, roots, eps, block_rows)

    def meet(tile: Tile) -> Iterator[dict]:
        u, v = (np.asarray(t.column("id")) for t in (tile.left, tile.right))
        for rows, cols, hit in tile.hits(eps):
            i, j = np.nonzero(hit)
            yield {"u": u[rows][i], "v": v[cols][j]}

    lone = cut_lineage(unsure.join(marks.filter("not core"), "id", "left_semi"), "lone")
    border = cut_lineage(everything.probe(lone, eps, meet, "u bigint, v bigint", whole=True), "border")
    every = members.select("id", "node")
    core_roots = salted_join(every, roots.withColumnRenamed("id", "node"), "node", "id", "inner").select("id", "root")
    all_marks = every.join(marks.filter("not core").select("id", "core"), "id", "left").select("id", F.coalesce("core", F.lit(True)).alias("core"))
    return cut_lineage(core_roots, "core-roots"), cut_lineage(all_marks, "marks"), border


def _bridged(members: DataFrame, nodes: DataFrame, roots: DataFrame, eps: float, block_rows: int) -> DataFrame:
    """The nodes' roots after links between other points of crowded boxes.

    A link missed by the nodes leads out of a component other than the largest, so only boxes of these ask.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(2).collect()
    if len(sizes) < 2:
        return roots
    minor = F.col("root") != sizes[0]["root"]
    shapes = cut_lineage(nodes.select("id", "features", "low", "high").join(roots, "id"), "shapes")

    def touch(tile: Tile) -> Iterator[dict]:
        (al, bl), (ah, bh) = ((matrix(tile.left, n), matrix(tile.right, n)) for n in ("low", "high"))
        (ra, rb), (ia, ib) = ((np.asarray(tile.left.column(n)), np.asarray(tile.right.column(n))) for n in ("root", "id"))
        left, right = np.zeros(len(ia), bool), np.zeros(len(ib), bool)
        for rows, cols, _ in tile.pieces():
            apart = np.zeros((len(ia[rows]), len(ib[cols])))
            for k in range(al.shape[1]):
                gap = np.maximum(al[rows, k][:, None] - bh[cols, k][None, :], bl[cols, k][None, :] - ah[rows, k][:, None])
                apart += np.maximum(gap, 0.0) ** 2
            met = (apart <= eps * eps * (1 + 1e-9)) & (ra[rows][:, None] != rb[cols][None, :])
            left[rows] |= met.any(axis=1)
            right[cols] |= met.any(axis=0)
        yield {"id": np.concatenate([ia[left], ib[right]])}

    touched = one_cell(shapes, block_rows).probe(shapes.filter(minor), math.inf, touch, "id bigint", whole=True).distinct()
    touched = cut_lineage(touched.join(roots, "id").withColumnRenamed("id", "node"), "touched")
    if touched.isEmpty():
        return roots
    ends = cut_lineage(salted_join(members.select("id", "features", "node"), touched, "node", "id", "inner").select("id", "features", "root"), "ends")

    def bridge(tile: Tile) -> Iterator[dict]:
        ra, rb = (np.asarray(t.column("root")) for t in (tile.left, tile.right))
        for rows, cols, hit in tile.hits(eps):
            i, j = np.nonzero(hit & (ra[rows][:, None] != rb[cols][None, :]))
            pairs = np.unique(np.stack([ra[rows][i], rb[cols][j]], axis=1), axis=0)
            yield {"u": pairs[:, 0], "v": pairs[:, 1]}

    found = Tiles(ends, eps, block_rows).probe(ends.filter(minor), eps, bridge, "u bigint, v bigint", whole=True)
    joined = _rooted(roots.select(F.col("root").alias("id")).distinct(), found.distinct())
    renamed = joined.select(F.col("id").alias("root"), F.col("root").alias("_top"))
    return cut_lineage(salted_join(roots, renamed, "root", "id", "inner").select("id", F.col("_top").alias("root")), "roots")
