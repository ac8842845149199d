"""Exact range self-joins of vectors, as tiles of bounded size.

Points are assigned to their nearest pivot. A point also visits a cell of lower number when it lies within the
radius of the plane which separates both pivots; every pair within the radius then meets in exactly one cell, and
pairs of distant cells are never formed. Cells are cut into blocks, and one task sees two blocks at a time, however
full a cell is. What a task returns is an aggregate (counts, sums, a spanning forest), never all pairs of its tile.

Cells with more than ``cell_rows`` points of their own are split again by pivots of their own, level by level, so the
number of cells grows with the points. The pivots of a level are a table. Points at home in a split cell go on as at
the first level; a visitor goes on to every part its ball meets, so a pair still meets where its paths divide, once.
A cell whose points are all alike cannot be split and is only cut into blocks.

Cells save work only where points are in reach of few of them. In many dimensions, or with a wide radius, a point visits
nearly every cell, and copying it there costs more than the distances it spares. So the visits are counted over all
points first, without moving any, and the first level takes the number of pivots with the least work; a crowded cell is
split only if that lowers its work, and a search meets all points in one cell if that is cheaper. Results are the same.

What is moved is a dealt block, as many points as some megabytes hold; inside a task it is cut into blocks of
``block_rows`` points, which are what a function sees. All pairs of N points so move each point N / dealt block times.
A function that is asked for ``whole`` tiles sees two dealt blocks, goes over their pairs piece by piece and returns its
sums once for all of them, so what leaves a task is a row per point and dealt tile, not per point and block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscope.operators.scale import cut_lineage, salted_join

#: Pivots of the first level, the only ones the driver sees.
MAX_PIVOTS = 1024
#: Pivots by which a crowded cell is split at each further level.
FANOUT = 32
PLACE_ROWS = 1024
CHUNK_ROWS = 4096
#: Size of a dealt block of points; a task holds two.
DEALT_BYTES = 16 << 20
#: Rows and columns of a piece of a whole tile.
PIECE_ROWS = 768
#: One pair in so many is measured by itself rather than all pairs of its piece in double precision.
FEW = 32
#: A moved row counts as much work as this many distances.
MOVED = 128


def distinct_points(points: DataFrame) -> DataFrame:
    """One row per distinct vector: smallest ``id``, ``features`` and the number of copies as ``weight``."""
    clean = F.transform("features", lambda x: x.cast("double") + F.lit(0.0))
    return (
        points.select("id", clean.alias("features"))
        .groupBy("features")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
        .select("id", "features", "weight")
    )


def copies_of(points: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(id, point)``: the distinct point each row is a copy of.

    Only vectors with copies are looked up, by a hash unless two of them share it, so that vectors are not moved.
    """
    clean = F.transform("features", lambda x: x.cast("double") + F.lit(0.0))
    rows = points.select("id", clean.alias("features")).filter("features IS NOT NULL")
    keys = distinct.filter("weight > 1 AND features IS NOT NULL")
    rows, keys = (t.withColumn("_hash", F.xxhash64("features")) for t in (rows, keys))
    on = ["_hash"] if keys.groupBy("_hash").count().filter("count > 1").isEmpty() else ["_hash", "features"]
    rows, keys = rows.select("id", *on), cut_lineage(keys.select(*on, F.col("id").alias("point")), "copied")
    return salted_join(rows, keys, on, "id", "left").select("id", F.coalesce("point", "id").alias("point"))


def matrix(table: pa.Table | pa.RecordBatch, column: str = "features") -> np.ndarray:
    values = table.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All Euclidean distances by direct differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        diff = a[start : start + step, None, :] - b[None, :, :]
        out[start : start + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def near(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Which distances are at most ``radius``, as :func:`distances` would find them.

    Squares and products tell it for nearly all pairs; those within the rounding error of the radius, or without a finite
    value, are told by direct differences.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), bool)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = a.mean(axis=0)
        x, y = a - middle, b - middle
        norms = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
        squares = norms - 2.0 * (x @ y.T)
        margin = 8 * (a.shape[1] + 8) * np.finfo(np.float64).eps * norms
        hit = squares <= radius * radius - margin
        rows, cols = np.nonzero(~hit & ~(squares > radius * radius + margin))
    hit[rows, cols] = apart(a, b, rows, cols) <= radius
    return hit


def apart(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of single pairs by direct differences."""
    out = np.empty(len(rows))
    step = max(1, 131_072 // max(1, a.shape[1]))
    for start in range(0, len(rows), step):
        diff = a[rows[start : start + step]] - b[cols[start : start + step]]
        out[start : start + step] = np.sqrt((diff * diff).sum(axis=1))
    return out


_row_products = getattr(np, "vecdot", None) or (lambda x, y: (x * y).sum(axis=1))


def where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the hits of a contiguous mask, several times as fast as ``nonzero`` if there are few."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


@dataclass
class Tile:
    """Two blocks of points; for ``same`` tiles only pairs with row < column count."""

    left: pa.Table
    right: pa.Table
    same: bool

    @cached_property
    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        return matrix(self.left), matrix(self.right)

    @cached_property
    def d(self) -> np.ndarray:
        return distances(*self.vectors)

    def within(self, radius: float) -> np.ndarray:
        hit = near(*self.vectors, radius)
        return np.triu(hit, 1) if self.same else hit

    def pairs(self, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and distances of the pairs within ``radius``."""
        rows, cols = np.nonzero(self.within(radius))
        return rows, cols, apart(*self.vectors, rows, cols)

    @cached_property
    def _framed(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Both sides such that products are squares of distances, the largest norms and the rounding error of a square."""
        a, b = self.vectors
        with np.errstate(all="ignore"):
            middle = a.mean(axis=0) if len(a) else 0.0
            x, y = a - middle, b - middle
            nx, ny = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[:, None]
            norms = float(nx.max(initial=0.0) + ny.max(initial=0.0))
            left, right = np.hstack([-2.0 * x, nx, np.ones_like(nx)]), np.hstack([y, np.ones_like(ny), ny])
        return left, right, norms, 8 * (a.shape[1] + 8) * np.finfo(np.float64).eps * norms

    @property
    def norms(self) -> float:
        return self._framed[2]

    @property
    def margin(self) -> float:
        return self._framed[3]

    @cached_property
    def _screen(self) -> tuple | None:
        """Both sides in single precision such that products are at most the scaled squares of distances; the scale of a
        square, and for each point the part of it that may be missing. None without finite values."""
        a, b = self.vectors
        with np.errstate(all="ignore"):
            middle = a.mean(axis=0) if len(a) else 0.0
            x, y = a - middle, b - middle
            nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
            largest = max(nx.max(initial=0.0), ny.max(initial=0.0))
            if not 1e-250 < largest < 1e250:
                return None
            scale = 2.0 ** -round(math.log2(largest) / 2)
        # twice what the rounding of the factors and of a sum of that length can come to; 1e-36 for what underflows
        rounding = 4 * (a.shape[1] + 8) * float(np.finfo(np.float32).eps)
        x, y, nx, ny = x * scale, y * scale, nx * scale**2, ny * scale**2
        left = np.column_stack([-2.0 * x, (1 - rounding) * nx - 1e-36, np.ones(len(x))]).astype(np.float32)
        right = np.column_stack([y, np.ones(len(y)), (1 - rounding) * ny - 1e-36]).astype(np.float32)
        return left, right, scale**2, 2 * rounding * nx + 2e-36, 2 * rounding * ny + 2e-36

    @property
    def screened(self) -> bool:
        return self._screen is not None

    def least(self, rows: slice, cols: slice) -> np.ndarray:
        """Squared distances of a piece, scaled and in single precision, each at most as large as it is exactly.

        By products as well, at less than half the cost of :meth:`squares`; what may be missing is told by :meth:`missing`.
        """
        return self._screen[0][rows] @ self._screen[1][cols].T

    @property
    def scale(self) -> float:
        return self._screen[2]

    def missing(self) -> tuple[np.ndarray, np.ndarray]:
        """The sum of both sides' numbers is the most by which :meth:`least` is too small."""
        return self._screen[3], self._screen[4]

    def scaled(self, square):
        """Squares of distances on the scale of :meth:`least`, in single precision and not smaller."""
        with np.errstate(over="ignore", under="ignore"):
            return np.nextafter(np.asarray(square * self.scale).astype(np.float32), np.float32(np.inf))

    def pieces(self) -> Iterator[tuple[slice, slice, bool]]:
        """Rows and columns of the pieces with pairs, and whether a piece lies on the diagonal of a ``same`` tile."""
        for i in range(0, self.left.num_rows, PIECE_ROWS):
            for j in range(i if self.same else 0, self.right.num_rows, PIECE_ROWS):
                yield slice(i, i + PIECE_ROWS), slice(j, j + PIECE_ROWS), self.same and i == j

    def squares(self, rows: slice, cols: slice) -> np.ndarray:
        """Squared distances of a piece from products, exact up to ``margin``, or by differences if that is not finite."""
        if not np.isfinite(self.margin):
            return distances(self.vectors[0][rows], self.vectors[1][cols]) ** 2
        return self._framed[0][rows] @ self._framed[1][cols].T

    def squares_of(self, rows: slice, cols: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The squares of :meth:`squares` of single pairs of a piece."""
        out, (x, y, *_) = np.empty(len(i)), self._framed
        x, y = x[rows], y[cols]
        for start in range(0, len(i), 1024):
            part = slice(start, start + 1024)
            out[part] = _row_products(x[i[part]], y[j[part]])
        return out

    def hits(self, radius: float, strict: bool = False) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Pieces, and which of their distances are at most ``radius`` (``strict``: less) by direct differences."""
        a, b = self.vectors
        full = 0
        for rows, cols, diagonal in self.pieces():
            hit = None
            if self.screened and full < 3:
                # few pairs in reach are found in single precision and measured; a tile that is full of them goes on in double
                hit = self.least(rows, cols) <= self.scaled(radius * radius)
                few = np.count_nonzero(hit) * FEW <= hit.size
                full = 0 if few else full + 1
                if few:
                    i, j = where(hit)
                    d = apart(a[rows], b[cols], i, j)
                    hit[i, j] = d < radius if strict else d <= radius
                else:
                    hit = None
            if hit is not None:
                pass
            elif np.isfinite(self.margin):
                square = self.squares(rows, cols)
                hit = square <= radius * radius + self.margin
                i, j = where(hit & (square > radius * radius - self.margin))
                d = apart(a[rows], b[cols], i, j)
                hit[i, j] = d < radius if strict else d <= radius
            else:
                d = distances(a[rows], b[cols])
                hit = d < radius if strict else d <= radius
            yield rows, cols, np.triu(hit, 1) if diagonal else hit

    def column(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.asarray(t.column(name).to_pylist()) for t in (self.left, self.right))


def visits(points: np.ndarray, pivots: np.ndarray, reach: float, at_home: np.ndarray, all_cells: bool, between: np.ndarray | None = None):
    """``(row, cell, home)`` of every cell each point belongs to or visits.

    A point at home goes to its nearest pivot and visits the cells in reach, of lower number or all of them; one that
    is a visitor already visits all cells in reach, the nearest included. Squares come from products; by their rounding
    error a point visits more cells, so none is missed. ``between`` are the distances of the pivots, if they are known.
    """
    between = distances(pivots, pivots) if between is None else between
    home, margin = _nearest_pivot(points, pivots, between)
    row, cell = np.arange(len(points)), np.arange(len(pivots))[None, :]
    visit = margin <= reach * (1 + 1e-9) + 1e-9
    visit &= (cell != home[:, None]) if all_cells else (cell < home[:, None]) | ~at_home[:, None]
    visit[row, home] = True
    rows, cells = where(visit)
    return rows, cells, at_home[rows] & (cells == home[rows])


def _nearest_pivot(points: np.ndarray, pivots: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each point, and how far the planes to the other pivots are at least."""
    row = np.arange(len(points))
    with np.errstate(all="ignore"):
        middle = pivots.mean(axis=0)
        x, y = points - middle, pivots - middle
        nx, ny = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
        error = 16 * (points.shape[1] + 8) * np.finfo(np.float64).eps * (nx + ny.max(initial=0.0))
        squares = nx + ny - 2.0 * (x @ y.T)
        if not np.isfinite(error).all():
            squares, error = distances(points, pivots) ** 2, np.zeros((len(points), 1))
        home = squares.argmin(axis=1)
        planes = 2.0 * np.where(between > 0, between, 1.0)[home]
        planes[row, home] = 2.0
        return home, (squares - squares[row, home][:, None] - error) / planes


def _copied(table: pa.Table | pa.RecordBatch, rows: np.ndarray, cells: list[str], home: np.ndarray, names: list[str]) -> pa.RecordBatch:
    taken = table.select(names).take(pa.array(rows))
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.string()), pa.array(home)], [*names, "cell", "home"])


class Tiles:
    """Points ``(id, features, ...)`` laid out for pairwise work within ``radius``.

    ``cell_rows`` bounds the points at home in a cell and ``first`` is the number of pivots of the first level; where one of
    them is given, cells are laid out so, else by the least work (see above) with cells of 8 blocks. Neither changes a result.
    """

    def __init__(
        self, points: DataFrame, radius: float = math.inf, block_rows: int = 1024, cell_rows: int | None = None,
        first: int | None = None, fanout: int = FANOUT,
    ):
        self.radius, self.block_rows, self.points, self.fanout = float(radius), block_rows, points, fanout
        self.fixed = cell_rows is not None or first is not None
        self.cell_rows = cell_rows or 8 * block_rows
        self.count = points.count()
        wanted = max(1, min(first or MAX_PIVOTS, MAX_PIVOTS, math.ceil(self.count / block_rows)))
        chosen = points.select("id", "features").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
        self.pivots = np.array([r["features"] for r in chosen], dtype=np.float64)
        self.dealt_rows = self._dealt_rows()
        self._last: tuple | None = None
        if not self.fixed:
            self.pivots = self.pivots[: self._cheapest()]
        self.levels: list[DataFrame] = []
        self.placed = self._split(cut_lineage(self._first_level(points, self.radius, False), "cells"))
        self.sizes = (
            self.placed.groupBy("cell")
            .agg(F.count_if("home").alias("_homes"), F.count_if(~F.col("home")).alias("_guests"))
            .select("cell", "_homes", self._blocks("_homes").alias("_hb"), self._blocks("_guests").alias("_gb"))
        )

    def _dealt_rows(self) -> int:
        """As many points as fit, but not so many that cores would be without a tile."""
        cores = self.points.sparkSession.sparkContext.defaultParallelism
        row_bytes = 8 * (self.pivots.shape[1] if self.pivots.ndim == 2 else 1) + 64
        return max(self.block_rows, min(math.ceil(self.count / math.isqrt(8 * cores)), DEALT_BYTES // row_bytes))

    def _blocks(self, rows: str) -> Column:
        return F.ceil(F.col(rows) / F.lit(self.dealt_rows)).cast("int")

    def _work(self, homes: str, guests: str) -> Column:
        """Work of a cell: its distances, and the rows stored and dealt for them."""
        h, g, hb, gb = F.col(homes).cast("double"), F.col(guests).cast("double"), self._blocks(homes), self._blocks(guests)
        return h * (h / 2 + g) + F.lit(MOVED) * (h * (hb + gb + 1) + g * (hb + 1))

    def _cheapest(self) -> int:
        """The number of first pivots with the least work, from the visits of all points."""
        most, pivots, reach = len(self.pivots), self.pivots, self.radius
        if math.isinf(reach) or most < 2:
            return 1
        if reach == 0:
            return most
        steps = sorted({min(4**k, most) for k in range(most.bit_length())})

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            between = distances(pivots, pivots)
            homes, guests = ({n: np.zeros(n, np.int64) for n in steps} for _ in range(2))
            for whole in batches:
                for batch in (whole.slice(i, PLACE_ROWS) for i in range(0, whole.num_rows, PLACE_ROWS)):
                    x = matrix(batch)
                    for n in steps:
                        _, cells, home = visits(x, pivots[:n], reach, np.ones(len(x), bool), False, between[:n, :n])
                        homes[n] += np.bincount(cells[home], minlength=n)
                        guests[n] += np.bincount(cells[~home], minlength=n)
            for n in steps:
                yield pa.RecordBatch.from_pydict({
                    "pivots": pa.array([n] * n, pa.int32()), "cell": pa.array(range(n), pa.int32()),
                    "homes": pa.array(homes[n]), "guests": pa.array(guests[n])})

        counted = self.points.select("features").mapInArrow(tally, "pivots int, cell int, homes bigint, guests bigint")
        cells = counted.groupBy("pivots", "cell").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests"))
        work = cells.groupBy("pivots").agg(F.sum(self._work("homes", "guests")).alias("work"))
        return work.orderBy("work", F.desc("pivots")).first()["pivots"]

    def _first_level(self, points: DataFrame, reach: float, all_cells: bool, names: list[str] | None = None) -> DataFrame:
        """Rows at their home cell and at the cells in reach, with all columns or those of ``names``."""
        pivots, names = self.pivots, names or points.columns

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            between = distances(pivots, pivots)
            for whole in batches:
                for batch in (whole.slice(i, PLACE_ROWS) for i in range(0, whole.num_rows, PLACE_ROWS)):
                    rows, cells, home = visits(matrix(batch), pivots, reach, np.ones(batch.num_rows, bool), all_cells, between)
                    yield _copied(batch, rows, [str(c) for c in cells], home, names)

        return points.mapInArrow(place, _placed_schema(points.select(*names)))

    def _split(self, placed: DataFrame) -> DataFrame:
        """Split crowded cells until none is left that has two different points and less work in parts."""
        settled = []
        while True:
            homes = placed.filter("home")
            crowded = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > self.cell_rows)
            crowded = cut_lineage(crowded, "crowded")
            if crowded.isEmpty():
                break
            inside = salted_join(homes, crowded, "cell", "id", "inner")
            # equal vectors share a bucket, so pivots differ
            bucket = F.pmod(F.xxhash64("features", F.lit(len(self.levels))), F.lit(self.fanout))
            drawn = F.struct(F.xxhash64("features"), "features")
            picked = inside.groupBy("cell", bucket.alias("_bucket")).agg(F.min(drawn)["features"].alias("_pivot"))
            pivots = picked.groupBy("cell").agg(F.sort_array(F.collect_list("_pivot")).alias("_pivots"))
            pivots = cut_lineage(pivots.filter(F.size("_pivots") > 1), "pivots")
            if not self.fixed and self.radius > 0:
                pivots = cut_lineage(self._worth_a_split(placed, pivots), "pivots")
            if pivots.isEmpty():
                break
            self.levels.append(pivots)
            settled.append(cut_lineage(salted_join(placed, pivots.select("cell"), "cell", "id", "left_anti"), "settled"))
            placed = cut_lineage(self._descend(placed, pivots, self.radius, False), "cells")
        for part in settled:
            placed = placed.unionByName(part)
        return placed

    def _worth_a_split(self, placed: DataFrame, pivots: DataFrame) -> DataFrame:
        """The pivots of those cells whose parts come to less work than the whole."""
        def work(rows: DataFrame, name: str) -> DataFrame:
            homes, guests = F.count_if("home").alias("_homes"), F.count_if(~F.col("home")).alias("_guests")
            cells = rows.groupBy("cell").agg(homes, guests).withColumn("_work", self._work("_homes", "_guests"))
            cell = F.regexp_replace("cell", "/[0-9]+$", "") if name == "_parts" else F.col("cell")
            return cells.groupBy(cell.alias("cell")).agg(F.sum("_work").alias(name))

        parts = work(self._descend(placed, pivots, self.radius, False, ["id"]), "_parts")
        better = parts.join(work(placed.select("cell", "home"), "_whole"), "cell").filter("_parts < _whole")
        return pivots.join(better.select("cell"), "cell", "left_semi")

    def _descend(
        self, placed: DataFrame, pivots: DataFrame, reach: float, all_cells: bool, names: list[str] | None = None
    ) -> DataFrame:
        """The rows of split cells at the parts of these; the rows of other cells are left out.

        Rows of a cell are dealt into chunks, each of which meets one copy of the cell's pivots. Returns all columns or
        those of ``names``.
        """
        names = names or [c for c in placed.columns if c not in ("cell", "home")]
        sent = list(dict.fromkeys(["features", *names]))
        counts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK_ROWS)).cast("int").alias("_chunks"))
        cut = cut_lineage(pivots.join(counts, "cell"), "chunks")
        chunk = F.pmod(F.xxhash64("id", F.lit(11)), F.col("_chunks")).cast("int")
        moving = salted_join(placed, cut.select("cell", "_chunks"), "cell", "id", "inner")
        moving = moving.select(*sent, "home", F.col("cell").alias("_cell"), chunk.alias("_chunk"))
        copies = cut.select(
            F.col("cell").alias("_cell"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "_pivots"
        )

        def place(rows: pa.Table, split: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.Table.from_batches([_copied(rows, np.zeros(0, int), [], np.zeros(0, bool), names)])
            prefix = rows.column("_cell")[0].as_py()
            centres = np.array(split.column("_pivots")[0].as_py(), dtype=np.float64)
            out = []
            for part in (rows.slice(i, PLACE_ROWS) for i in range(0, rows.num_rows, PLACE_ROWS)):
                home = part.column("home").to_numpy(zero_copy_only=False).astype(bool)
                row, cells, home = visits(matrix(part), centres, reach, home, all_cells)
                out.append(_copied(part, row, [f"{prefix}/{c}" for c in cells], home, names))
            return pa.Table.from_batches(out)

        both = moving.groupBy("_cell", "_chunk").cogroup(copies.groupBy("_cell", "_chunk"))
        return both.applyInArrow(place, _placed_schema(placed.select(*names)))

    def _place(self, points: DataFrame, radius: float) -> DataFrame:
        """Rows at every final cell within ``radius``."""
        placed = self._first_level(points, radius, True)
        settled = []
        for pivots in self.levels:
            placed = cut_lineage(placed, "asked")
            settled.append(salted_join(placed, pivots.select("cell"), "cell", "id", "left_anti"))
            placed = self._descend(placed, pivots, radius, True)
        for part in settled:
            placed = placed.unionByName(part)
        return placed

    def _sized(self, rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """Rows with the sizes of their cell. Without further levels there are at most MAX_PIVOTS cells."""
        if not self.levels:
            return rows.join(F.broadcast(sizes), "cell")
        return salted_join(rows, sizes, "cell", "id", "inner")

    def reach(self, asking: DataFrame, radius: float) -> float:
        """How far a search within ``radius`` sees: without limit if asking points and points all meet in one cell."""
        _, _, met = self._met(asking, radius)
        return math.inf if self._last[2] else radius

    def probe(
        self, asking: DataFrame, radius: float, fn: Callable[[Tile], dict], schema: str, extra: DataFrame | None = None,
        whole: bool = False,
    ) -> DataFrame:
        """Apply ``fn`` to tiles of ``asking`` points (left) and all points of a cell (right) within ``radius``.

        Only the asking points visit other cells; ``extra`` adds columns by ``id`` to both sides.
        """
        left, homes, sizes = self._met(asking, radius)
        if extra is not None:
            left, homes = left.join(extra, "id"), homes.join(extra, "id")

        def spread(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
            mine = F.pmod(F.xxhash64("id", F.lit(7)), F.col(own)).cast("int").alias("a" if side == 0 else "b")
            every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("b" if side == 0 else "a")
            columns = [c for c in df.columns if c != "cell"]
            dealt = self._sized(df, sizes).filter((F.col("_hb") > 0) & (F.col("_ab") > 0))
            return dealt.select("cell", mine, every, F.lit(side).alias("side"), *columns).select("cell", "a", "b", "side", *columns)

        both = spread(left, "_ab", "_hb", 0).unionByName(spread(homes, "_hb", "_ab", 1))
        return both.groupBy("cell", "a", "b").applyInArrow(_over_blocks(fn, schema, self.block_rows, whole=whole), schema)

    def _met(self, asking: DataFrame, radius: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Asking points and points with the cells where they meet, and the numbers of blocks of these cells."""
        if self._last is None or self._last[0] is not asking or self._last[1] != radius:
            found = self._meeting(asking, radius)
            self._last = (asking, radius, "_asked" not in found[2].columns, found)
        asked, homes, met = self._last[3]
        return asked, homes, met.select("cell", "_hb", "_ab")

    def _meeting(self, asking: DataFrame, radius: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        number, blocks = asking.count(), math.ceil(self.count / self.dealt_rows)
        whole = _probing(number, self.count, math.ceil(number / self.dealt_rows), blocks)

        def cheaper(cells: DataFrame) -> bool:
            a, h = F.col("_asked").cast("double"), F.col("_homes").cast("double")
            return whole < (cells.agg(F.sum(_probing(a, h, self._blocks("_asked"), self._blocks("_homes")))).first()[0] or 0)

        def at_once() -> tuple[DataFrame, DataFrame, DataFrame]:
            one = asking.sparkSession.range(1).select(
                F.lit("").alias("cell"), F.lit(blocks).alias("_hb"), F.lit(math.ceil(number / self.dealt_rows)).alias("_ab"))
            return asking.withColumn("cell", F.lit("")), self.points.withColumn("cell", F.lit("")), one

        if self.levels and not self.fixed:
            # counted before any point is moved: who meets nearly all cells of the first level would be copied to all their parts
            first = self.sizes.groupBy(F.substring_index("cell", "/", 1).alias("cell")).agg(F.sum("_homes").alias("_homes"))
            if cheaper(first.join(self._counted(asking, radius), "cell")):
                return at_once()
        if self.levels:
            visiting = self._place(asking, radius).groupBy("cell").agg(F.count(F.lit(1)).alias("_asked"))
        else:
            visiting = self._counted(asking, radius)
        met = self.sizes.join(visiting, "cell").withColumn("_ab", self._blocks("_asked"))
        met = cut_lineage(met.select("cell", "_homes", "_asked", "_hb", "_ab"), "met")
        if not self.fixed and cheaper(met):
            return at_once()
        homes = self.placed.filter("home").drop("home")
        return self._place(asking, radius).drop("home"), homes, met

    def _counted(self, asking: DataFrame, radius: float) -> DataFrame:
        """How many asking points come to each cell of the first level; the visits are not listed."""
        pivots = self.pivots

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            between, asked = distances(pivots, pivots), np.zeros(len(pivots), np.int64)
            for whole in batches:
                for batch in (whole.slice(i, PLACE_ROWS) for i in range(0, whole.num_rows, PLACE_ROWS)):
                    _, cells, _ = visits(matrix(batch), pivots, radius, np.ones(batch.num_rows, bool), True, between)
                    asked += np.bincount(cells, minlength=len(pivots))
            hit = np.flatnonzero(asked)
            yield pa.RecordBatch.from_pydict({"cell": pa.array([str(c) for c in hit], pa.string()), "asked": pa.array(asked[hit])})

        counted = asking.select("features").mapInArrow(tally, "cell string, asked bigint")
        return counted.groupBy("cell").agg(F.sum("asked").alias("_asked"))

    def map(
        self, fn: Callable[[Tile], dict], schema: str, extra: DataFrame | None = None, own_block: bool = False, whole: bool = False
    ):
        """Apply ``fn`` to every tile; it returns columns in the order of ``schema``.

        ``extra`` adds columns by ``id``. ``own_block`` only visits the tiles of a block with itself. With ``whole``, a tile is
        two dealt blocks, and ``fn`` yields any number of results.
        """
        placed = self.placed if extra is None else self.placed.join(extra, "id")
        blocks = F.when(F.col("home"), F.col("_hb")).otherwise(F.col("_gb"))
        rows = self._sized(placed, self.sizes).withColumn(
            "_b", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int")
        )
        columns = [c for c in placed.columns if c not in ("home", "cell")]

        def tile(kind, a, b, side):
            return F.struct(
                F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.alias("side")
            )

        mine = F.col("_b")
        if own_block:
            spots = F.array(tile(0, mine, mine, F.lit(0)))
            rows = rows.filter("home")
        else:
            inner = F.transform(
                F.sequence(F.lit(0), F.col("_hb") - 1),
                lambda o: tile(0, F.least(mine, o), F.greatest(mine, o), F.when(mine <= o, 0).otherwise(1)),
            )
            met = F.when(
                F.col("_gb") > 0,
                F.transform(F.sequence(F.lit(0), F.greatest("_gb", F.lit(1)) - 1), lambda v: tile(1, mine, v, F.lit(0))),
            ).otherwise(F.slice(inner, 1, 0))
            guest = F.transform(F.sequence(F.lit(0), F.col("_hb") - 1), lambda h: tile(1, h, mine, F.lit(1)))
            spots = F.when(F.col("home"), F.concat(inner, met)).otherwise(guest)
        spread = rows.select("cell", *columns, F.explode(spots).alias("_t")).select("cell", "_t.*", *columns)
        run = _over_blocks(fn, schema, self.block_rows, own_block, whole)
        return spread.groupBy("cell", "kind", "a", "b").applyInArrow(run, schema)


def one_cell(points: DataFrame, block_rows: int = 1024) -> Tiles:
    """All points in one cell, cut into dealt blocks only; for searches by few points."""
    return Tiles(points, math.inf, block_rows, cell_rows=1 << 62, first=1)


def _probing(asked, homes, asked_blocks, home_blocks):
    """Work of a cell of a search, of numbers or columns."""
    return asked * homes + MOVED * (asked * (home_blocks + 1) + homes * asked_blocks)


def _over_blocks(fn: Callable[[Tile], dict], schema: str, block_rows: int, own_block: bool = False, whole: bool = False):
    """Apply ``fn`` to the pairs of blocks of two dealt blocks, or of one with itself; a pair's result leaves at once.

    With ``whole``, ``fn`` sees the dealt blocks and yields its results.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def cut(table: pa.Table) -> list[pa.Table]:
        whole = table.combine_chunks()
        return [whole.slice(i, block_rows) for i in range(0, whole.num_rows, block_rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("side").to_numpy()
        sides = [table.filter(pa.array(side == i)) for i in (0, 1)]
        same = "kind" in table.column_names and table.column("kind")[0].as_py() == 0 and table.column("a")[0] == table.column("b")[0]
        if whole:
            left = sides[0].combine_chunks()
            right = left if same else sides[1].combine_chunks()
            del table, sides
            if left.num_rows and right.num_rows:
                for out in fn(Tile(left, right, same)):
                    yield from _as_table(out, names, schema).to_batches()
            return
        left = cut(sides[0])
        right = left if same else cut(sides[1])
        for i, a in enumerate(left):
            for j in range(i if same else 0, i + 1 if own_block else len(right)):
                out = fn(Tile(a, right[j], same and i == j))
                if out is not None:
                    yield from _as_table(out, names, schema).to_batches()

    return run


def _placed_schema(points: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in points.dtypes) + ", cell string, home boolean"


_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}


def _as_table(out: dict, names: list[str], schema: str) -> pa.Table:
    kinds = [_ARROW[part.strip().split(" ")[1]] for part in schema.split(",")]
    fields = pa.schema(list(zip(names, kinds)))
    return pa.Table.from_arrays([pa.array(np.asarray(out[n]), k) for n, k in zip(names, kinds)], schema=fields)

