"""Exact and approximate k nearest neighbours by a pivot index.

Every row goes to its nearest pivot, and within a pivot's cell to a ring of distances from it; a
block is a bounded piece of one ring. Queries go to groups of neighbouring ones in the same order. By the triangle
inequality a row at distance ``e`` from the pivot is at least ``|d - e|`` away from a query at distance ``d``. A group first
scans the blocks around its queries, which bounds each one's k-th distance by ``r``, and then exactly those further blocks
that the bounds cannot exclude: rings that meet ``[d - r, d + r]`` of cells that ``r`` reaches. What is planned is pairs of a
group and a block; vectors are copied once per group and block row, never per query and block. A task holds the queries
of one group and their ``k`` best, and the rows of its blocks stream past in Arrow batches.

Products of matrices say which rows may be among the ``k`` nearest, with room for their rounding; the distances
of those are computed from differences.

On data where no bound excludes anything (isotropic, many dimensions) the exact search is still
every query against every block. There ``probes`` gives the approximate mode: only the blocks of
so many nearest cells are scanned, and ``recall`` measures it against an exact result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import cut_lineage, fixed_ranges, ship

#: Most cells of an index, so that the pivots stay a small matrix at any number of rows.
MOST_CELLS = 1024
#: Distances that a task computes at a time, and queries of a group: those that one copy of a block serves.
DISTANCES_AT_ONCE, QUERIES_PER_COPY = 1_000_000, 16_384
#: Tasks that share the blocks of one group.
LANES = 8
#: Relative slack for rounding wherever a bound excludes something.
SLACK = 1e-9


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, from differences, so that equal rows are at exactly 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, DISTANCES_AT_ONCE // max(1, b.size))
    for i in range(0, len(a), step):
        apart = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart))
    return out


def spread_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows, each the one farthest from those before it."""
    if not len(points):
        return points
    chosen = [0]
    nearest = distances(points, points[:1])[:, 0]
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


@dataclass
class NeighbourIndex:
    """``blocks``: ``block, cell, id, vec, ring``; ``directory``: one row per block with its ring and row count."""

    blocks: DataFrame
    directory: DataFrame
    pivots: np.ndarray
    cells: list  # (cell, rows, least ring, greatest ring), one per pivot in use
    copies: int = 1

    @property
    def dim(self) -> int:
        return self.pivots.shape[1]


def vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``id, vec`` of the rows that have both."""
    d = df.select(F.col(key).cast("long").alias("id"), F.transform(F.col(vec), lambda x: x.cast("double")).alias("vec"))
    return d.where(F.col("id").isNotNull() & F.col("vec").isNotNull())


def homes(rows: DataFrame, pivots: np.ndarray, copies: int = 1) -> DataFrame:
    """``id, vec, cell, ring``: each row in the cells of its ``copies`` nearest pivots, with its distance from them."""
    dim = pivots.shape[1]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, len(pivots)):
            apart = distances(matrix(batch.column("vec"), dim), pivots)
            cell = np.argsort(apart, axis=1, kind="stable")[:, :copies]
            row = np.repeat(np.arange(len(cell)), cell.shape[1])
            taken, cell = batch.take(pa.array(row)), cell.ravel()
            yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("vec"), pa.array(cell.astype(np.int32)),
                                              pa.array(apart[row, cell])], names=["id", "vec", "cell", "ring"])

    return rows.mapInArrow(assign, "id long, vec array<double>, cell int, ring double")


def parts(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that a matrix of theirs with ``columns`` columns has ``DISTANCES_AT_ONCE`` entries at most."""
    step = max(1, DISTANCES_AT_ONCE // max(1, columns))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def build_index(df: DataFrame, key: str, vec: str, n_cells: int | None = None, block_rows: int = 1024,
                seed: int = 42, copies: int = 1) -> NeighbourIndex:
    """Pivots are spread over a sample of four rows for each cell (the smallest seeded hashes); all rows are indexed.

    With ``copies`` above 1 a row stands in the cells of so many nearest pivots, for the approximate mode only: a
    neighbour across a border between cells is then found from either side."""
    ship(df.sparkSession)
    rows = vectors(df, key, vec)
    n = rows.count()
    n_cells = n_cells or int(min(MOST_CELLS, max(1, n ** 0.5)))
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(4 * n_cells).select("vec").collect()
    if not sample:
        raise ValueError("no vectors to index")
    pivots = spread_pivots(np.array([r["vec"] for r in sample], float), n_cells)
    assigned = homes(rows, pivots, copies)
    # ranges of (cell, ring) split a cell that holds most rows; inside a range, pieces of block_rows
    ranged = fixed_ranges(assigned, ["cell", "ring", "id"], "part")
    at = F.row_number().over(Window.partitionBy("part", "cell").orderBy("ring", "id")) - 1
    block = F.shiftleft(F.col("part").cast("long"), 31) + F.shiftleft(F.col("cell").cast("long"), 20) + F.floor(at / block_rows)
    blocks = cut_lineage(ranged.select(block.alias("block"), "cell", "id", "vec", "ring"))
    directory = cut_lineage(blocks.groupBy("block", "cell").agg(
        F.min("ring").alias("near"), F.max("ring").alias("far"), F.count(F.lit(1)).alias("rows")))
    cells = directory.groupBy("cell").agg(F.sum("rows"), F.min("near"), F.max("far")).orderBy("cell").collect()
    return NeighbourIndex(blocks, directory, pivots, [tuple(r) for r in cells], copies)


def grouped_queries(index: NeighbourIndex, queries: DataFrame) -> DataFrame:
    """``query, vec, group``: queries next to each other, about ``QUERIES_PER_COPY`` to a group."""
    groups = max(1, math.ceil(queries.count() / QUERIES_PER_COPY))
    return fixed_ranges(homes(queries, index.pivots), ["cell", "ring", "id"], "group", groups).select(
        F.col("id").alias("query"), "vec", "group")


def reached_cells(index: NeighbourIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """``group, cell, low, high``: the cells that some query of a group has to look at, and the rings in them; several rows
    of a group and cell together span what it needs. Queries without a column ``group`` are their own groups.

    With a column ``reach`` (a bound on the k-th distance) these are all cells and rings that it does not exclude;
    without, the nearest cells that hold ``k`` rows together, or the ``probes`` nearest, at the query's own ring."""
    numbers = np.array([c[0] for c in index.cells], int)
    held = np.array([c[1] for c in index.cells])
    near, far = (np.array([c[i] for c in index.cells], float) for i in (2, 3))
    pivots, dim, bounded = index.pivots[numbers], index.dim, "reach" in queries.columns
    by = "group" if "group" in queries.columns else "query"

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, len(pivots)):
            away = distances(matrix(batch.column("vec"), dim), pivots)
            limit = 0.0
            if bounded:
                limit = batch.column("reach").to_numpy(zero_copy_only=False)[:, None]
                limit = limit + SLACK * (1 + np.where(np.isfinite(limit), limit, 0))
                ring = np.maximum(away - far, near - away)  # from the rings of the cell
                plane = (away - away.min(axis=1, keepdims=True)) / 2  # nearer to the nearest pivot than this, nothing is in the cell
                take = np.maximum(ring, plane) <= limit
            else:
                take = nearest_cells(away, probes) if probes else cells_holding(away, held, k)
            low, high = np.where(take, away - limit, np.inf), np.where(take, away + limit, -np.inf)
            groups = batch.column(by).to_numpy()
            own, at = np.unique(groups, return_inverse=True)
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(own)))
            taken = np.logical_or.reduceat(take[order], starts, axis=0)
            row, col = np.nonzero(taken)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row].astype(np.int64)), pa.array(numbers[col].astype(np.int32)),
                 pa.array(np.fmin.reduceat(low[order], starts, axis=0)[row, col]),
                 pa.array(np.fmax.reduceat(high[order], starts, axis=0)[row, col])], names=["group", "cell", "low", "high"])

    return queries.mapInArrow(reach, "group long, cell int, low double, high double")


def turns(away: np.ndarray) -> np.ndarray:
    """Per row the places of its columns in ascending order."""
    order = np.argsort(away, axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :], axis=1)
    return turn


def nearest_cells(away: np.ndarray, probes: int) -> np.ndarray:
    return turns(away) < probes


def cells_holding(away: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """The nearest cells that hold ``k`` rows together."""
    order = np.argsort(away, axis=1, kind="stable")
    sums = np.cumsum(held[order], axis=1) - held[order]
    return np.take_along_axis(sums, turns(away), axis=1) < k


class Best:
    """The first ``keep`` rows of each query by (dist, id), from candidates in any order; ``bound`` is the last one's distance."""

    def __init__(self, reach: np.ndarray, keep: int):
        self.bound, self.keep = reach.copy(), keep
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.later: list[tuple] = []
        self.n_later = 0

    def add(self, row: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        if len(row):
            self.later.append((row, ids, dist))
            self.n_later += len(row)
        if self.n_later > max(len(self.found[0]), len(self.bound)):
            self.settle()

    def settle(self) -> tuple:
        if self.later:
            row, ids, dist = (np.concatenate(x) for x in zip(self.found, *self.later, strict=True))
            order = np.lexsort((ids, dist, row))
            row, ids, dist = row[order], ids[order], dist[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == self.keep - 1
            self.bound[row[last]] = np.minimum(self.bound[row[last]], dist[last])
            first = place < self.keep
            self.found, self.later, self.n_later = (row[first], ids[first], dist[first]), [], 0
        return self.found


def scan_blocks(index: NeighbourIndex, queries: DataFrame, pairs: DataFrame, k: int, include_self: bool,
                probes: int | None = None) -> DataFrame:
    """``query, neighbor, dist``: the first ``k`` rows of each query among the blocks of ``pairs`` (``group, block``), per lane.

    ``queries`` is ``query, vec, group, reach``; what lies beyond a query's reach is left out. With ``probes`` a query
    sees only the rows of so many nearest cells, else all blocks of its group that its reach does not exclude."""
    dim, pivots = index.dim, index.pivots
    numbers = np.array([c[0] for c in index.cells], int)
    lane = F.pmod(F.xxhash64("block"), F.lit(LANES)).cast("int").alias("lane")
    held = (queries.join(pairs.select("group", lane).distinct(), "group")
            .select("group", "lane", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("cell"),
                    F.col("query").alias("id"), "vec", F.col("reach").alias("ring")))
    passing = index.blocks.join(pairs, "block").select("group", lane, F.lit(1).alias("kind"), "block", "cell", "id", "vec", "ring")
    tasks = max(1, pairs.agg(F.count_distinct("group")).first()[0]) * LANES
    rows = held.union(passing).repartition(tasks, "group", "lane").sortWithinPartitions("group", "lane", "kind", "block", "id")

    def meet(best: Best, asked: np.ndarray, points: np.ndarray, chosen: np.ndarray, ids: np.ndarray, block: np.ndarray) -> None:
        """Adds what the chosen queries find in rows of one block."""
        norms, sizes = (points * points).sum(axis=1), (block * block).sum(axis=1)
        # products round by less than this share of the norms
        room = 4 * np.finfo(float).eps * (dim + 8)
        plain = not (np.isfinite(norms).all() and np.isfinite(sizes).all())
        step = max(1, DISTANCES_AT_ONCE // len(ids))
        for i in range(0, len(chosen), step):
            own = chosen[i:i + step]
            if plain:
                squares = distances(points[own], block) ** 2
                squares[np.isnan(squares)] = np.inf
                error = SLACK * np.where(np.isfinite(best.bound[own]), best.bound[own], 0) ** 2
            else:
                squares = norms[own, None] + sizes[None, :] - 2 * (points[own] @ block.T)
                error = room * 2 * (norms[own] + sizes.max())
            if not include_self:
                squares[asked[own, None] == ids[None, :]] = np.inf
            limit = best.bound[own] ** 2 * (1 + SLACK) + error
            open_ = np.flatnonzero(np.isinf(limit))
            if len(open_) and len(ids) >= k:
                limit[open_] = np.partition(squares[open_], k - 1, axis=1)[:, k - 1] * (1 + SLACK) + 2 * error[open_]
            row, col = np.nonzero(squares <= limit[:, None])
            for j in range(0, len(row), max(1, DISTANCES_AT_ONCE // dim)):
                r, c = row[j:j + DISTANCES_AT_ONCE // dim], col[j:j + DISTANCES_AT_ONCE // dim]
                apart = points[own[r]] - block[c]
                dist = np.sqrt(np.einsum("ij,ij->i", apart, apart))
                real = np.isfinite(dist) & (dist <= best.bound[own[r]])
                if not include_self:
                    real &= asked[own[r]] != ids[c]
                best.add(own[r[real]], ids[c[real]], dist[real])

    def result(best: Best, asked: np.ndarray) -> pa.RecordBatch:
        row, ids, dist = best.settle()
        return pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids), pa.array(dist)], names=["query", "neighbor", "dist"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, best, asked, points, seen = None, [], None, None, None, None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("group", "lane", "kind", "block")])
            cuts = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                part, mark = batch.slice(start, stop - start), marks[:, start]
                if task != tuple(mark[:2]):
                    if best is not None:
                        yield result(best, asked)
                    task, waiting, best = tuple(mark[:2]), [], None
                ids, vecs = part.column("id").to_numpy(), matrix(part.column("vec"), dim)
                ring = part.column("ring").to_numpy(zero_copy_only=False)
                if mark[2] == 0:
                    waiting.append((ids, vecs, ring))
                    continue
                if best is None:
                    asked, points, reach = (np.concatenate(x) for x in zip(*waiting, strict=True))
                    best = Best(reach, k)
                    seen = {}
                cell = int(part.column("cell")[0].as_py())
                if probes:
                    if not seen:
                        few = max(1, DISTANCES_AT_ONCE // len(numbers))
                        near = np.concatenate([nearest_cells(distances(points[i:i + few], pivots[numbers]), probes)
                                               for i in range(0, len(points), few)])
                        seen = {int(c): np.flatnonzero(near[:, i]) for i, c in enumerate(numbers)}
                    chosen = seen[cell]
                else:
                    if cell not in seen:
                        seen = {cell: distances(points, pivots[cell:cell + 1])[:, 0]}  # blocks come cell by cell within a range
                    limit = best.bound + SLACK * (1 + np.where(np.isfinite(best.bound), best.bound, 0))
                    beyond = (seen[cell] - ring.max() > limit) | (ring.min() - seen[cell] > limit)
                    chosen = np.flatnonzero(~beyond)
                if len(chosen):
                    meet(best, asked, points, chosen, ids, vecs)
        if best is not None:
            yield result(best, asked)

    return rows.mapInArrow(scan, "query long, neighbor long, dist double")


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest (dist, neighbor) of each query, numbered in ``rank``; Spark keeps ``k`` per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "neighbor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: NeighbourIndex, queries: DataFrame, k: int, include_self: bool = False,
           probes: int | None = None) -> DataFrame:
    """``query, rank, neighbor, dist`` of ``queries`` (``id, vec``; ids are unique): exact, or from ``probes`` cells.

    Ties go by neighbour. Queries with fewer than ``k`` other rows get them all."""
    if index.copies > 1 and not probes:
        raise ValueError("an index with copies answers the approximate mode only; give probes")
    anywhere = F.lit(float("inf"))
    asked = grouped_queries(index, queries)
    first = reached_cells(index, asked, k + (not include_self), probes).groupBy("group", "cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).join(index.directory, "cell")
    if probes:
        pairs = cut_lineage(first.select("group", "block"))
        found = scan_blocks(index, asked.withColumn("reach", anywhere), pairs, k * index.copies, include_self, probes)
        if index.copies > 1:
            found = found.groupBy("query", "neighbor").agg(F.min("dist").alias("dist"))
        return first_k(found, k).select("query", "rank", "neighbor", "dist")
    # of these cells, the blocks that the queries' rings meet, and the next ones while they hold too few rows
    gap = F.greatest(F.col("near") - F.col("high"), F.col("low") - F.col("far"), F.lit(0.0))
    upto = Window.partitionBy("group", "cell").orderBy(gap, "block").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0))).where((F.col("before") <= k) | (gap == 0))
    first = cut_lineage(first.select("group", "block"))
    found = cut_lineage(first_k(scan_blocks(index, asked.withColumn("reach", anywhere), first, k, include_self), k))
    bound = found.where(F.col("rank") == k).select("query", F.col("dist").alias("reach"))
    limits = asked.join(bound, "query", "left").withColumn("reach", F.coalesce("reach", anywhere))
    second = reached_cells(index, limits, k).groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    second = second.join(index.directory, "cell").where("near <= high and far >= low").select("group", "block")
    second = cut_lineage(second.join(first, ["group", "block"], "left_anti"))
    rest = scan_blocks(index, limits, second, k, include_self)
    return first_k(found.drop("rank").unionByName(rest), k).select("query", "rank", "neighbor", "dist")


def knn_all(df: DataFrame, key: str, vec: str, k: int = 10, include_self: bool = False, queries: DataFrame | None = None,
            probes: int | None = None, n_cells: int | None = None, block_rows: int = 1024) -> DataFrame:
    """M33 (and M32 with ``queries``): the ``k`` nearest rows of every row or query, exact unless ``probes`` is given."""
    index = build_index(df, key, vec, n_cells, block_rows)
    asked = vectors(df if queries is None else queries, key, vec)
    return search(index, asked, k, include_self, probes)


def knn(df: DataFrame, key: str, vec: str, queries: DataFrame, k: int = 5, include_self: bool = False, **kw) -> DataFrame:
    """The ``k`` nearest neighbours of the rows in ``queries`` among all rows of ``df``."""
    return knn_all(df, key, vec, k, include_self, queries, **kw)


def recall(approximate: DataFrame, exact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of the exact neighbours that an approximate result has, overall or by columns of the exact one."""
    both = exact.join(approximate.select("query", "neighbor", F.lit(1).alias("hit")), ["query", "neighbor"], "left")
    return both.groupBy(*by).agg((F.count("hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("n"))


def knn_profile(nn: DataFrame) -> DataFrame:
    """M33 report: mean neighbour distance per rank."""
    return nn.groupBy("rank").agg(F.avg("dist").alias("mean_dist"), F.count(F.lit(1)).alias("n"))
