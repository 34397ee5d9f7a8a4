"""Hard negatives by slots between the positives' upper limits.

An anchor's positives have one window of scores each, up to a share of the positive's score.
Windows overlap, but their upper limits cut the scores into disjoint slots. Every cell of
candidates keeps an anchor's best few per slot, these are merged per slot, and a window's best
are the best of its own slot, then of the slot below, and so on: one descending merge answers
all windows of the anchor. The lower limits cut off tails of what is merged.

Candidates are dealt into cells of bounded size. A task holds one cell's vectors in memory and
streams the anchors past it, so neither side is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, shuffle_width, tabled

#: Scores that are held at a time in one task: anchors x candidates of a cell.
SCORES_AT_ONCE = 2_000_000
LEAST = np.iinfo(np.int64).min


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, anchor, vec`` of the rows without nulls and non-finite components, components to whole numbers."""
    x = F.transform("vector", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
            .where(finite).select("vec_id", "label", "anchor", F.transform(x, lambda v: F.floor(v * scale)).alias("vec")))


def matrix(lists: pa.ListArray) -> np.ndarray:
    """The lists as rows of whole numbers, short ones filled up with 0."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    out = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, as 64-bit numbers that stop at the largest and smallest.

    Floats multiply where all sums stay within their whole numbers, Python's numbers elsewhere.
    """
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * width
    for kind, whole in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if bound < whole:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def best(scores: np.ndarray, among: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's first ``k`` scores ``among`` the marked, ties by column."""
    n = scores.shape[1]
    if float(np.abs(scores.astype(float)).max(initial=0)) * (n + 1) < 2.0**62:
        order = np.where(among, scores * n + np.arange(n - 1, -1, -1), LEAST)
        at = np.argpartition(order, n - k, axis=1)[:, n - k:] if n > k else np.tile(np.arange(n), (len(scores), 1))
    else:
        at = np.stack([np.lexsort((-row, ~marks))[:k] for row, marks in zip(scores.astype(object), among, strict=True)]) \
            if len(scores) else np.zeros((0, min(k, n)), int)
    rows = np.repeat(np.arange(len(scores)), at.shape[1])
    at = at.ravel()
    held = among[rows, at]
    return rows[held], at[held]


class _Cell:
    """The candidates of one cell, in order of their ids."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def close(self) -> None:
        self.ids = np.concatenate([p.column("vec_id").to_numpy() for p in self.parts])
        self.labels = np.concatenate([p.column("label").to_numpy() for p in self.parts])
        self.vectors = matrix(pa.concat_arrays([p.column("vec") for p in self.parts]))
        self.parts = []


def past_cells(batches: Iterable[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by ``cell, kind, vec_id``: holds the candidates (kind 0), answers the anchors (kind 1)."""
    cell, number, closed = _Cell(), None, False
    for batch in batches:
        keys = 2 * batch.column("cell").to_numpy() + batch.column("kind").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if number != keys[start] // 2:
                cell, number, closed = _Cell(), keys[start] // 2, False
            if keys[start] % 2 == 0:
                cell.add(part)
            elif closed or cell.parts:
                if not closed:
                    cell.close()
                    closed = True
                step = max(1, SCORES_AT_ONCE // len(cell.ids))
                for i in range(0, part.num_rows, step):
                    yield answer(cell, part.slice(i, step))


def dealt(rows: DataFrame, anchors: DataFrame, cells: int) -> DataFrame:
    """Candidates in their cells and every anchor in each cell, sorted to be streamed."""
    extra = [c for c in anchors.columns if c not in rows.columns]
    held = rows.select(F.pmod("n", F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"), "n", "vec_id", "label", "vec",
                       *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "n", "vec_id",
                           "label", "vec", *extra)
    return held.union(asked).repartition("cell").sortWithinPartitions("cell", "kind", "vec_id", "n")


def first_of(rows: DataFrame, keys: list[str], other: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key by falling score, then by ``other``, numbered from 1 in ``rank``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), other))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10,
                   low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id",
                   label_col: str = "label", vector_col: str = "embedding", cell_rows: int = 131_072) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``; a score is the inner product of two such vectors. An
    anchor's positives are the first ``n_positives`` other rows of its label, and for each of them the
    first ``n_negatives`` rows of other labels with ``low * positive <= 100 * negative <= high * positive``
    are returned. First means higher score, then smaller id. ``is_anchor`` is a condition on the table.

    Rows with a null id, label, vector or component, or with a component that is not finite, take no part. Vectors
    of unequal lengths are filled up with 0; components and scores beyond 64 bits stop at the largest
    number. Rows that repeat an id stand for themselves, each anchor row gets its own result, and rows
    of the anchor's id are never its positives. Positives below 0 have no window; anchors without positives
    and empty tables give no rows. Labels that are no whole numbers are compared by 64-bit hashes. Other
    columns are not read.

    Work: rows / cell_rows cells (three per shuffle partition at least), to which all anchors go twice, once
    for the positives and once for the slots; a task holds one cell.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[label_col].dataType.typeName()
    asked = embeddings.withColumn("_anchor", F.coalesce(is_anchor, F.lit(False)))
    rows = pick(asked, vec_id=id_col, label=label_col, vector=vector_col, anchor="_anchor")
    label = F.col("label").cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64("label")
    label = F.when(F.col("label").isNotNull(), label)
    rows = tabled(usable(rows.withColumn("label", label), scale).withColumn("n", F.monotonically_increasing_id()))
    cells = max(3 * shuffle_width(spark), -(-rows.count() // cell_rows))
    anchors = rows.where("anchor").select("n", "vec_id", "label", "vec")
    rows = rows.select("n", "vec_id", "label", "vec")

    def positives_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(cell: _Cell, part: pa.RecordBatch) -> pa.RecordBatch:
            scores = products(matrix(part.column("vec")), cell.vectors)
            same = part.column("label").to_numpy()[:, None] == cell.labels
            same &= part.column("vec_id").to_numpy()[:, None] != cell.ids
            row, col = best(scores, same, n_positives)
            return pa.RecordBatch.from_arrays([pa.array(part.column("n").to_numpy()[row]), pa.array(cell.ids[col]),
                                               pa.array(scores[row, col])], names=["n", "positive_id", "score"])
        yield from past_cells(batches, answer)

    found = dealt(rows, anchors, cells).mapInArrow(positives_in, "n long, positive_id long, score long")
    wide = F.col("score").cast("decimal(38,0)")
    positives = tabled(first_of(found, ["n"], "positive_id", n_positives).where("score >= 0").withColumn("wide", wide)
                       .select("n", "positive_id", F.col("rank").alias("place"), F.col("score").alias("positive_score"),
                               F.expr(f"cast((wide * {low} + 99) div 100 as bigint)").alias("lower"),
                               F.expr(f"cast((wide * {high}) div 100 as bigint)").alias("upper")))
    limits = positives.groupBy("n").agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("uppers"),
                                        F.min("lower").alias("lowest"))

    def slots_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(cell: _Cell, part: pa.RecordBatch) -> pa.RecordBatch:
            scores = products(matrix(part.column("vec")), cell.vectors)
            uppers = part.column("uppers").to_pylist()
            lowest = part.column("lowest").to_numpy()
            other = part.column("label").to_numpy()[:, None] != cell.labels
            other &= scores >= lowest[:, None]
            out = []
            for slot in range(max(map(len, uppers), default=0)):
                own = np.array([len(u) > slot for u in uppers])
                top = np.array([u[slot] if len(u) > slot else LEAST for u in uppers])
                below = np.array([u[slot + 1] if len(u) > slot + 1 else LEAST for u in uppers])
                inside = other & own[:, None] & (scores <= top[:, None]) & (scores > below[:, None])
                row, col = best(scores, inside, n_negatives)
                out.append((part.column("n").to_numpy()[row], top[row], cell.ids[col], scores[row, col]))
            n, top, ids, found = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4))
            return pa.RecordBatch.from_arrays([pa.array(n), pa.array(top), pa.array(ids), pa.array(found)],
                                              names=["n", "slot", "negative_id", "score"])
        yield from past_cells(batches, answer)

    in_slots = dealt(rows, anchors.join(limits, "n"), cells).mapInArrow(
        slots_in, "n long, slot long, negative_id long, score long")
    in_slots = first_of(in_slots, ["n", "slot"], "negative_id", n_negatives).drop("rank")
    merged = first_of(positives.join(in_slots, "n").where(F.col("slot") <= F.col("upper")), ["n", "place"], "negative_id", n_negatives)
    return (merged.where(F.col("score") >= F.col("lower"))
            .join(anchors.select("n", F.col("vec_id").alias("anchor_id")), "n")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    F.col("score").alias("negative_score")))

