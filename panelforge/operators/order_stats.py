"""Exact order statistics of columns and of groups, without value maps and without sorting rows.

Values fall into bins that grow with them, and only counts of bins are aggregated. The first pass cuts
by sign and logarithm, which bounds every later interval to a small part of one power of two, however wide the
column is and with infinities in it. Each further pass cuts the interval that holds a wanted position
into equal parts, 12 bits finer, so at most five follow. Intervals of few rows end in one
pass that takes their values. ``quantiles_by_column`` keeps the few intervals of whole columns on the
driver; ``grouped_quantiles`` keeps one row per group and position in a table, for any number of groups.

Quantiles interpolate linearly between neighbours (the pandas rule). NULL and NaN take no part.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import cut_lineage, fixed_ranges, range_partitions

#: Equal bins that a pass cuts each open interval into, and rows of an interval whose values are taken as they are.
BINS, FEW_ROWS = 4096, 2048
#: Bins of the first pass for each power of two; code of the power 2**0, beyond that of any smaller one.
PER_OCTAVE, OFFSET = 64, 70_000
INFINITE = 200_000


def log_code(x: Column) -> Column:
    """A whole number that never falls as ``x`` grows; infinities and 0 have codes of their own."""
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE) + OFFSET
    size = F.when(F.abs(x) == float("inf"), F.lit(INFINITE)).otherwise(size).cast("int")
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


def cell_of(x: Column, low: Column, high: Column) -> Column:
    """The equal part of ``low..high`` that holds ``x``, from 0 to ``BINS``."""
    return F.floor((x - low) / (high - low) * BINS).cast("int")


def positions(n: int, qs: Sequence[float]) -> list[int]:
    """The places, from 0, of the values that the quantiles lie between."""
    found = {int(math.floor((n - 1) * q)) for q in qs}
    return sorted(found | {min(k + 1, n - 1) for k in found})


def between(a: float, b: float, part: float) -> float:
    return a if part == 0 or a == b else a + part * (b - a)


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], method: str = "exact") -> list[float | None]:
    """Exact quantiles of one column, for ungrouped use; see ``quantiles_by_column``."""
    return quantiles_by_column(df, [col], qs, method)[col]


def quantiles_by_column(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                        method: str = "exact") -> dict[str, list[float | None]]:
    """Exact quantiles of several columns in seven passes or fewer, most often in two.

    No row is shuffled, and what reaches the driver per pass is bounded: the logarithmic bins that hold values
    (some hundreds for each power of ten), then at most ``BINS`` counts or ``FEW_ROWS`` values for each
    interval that a quantile lies in. The columns are written once, as doubles: sums of doubles differ in their last bits
    from one evaluation to the next, and every pass has to see the same values. ``percentile`` and ``approx`` use those
    aggregates instead."""
    qs = [float(q) for q in qs]
    cols = list(dict.fromkeys(cols))
    if method in ("percentile", "approx"):
        wide = df.agg(*[(F.percentile_approx(c, qs, 10000) if method == "approx"
                         else F.percentile(c, F.array(*[F.lit(q) for q in qs]))).alias(c) for c in cols]).first()
        return {c: [None] * len(qs) if wide[c] is None else [float(x) for x in wide[c]] for c in cols}
    d = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double") + 0.0, F.lit(None)).alias(f"x{i}") for i, c in enumerate(cols)])
    d = cut_lineage(d)
    spans: dict[tuple[int, int], tuple[float, float, int, int]] = {}  # (column, place) -> low, high, rows, rows before
    sizes = [0] * len(cols)
    first = _stacked(d, [F.when(F.col(f"x{i}").isNotNull(), F.lit(i * 1_000_000) + log_code(F.col(f"x{i}"))) for i in range(len(cols))])
    bins = first.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    for i, own in itertools.groupby(sorted(bins, key=lambda r: (_column(r["k"]), r["lo"])), lambda r: _column(r["k"])):
        own = [(r["n"], r["lo"], r["hi"]) for r in own]
        sizes[i] = sum(n for n, _, _ in own)
        for place in positions(sizes[i], qs):
            spans[i, place] = _holding(own, place, 0)
    while True:
        cut = sorted({(i, s) for (i, _), s in spans.items() if s[0] < s[1]})
        if not cut:
            break
        found = _cut_spans(d, len(cols), cut)
        for (i, place), span in spans.items():
            if span[0] < span[1]:
                spans[i, place] = _holding(found[i, span], place, span[3])
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        n = sizes[i]
        at = [(n - 1) * q for q in qs]
        out[c] = [between(spans[i, int(h)][0], spans[i, min(int(h) + 1, n - 1)][0], h - int(h)) for h in at] if n else [None] * len(qs)
    return out


def _column(code: int) -> int:
    return (code + 500_000) // 1_000_000


def _stacked(d: DataFrame, codes: list[Column]) -> DataFrame:
    """One row ``k, x`` per row and column whose code is not NULL."""
    each = d.select(*[c.alias(f"k{i}") for i, c in enumerate(codes)], *d.columns)
    names = ", ".join(f"k{i}, x{i}" for i in range(len(codes)))
    return each.selectExpr(f"stack({len(codes)}, {names}) as (k, x)").where("k is not null")


def _holding(bins: list[tuple], place: int, before: int) -> tuple:
    """Low, high, rows and rows before of the bin that holds a place; the bins are in order."""
    ends = list(itertools.accumulate((n for n, _, _ in bins), initial=before))
    at = bisect.bisect_right(ends, place) - 1
    n, low, high = bins[at]
    return (low, high, n, ends[at])


def _cut_spans(d: DataFrame, n_cols: int, cut: list[tuple]) -> dict[tuple, list[tuple]]:
    """Per interval its bins ``rows, low, high`` in order; intervals of few rows are cut into their values."""
    codes = [F.lit(None).cast("long")] * n_cols
    few = []
    for j, (i, (low, high, n, _)) in enumerate(cut):
        x = F.col(f"x{i}")
        inside = (x >= low) & (x <= high)
        start = F.lit(j * (BINS + 1)).cast("long")
        code = start if n <= FEW_ROWS else start + cell_of(x, F.lit(low), F.lit(high))
        codes[i] = F.when(inside, code).otherwise(codes[i])
        if n <= FEW_ROWS:
            few.append(j * (BINS + 1))
    rows = _stacked(d, codes)
    value = F.when(F.col("k").isin(few), F.col("x")) if few else F.lit(None).cast("double")
    counts = rows.groupBy("k", value.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out: dict[tuple, list[tuple]] = {s: [] for s in cut}
    for r in sorted(counts.collect(), key=lambda r: (r["k"], r["lo"])):
        out[cut[r["k"] // (BINS + 1)]].append((r["n"], r["lo"], r["hi"]))
    return out


def _same(one: Sequence[str], two: Sequence[str]) -> Column:
    """Null-safe equality of the paired columns."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(one, two, strict=True)])


def grouped_quantiles(df: DataFrame, keys: Sequence[str], cols: str | Sequence[str], qs: Sequence[float],
                      names: Sequence[str] | None = None) -> DataFrame:
    """Exact quantiles of columns per group, all groups and columns at once: ``keys`` and one column each.

    ``names`` has one name per column and quantile, column by column. NULL keys are a group;
    groups without values have no row.

    Every pass is one partial aggregate by (group, column, bin), so a group that holds a third of the rows is
    added up where its rows are. Intervals are rows of a table, joined to the values by group; AQE sends
    them along where they are few and splits a hot group where not. A task holds at most
    ``FEW_ROWS`` values of an interval."""
    keys, cols, qs = list(keys), [cols] if isinstance(cols, str) else list(cols), [float(q) for q in qs]
    names = list(names or [f"q{int(round(q * 100))}" if len(cols) == 1 else f"{c}_q{int(round(q * 100))}" for c in cols for q in qs])
    ks = [f"__g{i}" for i in range(len(keys))]
    wide = df.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)],
                     *[F.nanvl(F.col(f"`{c}`").cast("double") + 0.0, F.lit(None)).alias(f"x{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"{i}, x{i}" for i in range(len(cols)))
    rows = cut_lineage(wide.selectExpr(*ks, f"stack({len(cols)}, {pairs}) as (__c, __x)").where("__x is not null"))
    group = [*ks, "__c"]

    def held(cells: DataFrame, by: list[str], order: str) -> DataFrame:
        """Adds the rows before each cell and the rows of all cells."""
        w = Window.partitionBy(*by)
        upto = F.sum("__n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return cells.withColumn("__before", upto - F.col("__n")).withColumn("__all", F.sum("__n").over(w))

    def cells_of(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))

    first = held(cells_of(rows.withColumn("__code", log_code(F.col("__x"))), [*group, "__code"]), group, "__code")
    h = [(F.col("__all") - 1) * F.lit(q) for q in qs]
    places = [F.floor(x) for x in h] + [F.least(F.floor(x) + 1, F.col("__all") - 1) for x in h]
    state = (first.withColumn("__at", F.explode(F.array_distinct(F.array(*places))))
             .where((F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__n")))
             .select(*group, "__all", "__at", (F.col("__at") - F.col("__before")).alias("__in"), "__n", "__lo", "__hi"))
    state = cut_lineage(state)
    span = [*group, "__lo", "__hi"]
    others = [f"{c}__" for c in span]

    def inside(spans: DataFrame) -> DataFrame:
        """The values that lie in the intervals, with their interval's bounds."""
        asked = spans.select(*[F.col(c).alias(o) for c, o in zip(span, others)]).distinct()
        low, high = others[-2:]
        return (rows.join(asked, _same(group, others[:-2]) & (F.col("__x") >= F.col(low)) & (F.col("__x") <= F.col(high)))
                .drop(*group))

    wide_spans = (F.col("__lo") < F.col("__hi")) & (F.col("__n") > FEW_ROWS)
    while not state.where(wide_spans).isEmpty():
        cells = inside(state.where(wide_spans)).withColumn("__cell", cell_of(F.col("__x"), F.col("__lo__"), F.col("__hi__")))
        cells = held(cells_of(cells, [*others, "__cell"]), others, "__cell").drop("__all")
        cells = cells.withColumnsRenamed({"__n": "n", "__lo": "lo", "__hi": "hi"})
        finer = (state.where(wide_spans).join(cells, _same(span, others))
                 .where((F.col("__in") >= F.col("__before")) & (F.col("__in") < F.col("__before") + F.col("n")))
                 .select(*group, "__all", "__at", (F.col("__in") - F.col("__before")).alias("__in"), F.col("n").alias("__n"),
                         F.col("lo").alias("__lo"), F.col("hi").alias("__hi")))
        state = cut_lineage(state.where(~wide_spans).unionByName(finer))
    some = state.where("__lo < __hi")
    values = inside(some).groupBy(*others).agg(F.sort_array(F.collect_list("__x")).alias("__values"))
    state = state.join(values, _same(span, others), "left")
    value = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.get("__values", F.col("__in").cast("int")))
    state = state.withColumn("__value", value)
    out = []
    for i in range(len(cols)):
        for x, low, high in zip(h, places[:len(qs)], places[len(qs):]):
            mine = F.col("__c") == i
            a, b = (F.max(F.when(mine & (F.col("__at") == p), F.col("__value"))) for p in (low, high))
            part = F.max(F.when(mine, x - F.floor(x)))
            out.append(F.when((part == 0) | (a == b), a).otherwise(a + part * (b - a)))
    return (state.groupBy(*ks).agg(*[o.alias(n) for o, n in zip(out, names, strict=True)])
            .withColumnsRenamed(dict(zip(ks, keys))))


def value_ranks(df: DataFrame, col: str, by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """One row per group and distinct value: ``n`` rows of it and ``before``, the rows of the group with smaller values.

    Rows are counted by (group, value) first, so ties never meet as rows: a value that half of all rows
    have is one row here. The distinct values are dealt into ranges, and counts of whole ranges (one row
    per group and range) carry the sums from range to range. NULL and NaN values take no part."""
    by = list(by)
    rows = df.select(*by, F.col(col)).where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    counts = rows.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    ranged = fixed_ranges(counts, [*[F.col(b) for b in by], F.col(col)], "__range", partitions)
    parts = ranged.groupBy(*by, "__range").agg(F.sum("n").alias("__all"))
    upto = Window.partitionBy(*by, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__range").alias("__part"),
                         F.coalesce(F.sum("__all").over(upto), F.lit(0)).alias("__earlier"))
    inside = Window.partitionBy("__range", *by).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("__own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    on = _same(["__range", *by], ["__part", *[f"__{b}" for b in by]])
    return ranked.join(parts, on).select(*by, col, "n", (F.col("__own") + F.col("__earlier")).alias("before"))


def expand_ranks(ranks: DataFrame, out: str = "i", rows_per_piece: int = 10_000, rows_per_task: int = 500_000) -> DataFrame:
    """One row per original row, numbered from 1 in ``out``; counts are cut into pieces that are dealt out first.

    ``ranks`` is read twice. The number of tasks follows the rows that come out: the pieces themselves are so small
    that Spark would put all of them into one task."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows_per_piece).cast("long"))
    tasks = math.ceil((ranks.agg(F.sum("n")).first()[0] or 0) / rows_per_task)
    tasks = max(tasks, range_partitions(ranks.sparkSession))
    pieces = ranks.withColumn("__start", F.explode(starts)).repartition(tasks, "before", "__start")
    stop = F.least(F.col("__start") + rows_per_piece, F.col("n")) - 1
    each = pieces.withColumn("__at", F.explode(F.sequence(F.col("__start"), stop)))
    return each.withColumn(out, F.col("before") + F.col("__at") + 1).drop("__start", "__at", "before", "n")
