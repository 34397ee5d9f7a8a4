"""Window functions and gap filling.

Scale design -- the two-level scan
----------------------------------
A plain ``Window.partitionBy(entity)`` sends every row of an entity to one
task, so an entity holding a third of the panel becomes a third of the job
in one task. Every ordered operator here instead runs in two levels:

1. rows are windowed per ``(entity, chunk)`` (chunk = year by default),
   which bounds a partition by the rows of one entity-year;
2. a summary with one row per ``(entity, chunk)`` (count, first/last
   non-NULL value with its position) is windowed per entity -- it has one
   row per chunk, so it is small even for the hottest entity;
3. the carried state is joined back on ``(entity, chunk)``. The large side
   is already hash-partitioned on those keys by step 1, so only the small
   summary is shuffled for the join.

This gives ffill, bfill, row-position interpolation, lag and global
row-order fill without a single-partition or single-entity task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.order_stats import expand_ranks, grouped_quantiles, quantiles_by_column, value_ranks
from panelforge.session import cut_lineage, fixed_ranges
from panelforge.spec import PanelSpec

UNB_P, UNB_F = Window.unboundedPreceding, Window.unboundedFollowing


def _chunk_expr(spec: PanelSpec) -> Column:
    if spec.chunk:
        return F.col(spec.chunk)
    if spec.month:
        return F.col(spec.year)
    return F.floor(F.col(spec.year) / 8)  # yearly panel: 8-year chunks


def _with_chunk(df: DataFrame, spec: PanelSpec) -> tuple[DataFrame, str]:
    """The chunk column: an existing column is used as is (so a partitioning
    by (entity, year) already present in the plan is reused), otherwise it
    is derived into ``__chunk``."""
    name = spec.chunk or (spec.year if spec.month else None)
    if name and name in df.columns:
        return df, name
    return df.withColumn("__chunk", _chunk_expr(spec)), "__chunk"


def _order_in_chunk(spec: PanelSpec) -> list[str]:
    return spec.time_cols



def _scan(df: DataFrame, spec: PanelSpec, cols: Sequence[str]) -> DataFrame:
    """Adds, for every column ``c``: ``__pv_c``/``__pp_c`` (previous non-NULL
    value / absolute position, current row included), ``__nv_c``/``__np_c``
    (next non-NULL value / position) and ``__pos`` (row position within the
    entity, 1-based). Two-level as described in the module docstring."""
    e = spec.entity
    d, ch = _with_chunk(df, spec)
    wc = Window.partitionBy(e, ch).orderBy(*_order_in_chunk(spec))
    d = d.withColumn("__rn", F.row_number().over(wc))
    wp, wn = wc.rowsBetween(UNB_P, 0), wc.rowsBetween(0, UNB_F)
    for c in cols:
        pt = F.when(F.col(c).isNotNull(), F.struct(F.col("__rn").alias("p"), F.col(c).alias("v")))
        d = d.withColumn(f"__ip_{c}", F.last(pt, ignorenulls=True).over(wp))
        d = d.withColumn(f"__in_{c}", F.first(pt, ignorenulls=True).over(wn))
    # per-chunk summary, computed from the windowed rows (same partitioning)
    aggs = [F.count(F.lit(1)).alias("__cnt")]
    for c in cols:
        aggs.append(F.max_by(F.col(f"__ip_{c}"), F.col("__rn")).alias(f"__cl_{c}"))   # last non-null
        aggs.append(F.min_by(F.col(f"__in_{c}"), F.col("__rn")).alias(f"__cf_{c}"))   # first non-null
    s = d.groupBy(e, ch).agg(*aggs)
    ws = Window.partitionBy(e).orderBy(ch)
    s = s.withColumn("__off", F.coalesce(F.sum("__cnt").over(ws.rowsBetween(UNB_P, -1)), F.lit(0)))
    carry = []
    for c in cols:
        last_abs = F.when(F.col(f"__cl_{c}").isNotNull(),
                          F.struct((F.col(f"__cl_{c}.p") + F.col("__off")).alias("p"), F.col(f"__cl_{c}.v").alias("v")))
        first_abs = F.when(F.col(f"__cf_{c}").isNotNull(),
                           F.struct((F.col(f"__cf_{c}.p") + F.col("__off")).alias("p"), F.col(f"__cf_{c}.v").alias("v")))
        s = s.withColumn(f"__cp_{c}", F.last(last_abs, ignorenulls=True).over(ws.rowsBetween(UNB_P, -1)))
        s = s.withColumn(f"__cn_{c}", F.first(first_abs, ignorenulls=True).over(ws.rowsBetween(1, UNB_F)))
        carry += [f"__cp_{c}", f"__cn_{c}"]
    s = s.select(e, ch, "__off", *carry)
    out = d.join(s, on=[e, ch], how="left").withColumn("__chunk", F.col(ch))
    out = out.withColumn("__pos", F.col("__rn") + F.col("__off"))
    for c in cols:
        ip, inn = F.col(f"__ip_{c}"), F.col(f"__in_{c}")
        out = out.withColumns({
            f"__pv_{c}": F.coalesce(ip["v"], F.col(f"__cp_{c}.v")),
            f"__pp_{c}": F.coalesce(ip["p"] + F.col("__off"), F.col(f"__cp_{c}.p")),
            f"__nv_{c}": F.coalesce(inn["v"], F.col(f"__cn_{c}.v")),
            f"__np_{c}": F.coalesce(inn["p"] + F.col("__off"), F.col(f"__cn_{c}.p")),
        })
    return out



def _interp(c: str) -> Column:
    pv, pp, nv, np_ = (F.col(f"__pv_{c}"), F.col(f"__pp_{c}"), F.col(f"__nv_{c}"), F.col(f"__np_{c}"))
    lin = pv + (nv - pv) * (F.col("__pos") - pp) / (np_ - pp)
    return (F.when(F.col(c).isNotNull(), F.col(c))
            .when(pv.isNotNull() & nv.isNotNull(), F.when(np_ == pp, pv).otherwise(lin))
            .otherwise(F.coalesce(pv, nv)))


def ffill(df: DataFrame, cols: Sequence[str], spec: PanelSpec) -> DataFrame:
    """Forward fill per entity in time order."""
    s = _scan(df, spec, cols)
    s = s.withColumns({c: F.coalesce(F.col(c), F.col(f"__pv_{c}")) for c in cols})
    return s.select(*df.columns)


def bfill(df: DataFrame, cols: Sequence[str], spec: PanelSpec) -> DataFrame:
    """Backward fill per entity in time order."""
    s = _scan(df, spec, cols)
    s = s.withColumns({c: F.coalesce(F.col(c), F.col(f"__nv_{c}")) for c in cols})
    return s.select(*df.columns)


def interpolate(df: DataFrame, cols: Sequence[str], spec: PanelSpec) -> DataFrame:
    """Linear interpolation by row position within the entity, values
    before the first / after the last observation held (pandas
    ``interpolate(limit_direction='both')``)."""
    s = _scan(df, spec, cols)
    s = s.withColumns({c: _interp(c) for c in cols})
    return s.select(*df.columns)


def group_medians(df: DataFrame, by: Sequence[str], cols: Sequence[str], names: Sequence[str], method: str = "exact") -> DataFrame:
    """The median of each column per group under the given names. ``exact`` counts value bins of
    all groups and columns together (``grouped_quantiles``); ``percentile`` holds a value map per group, ``approx`` a sketch."""
    if method == "exact":
        return grouped_quantiles(df, by, cols, [0.5], names)
    median = F.median if method == "percentile" else (lambda c: F.percentile_approx(c, 0.5, 10000))
    return df.groupBy(*by).agg(*[median(c).alias(n) for c, n in zip(cols, names)])


def fill_group_median(df: DataFrame, cols: Sequence[str], by: str | Sequence[str], method: str = "exact") -> DataFrame:
    """Fill with the group median (``group_medians``, then join back)."""
    by = [by] if isinstance(by, str) else list(by)
    med = group_medians(df, by, cols, [f"__med_{c}" for c in cols], method)
    out = df.join(med, on=by, how="left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__med_{c}")) for c in cols})
    return out.select(*df.columns)


def _attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row: equi join on a constant key
    with the (provably one-row) side broadcast -- no shuffle of ``df``."""
    return (df.withColumn("__k", F.lit(1))
            .join(F.broadcast(one_row.withColumn("__k", F.lit(1))), on="__k", how="left").drop("__k"))


def fill_median(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Fill with the overall median of each column. The medians are
    exact (``quantiles_by_column``: counts of value bins) and are applied as literals."""
    med = quantiles_by_column(df, list(cols), [0.5], "approx" if approx else "exact")
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c][0]).cast(df.schema[c].dataType))
                           for c in cols if med[c][0] is not None})


REFERENCE_STAGES = ("ffill", "bfill", "interpolate", "entity_median", "year_median", "median")
DEFAULT_STAGES = ("interpolate", "ffill", "bfill", "entity_median", "year_median", "median")


def impute_cascade(df: DataFrame, cols: Sequence[str], spec: PanelSpec,
                   stages: Sequence[str] | str = DEFAULT_STAGES, approx: bool = False,
                   with_log: bool = True):
    """Staged gap filling with a NULL counter after every stage.

    The within-entity stages (ffill, bfill, interpolate) all come from one
    two-level scan of the original column: after ffill only leading NULLs
    remain (filled later from the next observation), after bfill only
    trailing ones, and interpolation run first fills everything an entity
    can fill. Group-median stages then aggregate the current column and
    join back. ``stages='reference'`` gives the reference order (ffill and
    bfill first, so interpolation and entity median find nothing left).
    Returns ``(df, log)``; the log has one row per (column, stage)."""
    if stages == "reference":
        stages = REFERENCE_STAGES
    stages = list(stages)
    within = {"ffill", "bfill", "interpolate"}
    medians = {"entity_median": [spec.entity], "year_median": [spec.year], "median": []}
    for st in stages:
        if st not in within and st not in medians:
            raise ValueError(f"unknown stage {st!r}")
    first_median = next((i for i, st in enumerate(stages) if st in medians), len(stages))
    if any(st in within for st in stages[first_median:]):
        raise ValueError("within-entity stages must precede group-median stages")
    s = _scan(df, spec, cols) if first_median else df
    s = s.withColumns({f"__s0_{c}": F.col(c) for c in cols})
    done: set[str] = set()
    for i, st in enumerate(stages, start=1):
        prev = {c: F.col(f"__s{i - 1}_{c}") for c in cols}
        if st == "ffill":
            s = s.withColumns({f"__s{i}_{c}": F.coalesce(prev[c], F.col(f"__pv_{c}")) for c in cols})
        elif st == "bfill":
            s = s.withColumns({f"__s{i}_{c}": F.coalesce(prev[c], F.col(f"__nv_{c}")) for c in cols})
        elif st == "interpolate":
            if done & {"ffill", "bfill"}:
                s = s.withColumns({f"__s{i}_{c}": F.coalesce(prev[c], F.col(f"__pv_{c}"), F.col(f"__nv_{c}"))
                                   for c in cols})
            else:
                s = s.withColumns({f"__s{i}_{c}": _interp(c) for c in cols})
        elif st == "entity_median" and ("interpolate" in done or {"ffill", "bfill"} <= done):
            # every entity is now either complete or wholly NULL, so an entity
            # median cannot fill anything: skip the aggregate and its join
            s = s.withColumns({f"__s{i}_{c}": prev[c] for c in cols})
        else:
            by = medians[st]
            if by:
                s = cut_lineage(s)
                s = s.join(group_medians(s, by, [f"__s{i - 1}_{c}" for c in cols], [f"__m{i}_{c}" for c in cols],
                                         "approx" if approx else "exact"), on=by, how="left")
                s = s.withColumns({f"__s{i}_{c}": F.coalesce(prev[c], F.col(f"__m{i}_{c}")) for c in cols})
            else:
                # overall median: exact and memory-bounded, applied as literals; the
                # scanned panel is written once, as the quantile passes read it again
                s = cut_lineage(s)
                names = [f"__s{i - 1}_{c}" for c in cols]
                med = quantiles_by_column(s.select(*names), names, [0.5], "approx" if approx else "exact")
                s = s.withColumns({f"__s{i}_{c}": F.coalesce(prev[c], F.lit(med[f"__s{i - 1}_{c}"][0]).cast("double"))
                                   for c in cols})
        done.add(st)
    last = len(stages)
    stage_cols = [f"__s{i}_{c}" for c in cols for i in range(0, last + 1)]
    out = s.withColumns({c: F.col(f"__s{last}_{c}") for c in cols})
    if not with_log:
        return out.select(*df.columns)
    kept = out.select(*df.columns, *stage_cols)
    return kept.select(*df.columns), cascade_log(kept, cols, stages)


def cascade_log(staged: DataFrame, cols: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """NULLs remaining after each stage, all counters in one aggregate."""
    aggs = [F.count_if(F.col(f"__s{i}_{c}").isNull()).alias(f"{c}|{i}")
            for c in cols for i in range(0, len(stages) + 1)]
    wide = staged.agg(*aggs)
    names = ["initial", *stages]
    rows = []
    for c in cols:
        for i in range(0, len(stages) + 1):
            filled = (F.col(f"`{c}|{i - 1}`") - F.col(f"`{c}|{i}`")) if i else F.lit(0).cast("bigint")
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(i).alias("step"), F.lit(names[i]).alias("stage"),
                                 F.col(f"`{c}|{i}`").alias("missing"), filled.alias("filled")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scan_global(df: DataFrame, order: Sequence[str | Column], last_cols: Sequence[str] = (),
                first_cols: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Distributed prefix scan in a global order: for every row, the last
    non-NULL value of each ``last_cols`` column among the rows strictly
    before it (``__prev_<c>``) and the first non-NULL value of each
    ``first_cols`` column strictly after it (``__next_<c>``).

    Rows are range-partitioned on the order once (``fixed_ranges``); each
    range is scanned by its own window, and the carry between ranges comes from a table with one row
    per range. No window ever spans the whole data."""
    oc = [F.col(o) if isinstance(o, str) else o for o in order]
    okey = F.struct(*oc)
    r = fixed_ranges(df, oc, "__rp", partitions)
    aggs = []
    for c in last_cols:
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"__rl_{c}"))
    for c in first_cols:
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"__rf_{c}"))
    rng = r.groupBy("__rp").agg(*aggs)
    wr = Window.orderBy("__rp")
    carry = [F.last(f"__rl_{c}", ignorenulls=True).over(wr.rowsBetween(UNB_P, -1)).alias(f"__cp_{c}") for c in last_cols]
    carry += [F.first(f"__rf_{c}", ignorenulls=True).over(wr.rowsBetween(1, UNB_F)).alias(f"__cn_{c}") for c in first_cols]
    rng = rng.select("__rp", *carry)  # one row per range: bounded by ``partitions``
    wi = Window.partitionBy("__rp").orderBy(*oc)
    out = r.join(F.broadcast(rng), "__rp", "left")
    new = {}
    for c in last_cols:
        new[f"__prev_{c}"] = F.coalesce(F.last(c, ignorenulls=True).over(wi.rowsBetween(UNB_P, -1)), F.col(f"__cp_{c}"))
    for c in first_cols:
        new[f"__next_{c}"] = F.coalesce(F.first(c, ignorenulls=True).over(wi.rowsBetween(1, UNB_F)), F.col(f"__cn_{c}"))
    out = out.withColumns(new)
    return out.drop("__rp", *[f"__cp_{c}" for c in last_cols], *[f"__cn_{c}" for c in first_cols])


def ffill_global(df: DataFrame, cols: Sequence[str], spec: PanelSpec, backward: bool = True) -> DataFrame:
    """Forward fill (then backward fill) in global row order across
    entities (the reference's ungrouped fill), without a single-partition
    window: per-(entity, chunk) scans, then a carry over the small
    per-(entity, chunk) summary in global order, then a join back."""
    e = spec.entity
    s = _scan(df, spec, cols)
    # per-(entity, chunk) last / first non-null, ordered globally by (entity, chunk)
    aggs = []
    for c in cols:
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__pos"))).alias(f"__gl_{c}"))
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__pos"))).alias(f"__gf_{c}"))
    summ = s.groupBy(e, "__chunk").agg(*aggs)
    # carry across the per-(entity, chunk) summary in global order with a
    # distributed prefix scan (no window over the whole summary)
    summ = scan_global(summ, [e, "__chunk"], [f"__gl_{c}" for c in cols], [f"__gf_{c}" for c in cols])
    carry = []
    for c in cols:
        summ = summ.withColumnsRenamed({f"__prev___gl_{c}": f"__gp_{c}", f"__next___gf_{c}": f"__gn_{c}"})
        carry += [f"__gp_{c}", f"__gn_{c}"]
    s = s.join(summ.select(e, "__chunk", *carry), on=[e, "__chunk"], how="left")
    fills = {}
    for c in cols:
        in_entity_prev = F.col(f"__pv_{c}")
        in_entity_next = F.col(f"__nv_{c}")
        f = F.coalesce(F.col(c), in_entity_prev, F.col(f"__gp_{c}"))
        if backward:
            f = F.coalesce(f, in_entity_next, F.col(f"__gn_{c}"))
        fills[c] = f
    return s.withColumns(fills).select(*df.columns)


def impute_by_share(df: DataFrame, cols: Sequence[str], spec: PanelSpec, drop_above: float = 50.0,
                    median_above: float = 20.0, scope: str = "entity", approx: bool = False) -> DataFrame:
    """Per column by missing share: > drop_above dropped, > median_above
    filled with the overall median, else forward then backward fill
    (``scope='global'`` reproduces the reference's ungrouped fill)."""
    from panelforge.functions.predicates import missing_shares

    shares = missing_shares(df, cols)
    drop = [c for c in cols if shares[c] > drop_above]
    med = [c for c in cols if median_above < shares[c] <= drop_above]
    fill = [c for c in cols if 0 < shares[c] <= median_above]
    out = df.drop(*drop)
    if med:
        out = fill_median(out, med, approx)
    if fill:
        if scope == "global":
            out = ffill_global(out, fill, spec)
        else:
            s = _scan(out, spec, fill)
            s = s.withColumns({c: F.coalesce(F.col(c), F.col(f"__pv_{c}"), F.col(f"__nv_{c}")) for c in fill})
            out = s.select(*out.columns)
    return out


def lag_value(df: DataFrame, col: str, spec: PanelSpec, out: str | None = None) -> DataFrame:
    """Previous row's value per entity, two-level (the first row of a chunk
    takes the last row of the previous chunk from the summary)."""
    e = spec.entity
    out = out or f"{col}_lag"
    d, ch = _with_chunk(df, spec)
    wc = Window.partitionBy(e, ch).orderBy(*spec.time_cols)
    d = d.withColumn("__rn", F.row_number().over(wc)).withColumn("__lag", F.lag(col).over(wc))
    summ = d.groupBy(e, ch).agg(F.max_by(F.col(col), F.col("__rn")).alias("__last"))
    ws = Window.partitionBy(e).orderBy(ch)
    summ = summ.withColumn("__carry", F.lag("__last").over(ws)).select(e, ch, "__carry")
    d = d.join(summ, on=[e, ch], how="left")
    d = d.withColumn(out, F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__lag")))
    return d.select(*df.columns, out)


def pct_change(df: DataFrame, col: str, spec: PanelSpec, out: str = "pct_change") -> DataFrame:
    """``(x - x_prev) / x_prev`` per entity; NULL where x_prev is 0."""
    d = lag_value(df, col, spec, "__prev")
    return d.withColumn(out, F.try_divide(F.col(col) - F.col("__prev"), F.col("__prev"))).drop("__prev")


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  salt_buckets: int = 16, salt_on: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order`` in two stages: top-n within
    (key, salt) sub-groups, then top-n over the at most ``n x salt_buckets``
    survivors per key. A hot key is thereby ranked by many tasks."""
    salt_src = [F.col(c) for c in (salt_on or [c for c in df.columns if c not in keys])]
    d = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    d = d.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= n)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return d.withColumn("rn", F.row_number().over(w2)).where(F.col("rn") <= n).drop("__salt", "__r1")


def recent_mean(df: DataFrame, key: str, order: str, col: str, n: int = 3, out: str = "recent_mean") -> DataFrame:
    """Mean of the last ``n`` rows per key."""
    last = top_n_per_key(df.select(key, order, col), [key], [F.col(order).desc()], n, salt_on=[order])
    return last.groupBy(key).agg(F.avg(col).alias(out), F.count(F.lit(1)).alias("n_recent"))


def recent_history(df: DataFrame, key: str, order: str, col: str, n: int = 5,
                   out: str = "history") -> DataFrame:
    """The last ``n`` values per key, oldest first (bounded array)."""
    last = top_n_per_key(df.select(key, order, col), [key], [F.col(order).desc()], n, salt_on=[order])
    arr = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("v"))))
    return last.groupBy(key).agg(F.transform(arr, lambda x: x["v"]).alias(out))


def rank_entities(totals: DataFrame, col: str, key: str, k: int | None = None) -> DataFrame:
    """Rank by total, 1 = largest; ties by key. With ``k`` the
    top-k is taken first (distributed TakeOrdered) and only k rows are
    ranked; without it the rank is a distributed global row index."""
    if k:
        d = totals.orderBy(F.col(col).desc(), F.col(key)).limit(k)
        return d.withColumn("rank", F.row_number().over(Window.orderBy(F.col(col).desc(), F.col(key))))
    return global_row_index(totals, [F.col(col).desc(), F.col(key)], out="rank")


def carry_header(df: DataFrame, file_col: str, line_col: str, header_col: str, out: str = "header",
                 block_lines: int = 10_000) -> DataFrame:
    """Header carried down over the following lines of the same file.

    A file is cut into blocks of ``block_lines`` line numbers. Lines are windowed inside their block, a
    table with one row per block carries the last header of the earlier blocks, and lines before
    a block's first header take that one; so a file of a million lines is the work of many tasks."""
    d = df.withColumn("__block", F.floor(F.col(line_col) / block_lines))
    last = F.max_by(F.col(header_col), F.when(F.col(header_col).isNotNull(), F.col(line_col)))
    blocks = d.groupBy(file_col, "__block").agg(last.alias("__last"))
    earlier = Window.partitionBy(file_col).orderBy("__block").rowsBetween(UNB_P, -1)
    blocks = blocks.select(F.col(file_col).alias("__file"), F.col("__block").alias("__of"),
                           F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    inside = Window.partitionBy(file_col, "__block").orderBy(line_col).rowsBetween(UNB_P, 0)
    d = d.withColumn("__own", F.last(F.col(header_col), ignorenulls=True).over(inside))
    d = d.join(blocks, F.col(file_col).eqNullSafe(F.col("__file")) & (F.col("__block") == F.col("__of")), "left")
    return d.select(*df.columns, F.coalesce("__own", "__carried").alias(out))


def components_for(var: DataFrame, idx: str, ratio: str, thresholds: Sequence[float] = (0.9, 0.95)) -> DataFrame:
    """Cumulative explained variance and the first component count
    reaching each threshold (on the small per-component table)."""
    w = Window.orderBy(idx).rowsBetween(UNB_P, 0)
    cum = var.withColumn("cumulative", F.sum(ratio).over(w))
    return cum.agg(*[F.min(F.when(F.col("cumulative") >= t, F.col(idx))).alias(f"n_for_{int(round(t * 100))}")
                     for t in thresholds])


# Coefficients of Acklam's rational approximation of the
# inverse standard normal CDF (public algorithm, relative error < 1.2e-9).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF as a native expression."""
    plow, phigh = 0.02425, 1 - 0.02425
    q_lo = F.sqrt(-2 * F.log(p))
    lo = _poly(_C, q_lo) / (_poly(_D, q_lo) * q_lo + 1)
    q = p - 0.5
    r = q * q
    mid = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    q_hi = F.sqrt(-2 * F.log(1 - p))
    hi = -_poly(_C, q_hi) / (_poly(_D, q_hi) * q_hi + 1)
    return F.when(p < plow, lo).when(p > phigh, hi).otherwise(mid)


def global_row_index(df: DataFrame, order: Sequence[str | Column], partitions: int | None = None,
                     out: str = "row_idx") -> DataFrame:
    """1-based position in a global sort without a single-partition window:
    rows are dealt into ranges once and written (``fixed_ranges``), each range
    is sorted locally, and the counts (one row per range) of the same written
    rows give each range's offset."""
    ranged = fixed_ranges(df, list(order), "__pid", partitions)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(UNB_P, -1)
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).select("__pid", "__off")
    wl = Window.partitionBy("__pid").orderBy(*order)
    ranked = ranged.withColumn("__rn", F.row_number().over(wl))
    return (ranked.join(F.broadcast(offs), "__pid").withColumn(out, F.col("__rn") + F.col("__off"))
            .drop("__pid", "__rn", "__off"))


def qq_table(df: DataFrame, col: str) -> DataFrame:
    """Normal Q-Q positions: sorted sample vs theoretical quantiles at
    Filliben's order-statistic medians (the probplot convention). Ranks come from
    counts of distinct values (``value_ranks``), so a very common value is no task's burden."""
    ranks = cut_lineage(value_ranks(df, col))
    n = ranks.agg(F.sum("n")).first()[0] or 0
    last = 0.5 ** (1.0 / n) if n else 0.5
    u = (F.when(F.col("i") == 1, F.lit(1 - last)).when(F.col("i") == n, F.lit(last))
         .otherwise((F.col("i") - 0.3175) / (n + 0.365)))
    return expand_ranks(ranks, "i").select("i", F.col(col).alias("sample"), norm_ppf(u).alias("theoretical"))


def forecast_year(df: DataFrame, key: str, year: str) -> DataFrame:
    """Latest year per key and the year to forecast (latest + 1)."""
    return df.groupBy(key).agg(F.max(year).alias("latest_year"), (F.max(year) + 1).alias("forecast_year"))

