"""Joins and set operations.

No join is hinted: AQE broadcasts a side whose real size in bytes is under
the session's threshold and splits skewed partitions otherwise, so no side
is run twice to measure it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalar import squeeze, upper_trim


@dataclass
class JoinReport:
    df: DataFrame
    matched: int
    total: int

    @property
    def match_rate(self) -> float:
        return self.matched / self.total if self.total else 0.0


def left_enrich(base: DataFrame, src: DataFrame, keys: Sequence[str],
                fill: dict | float | None = None, flag: str | None = None) -> DataFrame:
    """Left equi join of ``src`` columns onto ``base``.

    ``src`` must be unique on ``keys`` (pre-aggregate first).
    ``fill`` replaces NULLs in the new columns (J6); ``flag`` names a column
    that says where the joined value was missing and filled."""
    new = [c for c in src.columns if c not in keys]
    out = base.join(src, on=list(keys), how="left")
    if fill is not None:
        if flag:
            missing = F.lit(False)
            for c in new:
                missing = missing | F.col(c).isNull()
            out = out.withColumn(flag, missing)
        vals = fill if isinstance(fill, dict) else {c: fill for c in new}
        out = out.fillna(vals)
    return out


def inner_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J5."""
    return a.join(b, on=list(keys), how="inner")


def outer_chain(dfs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Chained full outer join; USING keys are coalesced by Spark."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, on=list(keys), how="full")
    return out


def enrich_at_grain(base: DataFrame, src: DataFrame, keys: Sequence[str], month: str,
                    value_cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Monthly join when ``base`` has the month column, else the source
    is averaged to the coarser grain first (pre-aggregation before join)."""
    if month in base.columns:
        return base.join(src.select(*keys, month, *value_cols), on=[*keys, month], how="left")
    yearly = src.groupBy(*keys).agg(*[F.avg(c).alias(c + suffix) for c in value_cols])
    return base.join(yearly, on=list(keys), how="left")


def map_lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, value: str,
               alias: str | None = None) -> DataFrame:
    """Dictionary lookup column via a left join on the distinct keys."""
    d = dim.select(F.col(dim_key).alias(key), F.col(value).alias(alias or value)).dropDuplicates([key])
    return df.join(d, on=key, how="left")


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Newest row per key (ties broken by the remaining order
    columns). Uses ``max_by`` over a struct, a partial aggregate, so a key
    holding a third of the rows is pre-reduced map-side instead of being
    sorted in one task as a ``row_number`` window would be."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    ordkey = F.struct(*order_cols) if len(order_cols) > 1 else order_cols[0]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), ordkey).alias("__r"))
    return picked.select(*keys, "__r.*")


def semi(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J13."""
    return df.join(other.select(*keys).distinct(), on=list(keys), how="left_semi")


def unmatched(left: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no partner in ``dim``."""
    return left.join(dim.select(*keys).distinct(), on=list(keys), how="left_anti")


def with_group_stat(df: DataFrame, keys: Sequence[str], agg: Column, name: str) -> DataFrame:
    """Group statistic joined back. Aggregate-then-join keeps the
    aggregate partial (map-side combine) -- safe for hot keys -- where
    ``agg().over(partitionBy)`` would put a whole hot group in one task."""
    stat = df.groupBy(*keys).agg(agg.alias(name))
    return df.join(stat, on=list(keys), how="left")


def apply_stats(df: DataFrame, stats: dict, fn) -> DataFrame:
    """One-row training statistics applied to other rows as literals
    (no cross join; the statistics row is bounded by the column count)."""
    return df.withColumns({c: fn(F.col(c), s) for c, s in stats.items() if c in df.columns})


def calendar(spark, first_year: int, last_year: int, months: Sequence[int] = tuple(range(1, 13)),
             year_col: str = "year", month_col: str = "month") -> DataFrame:
    """(year x month) calendar by two generators -- no join."""
    months_arr = F.array(*[F.lit(int(m)) for m in months])
    return (spark.range(1).select(F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias(year_col))
            .select(year_col, F.explode(months_arr).alias(month_col)))


def attach_predictions(panel: DataFrame, preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions are attached by key, never by position."""
    return panel.join(preds, on=list(keys), how="left")


# J8 -------------------------------------------------------------------------
#: Length of the name pieces that containment is looked up by.
GRAM = 3


def _grams(c: Column, sizes: Sequence[int]) -> Column:
    """The distinct pieces of a string with the given lengths."""
    def pieces(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substring(c, i, F.lit(k))), lambda x: F.length(x) == k)
    return F.array_distinct(F.flatten(F.array(*[pieces(k) for k in sizes])))


def _contained(names: DataFrame, name: str, dim: DataFrame, dim_name: str) -> DataFrame:
    """``(__name, __key)`` where the dimension name contains the name.

    A dimension name that contains a name holds every piece of it, so each
    name is looked up by its rarest piece of ``GRAM`` letters (by all of it
    if it is shorter) and the candidates are verified."""
    held = dim.select("__key", F.col(dim_name).alias("__text"),
                      F.explode(_grams(F.col(dim_name), range(1, GRAM + 1))).alias("__g"))
    often = held.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    size = F.least(F.length(name), F.lit(GRAM))
    own = names.where(F.length(name) > 0).select(
        "__name", F.col(name).alias("__own"),
        F.explode(F.filter(_grams(F.col(name), range(1, GRAM + 1)), lambda g: F.length(g) == size)).alias("__g"))
    rarest = own.join(often, "__g").groupBy("__name", "__own").agg(
        F.min(F.struct("__n", "__g"))["__g"].alias("__g"))
    return rarest.join(held, "__g").where(F.contains("__text", "__own")).select("__name", "__key")


def match_names(left: DataFrame, name_col: str, dim: DataFrame, dim_name: str, dim_key: str,
                out_col: str = "match_key") -> DataFrame:
    """Tiered name match, first tier that matches wins; within a tier the
    smallest dimension key wins (deterministic "first row").

    Tiers: (1) exact on upper/trim, (2) exact on squeezed (spaces and hyphens
    removed), (3) squeezed dimension name contains the squeezed name,
    (4) upper dimension name contains the upper raw name.

    Only the distinct names of ``left`` are matched, then joined back. All
    tiers are equi joins; see ``_contained`` for the last two."""
    names = left.select(F.col(name_col).alias("__name")).where(F.col("__name").isNotNull()).distinct()
    names = names.select("__name", upper_trim("__name").alias("__ut"), squeeze("__name").alias("__sq"),
                         F.upper(F.col("__name")).alias("__up"))
    d = dim.select(F.col(dim_key).alias("__key"), F.col(dim_name).alias("__dn"))
    d = d.select("__key", upper_trim("__dn").alias("__dut"), squeeze("__dn").alias("__dsq"),
                 F.upper(F.col("__dn")).alias("__dup"))
    tiers = [names.join(d, names["__ut"] == d["__dut"]), names.join(d, names["__sq"] == d["__dsq"]),
             _contained(names, "__sq", d, "__dsq"), _contained(names, "__up", d, "__dup")]
    cands = None
    for i, t in enumerate(tiers, 1):
        t = t.select("__name", F.lit(i).alias("__tier"), "__key")
        cands = t if cands is None else cands.unionByName(t)
    best = cands.groupBy("__name").agg(F.min(F.struct("__tier", "__key")).alias("__b"))
    best = best.select(F.col("__name").alias(name_col), F.col("__b.__key").alias(out_col),
                       F.col("__b.__tier").alias(out_col + "_tier"))
    return left.join(best, on=name_col, how="left")


# U1-U4 ----------------------------------------------------------------------
def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows appended by column name; missing columns become NULL."""
    return a.unionByName(b, allowMissingColumns=True)


def select_bands(top: DataFrame, must_have: Sequence[str], col: str = "band") -> DataFrame:
    """Union of selected names and must-have names."""
    spark = top.sparkSession
    extra = spark.createDataFrame([(m,) for m in must_have], [col])
    return top.select(col).unionByName(extra).distinct()
