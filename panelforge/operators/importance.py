"""Permutation importance in one pass.

One table pairs every row with a partner row for every repeat; the partners of a repeat are a
permutation of the rows. Every column of every repeat is then one variant of a row: its own values but
for that column, which the partner lends. All variants are scored in one job by whatever scores rows, and one
aggregate gives all R2 drops, so the number of jobs does not grow with columns or repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import cut_lineage


def seeded(keys: Sequence[str], seed: int | Column) -> Column:
    """A seeded order of rows that any engine repeats."""
    start = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", start, *[F.col(k).cast("string") for k in keys]))


def partners(df: DataFrame, keys: Sequence[str], cols: Sequence[str], repeats: int, seed: int = 42, blocks: int = 64) -> DataFrame:
    """``keys, repeat`` and a struct ``lent`` of the partner's ``cols``: within hash blocks, the row at a
    place in key order gets the row at that place in the repeat's seeded order. Blocks bound what a task sorts."""
    block = F.pmod(F.conv(F.substring(seeded(keys, seed), 1, 8), 16, 10).cast("long"), F.lit(blocks)).cast("int")
    rows = df.withColumn("__block", block)
    place = F.row_number().over(Window.partitionBy("__block").orderBy(*keys))
    own = rows.select("__block", *keys, place.alias("__place"))
    drawn = rows.select("__block", *keys, F.struct(*cols).alias("lent"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    order = seeded(keys, F.col("repeat") + seed + 1)
    drawn = drawn.withColumn("__place", F.row_number().over(Window.partitionBy("__block", "repeat").orderBy(order, *keys)))
    return own.join(drawn.select("__block", "__place", "repeat", "lent"), ["__block", "__place"]).select(*keys, "repeat", "lent")


def permutation_importance(df: DataFrame, cols: Sequence[str], label: str, keys: Sequence[str],
                           score: Callable[[DataFrame, list[str]], DataFrame], repeats: int = 10, seed: int = 42,
                           blocks: int = 64) -> DataFrame:
    """``feature, mean_r2_drop, std_r2_drop`` (population deviation over the repeats), largest drop first.

    ``score(rows, keys)`` adds a column ``prediction``; it is called once, on all variants of all rows. ``keys``
    name a row of ``df``."""
    cols, keys = list(cols), list(keys)
    rows = df.select(*keys, label, *cols)
    lent = cut_lineage(partners(rows, keys, cols, repeats, seed, blocks))
    variants = rows.join(lent, keys)
    which = F.explode(F.array(*[F.lit(c) for c in cols])).alias("variant")
    variants = variants.select(*keys, label, "repeat", which, *[F.col(c).alias(f"__own_{c}") for c in cols], "lent")
    variants = variants.select(*keys, label, "repeat", "variant", *[
        F.when(F.col("variant") == c, F.col(f"lent.{c}")).otherwise(F.col(f"__own_{c}")).alias(c) for c in cols])
    plain = rows.select(*keys, label, F.lit(-1).alias("repeat"), F.lit("").alias("variant"), *cols)
    scored = score(variants.unionByName(plain), [*keys, "repeat", "variant"])
    error = F.sum(F.pow(F.col(label) - F.col("prediction"), 2))
    spread = F.var_pop(label) * F.count(F.lit(1))
    r2 = cut_lineage(scored.groupBy("variant", "repeat").agg((1 - error / spread).alias("r2")))
    base = r2.where("repeat = -1").select(F.col("r2").alias("base"), F.lit(1).alias("__k"))
    drops = r2.where("repeat >= 0").withColumn("__k", F.lit(1)).join(F.broadcast(base), "__k")
    drop = F.col("base") - F.col("r2")
    return (drops.groupBy(F.col("variant").alias("feature")).agg(F.avg(drop).alias("mean_r2_drop"), F.stddev_pop(drop).alias("std_r2_drop"))
            .orderBy(F.desc("mean_r2_drop"), "feature"))
