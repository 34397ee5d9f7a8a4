"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every source gets a target size. All documents of a source have the same expected number
of copies, target / size of the source. Along the source's documents these expected
copies are summed up from one random offset, and a document is taken once for every whole
number that the sum crosses at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, ranked, settle, source_key

#: Above any size class: a class is 16 for each doubling of the size, and sizes are below 2**63.
MOST_CLASSES = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def size_class(size: str) -> Column:
    """Grows with the size; sizes of one class differ by a sixteenth at most."""
    shift = f"greatest(length(bin({size})) - 5, 0)"
    return F.expr(f"16 * {shift} + shiftright({size}, {shift})").cast("long")


def source_targets(sizes: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per source ``(_key, source_size)``.

    The weights repeat over the sources in code point order, null last. Together the targets
    are ``share`` times all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. Sources ordered by size per weight fill up one
    after the other, so one pass of running sums finds the level at which the rest stand.
    Its windows hold one row per source.
    """
    by_key = Window.orderBy("_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("_ratio", "_key")
    whole = Window.partitionBy(F.lit(0))
    earlier = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = (sizes.withColumn("weight", weight)
           .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
           .withColumn("_ratio", F.col("_cap") / F.col("weight"))
           .withColumn("_level", (F.sum("source_size").over(whole) * F.lit(float(share)) - earlier) / rest)
           .withColumn("_full", F.col("_level") >= F.col("_ratio")))
    level = F.min_by(F.when(~F.col("_full"), F.col("_level")),
                     F.when(~F.col("_full"), F.struct("_ratio", "_key"))).over(whole)
    return (out.withColumn("_level", level)
            .select("_key", "source_size", "weight",
                    F.when(F.col("_full"), F.col("_cap"))
                    .otherwise(F.col("weight") * F.col("_level")).alias("target")))


def source_offset(seed: int, key: str) -> Column:
    """A source's random offset in [0, 1), a multiple of 2**-20 so that sums with it stay exact."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key))), 1, 5)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**20))


def mix_plan(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0,
             id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             seed: int = 11, rows_per_bucket: int = 50_000) -> DataFrame:
    """Rows ``doc_id, source, size, source_size, target, copies, taken``, one per input row.

    ``size`` counts the words of the text (null: 0), ``copies`` is how often the mix takes the
    document, at most ``most`` rounded up, and ``taken`` is ``copies * size``.

    A source's documents stand in order of falling size class, then of a seeded hash of the
    id, id and size. Neighbours have like sizes, so the words taken come within about the
    largest document of the target although lengths are very uneven.

    Null sources form a source of their own; a null id hashes as the text ``null``; rows alike
    in id, source and size could swap places, with the same result. A source without words
    has target 0 and gives no copies. Null, empty and wordless texts have size 0; texts count whole at
    any length. Columns beyond the three named ones are not read. Empty tables give no rows.

    Work: one pass over the texts leaves a narrow table; the running sum of equal expected
    copies is a rank, found in buckets of (source, size class, hash), so that a hot source
    is numbered by many tasks.
    """
    order_hash = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = settle(pick(docs, doc_id=id_col, source=source_col, text=text_col)
                  .select("doc_id", "source", source_key("source").alias("_key"),
                          word_count(F.col("text")).alias("size"), order_hash.alias("_hash")))
    sizes = rows.groupBy("_key").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(sizes, weights, share, most)
                     .withColumn("_offset", source_offset(seed, "_key")))
    buckets = max(1, -(-rows.count() // rows_per_bucket))  # on top of the size classes
    slice_of = F.expr(f"(cast(conv(substring(_hash, 1, 8), 16, 10) as bigint) * {buckets}L) div 4294967296L")
    cut = rows.withColumn("_class", size_class("size"))
    cut = cut.withColumn("_b", (MOST_CLASSES - F.col("_class")) * buckets + slice_of)
    placed = ranked(cut, "_b", [F.col("_class").desc(), "_hash", "doc_id", "size"],
                    group="_key", rank="_rank", total="_rows").join(targets, "_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("_offset") + (F.col("_rank") + 1) * F.col("_rate")) \
        - F.floor(F.col("_offset") + F.col("_rank") * F.col("_rate"))
    return (placed.withColumn("_rate", rate).withColumn("copies", crossed.cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, each repeated as often as ``mix_plan`` takes it, with all columns kept.

    The plan comes back to the rows by id, source and word count, nulls included. Rows alike in all three are
    numbered, and the number picks from their group's list of copies; a repeated id is expected
    to be rare. Texts of any length are carried along, as are other columns, whatever their names. Empty
    tables give no rows.
    """
    plan = mix_plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, **settings)
    plan = (plan.groupBy(F.struct("doc_id", "source", "size").alias("_same"))
            .agg(F.sort_array(F.collect_list("copies"), asc=False).alias("_copies")))
    rows = docs.select(
        F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
                 word_count(F.col(f"`{text_col}`")).alias("size")).alias("_same"),
        F.struct("*").alias("_row"))
    at = F.row_number().over(Window.partitionBy("_same").orderBy("_same.size"))
    taken = F.element_at("_copies", at).cast("int")
    return (rows.join(plan, "_same").select("_row", taken.alias("_taken")).where("_taken > 0")
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("_taken"))))
            .select("_row.*"))
