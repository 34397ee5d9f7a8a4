"""Sharding by proportional stratified interleaving.

Each source's rows are shuffled by a seeded hash and ranked; a row's fractional rank
``(rank + offset) / rows of its source``, with an offset between 0 and 1 for each source, says how far through its source it lies. Sorting
all rows by that fraction interleaves the sources in proportion, so any contiguous cut
of the order holds the mixture of the whole. Shards are equal cuts by rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import bucket_count, pick, ranked, settle, source_key, unit53


def numbered(rows: DataFrame, rows_per_piece: int = 10_000) -> DataFrame:
    """The rows, each with its number among the rows alike in all columns in ``_copy``, from 0.

    Like rows are counted and made anew from the count, in pieces that are dealt out."""
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(rows_per_piece).cast("long"))
    pieces = counts.withColumn("_from", F.explode(starts)).repartition(*rows.columns, "_from")
    last = F.least(F.col("_from") + rows_per_piece, F.col("_n")) - 1
    return pieces.withColumn("_copy", F.explode(F.sequence(F.col("_from"), last))).drop("_n", "_from")


def interleave_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id",
                      source_col: str = "source", text_col: str = "text", seed: int = 7,
                      rows_per_bucket: int = 50_000) -> DataFrame:
    """Rows ``doc_id, source, size, text_crc32, shard, slot``, one per input row.

    Shard counts differ by one row at most, and each source's share of a shard differs from
    its share of the whole by about a row. ``size`` is the text's UTF-8 bytes plus 16 and
    ``text_crc32`` its unsigned CRC-32 (a null text counts as empty in both). ``slot`` runs
    from 0 without gaps in each shard.

    Null sources form a source of their own; null ids are rows like others. Rows alike in id, source,
    size and checksum are numbered, and the number enters the hash, so copies of a document
    spread over the shards. Texts count at any length, by size and checksum only. Empty
    tables give no rows. Columns beyond the three named ones are not read.

    Work: one pass over the texts, which leaves some 40 bytes a row; like rows travel as one
    row with their number. The rows are ranked twice, within source and over all, in buckets of the hash and
    of the fraction, which is shifted for each source by less than a rank, so that many
    sources of one row do not meet in one bucket. A hot source is ranked by many tasks.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    alike = (pick(docs, doc_id=id_col, source=source_col, text=text_col)
             .select("doc_id", "source", source_key("source").alias("_key"),
                     (F.octet_length(text).cast("long") + 16).alias("size"),
                     F.crc32(text).alias("text_crc32")))
    rows = settle(numbered(alike).withColumn("_u", unit53(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("_copy"))))
    n = rows.count()
    buckets = bucket_count(spark, n, rows_per_bucket)
    tie = ["_u", "doc_id", "text_crc32", "size", "_copy"]
    within = ranked(rows.withColumn("_b", F.floor(F.col("_u") * F.lit(buckets / 2.0**53))),
                    "_b", tie, group="_key", rank="_rank", total="_rows")
    # a place within the row's rank, the same for all rows of a source
    offset = (F.pmod(F.xxhash64(F.lit(seed), F.col("_key")), F.lit(2**20)) + 0.5) / 2**20
    share = (F.col("_rank") + offset) / F.col("_rows")
    within = settle(within.drop("_b").withColumn("_share", share.cast("double")))
    placed = ranked(within.withColumn("_b", F.floor(F.col("_share") * buckets)), "_b",
                    ["_share", F.xxhash64(F.lit(seed), F.col("_key")), "_key", *tie],
                    rank="_place", total="_all")
    placed = placed.withColumn("shard", F.expr(f"_place * {n_shards} div _all"))
    first = F.expr(f"(shard * _all + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "source", "size", "text_crc32",
                         F.col("shard").cast("int").alias("shard"),
                         (F.col("_place") - first).cast("long").alias("slot"))
