"""Line dedup by ranges of line hashes, in DataFrame functions only.

Every line has a key, and the rows ``(key hash, document, position)`` are range-partitioned by key
and document and sorted by key, document and position inside the ranges. The boundaries may fall
inside a key, so a line that a third of all documents hold is spread over many ranges. Each range
streams its rows: one row per key and document comes out, with that document's positions and the
first of them; keys that go on in the next range are added up from such rows. The result is not
text but one bitmap per document that loses lines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, tabled

#: What is stripped from both ends of a line to make its key.
STRIPPED = " \t\n\x0b\x0c\r"
#: Lines of one bitmap word.
WORD_BITS = 64


def line_keys(text: Column) -> Column:
    """The keys of a text's lines in order: stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(text, "\n", -1), lambda line: F.translate(
        F.trim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.withColumn("mark", F.xxhash64("text"))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none",
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, bits``, one row per document that loses lines.

    Lines whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents or more
    are lost; ``keep="first"`` spares the first of them all (smallest id, null first, then mark, then
    position), ``keep="none"`` spares none. Line ``i`` is lost if bit ``i % 64`` of ``bits[i div 64]`` is
    set; words after the last lost line are left out. ``mark`` is a hash of the text.

    Null texts count as empty, with one empty line, whose key is too short for ``min_chars`` of 1 or
    more. A document is an id with a text: rows that repeat both are one document and share its bitmap;
    rows that only share an id, null or not, are documents of their own. Lines are at any length;
    other columns are not read. Empty tables give no rows.

    Keys are 64-bit hashes. Work: the texts are read twice (the ranges' boundaries come from a
    sample), 28 bytes a line are shuffled, and no key, document or range meets whole in one
    task but a document's own lines.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    rows = _documents(docs, id_col, text_col)
    hashes = F.transform(line_keys(F.col("text")), lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k)))
    lines = rows.select("doc_id", "mark", F.posexplode(hashes).alias("at", "key")).where(F.col("key").isNotNull())
    ranged = (lines.repartitionByRange("key", "doc_id", "mark")
              .sortWithinPartitions("key", "doc_id", "mark", "at"))
    # equal (key, doc_id, mark) stand in one range, so this needs no exchange
    found = tabled(ranged.groupBy("key", "doc_id", "mark").agg(F.min("at").alias("first"), F.collect_list("at").alias("places")))
    common = (found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "mark", "first")).alias("spared"))
              .where(F.col("n") >= min_docs).select("key", "spared"))
    # written, so that the join reads plain exchanges, of which Spark splits a hot key's
    lost = (found.join(tabled(common), "key")
            .select("doc_id", "mark", "spared", F.explode("places").alias("at")))
    if keep == "first":
        lost = lost.where(~F.struct("doc_id", "mark", "at").eqNullSafe(
            F.struct(F.col("spared.doc_id").alias("doc_id"), F.col("spared.mark").alias("mark"), F.col("spared.first").alias("at"))))
    words = (lost.select("doc_id", "mark", F.expr(f"cast(at div {WORD_BITS} as int)").alias("word"),
                         F.expr(f"shiftleft(1L, at % {WORD_BITS})").alias("bit"))
             .repartition("doc_id", "mark").groupBy("doc_id", "mark", "word").agg(F.bit_or("bit").alias("bits")))
    earlier = F.lag("word", 1, -1).over(Window.partitionBy("doc_id", "mark").orderBy("word"))
    pieces = words.withColumn("gap", F.col("word") - earlier - 1).select(
        "doc_id", "mark", F.struct("word", F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("gap")), F.array("bits")).alias("bits")).alias("piece"))
    return (pieces.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
            .select("doc_id", "mark", F.flatten(F.transform("pieces", lambda p: p["bits"])).alias("bits")))


def without_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` per row of ``docs``: the text without the lines its bitmap marks.

    ``n_lines`` counts before dropping; what stays is joined by line feeds, the empty text if nothing
    stays. Documents without a bitmap stay whole. The texts are shuffled once, to their bitmaps.
    """
    rows = _documents(docs, id_col, text_col)
    marked = bitmaps.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "bits")
    both = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    stays = (f"(shiftright(coalesce(get(bits, cast(i div {WORD_BITS} as int)), 0L), i % {WORD_BITS}) & 1L) = 0L")
    kept = F.when(F.col("bits").isNull(), F.col("text")).otherwise(
        F.expr(f"array_join(filter(split(text, '\\n', -1), (line, i) -> {stays}), '\\n')"))
    dropped = F.coalesce(F.expr("aggregate(bits, 0L, (n, word) -> n + bit_count(word))"), F.lit(0).cast("long"))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return both.select("doc_id", n_lines.cast("long").alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept"))
