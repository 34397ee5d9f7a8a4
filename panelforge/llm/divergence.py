"""How far the sources of a language differ, from a single-pass index of term counts.

Each task indexes documents in memory until a bound on its postings is reached, then spills them
as one run sorted by term. Runs are dealt by a hash of language and term; in a shard Spark's external
sort merges them by a heap and the merged stream is added up, so a term's postings come out
one after the other with the language's totals. The divergence of two sources starts from what
it would be if neither had any kept term, and postings correct it: from counts of equal shares
where one source has the term, and from a second stream over the postings where both have it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, tabled
from panelforge.llm.hashing import sliced

#: Bytes of a text that are split into terms at a time, and postings of one written batch.
PIECE_BYTES, BATCH_POSTINGS = 1 << 20, 50_000
#: ASCII letters to lower case, other ASCII characters to spaces; all else stays.
TERM_BYTES = bytes.maketrans(bytes(range(128)), bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(128)))
SCALE = 1_000_000_000
RUN = "lang string, source string, term string, count long, docs long"
POSTING = RUN + ", lang_count long, first boolean"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``PIECE_BYTES``; no term is cut."""
    text = text.translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class _Block:
    """Postings of the documents since the last spill: counts and documents by group and term."""

    def __init__(self):
        self.held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts, docs = self.held.setdefault((lang, source), (Counter(), Counter()))
        before, own = len(counts), set()
        for terms in pieces(text):
            counts.update(terms)
            own.update(terms)
        docs.update(own)
        self.size += len(counts) - before

    def run(self) -> Iterator[pa.RecordBatch]:
        """The block as one run in order of language, term and source."""
        for lang in sorted({lang for lang, _ in self.held}):
            sources = sorted(source for own, source in self.held if own == lang)
            terms, count, docs = [], [], []
            for source in sources:
                counts, in_docs = self.held[lang, source]
                terms.append(pa.array(counts.keys(), pa.binary(), size=len(counts)))
                count.append(np.fromiter(counts.values(), np.int64, len(counts)))
                docs.append(np.fromiter(map(in_docs.__getitem__, counts), np.int64, len(counts)))
            sizes = [len(c) for c in count]
            run = pa.table({"lang": pa.array(np.repeat(lang, sum(sizes)), pa.string()),
                            "source": pa.array(np.repeat(np.array(sources, object), sizes), pa.string()),
                            "term": pa.concat_arrays(terms).cast(pa.string()),
                            "count": np.concatenate(count), "docs": np.concatenate(docs)})
            in_order = pc.sort_indices(run["term"])  # stable, and the sources are in order already
            yield from run.take(in_order).combine_chunks().to_batches(max_chunksize=BATCH_POSTINGS)


def index_runs(batches: Iterable[pa.RecordBatch], most_postings: int) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in (part for whole in batches for part in sliced(whole)):
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang"), batch.column("source"), texts, strict=True):
            block.add(lang.as_py(), source.as_py(), text.as_py())
            if block.size >= most_postings:
                yield from block.run()
                block = _Block()
    yield from block.run()


def whole_terms(batches: Iterable[pa.RecordBatch], squeeze=lambda rows: rows) -> Iterator[pd.DataFrame]:
    """Frames of a stream sorted by language and term, cut so that a term's rows stand in one frame.

    ``squeeze`` adds up rows, so that a term with rows in very many batches stays small.
    """
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch.to_pandas()
        now = squeeze(now if rest is None else pd.concat([rest, now], ignore_index=True))
        last = ((now["lang"] == now["lang"].iloc[-1]) & (now["term"] == now["term"].iloc[-1])).to_numpy()
        rest = now[last]
        if not last.all():
            yield now[~last].reset_index(drop=True)
    if rest is not None:
        yield rest.reset_index(drop=True)


def merged(batches: Iterable[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Adds up the sorted postings of all runs; keeps the terms in ``min_docs`` of the language's documents."""
    def add_up(runs: pd.DataFrame) -> pd.DataFrame:
        return runs.groupby(["lang", "term", "source"], sort=False, as_index=False)[["count", "docs"]].sum()

    for sums in whole_terms(batches, add_up):
        by_term = sums.groupby(["lang", "term"], sort=False)
        sums["lang_count"], in_docs = by_term["count"].transform("sum"), by_term["docs"].transform("sum")
        sums["first"] = by_term.cumcount() == 0
        sums = sums[in_docs >= min_docs]
        kinds = {"count": pa.int64(), "docs": pa.int64(), "lang_count": pa.int64(), "first": pa.bool_()}
        names = ["lang", "source", "term", *kinds]
        yield pa.RecordBatch.from_arrays([pa.array(sums[c], kinds.get(c, pa.string()), from_pandas=False) for c in names], names=names)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_corrections(batches: Iterable[pa.RecordBatch], most_sums: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Per pair of sources that share terms, what their terms add beyond the one-sided corrections.

    Works through the sorted stream by distance: each posting against the next one of its term, then
    the one after it, and so on. Sums per pair are kept and written out when they are many.
    """
    sums: Counter = Counter()

    def written() -> pa.RecordBatch:
        lang, a, b = zip(*sums, strict=True) if sums else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                                           pa.array(list(sums.values()), pa.int64())], names=["lang", "a", "b", "value"])

    for rows in whole_terms(batches):
        term = rows.groupby(["lang", "term"], sort=False).ngroup().to_numpy()
        group = rows.groupby(["lang", "source"], sort=False).ngroup().to_numpy()
        names = rows[["lang", "source"]].drop_duplicates().to_numpy()
        p, p0 = rows["p"].to_numpy(), rows["p0"].to_numpy()
        apart = 1
        while apart < len(rows):
            at = np.flatnonzero(term[:-apart] == term[apart:])
            if not len(at):
                break
            one, two = at, at + apart
            value = (difference(p[one], p[two]) - difference(p[one], p0[two]) - difference(p0[one], p[two])
                     + difference(p0[one], p0[two]))
            code = group[one] * len(names) + group[two]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            for c, v in zip(code[order][starts], np.add.reduceat(value[order], starts), strict=True):
                sums[names[c // len(names)][0], names[c // len(names)][1], names[c % len(names)][1]] += int(v)
            if len(sums) >= most_sums:
                yield written()
                sums.clear()
            apart += 1
    yield written()


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kept))`` in whole numbers; null without kept terms."""
    wide = [c.cast("decimal(25,0)") for c in (count, total, kept)]
    above = (wide[0] + 2) * F.lit(SCALE)
    below = wide[1] + wide[2] * 2
    exact = F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)"))
    return F.when(kept > 0, exact + 1).cast("long")


def differs(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source",
                      text_col: str = "text", most_postings: int = 800_000) -> DataFrame:
    """``lang, source, part, item, value, rank``: which sources of a language differ, and by which terms.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps the
    V terms in ``min_docs`` of its documents or more. A group's share of a kept term is ``p = 1 +
    floor(10**9 * (count + 2) / (N + 2 * V))`` with N the group's count of all kept terms; two shares differ
    by ``f = floor((p - q)**2 / (p + q))``. All arithmetic is on whole numbers.

    Part ``pair``: against each other source of the language, f summed over all kept terms. Part ``term``:
    kept terms that the group has and with a larger share than the language has, the ``top`` with the
    largest f. Ranks go by falling value, then by item in UTF-8 order.

    Null texts, languages and sources count as empty; empty names are names. Each row is a document,
    also if it repeats another. A source without terms has N = 0; a language without kept terms has pairs
    with value 0 and no terms. Texts of any length are taken in pieces. Empty tables give no rows.
    Other columns are not read.

    Memory: a task holds ``most_postings`` postings and one document's distinct terms when indexing, one term's
    postings when merging. The result has a row for every two sources of a language; nothing else grows
    faster than the postings.
    """
    rows = pick(docs, lang=lang_col, source=source_col, text=text_col)
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    runs = rows.mapInArrow(lambda batches: index_runs(batches, most_postings), RUN)
    sharded = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    postings = tabled(sharded.mapInArrow(lambda batches: merged(batches, min_docs), POSTING))

    langs = postings.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("count").alias("lang_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = tabled(groups.fillna(0, ["total", "kept", "lang_total"]).withColumn("p0", share(zero, F.col("total"), F.col("kept"))))

    shared = postings.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("kept")))
    over = (shared.withColumn("q", share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))).where("p > q")
            .select("lang", "source", F.col("term").alias("item"), differs(F.col("p"), F.col("q")).alias("value")))
    ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = over.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top)

    stream = (shared.select("lang", "term", "source", "p", "p0").repartition("lang", "term")
              .sortWithinPartitions("lang", "term", "source"))
    both = (stream.mapInArrow(pair_corrections, "lang string, a string, b string, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("both")))
    shares = (shared.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shares")))
    sides = groups.join(shares, ["lang", "source"], "left").select(
        "lang", "source", "kept", "p0", F.coalesce("shares", F.array().cast("array<struct<p:bigint,n:bigint>>")).alias("shares"))
    other = sides.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("shares").alias("others"))
    pairs = sides.join(other, "lang").where(F.col("source") != F.col("item"))
    pairs = (pairs.withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item"))
             .join(both, ["lang", "a", "b"], "left"))
    base = differs(F.col("p0"), F.col("q0"))

    def corrected(held: str, against: str) -> Column:
        """Over the terms that one side has, as if the other side had none of them."""
        return F.aggregate(held, F.lit(0).cast("long"), lambda sum_, x: sum_ + x["n"] * (
            differs(x["p"], F.col(against)) - base))

    value = F.col("kept") * base + corrected("shares", "q0") + corrected("others", "p0") + F.coalesce("both", zero)
    pairs = pairs.select("lang", "source", "item", F.when(F.col("kept") > 0, value).otherwise(zero).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranks))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
