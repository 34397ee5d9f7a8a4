"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

A copy of a test item with few enough edits keeps some of the item's word n-grams whole. How
many edits a score allows tells how many n-grams must be looked for so that one survives:
the rarest that many of each item are its seeds, by document counts over the corpus.
Where a document holds a seed, and enough of the item's n-grams at all, the words around it
are aligned with the item locally; the score says how much of the item is there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import free_name, pick, tabled
from panelforge.llm.hashing import ALNUM, mixed, odd_numbers, sliced, word_hashes

#: Alignment scores: an equal word, a replaced word, a word more or less.
EQUAL, REPLACED, GAP = 2, -1, -2
#: Cells of the table that rules out most n-grams at once.
SIEVE = 1 << 22


def word_grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(odd_numbers(width, 6)):
        out += words[k:n + k] * factor
    return mixed(out)


def grams_broken(n_words: int, width: int, least: float) -> int:
    """The most n-grams of an item that a copy can lack and still reach the score.

    Of the EQUAL * n_words points a copy may lose the share 1 - least. A replaced word costs EQUAL -
    REPLACED points and breaks ``width`` n-grams, a lost one EQUAL - GAP points and as many, one put
    in -GAP points and one n-gram less; words cut off at either end break fewer.
    """
    per_point = max(width / (EQUAL - REPLACED), width / (EQUAL - GAP), (width - 1) / -GAP)
    return int((1 - least) * EQUAL * n_words * per_point + 1e-9)


def words_put_in(n_words: int, least: float) -> int:
    """The most words that a copy can have more than its item."""
    return int((1 - least) * EQUAL * n_words / -GAP + 1e-9)


@dataclass
class Items:
    """A block of test items, looked up by n-gram."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  # sorted, distinct
    starts: np.ndarray  # bounds of each gram's rows in the next two
    item: np.ndarray
    place: np.ndarray
    seed: np.ndarray  # whether the row's gram is a seed of its item
    needed: np.ndarray  # n-grams that a copy keeps at least, by item
    sieve: np.ndarray

    @classmethod
    def of(cls, ids: list, words: list[np.ndarray], width: int, least: float) -> Items:
        grams = [word_grams(w, width) for w in words]
        item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        distinct, first = np.unique(flat[order], return_index=True)
        needed = np.array([max(1, len(g) - grams_broken(len(w), width, least))
                           for g, w in zip(grams, words, strict=True)], np.int64)
        sieve = np.zeros(SIEVE, bool)
        sieve[distinct & np.uint64(SIEVE - 1)] = True
        return cls(ids, words, distinct, np.append(first, len(flat)), item[order], place[order],
                   np.ones(len(flat), bool), needed, sieve)

    def with_seeds(self, documents: dict[int, int]) -> Items:
        """Marks each item's rarest n-grams, as many as make sure that a copy keeps one."""
        counts = np.array([documents.get(g, 0) for g in self.grams.view(np.int64).tolist()], np.int64)
        row_counts = np.repeat(counts, np.diff(self.starts))
        row_grams = np.repeat(self.grams, np.diff(self.starts))
        order = np.lexsort((self.place, row_grams, row_counts, self.item))
        sizes = np.bincount(self.item, minlength=len(self.ids))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seeds = sizes - self.needed + 1
        self.seed = np.zeros(len(order), bool)
        self.seed[order] = rank < seeds[self.item[order]]
        return self

    def found(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document and numbers of the n-grams there that belong to items."""
        grams = word_grams(words, width)
        at = np.flatnonzero(self.sieve[grams & np.uint64(SIEVE - 1)])
        number = np.searchsorted(self.grams, grams[at])
        number[number == len(self.grams)] = 0
        same = self.grams[number] == grams[at] if len(self.grams) else np.zeros(0, bool)
        return at[same], number[same]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of the item in the words, and the place behind its last word.

    One row per word of the item; within a row, gaps along the words are a running maximum.
    """
    slope = -GAP * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        here = np.zeros_like(row)
        here[1:] = np.maximum(row[:-1] + np.where(words == word, EQUAL, REPLACED), row[1:] + GAP)
        here = np.maximum(np.maximum.accumulate(here + slope) - slope, 0)
        row = here
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def stretches(places: np.ndarray, before: int, after: int, n_words: int) -> list[tuple[int, int]]:
    """The ranges around sorted places, joined where they meet."""
    out: list[list[int]] = []
    for start, stop in zip((places - before).tolist(), (places + after).tolist(), strict=True):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(max(0, a), min(n_words, b)) for a, b in out]


def leaks(words: np.ndarray, items: Items, width: int, least: float) -> Iterator[tuple]:
    """``item number, score, first word, last word`` of the items that a document holds."""
    at, number = items.found(words, width)
    if not len(at):
        return
    times = items.starts[number + 1] - items.starts[number]
    rows = np.repeat(items.starts[number], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    at = np.repeat(at, times)
    owner = items.item[rows]
    order = np.lexsort((at, owner))
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    for group in np.split(order, cuts):
        k = int(owner[group[0]])
        seeded = group[items.seed[rows[group]]]
        if not len(seeded) or len(np.unique(items.place[rows[group]])) < items.needed[k]:
            continue
        item = items.words[k]
        slack = words_put_in(len(item), least)
        starts = np.sort(at[seeded] - items.place[rows[seeded]])
        best = (0, 0, 0)
        for start, stop in stretches(starts, slack, len(item) + slack, len(words)):
            score, end = align(item, words[start:stop])
            if score > best[0]:
                best = score, start, start + end
        score, start, end = best
        if score >= least * EQUAL * len(item):
            _, length = align(item[::-1], words[start:end][::-1])
            yield k, score / (EQUAL * len(item)), end - length, end - 1


def _blocks(items: DataFrame, width: int, block_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Items in blocks of bounded size, each brought to the driver to be sent to all executors."""
    words = F.octet_length("text") / 2
    total = items.agg(F.sum(words)).first()[0] or 0
    n_blocks = max(1, int(-(-total // block_words)))
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).toPandas()
        part = part.sort_values(["item_id", "text"], kind="stable")
        texts = pa.array(part["text"], pa.string())
        hashes, rows = word_hashes(texts, ALNUM)
        each = np.split(hashes, np.cumsum(np.bincount(rows, minlength=len(texts)))[:-1]) if len(texts) else []
        kept = [(i, w) for i, w in zip(part["item_id"], each, strict=True) if len(w) >= width]
        if kept:
            yield [i for i, _ in kept], [w for _, w in kept]


def benchmark_leaks(docs: DataFrame, items: DataFrame, least: float = 0.55, width: int = 3,
                    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                    item_text_col: str = "text", block_words: int = 500_000) -> DataFrame:
    """Rows ``doc_id, item_id, score, first_word, last_word``: items that documents hold, edited or not.

    Words are lower-cased runs of 0-9, a-z and all beyond ASCII. The score is that of the best local
    alignment over the score of the item with itself: 1 for a whole copy, and each replaced,
    lost or added word takes off some. Pairs from ``least`` up are returned, with the words of the
    document (from 0) that the alignment spans; of several places the best, then the first, counts. At 0.55 and three words, the seeds
    find every such copy of an item of more than 20 words; shorter items need one n-gram whole.

    Null and empty texts on either side match nothing, nor do items of fewer than ``width`` words.
    Null or repeated ids are rows like others. No items or no documents give no rows. Columns
    beyond the named ones are not read.

    Work: two passes over the texts for each block of items, without shuffling them: one
    counts the documents of the items' n-grams, the other finds seeds and aligns. A block holds at
    most about ``block_words`` words (bytes / 2), and so do the tables sent to the executors; more items
    take more blocks.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    tests = pick(items, item_id=item_id_col, text=item_text_col).where("text is not null")
    id_type, item_type = rows.schema["doc_id"].dataType, tests.schema["item_id"].dataType
    schema = (f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, score double, "
              "first_word long, last_word long")
    found = None
    for ids, words in _blocks(tests, width, block_words):
        block = Items.of(ids, words, width, least)
        plain = spark.sparkContext.broadcast(block)

        def counted(batches: Iterable[pa.RecordBatch], plain=plain) -> Iterator[pa.RecordBatch]:
            known = plain.value
            for batch in batches:
                counts = np.zeros(len(known.grams), np.int64)
                for _, own in _documents(batch):
                    counts[np.unique(known.found(own, width)[1])] += 1
                met = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(known.grams[met].view(np.int64)), pa.array(counts[met])],
                                                 names=["gram", "n"])

        counts = rows.mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        seeded = spark.sparkContext.broadcast(block.with_seeds({r["gram"]: r["n"] for r in counts.collect()}))

        def aligned(batches: Iterable[pa.RecordBatch], seeded=seeded) -> Iterator[pa.RecordBatch]:
            known = seeded.value
            for batch in batches:
                out = [(i, *hit) for i, own in _documents(batch) for hit in leaks(own, known, width, least)]
                names = pa.array([known.ids[o[1]] for o in out])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([o[0] for o in out], pa.int64())),
                     names if len(out) else pa.array([], pa.int64()),
                     pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.int64()),
                     pa.array([o[4] for o in out], pa.int64())],
                    names=["doc_id", "item_id", "score", "first_word", "last_word"])

        part = rows.mapInArrow(aligned, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Number and word hashes of each document of a batch that has words."""
    first = 0
    for part in sliced(batch):
        hashes, rows = word_hashes(part.column("text"), ALNUM)
        bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
        for i in range(part.num_rows):
            if bounds[i + 1] > bounds[i]:
                yield first + i, hashes[bounds[i]:bounds[i + 1]]
        first += part.num_rows


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose own text has no leak of an item, all columns kept.

    A row that shares its id, null or not, with a leaking text stays unless it leaks itself. The texts
    are not shuffled unless very many leak: what is joined is the list of leaking ids and text hashes."""
    given, text = F.col("`" + id_col.replace("`", "``") + "`"), F.col("`" + text_col.replace("`", "``") + "`")
    name = F.struct(given.alias("id"), F.xxhash64(text).alias("mark"))
    named = docs.select(name.alias("doc_id"), text.alias("text"))
    own, other = free_name(docs, "_own"), free_name(docs, "_other")
    bad = tabled(benchmark_leaks(named, items, **settings).select(F.col("doc_id").alias(other)).distinct())
    return docs.withColumn(own, name).join(bad, F.col(own) == F.col(other), "left_anti").select(docs.columns)
