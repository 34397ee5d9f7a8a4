"""Exact substring dedup: removes every byte covered by a string of ``length`` bytes that
starts anywhere else too.

The scheme is that of difference-cover suffix sorting: sort short tuples at sampled positions,
name them, go on with longer strings where names repeat, place the remaining suffixes by
their distance to a sampled one, and compare what falls together. The sample is not the
periodic difference cover, of which every suffix of the corpus would have to be moved
several times, but one that the content defines: of each string of ``length`` bytes, the
position whose ``TUPLE`` bytes have the smallest hash. Equal strings agree on it, so each
remaining suffix belongs to one sampled position and only sampled positions are moved.

Tuples that stand once prove all strings around them to stand once. The others' strings are
taken in cells of up to CELL neighbouring starts: the bytes that all strings of a cell share
prove them single if they stand once, and the bytes of the whole cell prove all of them
repeated if they stand twice. Only cells that stay open are compared string by string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, tabled
from panelforge.llm.hashing import BYTE_VALUES, run_hashes

#: Bytes of a tuple at a sampled position, and starts in a cell.
TUPLE, CELL = 64, 48
#: Starts of strings that are looked at together in a long text; fewer than 2**24.
CHUNK = 1 << 20
#: Nodes up to which a list of them may be sent to every executor.
SMALL_ROWS = 1_000_000

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Sample:
    """The sampled positions of one chunk of a text, with the starts of the strings that chose each."""

    def __init__(self, data: np.ndarray, offset: int, length: int):
        self.data, self.offset, self.length = BYTE_VALUES[data], offset, length
        n = len(data) - length + 1  # strings
        width = length - TUPLE + 1  # tuples in a string
        starts = np.arange(n + width - 1)
        tuples = run_hashes(self.data, starts, starts + TUPLE)
        # the hash's upper 40 bits, then the position: the least is the leftmost of the smallest
        value = (tuples & ~np.uint64((1 << 24) - 1)) | starts.astype(np.uint64)
        at = (_sliding_least(value, width)[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.place = at[first]
        self.tuple = tuples[self.place]
        self.far = self.place - first  # distance of the earliest string's start, of the latest one's
        self.near = self.place - (np.append(first[1:], n) - 1)

    def cells(self, chosen: np.ndarray) -> Cells:
        """The cells of the chosen sampled positions."""
        place, near, far = self.place[chosen], self.near[chosen], self.far[chosen]
        low, high = near // CELL, far // CELL
        times = high - low + 1
        place = np.repeat(place, times)
        q = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        near = np.maximum(np.repeat(near, times), q * CELL)
        far = np.minimum(np.repeat(far, times), q * CELL + CELL - 1)
        begin = place - q * CELL
        shared = run_hashes(self.data, begin, begin + self.length - CELL + 1) ^ q.astype(np.uint64)
        whole = run_hashes(self.data, place - far, place - near + self.length) ^ (
            (q * CELL + near).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return Cells(place - far, place - near, shared, whole)

    def strings(self, starts: np.ndarray) -> np.ndarray:
        return run_hashes(self.data, starts, starts + self.length)


class Cells:
    """First and last start, the hash of what all strings share, and that of the whole, per cell."""

    def __init__(self, first: np.ndarray, last: np.ndarray, shared: np.ndarray, whole: np.ndarray):
        self.first, self.last, self.shared, self.whole = first, last, shared, whole


def _sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima within blocks of that width."""
    n = len(value)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = value
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(back[:n - width + 1], ahead[width - 1:])


def samples(text: bytes, length: int) -> Iterator[Sample]:
    """Chunks of a text that hold a string; neighbours overlap by all but one byte of a string."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - length + 1, CHUNK):
        yield Sample(data[start:start + CHUNK + length - 1], start, length)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of keys and whether each stands more than once."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    own, counts = np.unique(keys, axis=0, return_counts=True)
    return own, counts > 1


def _longs(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))


def _flags(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rows) if rows else np.zeros(0, bool)))


def _list(column: pa.Array, i: int) -> np.ndarray:
    return np.asarray(column[i].values, np.int64).view(np.uint64) if column[i].is_valid else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Texts are UTF-8 bytes. A byte goes if some string of ``length`` bytes over it also starts
    at another place, in the same document or another; strings do not cross documents, overlaps
    count, and the input decides, not what is left. ``n_spans`` counts maximal removed runs and
    ``kept_sha256`` is that of the remaining bytes together.

    Null texts count as empty; texts shorter than ``length`` keep all. Null or repeated ids are rows
    like others (equal texts under one id are two copies). Empty tables give no rows.

    Work: the first pass leaves the sampled tuples of each document, some 160 bytes. Equal texts are one
    class (by SHA-256) from there on. Texts that share a tuple are written once and read in
    three further passes; keys are 64-bit hashes. Every group of equal keys is pre-aggregated, none is
    gathered; what comes back to a text is at most a list of its own keys.
    """
    if length < TUPLE + CELL:
        raise ValueError(f"length must be at least {TUPLE + CELL}")
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, tuples, again = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                found = [s.tuple for s in samples(text, length)]
                own, twice = _distinct(np.concatenate(found) if found else np.zeros(0, np.uint64))
                sizes.append(len(text))
                shas.append(hashlib.sha256(text).hexdigest())
                tuples.append(own)
                again.append(twice)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), _longs(tuples),
                 _flags(again)], names=["doc_id", "n_bytes", "sha", "tuples", "again"])

    seen = tabled(rows.mapInArrow(
        sampled, f"doc_id {id_type}, n_bytes long, sha string, tuples array<long>, again array<boolean>"))
    # one row per distinct text; of a text with copies every string is known to be repeated
    texts = tabled(seen.where(F.size("tuples") > 0).groupBy("sha")
                   .agg(F.min(F.struct("doc_id", "tuples", "again")).alias("first"), F.count(F.lit(1)).alias("copies"))
                   .select("sha", "first.*", "copies").withColumn("node", F.monotonically_increasing_id()))
    each = (texts.select("node", "copies", F.explode(F.arrays_zip("tuples", "again")).alias("t"))
            .select("node", F.col("t.tuples").alias("key"),
                    (F.col("t.again") & (F.col("copies") == 1)).cast("int").alias("inner")))
    common = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"))
    common = common.where("n > 1 or inner = 1").select("key", "n")
    wanted = tabled(each.join(common, "key").where("n > 1 or inner = 1").groupBy("node")
                    .agg(F.collect_list("key").alias("tuples"))
                    .join(texts.select("node", "sha", F.col("doc_id").alias("first_id"), "copies"), "node"))
    n_wanted = wanted.count()
    ids = wanted.select("first_id", "sha", "node")
    sent = F.broadcast(ids) if n_wanted <= SMALL_ROWS else ids
    bodies = (rows.join(sent, rows["doc_id"].eqNullSafe(F.col("first_id")))
              .where(F.sha2("text", 256) == F.col("sha")).select("node", "text"))
    bodies = tabled(bodies.join(wanted.select("node", "tuples", "copies"), "node"))
    if bodies.count() > n_wanted:  # rows that repeat an id and a text
        bodies = tabled(bodies.dropDuplicates(["node"]))

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, whole, again = [], [], []
            for i, text in enumerate(batch.column("text")):
                chosen = _list(batch.column("tuples"), i)
                found = []
                for sample in samples(text.as_py(), length):
                    c = sample.cells(np.isin(sample.tuple, chosen))
                    found.append(np.stack([c.shared, c.whole], axis=1))
                own, twice = _distinct(np.concatenate(found) if found else np.zeros((0, 2), np.uint64))
                shared.append(np.ascontiguousarray(own[:, 0]))
                whole.append(np.ascontiguousarray(own[:, 1]))
                again.append(twice)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), _longs(shared), _longs(whole),
                                              _flags(again)], names=["node", "copies", "shared", "whole", "again"])

    cells = bodies.select("node", "copies", "text", "tuples").mapInArrow(
        celled, "node long, copies long, shared array<long>, whole array<long>, again array<boolean>")
    cells = (cells.select("node", "copies", F.explode(F.arrays_zip("shared", "whole", "again")).alias("c"))
             .select("node", "copies", "c.shared", "c.whole", F.col("c.again").cast("int").alias("inner")))
    cells = tabled(cells)
    # the texts of equal cells, and how many kinds of cells share the same middle
    kinds = tabled(cells.groupBy("shared", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner"), F.max("copies").alias("copies"),
        F.min("node").alias("first")))
    mixed = kinds.groupBy("shared").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("shared")
    repeated = kinds.where("n > 1 or inner = 1").select("shared", "whole")
    covered = (cells.where("copies = 1").join(repeated, ["shared", "whole"], "left_semi")
               .groupBy("node").agg(F.collect_list("whole").alias("covered")))
    # one text of each kind gives its strings; those of kinds that stand once are in question
    weight = F.when((F.col("n") > 1) | (F.col("inner") == 1) | (F.col("copies") > 1), 2).otherwise(1)
    asked = (kinds.join(mixed, "shared", "left_semi").withColumn("weight", weight).groupBy(F.col("first").alias("node"))
             .agg(F.collect_list(F.when(F.col("weight") == 2, F.col("whole"))).alias("given"),
                  F.collect_list(F.when(F.col("weight") == 1, F.col("whole"))).alias("asked")))
    state = tabled(bodies.select("node", "copies").join(covered, "node", "left").join(asked, "node", "left"))

    def stringed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, wanted_here = [], []
            for i, text in enumerate(batch.column("text")):
                own = {2: [np.zeros(0, np.uint64)], 1: [np.zeros(0, np.uint64)]}
                chosen, keys = _list(batch.column("tuples"), i), {2: _list(batch.column("given"), i),
                                                                   1: _list(batch.column("asked"), i)}
                for sample in samples(text.as_py(), length):
                    c = sample.cells(np.isin(sample.tuple, chosen))
                    for k in (2, 1):
                        at = np.isin(c.whole, keys[k])
                        own[k].append(sample.strings(_starts(c.first[at], c.last[at])))
                given.append(np.unique(np.concatenate(own[2])))
                wanted_here.append(np.concatenate(own[1]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), _longs(given), _longs(wanted_here)],
                                             names=["node", "given", "asked"])

    strings = (bodies.join(state.where("given is not null").select("node", "given", "asked"), "node")
               .select("node", "text", "tuples", "given", "asked")
               .mapInArrow(stringed, "node long, given array<long>, asked array<long>"))
    strings = (strings.select("node", F.explode("given").alias("key"), F.lit(2).alias("weight"))
               .unionByName(strings.select("node", F.explode("asked").alias("key"), F.lit(1).alias("weight"))))
    strings = tabled(strings)
    twice = strings.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select("key")
    single = (strings.where("weight = 1").join(twice, "key", "left_semi")
              .groupBy("node").agg(F.collect_set("key").alias("strings")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                edges = np.zeros(len(text) + 1, np.int32)
                chosen, whole = _list(batch.column("tuples"), i), _list(batch.column("covered"), i)
                asked_here, known = _list(batch.column("asked"), i), _list(batch.column("strings"), i)
                for sample in samples(text, length):
                    c = sample.cells(np.isin(sample.tuple, chosen))
                    at = np.isin(c.whole, whole)
                    open_ = np.isin(c.whole, asked_here)
                    starts = _starts(c.first[open_], c.last[open_])
                    starts = starts[np.isin(sample.strings(starts), known)]
                    np.add.at(edges, sample.offset + np.concatenate([c.first[at], starts]), 1)
                    np.add.at(edges, sample.offset + np.concatenate([c.last[at], starts]) + length, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), pa.array([o[0] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())],
                names=["sha", "n_removed", "n_spans", "kept_sha256"])

    lists = (state.where("copies = 1 and (covered is not null or asked is not null)")
             .join(single, "node", "left").where("covered is not null or strings is not null"))
    results = (bodies.select("node", "text", "tuples").join(lists, "node").join(wanted.select("node", "sha"), "node")
               .select("sha", "text", "tuples", "covered", "asked", "strings")
               .mapInArrow(cut, "sha string, n_removed long, n_spans long, kept_sha256 string"))
    copies = texts.where("copies > 1").select("sha", F.lit(None).cast("long").alias("n_removed"),
                                              F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY_SHA).alias("kept_sha256"))
    known = tabled(results.unionByName(copies))
    out = seen.select("doc_id", "n_bytes", "sha").join(known, "sha", "left")
    removed = F.when(F.col("n_spans").isNull(), 0).otherwise(F.coalesce("n_removed", "n_bytes"))
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def _starts(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All starts of the given ranges, end to end."""
    times = last - first + 1
    return np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
