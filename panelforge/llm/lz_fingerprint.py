"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the shortest string that is not a
phrase yet. Like texts build like dictionaries, which is what makes them compress each
other well. The set of phrases is hashed, its smallest hashes are the fingerprint, and two
fingerprints estimate the overlap of the two dictionaries (intersection over union).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.frames import pick, settle, shuffle_width, unit53
from panelforge.llm.hashing import run_hashes

#: Room for a code point in a dictionary key of (parent phrase, code point).
PHRASE_STEP = 1 << 21

def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def phrase_hashes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the phrases that stand end to end, the k-th up to ``ends[k]``."""
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    return run_hashes(codes[:ends[-1]].astype(np.uint64) + np.uint64(1), starts, ends)


def parse(codes: list[int], phrases: dict[int, int], node: int, start: int,
          ends: list[int], added: list[int]) -> int:
    """Goes on parsing at position ``start`` inside phrase ``node``; gives the open phrase.

    ``phrases`` maps parent * PHRASE_STEP + code point to the phrase's own number (times the
    step), ``ends`` and ``added`` get each new phrase's end and key.
    """
    known = phrases.get
    for at, code in enumerate(codes, start + 1):
        key = node + code
        node = known(key, -1)
        if node < 0:
            phrases[key] = (len(phrases) + 1) * PHRASE_STEP
            ends.append(at)
            added.append(key)
            node = 0
    return node


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest hashes, to 32 bits, in order."""
    short = hashes >> np.uint64(32)
    if len(short) > size:
        short = np.partition(short, size - 1)[:size]
    return np.unique(short).astype("<u4")


def written(signed: np.ndarray) -> str:
    return base64.b64encode(signed.tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Estimated intersection over union of the sets behind two signatures; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    new = np.ones(len(both), bool)
    new[1:] = ~twice
    last = both[new][:size][-1]
    return float(np.count_nonzero(both[1:][twice] <= last)) / min(size, int(np.count_nonzero(new)))


def fingerprint(text: str, size: int) -> np.ndarray:
    codes, ends = code_points(text), []
    parse(codes.tolist(), {}, 0, 0, ends, [])
    return signature(phrase_hashes(codes, np.array(ends, np.int64)), size)


def fingerprints(text: str, tail: str, size: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Of the text, of the text with its last half replaced by ``tail``; the edited text.

    Both share the parse of the first half: the phrases of one rest are taken out again
    before the other rest is parsed.
    """
    keep = len(text) - len(text) // 2
    codes = code_points(text)
    listed = codes.tolist()
    phrases: dict[int, int] = {}
    ends: list[int] = []
    node = parse(listed[:keep], phrases, 0, 0, ends, [])
    whole, added = list(ends), []
    parse(listed[keep:], phrases, node, keep, whole, added)
    for key in added:
        del phrases[key]
    edited = text[:keep] + tail
    other = np.concatenate([codes[:keep], code_points(tail)])
    parse(other[keep:].tolist(), phrases, node, keep, ends, [])
    sign = lambda c, e: signature(phrase_hashes(c, np.array(e, np.int64)), size)
    return sign(codes, whole), sign(other, ends), edited


RESULT = ("doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
FIELDS = [x.split()[0] for x in RESULT.split(", ")]


class _Out:
    """Collects result rows and hands them out as record batches."""

    def __init__(self, kind: pa.DataType):
        self.rows: dict[str, list] = {f: [] for f in FIELDS}
        self.schema = pa.schema([("doc_id", kind), ("n_chars", pa.int64()), *[(f, pa.string()) for f in FIELDS[2:5]],
                                 ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def add(self, **row) -> None:
        for f in FIELDS:
            self.rows[f].append(row[f])

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict(self.rows, schema=self.schema)
        self.rows = {f: [] for f in FIELDS}
        return out


def _tail(text: str, following: str) -> str:
    return following[: len(text) // 2]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def compare_fingerprints(docs: DataFrame, size: int = 128, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and likenesses.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The edited text has the last half (rounded down) of the code points replaced
    by the first as many of the next document's, in id order; the last document's next is the
    first. ``near_edited`` compares a text with its edited text, ``near_next`` with the next
    document. A fingerprint is base64 of the ``size`` smallest 32-bit phrase hashes in order,
    little-endian, so equal texts have equal fingerprints.

    Null texts count as empty; an empty text has the empty fingerprint, like 1 to another empty
    one and 0 to the rest. Null ids stand first; rows that share an id stand in the order of a
    hash of their texts. A single document is its own next. Empty tables give no rows; other columns are
    not read. Texts are parsed whole at any length, with one dictionary entry per phrase while a text is parsed.

    Work: a sample of ids cuts them into ranges, and the first text of each range is copied to the end of
    the range before. Then one shuffle of the texts by range is all: a task walks through its sorted
    ranges, keeps two documents, and meets every document's next one.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tasks = shuffle_width(spark)
    rows = rows.withColumn("range", _range_of(rows, 4 * tasks))
    firsts = settle(rows.groupBy("range").agg(F.min(F.struct("doc_id"))["doc_id"].alias("first_id")))
    # one row per range: the range before it, and the last one for the first
    around = Window.orderBy("range")
    ends = firsts.select("first_id", F.col("range").alias("own"), F.coalesce(
        F.lag("range").over(around), F.max("range").over(Window.partitionBy(F.lit(0)))).alias("before"))
    heads = (rows.join(F.broadcast(ends), (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
             .groupBy("before").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    both = (rows.select("range", F.lit(0).alias("head"), "doc_id", F.xxhash64("text").alias("hash"), "text")
            .unionByName(heads.select(F.col("before").alias("range"), F.lit(1).alias("head"),
                                      F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("hash"), "text")))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for the next one
        ready = None  # its predecessor, done but for near_next
        for batch in batches:
            out = _Out(batch.schema.field("doc_id").type)
            for head, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("head", "doc_id", "text")],
                                          strict=True):
                if held is not None:
                    own, other, edited = fingerprints(held[1], _tail(held[1], text), size)
                    if ready:
                        out.add(**ready[1], near_next=likeness(ready[0], own, size))
                    ready = own, {
                        "doc_id": held[0], "n_chars": len(held[1]), "edited_sha256": _sha(edited),
                        "fingerprint": written(own), "edited_fingerprint": written(other),
                        "near_edited": likeness(own, other, size)}
                held = doc_id, text
                if head:
                    out.add(**ready[1], near_next=likeness(ready[0], fingerprint(text, size), size))
                    held = ready = None
            yield out.batch()

    return (both.repartitionByRange(tasks, "range").sortWithinPartitions("range", "head", "doc_id", "hash")
            .select("head", "doc_id", "text").mapInArrow(walk, RESULT.format(id=kind)))


def _range_of(rows: DataFrame, n: int) -> Column:
    """The number of the id's range, from 0 (with null) to below ``n``, by about 50 sampled ids a range."""
    rate = min(1.0, 50 * n / max(1, rows.count()))
    some = rows.select("doc_id").where(F.col("doc_id").isNotNull() & (unit53(F.lit(1), F.col("doc_id")) < int(rate * 2**53)))
    ids = sorted({r["doc_id"] for r in some.collect()})
    cuts = sorted({ids[k * len(ids) // n] for k in range(1, n)}) if ids else []
    if not cuts:
        return F.lit(0)
    kind = rows.schema["doc_id"].dataType
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c).cast(kind) for c in cuts]), lambda c: c <= F.col("doc_id"))),
                      F.lit(0))
