"""Near duplicates by MinHash with tensored banding.

A banded index with ``m * m`` tables would need as many independent bands of minimum hashes.
Here two collections of ``m`` short bands each are computed, and every pair of a band from
the one and a band from the other is a table key: ``m * m`` tables from ``2 * m`` bands. Two
documents become candidates if they agree on any band of both collections.

Documents with equal shingle sets are one class from the start. Keys are only formed from
bands that another class has too, which loses no key that could match. Within a key, classes
are held against the most central member (never all pairs); what then still stands unlinked in a common key is joined
exactly by a prefix filter that orders shingles from rare to frequent. Each set carries a parity sketch, whose
bits that differ between two sets can be no more than the shingles that differ: that leaves
out pairs which share a prefix, but not enough of the rest. All links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.components import components
from panelforge.llm.frames import free_name, pick, tabled
from panelforge.llm.hashing import SPACED, mixed, odd_numbers, shingles, sliced, word_hashes

#: A table of node numbers up to so many rows (16 MB) may be sent to every executor.
SMALL_ROWS = 1_000_000
#: 64-bit words of a set's parity sketch.
PARITY_WORDS = 8


def parities(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row ``PARITY_WORDS`` words: each shingle flips one bit, the same in every set."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = mixed(sets ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * PARITY_WORDS)
    out = np.zeros((len(bounds) - 1, PARITY_WORDS), np.uint64)
    np.bitwise_xor.at(out, (rows, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def sketch(sets: np.ndarray, bounds: np.ndarray, bands: int, rows_per_band: int) -> tuple[np.ndarray, ...]:
    """Two 64-bit sums that identify each row's set, and its 2 * bands band hashes."""
    n = len(bounds) - 1
    filled = np.flatnonzero(np.diff(bounds))
    starts = bounds[:-1][filled]
    ids = np.zeros((2, n), np.uint64)
    found = np.zeros((n, 2 * bands), np.uint64)
    if len(filled):
        ids[0, filled] = np.add.reduceat(mixed(sets), starts)
        ids[1, filled] = np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
        seeds = odd_numbers(2 * bands * rows_per_band, 3)
        salts = odd_numbers(2 * bands, 4)
        for band in range(2 * bands):
            value = np.full(len(filled), salts[band], np.uint64)
            for k in range(rows_per_band):
                least = np.minimum.reduceat(sets * seeds[band * rows_per_band + k], starts)
                value = mixed(value ^ least)
            found[filled, band] = value
    return ids[0].view(np.int64), ids[1].view(np.int64), found.view(np.int64)


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _semi(df: DataFrame, ids: DataFrame, column: str, n_ids: int) -> DataFrame:
    """Rows whose ``column`` is in ``ids``, which is sent along if it has few rows."""
    ids = ids.select(column).distinct()
    return df.join(F.broadcast(ids) if n_ids <= SMALL_ROWS else ids, column, "left_semi")


def confirmed(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` with ``linked``: whether their full sets overlap by ``percent`` or more.

    ``sets`` has ``node, shingles`` without repeats in a list. Of ``pairs``, a written table, only
    the sets that it names are moved.
    """
    left = _semi(sets, pairs.select(F.col("a").alias("node")), "node", n_pairs)
    right = _semi(sets, pairs.select(F.col("b").alias("node")), "node", n_pairs)
    sent = F.broadcast(pairs) if n_pairs <= SMALL_ROWS else pairs
    with_left = left.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).join(sent, "a")
    both = with_left.join(right.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - shared
    return both.select("a", "b", (100 * shared.cast("long") >= percent * either.cast("long")).alias("linked"))


class _Linker:
    """Keeps what has been tested and linked, and the labels that follow."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.tested: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def test(self, pairs: DataFrame) -> None:
        """Confirms the pairs that are new, and finds the labels anew if any of them is a link."""
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
        if self.tested:
            pairs = pairs.join(self.all_tested().select("a", "b"), ["a", "b"], "left_anti")
        pairs = tabled(pairs)
        n_pairs = pairs.count()
        if not n_pairs:
            return
        self.tested.append(tabled(confirmed(pairs, n_pairs, self.sets, self.percent)))
        if not self.tested[-1].where("linked").isEmpty():
            self.labels = tabled(components(self.all_tested().where("linked").select("a", "b")))

    def all_tested(self) -> DataFrame:
        return reduce(DataFrame.union, self.tested)

    def labelled(self, groups: DataFrame) -> DataFrame:
        """``key, node, label`` of the groups that still hold several labels."""
        if self.labels is None:
            return groups.withColumn("label", F.col("node"))
        named = groups.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed_keys = (named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                      .where("lo < hi").select("key"))
        return named.join(mixed_keys, "key", "left_semi").select("key", "node", "label")

    def star(self, groups: DataFrame, tries: int = 1) -> None:
        """Holds each node against the most central member of each of its groups, ``tries`` of them at most.

        That is the member that meets most others over all of its groups, so that copies of one text
        join around it."""
        named = self.labelled(groups)
        sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        meets = named.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("meets"))
        named = tabled(named.join(meets, "node"))
        order = F.struct(-F.col("meets"), "node")
        first = named.groupBy("key").agg(F.min_by(F.struct("node", "label"), order).alias("rep"))
        met = (named.join(first, "key").where(F.col("label") != F.col("rep.label"))
               .groupBy("node", F.col("rep.node").alias("rep")).agg(F.count(F.lit(1)).alias("n")))
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "rep"))
        self.test(met.withColumn("at", best).where(F.col("at") <= tries)
                  .select(F.col("node").alias("a"), F.col("rep").alias("b")))

    def rest(self, prefixes: DataFrame) -> None:
        """Tests all pairs that share a prefix under different labels and could still overlap enough.

        Where the first shared shingle stands late in either order, too few are left behind it. Where
        more parity bits differ than shingles may, the pair cannot be linked either: at ``percent`` of
        the union, at most (100 - percent) / (100 + percent) of both sizes together differ.
        """
        named = self.labelled(prefixes.select("key", "node")).join(prefixes, ["key", "node"])
        named = tabled(named.join(self.sets.select("node", "parity"), "node"))
        words = [F.col("parity")[i].alias(f"w{i}") for i in range(PARITY_WORDS)]
        one = named.select("key", F.col("node").alias("a"), "label", "n", "place", *words)
        two = named.select("key", F.col("node").alias("b"), F.col("label").alias("label2"),
                           F.col("n").alias("n2"), F.col("place").alias("place2"),
                           *[F.col("parity")[i].alias(f"v{i}") for i in range(PARITY_WORDS)])
        differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(PARITY_WORDS)])
        needed = F.col("n").cast("long") + F.col("n2")
        could = (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) + 1) * (100 + self.percent)
        self.test(one.join(two, "key").where(
            (F.col("a") > F.col("b")) & (F.col("label") != F.col("label2")) & (could >= needed * self.percent)
            & (differ * (100 + self.percent) <= needed * (100 - self.percent)))
            .select("a", "b"))


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``key, node, n, place``: the shingles of which a node shares one with any node it links to.

    ``place`` is the shingle's place, from 1, in the node's order of its ``n`` shingles.

    Shingles are ordered from rare to frequent among these sets. Two sets that overlap by
    ``percent`` share one of their first ``n - ceil(n * percent / 100) + 1`` shingles each.
    Shingles that one set alone has come first and can be shared with none.
    """
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(often, "key")
    by_node = Window.partitionBy("node")
    at = F.row_number().over(by_node.orderBy("df", "key"))
    alone = F.col("n") - F.count(F.lit(1)).over(by_node)
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return (shared.withColumn("at", at).withColumn("alone", alone).withColumn("place", F.col("at") + F.col("alone"))
            .where(F.col("place") <= reach).select("key", "node", "n", "place"))


SKETCHED = "doc_id {id}, n_shingles int, s1 long, s2 long, bands array<long>"


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, bands: int = 12,
                    rows_per_band: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    A document's set holds the distinct ``width``-word shingles of its lower-cased words; with
    fewer words the whole sequence is the one shingle. Documents whose sets overlap by
    ``percent`` of their union or more are linked; ``component_id`` is the smallest id reachable
    and ``kept`` says that it is the document's own.

    Null, empty and wordless texts have 0 shingles and are linked with nothing. Null ids take part
    but name no component (a component of null ids only has a null id and keeps none). Rows that
    repeat an id and a text are one class; all rows with the kept id are kept. Empty tables
    give no rows.

    Shingles are 64-bit hashes. The chance that a pair at exactly 75 % never meets in a table is
    about 2 * (1 - 0.75 ** 2) ** 12 = 1 in 10,000 with 12 bands of 2, and falls fast above.
    Work: two passes over the texts; the first leaves some 250 bytes a document, the second takes
    only documents that share keys.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            n = batch.num_rows
            sets, bounds = shingles(*word_hashes(batch.column("text"), SPACED), n, width)
            s1, s2, found = sketch(sets, bounds, bands, rows_per_band)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int32)), pa.array(s1), pa.array(s2),
                 list_array(found.ravel(), np.arange(n + 1) * 2 * bands)],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    def with_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole)):
            sets, bounds = shingles(*word_hashes(batch.column("text"), SPACED), batch.num_rows, width)
            s1, s2, _ = sketch(sets, bounds, 0, 0)
            own = (batch.column("s1").to_numpy() == s1) & (batch.column("s2").to_numpy() == s2)
            bits = list_array(parities(sets, bounds).ravel(), np.arange(batch.num_rows + 1) * PARITY_WORDS)
            out = pa.RecordBatch.from_arrays([batch.column("node"), list_array(sets, bounds), bits],
                                             names=["node", "shingles", "parity"])
            yield out.filter(pa.array(own))

    sketches = tabled(rows.mapInArrow(sketched, SKETCHED.format(id=kind)))
    classes = tabled(sketches.where("n_shingles > 0").groupBy("s1", "s2")
                     .agg(F.min(F.struct("doc_id", "bands")).alias("first"))
                     .select("s1", "s2", "first.*").withColumn("node", F.monotonically_increasing_id()))
    halves = classes.select("node", F.posexplode("bands").alias("at", "half"))
    common = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    common = halves.join(common, "half", "left_semi").groupBy("node").agg(
        F.collect_list(F.when(F.col("at") < bands, F.col("half"))).alias("left"),
        F.collect_list(F.when(F.col("at") >= bands, F.col("half"))).alias("right"))
    common = tabled(common.where("size(left) > 0 and size(right) > 0"))
    keys = (common.select("node", F.explode("left").alias("f"), "right")
            .select("node", "f", F.explode("right").alias("g"))
            .select("node", F.xxhash64("f", "g").alias("key")))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    groups = tabled(keys.join(met, "key", "left_semi").select("key", "node"))
    wanted = tabled(classes.join(groups.select("node").distinct(), "node")
                    .select(F.col("doc_id").alias("first_id"), "node", "s1", "s2"))
    n_wanted = wanted.count()
    sent = F.broadcast(wanted) if n_wanted <= SMALL_ROWS else wanted
    texts = rows.join(sent, rows["doc_id"].eqNullSafe(F.col("first_id"))).select("node", "s1", "s2", "text")
    sets = tabled(texts.mapInArrow(with_sets, "node long, shingles array<long>, parity array<long>"))
    if sets.count() > n_wanted:  # rows that repeat an id and a text
        sets = tabled(sets.dropDuplicates(["node"]))

    linker = _Linker(sets, percent)
    linker.star(groups)
    open_nodes = tabled(linker.labelled(groups).select("node").distinct())
    prefixes = tabled(rare_prefixes(_semi(sets, open_nodes, "node", open_nodes.count()), percent))
    linker.rest(prefixes)

    labels = linker.labels if linker.labels is not None else classes.select("node", F.col("node").alias("label"))
    named = (sketches.where("n_shingles > 0").join(classes.select("s1", "s2", "node"), ["s1", "s2"])
             .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select(
        "doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_per_group(docs: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates, all columns kept: of each component the row with the smallest id.

    A document is an id with its text, so a row that shares its id with another text is judged by its own.
    Null ids come after all others; of rows alike in id and text one stays. Texts without words are linked
    with nothing, but of such rows alike in id and text one stays as well. Empty tables give no rows.
    """
    given, text = F.col("`" + id_col.replace("`", "``") + "`"), F.col("`" + text_col.replace("`", "``") + "`")
    name = F.struct(given.isNull().alias("none"), given.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"))
    names = docs.select(name.alias("doc_id"), text.alias("text"))
    found = near_duplicates(names, percent=percent, width=width).groupBy("doc_id").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    found = tabled(found.where("not kept or n > 1"))
    own, other = free_name(docs, "_own"), free_name(docs, "_other")
    rows = docs.withColumn(own, name)
    listed = found.select(F.col("doc_id").alias(other), "kept")
    out = rows.join(listed.select(other), F.col(own) == F.col(other), "left_anti").select(docs.columns)
    again = listed.where("kept").select(other)
    if again.isEmpty():
        return out
    rows = rows.join(again, F.col(own) == F.col(other), "left_semi").dropDuplicates([own])
    return out.union(rows.select(docs.columns))
