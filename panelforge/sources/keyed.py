"""Documents named by key as a Spark data source (S9): many texts per file, with an index of offsets.

``df.write.format("keyedtext")`` packs ``key, text`` rows. Each task appends its texts to one data
file and writes an index of (key, offset, length) beside it; the commit lists the finished
files in a manifest, so files of failed or repeated tasks are never seen. Reading plans pieces of
about ``pieceBytes`` from the manifest alone, and ``keys`` (a JSON list) reads only the byte ranges of
the wanted texts. Paths may be on any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# sent to the workers as it is, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
INDEX = pa.schema([("key", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
TEXTS = pa.schema([("key", pa.string()), ("text", pa.string())])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """A data file: name, texts, bytes, first and last key, and where its pieces start as (index row, offset)."""

    name: str
    rows: int
    bytes: int
    least: str
    greatest: str
    pieces: list


@dataclass
class Piece(InputPartition):
    """Index rows ``start`` to ``stop`` of a data file."""

    name: str
    start: int
    stop: int


class KeyedTextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, piece_bytes: int):
        self.path, self.overwrite, self.piece_bytes = path, overwrite, piece_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        rows, at, pieces, least, greatest = 0, 0, [(0, 0)], "", ""
        with fs.open_output_stream(f"{root}/{name}.txt") as data, fs.open_output_stream(f"{root}/{name}.idx") as side, \
                pq.ParquetWriter(side, INDEX) as index:
            for batch in iterator:
                entries = []
                for key, text in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if key is None or text is None:
                        continue
                    if at - pieces[-1][1] >= self.piece_bytes:
                        pieces.append((rows, at))
                    body = text.encode()
                    data.write(body)
                    entries.append((key, at, len(body)))
                    least, greatest = (key, key) if not rows else (min(least, key), max(greatest, key))
                    rows, at = rows + 1, at + len(body)
                if entries:
                    index.write_table(pa.table([list(c) for c in zip(*entries, strict=True)], schema=INDEX), row_group_size=8192)
        return Written(name, rows, at, least, greatest, pieces)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        earlier = [] if self.overwrite else manifest(self.path)
        listed = earlier + [vars(m) for m in messages if m is not None and m.rows]
        new = f"{root}/_manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(new) as out:
            out.write(json.dumps(listed).encode())
        fs.move(new, f"{root}/_manifest")

    def abort(self, messages: list) -> None:
        """Unlisted files are never read."""


def manifest(path: str) -> list[dict]:
    fs, root = opened(path)
    if fs.get_file_info(f"{root}/_manifest").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(f"{root}/_manifest") as held:
        return json.loads(held.read())


class KeyedTextReader(DataSourceReader):
    def __init__(self, path: str, keys: list | None):
        self.path, self.keys = path, keys if keys is None else sorted(map(str, keys))

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for file in manifest(self.path):
            if self.keys is not None and not any(file["least"] <= k <= file["greatest"] for k in self.keys):
                continue
            starts = [row for row, _ in file["pieces"]] + [file["rows"]]
            out += [Piece(file["name"], a, b) for a, b in zip(starts[:-1], starts[1:], strict=True) if a < b]
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{partition.name}.idx") as side:
            index = pq.read_table(side, memory_map=False).slice(partition.start, partition.stop - partition.start)
        rows = list(zip(*(index[c].to_pylist() for c in INDEX.names), strict=True))
        if self.keys is not None:
            wanted = set(self.keys)
            rows = [r for r in rows if r[0] in wanted]
        with fs.open_input_file(f"{root}/{partition.name}.txt") as data:
            batch, size = [], 0
            for key, offset, length in rows:
                batch.append((key, data.read_at(length, offset).decode()))
                size += length
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*batch, strict=True)], schema=TEXTS)
                    batch, size = [], 0
            if batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*batch, strict=True)], schema=TEXTS)


class KeyedText(DataSource):
    """Format ``keyedtext``: columns ``key, text``; options ``path``, ``keys``, ``pieceBytes``."""

    @classmethod
    def name(cls) -> str:
        return "keyedtext"

    def schema(self) -> str:
        return "key string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        keys = self.options.get("keys")
        return KeyedTextReader(self.options["path"], None if keys is None else json.loads(keys))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return KeyedTextWriter(self.options["path"], overwrite, int(self.options.get("pieceBytes", PIECE_BYTES)))


def write_keyed(df: DataFrame, key: str, text: str, path: str, piece_bytes: int = PIECE_BYTES, mode: str = "overwrite") -> None:
    """Packs one text per row under its key; rows without a key or a text are left out."""
    spark = df.sparkSession
    spark.dataSource.register(KeyedText)
    rows = df.select(df[key].cast("string").alias("key"), df[text].cast("string").alias("text"))
    rows.write.format("keyedtext").option("pieceBytes", piece_bytes).mode(mode).save(path)


def read_keyed(spark: SparkSession, path: str, keys: Sequence | None = None, key_type: str = "bigint") -> DataFrame:
    """``key, text`` of all documents, or of the given keys only; keys that are no ``key_type`` become NULL."""
    spark.dataSource.register(KeyedText)
    read = spark.read.format("keyedtext")
    if keys is not None:
        read = read.option("keys", json.dumps([str(k) for k in keys]))
    d = read.load(path)
    return d.select(d["key"].try_cast(key_type).alias("key"), "text")
