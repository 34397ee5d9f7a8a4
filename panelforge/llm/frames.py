"""Frame helpers that the document operators share.

Column picking keeps operators blind to whatever else a table carries, so an
extra column can never clash with a working column. ``settle`` cuts lineage
through the cluster's shared checkpoint folder. ``ranked`` numbers rows in an
order without ever holding one group in one task.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per session."""
    package = Path(__file__).resolve().parents[1]
    if not package.is_dir():  # already a shipped copy
        return
    sc = spark.sparkContext
    if getattr(sc, "_shipped_package", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="llm-package-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(target)
    sc._shipped_package = True


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: ``pick(df, doc_id="id")``."""
    return df.select(*[F.col("`" + old.replace("`", "``") + "`").alias(new)
                       for new, old in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table below the shared folder; it goes when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{os.urandom(8).hex()}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def settle(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, so that every later use reads the same rows.

    Lost executors do not lose them, and Spark's cleaner removes the files with the frame.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read from there.

    Like ``settle``, for frames that are read often: Spark knows the size of the table and reads
    only the columns it needs. The files go when the session ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def unit53(*columns: Column | str) -> Column:
    """A uniform whole number below 2**53 from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11)


def ranked(df: DataFrame, bucket: str, order: list, group: str | None = None,
           rank: str = "rank", total: str = "total") -> DataFrame:
    """Zero-based ``rank`` of each row within ``group`` (or overall) and the group's row count.

    ``bucket`` is a whole-number column that grows with the order, cut so fine that the
    rows of one (group, bucket) are few: those are numbered by a window, and the counts of
    the earlier buckets are added. Only the counts, one row per (group, bucket), ever meet
    per group. ``df`` must give the same rows each time it is read (see ``settle``); group
    and bucket hold no nulls.
    """
    keys = [group, bucket] if group else [bucket]
    span = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    before = span.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*keys, (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(span).alias(total))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_at", F.row_number().over(inside))
            .join(counts, keys)
            .withColumn(rank, F.col("_before") + F.col("_at") - 1)
            .drop("_before", "_at"))


def bucket_count(spark: SparkSession, rows: int, rows_per_bucket: int) -> int:
    """So many buckets that one holds about ``rows_per_bucket`` rows, and a few for every task."""
    return max(1, 4 * shuffle_width(spark), -(-rows // rows_per_bucket))


def source_key(column: str) -> Column:
    """The source as a string without nulls: ``=name``, or ``~`` for null, which sorts last."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("~"))
