"""Session helpers: local builder for tests/bench, checkpoint directory, lineage cuts."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "panelforge", checkpoint_dir: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. A cluster job receives its session
    from the caller instead and keeps the cluster's settings."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "16g"))
    if checkpoint_dir:
        b = b.config(CHECKPOINT_CONF, checkpoint_dir)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir:
        ensure_checkpoint_dir(spark, checkpoint_dir)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per session, for functions that
    run there. Spark's file server distributes it, so nothing but the driver reads the written zip."""
    package = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if not package.is_dir() or getattr(sc, "_panelforge_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="panelforge-package-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(target)
    sc._panelforge_shipped = True


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder named by the cluster, if any."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    try:
        return spark.conf.get(CHECKPOINT_CONF, None) or None
    except Exception:  # noqa: BLE001 - conf lookup on a stopped/remote session
        return None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str) -> str:
    """Use the configured folder; set ``fallback`` only when none is set (tests)."""
    d = checkpoint_dir(spark)
    if not d:
        d = fallback
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return spark.sparkContext.getCheckpointDir() or d


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. A local session
    without one gets a temporary folder; on a cluster it is required."""
    sc = spark.sparkContext
    folder = checkpoint_dir(spark)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="panelforge-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/panelforge_io/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: the rows are
    computed once and survive executor loss. Spark's cleaner removes the files
    with the frame (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed_ranges(df: DataFrame, order: list, out: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt into ranges of ``order`` with the range number in ``out``,
    written once: the boundaries come from a sample, so counts and ranks must
    never come from two evaluations of the same range exchange."""
    ranged = df.repartitionByRange(range_partitions(df.sparkSession, partitions), *order)
    return cut_lineage(ranged.withColumn(out, F.spark_partition_id()))


def range_partitions(spark: SparkSession, requested: int | None = None) -> int:
    """Number of ranges for range-partitioned scans: the caller's value, else
    the session's ``spark.sql.shuffle.partitions`` (sized by the cluster to
    its data), so a range holds a bounded slice at any scale."""
    if requested:
        return int(requested)
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # noqa: BLE001 - conf not readable: Spark's default
        return 200


def materialize(df: DataFrame) -> DataFrame:
    """Input for iterative work (model fitting, tuning), checkpointed into
    the shared folder."""
    return cut_lineage(df)
