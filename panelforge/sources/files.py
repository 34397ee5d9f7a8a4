"""File sources and sinks.

Reads take an explicit schema where one is known (no inference pass);
writes default to Parquet, optionally partitioned so later year filters
prune whole directories.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.scalar import null_if_nan

log = logging.getLogger(__name__)


def _fmt(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    p = path.lower().rstrip("/")
    for ext in ("csv", "json", "parquet", "orc", "txt"):
        if p.endswith("." + ext):
            return {"txt": "text"}.get(ext, ext)
    return "parquet"


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
               fmt: str | None = None, header: bool = True, **options) -> DataFrame:
    """Typed scan of CSV, JSON or Parquet."""
    paths = [path] if isinstance(path, str) else list(path)
    f = _fmt(paths[0], fmt)
    r = spark.read.format(f)
    if schema is not None:
        r = r.schema(schema)
    if f == "csv":
        r = r.option("header", header).option("quote", '"').option("escape", '"')
        if schema is None:
            r = r.option("inferSchema", True)
    for k, v in options.items():
        r = r.option(k, v)
    return clean_numbers(r.load(paths if len(paths) > 1 else paths[0]))


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinity to NULL in every float column: the rule of each read."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(F.col(f"`{c}`")) for c in floats}) if floats else df


def read_first(spark: SparkSession, paths: Sequence[str], requires: Sequence[str] = (), **kw) -> DataFrame:
    """The first path that exists and has the required columns."""
    errors = []
    for p in paths:
        try:
            df = read_table(spark, p, **kw)
        except AnalysisException as e:
            errors.append(f"{p}: {e.getMessage() if hasattr(e, 'getMessage') else e}")
            continue
        missing = [c for c in requires if c not in df.columns]
        if missing:
            errors.append(f"{p}: missing {missing}")
            continue
        return df
    raise FileNotFoundError("no usable source: " + "; ".join(errors))


def read_optional(spark: SparkSession, path: str, schema: T.StructType, **kw) -> DataFrame:
    """S3: a missing source yields an empty typed DataFrame and a warning."""
    try:
        return read_table(spark, path, schema=schema, **kw)
    except AnalysisException:
        log.warning("optional source %s not found; continuing with an empty table", path)
        return spark.createDataFrame([], schema)


def require(df: DataFrame, cols: Sequence[str] = (), nonempty: bool = True) -> DataFrame:
    """Required columns present and (optionally) at least one row."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    if nonempty and df.isEmpty():
        raise ValueError("input is empty")
    return df


def read_json_records(spark: SparkSession, path: str, field: str = "data",
                      record_schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """JSON documents holding a record array under ``field`` -> rows;
    one document per file, or with ``lines`` one per line (splittable)."""
    if record_schema is not None:
        schema = T.StructType([T.StructField(field, T.ArrayType(record_schema))])
        raw = spark.read.schema(schema).option("multiLine", not lines).json(path)
    else:
        raw = spark.read.option("multiLine", not lines).json(path)
    return raw.select(F.explode(F.col(field)).alias("r")).select("r.*")


def records_from_text(df: DataFrame, text_col: str, record_schema: T.StructType, field: str = "data") -> DataFrame:
    """S5 on a text column: parse the payload and explode its records."""
    schema = T.StructType([T.StructField(field, T.ArrayType(record_schema))])
    return df.select(F.explode(F.from_json(F.col(text_col), schema)[field]).alias("r")).select("r.*")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite", sort_within: Sequence[str] = ()) -> None:
    """Parquet by default (CSV with header on request), optional
    directory partitioning and sorted files for better min/max skipping."""
    d = df.sortWithinPartitions(*sort_within) if sort_within else df
    w = d.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_profile(df: DataFrame, path: str, spec=None) -> None:
    """Column profile (Q1) and missing report (Q2) written next to each other."""
    from panelforge.operators.quality import missing_report, profile

    write_table(profile(df, spec), f"{path}/profile", fmt="csv")
    write_table(missing_report(df, only_missing=False), f"{path}/missing", fmt="csv")


def save_model(model, path: str) -> None:
    """Fitted transformer / model (``pyspark.ml`` writer)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """Loads any saved pipeline model."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def export_predictions(panel: DataFrame, preds: DataFrame, keys: Sequence[str], path: str | None = None,
                       fmt: str = "parquet") -> DataFrame:
    """Wide per-row predictions joined by key (J12), sorted by key."""
    out = panel.join(preds, on=list(keys), how="inner").orderBy(*keys)
    if path:
        write_table(out, path, fmt=fmt)
    return out


def tuning_summary(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A small table of tuning stages (one row per stage)."""
    schema = "stage string, cv_score double, test_r2 double, test_rmse double, params string"
    return spark.createDataFrame([(r.get("stage"), r.get("cv_score"), r.get("test_r2"), r.get("test_rmse"),
                                   str(r.get("params", ""))) for r in rows], schema)


def write_sequences(df: DataFrame, path: str) -> None:
    """Sequences with their target (array column) to Parquet."""
    write_table(df, path)
