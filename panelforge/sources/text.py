"""Semi-structured text sources (S7-S9): keyed JSON objects, prose reports
with header lines, and documents named by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.scalar import capture_int, capture_text
from panelforge.operators.windows import carry_header


def explode_keyed_json(df: DataFrame, col: str, value_schema: T.StructType | T.DataType,
                       key_name: str = "key") -> DataFrame:
    """A JSON object keyed by entity (``{"27001": {...}, ...}``) -> one
    row per key with the value's fields."""
    m = F.from_json(F.col(col), T.MapType(T.StringType(), value_schema))
    d = df.select(F.explode(m).alias(key_name, "__v"))
    if isinstance(value_schema, T.StructType):
        return d.select(key_name, "__v.*")
    return d.withColumnRenamed("__v", "value")


def lines(df: DataFrame, doc_key: str, text_col: str) -> DataFrame:
    """Text to (doc, line_no, line) rows, line numbers from 1."""
    return df.select(doc_key, F.posexplode(F.split(F.col(text_col), r"\r?\n")).alias("line_no", "line")) \
             .withColumn("line_no", F.col("line_no") + 1)


# Header line and JSON field patterns of the report format.
HEADER_PATTERN = r"^\s*(.+?)\s+County\s*\(Rank\s*(\d+),\s*FIPS\s*(\d+)\)"
FIELD_PATTERN = r'"([A-Za-z_][A-Za-z0-9_]*)"\s*:\s*(-?[0-9][0-9.eE+-]*)'


def parse_report(df: DataFrame, doc_key: str, text_col: str, fields: Sequence[str],
                 header_pattern: str = HEADER_PATTERN, field_pattern: str = FIELD_PATTERN) -> DataFrame:
    """Prose report with header lines followed by JSON-ish fields ->
    one row per header block with the numeric fields.

    Lines get numbers, headers are recognised by regex, carried down over
    the following lines of the same document block by block (W15), and numeric fields are
    pivoted per block with one conditional aggregate per field."""
    ln = lines(df, doc_key, text_col)
    hdr = F.when(F.col("line").rlike(header_pattern), F.col("line_no"))
    ln = carry_header(ln.withColumn("__hdr_line", hdr), doc_key, "line_no", "__hdr_line", "block").where(F.col("block").isNotNull())
    ln = ln.withColumn("__kvs", F.regexp_extract_all(F.col("line"), F.lit(field_pattern), 0))
    ln = ln.withColumn("__hname", F.when(F.col("line_no") == F.col("block"), capture_text("line", header_pattern, 1)))
    ln = ln.withColumn("__hrank", F.when(F.col("line_no") == F.col("block"), capture_int("line", header_pattern, 2)))
    ln = ln.withColumn("__hkey", F.when(F.col("line_no") == F.col("block"), capture_int("line", header_pattern, 3)))
    kv = ln.select(doc_key, "block", "__hname", "__hrank", "__hkey", F.explode_outer("__kvs").alias("__kv"))
    kv = kv.withColumn("__f", F.regexp_extract("__kv", field_pattern, 1)).withColumn(
        "__x", F.regexp_extract("__kv", field_pattern, 2).try_cast("double"))
    aggs = [F.max("__hname").alias("name"), F.max("__hrank").alias("rank"), F.max("__hkey").alias("key")]
    aggs += [F.max(F.when(F.col("__f") == f, F.col("__x"))).alias(f) for f in fields]
    return kv.groupBy(doc_key, "block").agg(*aggs)


def read_keyed_text(spark: SparkSession, path: str, key_pattern: str = r"([0-9]+)[^/]*$",
                    key_type: str = "bigint") -> DataFrame:
    """One document per file; the key comes from the file name."""
    d = spark.read.text(path, wholetext=True)
    name = F.input_file_name()
    return d.select(F.regexp_extract(name, key_pattern, 1).try_cast(key_type).alias("key"),
                    F.col("value").alias("text"))
