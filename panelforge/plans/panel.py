"""Panels built from the driver tables (the analogues of the reference's
sources; see SURVEY section 7.3).

* base panel   -- orders x customer by (nation, year, month): the county x
                  year x month panel with a target (``total``);
* sparse item  -- a yearly "census" value observed only in some years and
                  never for entities 20-24, so every gap-filling stage has
                  work to do;
* survey text  -- order prices as thousands-separated text with ``(D)``
                  suppression codes, and float-text county codes;
* monthly price, static dimension, name table -- small lookup sources.

Everything is a lazy DataFrame over the whole tables; nothing is sampled.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.spec import PanelSpec

PANEL = PanelSpec(entity="entity", year="yr", month="mo", target="total")
YEARLY = PanelSpec(entity="entity", year="yr", month=None, target="total")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def base_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, yr, mo) -> v (mean price), total (sum), n (orders)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return (j.groupBy(F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("yr"),
                      F.month("o_orderdate").alias("mo"))
            .agg(F.avg("o_totalprice").alias("v"), F.sum("o_totalprice").alias("total"),
                 F.count(F.lit(1)).alias("n")))


def yearly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel to (entity, yr) means (A3)."""
    p = base_panel(spark, sf_dir)
    return p.groupBy("entity", "yr").agg(F.avg("v").alias("v"), F.avg("total").alias("total"),
                                          F.sum("n").alias("n"))


def sparse_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly census-like item: observed in every third year per entity,
    never for entities 20 and above (fixture rule of SURVEY 7.3)."""
    y = yearly_panel(spark, sf_dir)
    return y.select("entity", "yr", F.when(((F.col("yr") + F.col("entity")) % 3 == 0) & (F.col("entity") < 20),
                                           F.col("v")).alias("item"))


def panel_with_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly panel with the sparse yearly item. The yearly mean is a
    window over (entity, year) -- at most 12 rows per partition -- rather
    than a re-aggregation joined back, and it leaves the panel partitioned
    by (entity, year), the layout the gap-filling scans use next."""
    p = base_panel(spark, sf_dir)
    observed = ((F.col("yr") + F.col("entity")) % 3 == 0) & (F.col("entity") < 20)
    return p.withColumn("item", F.when(observed, F.avg("v").over(Window.partitionBy("entity", "yr"))))


def survey_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long survey analogue: text values with thousands separators and a
    ``(D)`` suppression code for low-priority orders, a state code and a
    float-text county code."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                              "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    value = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("(D)")).otherwise(S.thousands("o_totalprice", 2))
    return j.select("o_orderkey", F.col("n_regionkey").cast("string").alias("state_code"),
                    F.format_string("%.1f", F.col("c_nationkey").cast("double")).alias("county_code"),
                    F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("item"),
                    value.alias("value_text"))


def monthly_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National monthly series: mean extended price by ship month."""
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_shipdate")
    return li.groupBy(F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo")).agg(
        F.avg("l_extendedprice").alias("price"))


def static_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static per-entity dimension: mean supplier balance by nation as a
    distance-like value, and the richest supplier's name as the facility."""
    s = table(spark, sf_dir, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("entity")).agg(
        (F.avg("s_acctbal") / 100).alias("dist"),
        F.max_by("s_name", F.struct("s_acctbal", F.col("s_suppkey"))).alias("facility"))
