"""Gridded (Z*), quality (Q*), source / sink (S*) and text-parsing queries."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import predicates as PR
from panelforge.operators import grid as Z
from panelforge.operators import quality as QL
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query
from panelforge.session import scratch_path
from panelforge.sources import files as SF
from panelforge.sources import keyed as KY
from panelforge.sources import text as TX


def R(c, n=4):
    return F.round(c, n)


# ---------------------------------------------------------------- Z: gridded data as pixel tables
def _zones(spark, sf_dir):
    """pixel -> zone: each user's zone is the type of its first event."""
    e = P.table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("zone"))


ZONES_SQL = """zones AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS zone FROM events GROUP BY user_id)"""


@query("z01_pixel_composite", ops=("Z1",), sql="""
SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, round(avg(value), 6) AS value FROM events
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2""")
def z_composite(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    c = Z.composite(e, "user_id", "ts", ["value"], grain="day", start="2024-01-03", end="2024-01-29")
    return c.select("user_id", F.date_format("period", "yyyy-MM-dd").alias("period"), R("value", 6).alias("value"))


@query("z02_z03_zonal_mean_all_periods", ops=("Z2", "Z3", "J4"), sql=Q.with_(ZONES_SQL) + """
, comp AS (SELECT user_id, date_trunc('week', ts) AS period, avg(value) AS value FROM events GROUP BY 1, 2)
SELECT zone, strftime(period, '%Y-%m-%d') AS period, round(avg(value), 6) AS value FROM comp JOIN zones USING (user_id) GROUP BY 1, 2""")
def z_zonal(spark, sf_dir):
    e = P.table(spark, sf_dir, "events")
    comp = Z.composite(e, "user_id", "ts", ["value"], grain="week")
    d = Z.zonal_mean(comp, "user_id", _zones(spark, sf_dir), "zone", ["value"])
    return d.select("zone", F.date_format("period", "yyyy-MM-dd").alias("period"), R("value", 6).alias("value"))


@query("z04_nearest_site", ops=("Z4",), sql="""
WITH pts AS (SELECT c_custkey, 40 + c_acctbal / 2000 AS lat, -90 - c_nationkey / 5 AS lon FROM customer),
st AS (SELECT s_name, 40 + s_acctbal / 2000 AS lat, -90 - s_nationkey / 5 AS lon FROM supplier),
d AS (SELECT c_custkey, s_name, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(st.lat - pts.lat) / 2), 2)
          + cos(radians(pts.lat)) * cos(radians(st.lat)) * pow(sin(radians(st.lon - pts.lon) / 2), 2))) AS km FROM pts, st)
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, round(min(km), 4) AS dist_km, arg_min(s_name, (km, s_name)) AS nearest_site
FROM d GROUP BY c_custkey""")
def z_nearest(spark, sf_dir):
    c = P.table(spark, sf_dir, "customer").select("c_custkey", (40 + F.col("c_acctbal") / 2000).alias("lat"),
                                                   (-90 - F.col("c_nationkey") / 5).alias("lon"))
    s = P.table(spark, sf_dir, "supplier").select("s_name", (40 + F.col("s_acctbal") / 2000).alias("slat"),
                                                   (-90 - F.col("s_nationkey") / 5).alias("slon"))
    d = Z.nearest(c, "c_custkey", "lat", "lon", s, "slat", "slon", "s_name")
    return d.select("c_custkey", R("dist_km").alias("dist_km"), "nearest_site")


@query("z05_band_range_check", ops=("Z5",), sql="""
SELECT 'value' AS band, CAST(0.0 AS DOUBLE) AS expected_min, CAST(50.0 AS DOUBLE) AS expected_max, min(value) AS min, max(value) AS max,
       CAST(count_if(value < 0 OR value > 50) AS BIGINT) AS n_out_of_range FROM events""")
def z_range(spark, sf_dir):
    return Z.range_check(P.table(spark, sf_dir, "events"), {"value": (0.0, 50.0), "not_a_band": (0.0, 1.0)})


@query("z06_horizon_slice", ops=("Z6",), sql=Q.with_(Q.PANEL) + """
SELECT entity, yr, mo, n FROM panel WHERE mo <= 5""")
def z_horizon(spark, sf_dir):
    return Z.horizon_slice(P.base_panel(spark, sf_dir), "mo", 5).select("entity", "yr", "mo", "n")


# ---------------------------------------------------------------- Q: data quality
@query("q01_profile", ops=("Q1", "A7", "P13"), sql=Q.with_(Q.PANEL) + """
, c AS (SELECT count(*) AS n, count(entity) AS c_entity, count(yr) AS c_yr, count(mo) AS c_mo, count(v) AS c_v,
               count(total) AS c_total, count(n) AS c_n, count(DISTINCT entity) AS ents, min(yr) AS ymin, max(yr) AS ymax FROM panel)
SELECT "column", dtype, CAST(non_null AS BIGINT) AS non_null, CAST(n AS BIGINT) AS rows, CAST(ents AS BIGINT) AS entities,
       ymin AS min_year, ymax AS max_year FROM c, (VALUES ('entity', 'int', 1), ('yr', 'int', 2), ('mo', 'int', 3), ('v', 'double', 4),
       ('total', 'double', 5), ('n', 'bigint', 6)) t("column", dtype, i),
  LATERAL (SELECT [c_entity, c_yr, c_mo, c_v, c_total, c_n][i] AS non_null)""")
def q_profile(spark, sf_dir):
    p = P.base_panel(spark, sf_dir)
    assert PR.numeric_columns(p) == p.columns
    return QL.profile(p, P.PANEL)


@query("q02_missing_report", ops=("Q2", "J3"), sql=Q.with_(Q.SPARSE, Q.PRICE) + """
, j AS (SELECT pitem.*, price FROM pitem LEFT JOIN price USING (yr, mo))
SELECT * FROM (SELECT 'item' AS "column", CAST(count_if(item IS NULL) AS BIGINT) AS missing,
                      round(100.0 * count_if(item IS NULL) / count(*), 6) AS missing_pct FROM j
               UNION ALL SELECT 'price', CAST(count_if(price IS NULL) AS BIGINT), round(100.0 * count_if(price IS NULL) / count(*), 6) FROM j)
WHERE missing > 0""")
def q_missing(spark, sf_dir):
    d = P.panel_with_item(spark, sf_dir).join(P.monthly_price(spark, sf_dir), ["yr", "mo"], "left")
    return QL.missing_report(d).withColumn("missing_pct", R("missing_pct", 6))


def _outlier_sql(k):
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        parts.append(f"""SELECT '{c}' AS "column", q1, q3, q1 - {k} * (q3 - q1) AS lower, q3 + {k} * (q3 - q1) AS upper,
  (SELECT count_if({c} < q1 - {k} * (q3 - q1) OR {c} > q3 + {k} * (q3 - q1)) FROM lineitem) AS n_out, (SELECT count(*) FROM lineitem) AS n
  FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""")
    return ("SELECT \"column\", round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 6) AS lower, round(upper, 6) AS upper, "
            "CAST(n_out AS BIGINT) AS n_outliers, round(100.0 * n_out / n, 6) AS pct FROM (" + " UNION ALL ".join(parts) + ")")


def _outliers(spark, sf_dir, k):
    d = QL.outliers(P.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], k)
    return d.select("column", R("q1").alias("q1"), R("q3").alias("q3"), R("lower", 6).alias("lower"),
                    R("upper", 6).alias("upper"), "n_outliers", R("pct", 6).alias("pct"))


@query("q03_outliers_3iqr", ops=("Q3",), sql=_outlier_sql(3.0))
def q_outliers3(spark, sf_dir):
    return _outliers(spark, sf_dir, 3.0)


@query("q04_outliers_1_5iqr", ops=("Q4", "A11"), sql=_outlier_sql(1.5))
def q_outliers15(spark, sf_dir):
    return _outliers(spark, sf_dir, 1.5)


@query("q04_outlier_rows", ops=("Q4",), sql="""
WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders, b
WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)""")
def q_outlier_rows(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return QL.outlier_rows(o, "o_totalprice", 1.5).withColumn("o_totalprice", R("o_totalprice", 2))


@query("q06_step_log_observed", ops=("Q6", "P7"), sql=Q.with_(Q.SPARSE) + """
SELECT 'drop_nonpositive' AS step, CAST(count(*) AS BIGINT) AS rows_in, CAST(count_if(coalesce(item, 0) > 0) AS BIGINT) AS rows_out,
       CAST(count(*) - count_if(coalesce(item, 0) > 0) AS BIGINT) AS removed FROM pitem""")
def q_step_log(spark, sf_dir):
    d = P.panel_with_item(spark, sf_dir).fillna({"item": 0.0})
    out, report = QL.step_log(d, lambda x: PR.drop_nonpositive(x, "item"), "drop_nonpositive")
    out.write.format("noop").mode("overwrite").save()  # one pass fills both observations
    r = report()
    return spark.createDataFrame([(r["step"], r["rows_in"], r["rows_out"], r["removed"])],
                                 "step string, rows_in bigint, rows_out bigint, removed bigint")


@query("q07_expectations", ops=("Q7", "Q10"), sql="""
SELECT rule, CAST(violations AS BIGINT) AS violations FROM (
  SELECT 'no_null_price' AS rule, count_if(NOT coalesce(l_extendedprice IS NOT NULL, false)) AS violations FROM lineitem
  UNION ALL SELECT 'finite_price', count_if(NOT coalesce(NOT isinf(l_extendedprice), false)) FROM lineitem
  UNION ALL SELECT 'discount_in_range', count_if(NOT coalesce(l_discount BETWEEN 0 AND 0.1, false)) FROM lineitem
  UNION ALL SELECT 'quantity_positive', count_if(NOT coalesce(l_quantity > 0, false)) FROM lineitem)""")
def q_expect(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    assert PR.has_column(li, "l_discount")
    rules = {"no_null_price": F.col("l_extendedprice").isNotNull(),
             "finite_price": F.abs("l_extendedprice") != float("inf"),
             "discount_in_range": F.col("l_discount").between(0, 0.1),
             "quantity_positive": F.col("l_quantity") > 0}
    QL.expect(li, rules)  # raises if any rule fails
    return QL.expectation_report(li, rules)


@query("q11_same_keys", ops=("Q11",), sql=Q.with_(Q.YEARLY) + """
, k AS (SELECT DISTINCT entity, yr FROM panel WHERE mo BETWEEN 2 AND 8)
SELECT CAST((SELECT count(*) FROM (SELECT entity, yr FROM yearly EXCEPT SELECT entity, yr FROM k)) AS BIGINT) AS only_left,
       CAST((SELECT count(*) FROM (SELECT entity, yr FROM k EXCEPT SELECT entity, yr FROM yearly)) AS BIGINT) AS only_right""")
def q_same_keys(spark, sf_dir):
    y = P.yearly_panel(spark, sf_dir)
    k = P.base_panel(spark, sf_dir).where(F.col("mo").between(2, 8)).select("entity", "yr")
    return QL.expect_same_keys(y, k, ["entity", "yr"])


# ---------------------------------------------------------------- S: sources and sinks
ORDER_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderpriority", T.StringType()),
                             T.StructField("o_totalprice", T.DoubleType())])


@query("s01_s04_s11_csv_roundtrip", ops=("S1", "S2", "S3", "S4", "S11"), sql="""
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def s_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders_csv")
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    SF.write_table(o, path, fmt="csv", partition_by=["o_orderpriority"])
    missing = scratch_path(spark, "does_not_exist")
    back = SF.read_first(spark, [missing + "/x.csv", path], requires=["o_orderkey"], fmt="csv",
                         schema="o_orderkey bigint, o_totalprice double, o_orderpriority string")
    empty = SF.read_optional(spark, missing + "/y.csv", ORDER_SCHEMA, fmt="csv")
    SF.require(back, ["o_orderkey", "o_totalprice"])
    d = back.unionByName(empty)
    return d.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), R(F.sum("o_totalprice"), 2).alias("total"))


@query("s05_json_record_payloads", ops=("S5",), sql="""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1""")
def s_json_records(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    # one payload per order (an order has a bounded number of lines)
    payload = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(
        F.struct("l_linenumber", "l_returnflag", "l_quantity")).alias("data"))).alias("payload"))
    rec = T.StructType([T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_returnflag", T.StringType()),
                        T.StructField("l_quantity", T.DoubleType())])
    rows = SF.records_from_text(payload, "payload", rec)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), R(F.sum("l_quantity"), 2).alias("qty"))


@query("s07_keyed_json_objects", ops=("S7", "A1"), sql="""
SELECT CAST(l_linenumber AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n, round(sum(price), 2) AS price
FROM (SELECT l_orderkey, l_linenumber, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def s_keyed_json(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    # line numbers repeat within an order in this data: one entry per key first
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("l_extendedprice"))
    obj = lines.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("l_linenumber").cast("string"), F.struct("l_extendedprice"))))).alias("obj"))
    rows = TX.explode_keyed_json(obj, "obj", T.StructType([T.StructField("l_extendedprice", T.DoubleType())]))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), R(F.sum("l_extendedprice"), 2).alias("price"))


REPORT_SQL = """rep AS (
  SELECT n_nationkey, n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank,
         (SELECT round(avg(s_acctbal), 2) FROM supplier WHERE s_nationkey = n_nationkey) AS bal FROM nation)"""


@query("s08_w15_parse_text_report", ops=("S8", "W15", "F18"), sql=Q.with_(REPORT_SQL) + """
SELECT CAST(n_regionkey AS BIGINT) AS region, n_name AS name, CAST(rank AS BIGINT) AS rank, CAST(27000 + n_nationkey AS BIGINT) AS key,
       round(bal / 10000 - 0.5, 6) AS adj_raw, round(bal, 2) AS pred FROM rep""")
def s_parse_report(spark, sf_dir):
    n = P.table(spark, sf_dir, "nation")
    s = P.table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.avg("s_acctbal"), 2).alias("bal"))
    d = n.join(s, n.n_nationkey == s.s_nationkey, "left")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    d = d.withColumn("rank", F.row_number().over(w))
    block = F.concat(F.col("n_name"), F.lit(" County (Rank "), F.col("rank").cast("string"), F.lit(", FIPS "),
                     (F.col("n_nationkey") + 27000).cast("string"), F.lit(")\n```json\n{\n  \"adj_raw\": "),
                     F.format_string("%.6f", F.col("bal") / 10000 - 0.5), F.lit(",\n  \"pred\": "),
                     F.format_string("%.2f", F.col("bal")), F.lit("\n}\n```"))
    # one report per region; a region holds a bounded number of nations
    reports = d.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
    parsed = TX.parse_report(reports, "n_regionkey", "text", ["adj_raw", "pred"])
    return parsed.select(F.col("n_regionkey").alias("region"), "name", "rank", "key", R("adj_raw", 6).alias("adj_raw"),
                         R("pred", 2).alias("pred"))


@query("s09_keyed_text_files", ops=("S9",), sql="""
SELECT CAST(doc_id AS BIGINT) AS key, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM documents""")
def s_keyed_text(spark, sf_dir):
    """All documents packed under their keys and read back."""
    path = scratch_path(spark, "docs_text")
    KY.write_keyed(P.table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return KY.read_keyed(spark, path).select("key", F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("s09_keyed_text_lookup", ops=("S9", "P11"), sql="""
SELECT CAST(doc_id AS BIGINT) AS key, md5(text) AS digest FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lang, source)""")
def s_keyed_lookup(spark, sf_dir):
    """The first document of every language and source, read by key: only their byte ranges are read."""
    docs, path = P.table(spark, sf_dir, "documents"), scratch_path(spark, "docs_text")
    KY.write_keyed(docs, "doc_id", "text", path)
    firsts = [r[0] for r in docs.groupBy("lang", "source").agg(F.min("doc_id")).select("min(doc_id)").collect()]
    return KY.read_keyed(spark, path, keys=firsts).select("key", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("z03_streaming_incremental_composite", ops=("Z3", "Z1"), sql="""
SELECT user_id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, round(avg(value), 6) AS value FROM events GROUP BY 1, 2""")
def z_stream(spark, sf_dir):
    from panelforge.streaming.incremental import composite_stream, read_composite
    schema = P.table(spark, sf_dir, "events").schema
    sink, ckpt = scratch_path(spark, "composite_sink"), scratch_path(spark, "composite_ckpt")
    q = composite_stream(spark, sf_dir, schema, "user_id", "ts", ["value"], sink, ckpt, grain="month",
                         glob="events.parquet")
    q.awaitTermination()
    d = read_composite(spark, sink, "user_id", ["value"])
    return d.select("user_id", F.date_format("period", "yyyy-MM-dd").alias("period"), R("value", 6).alias("value"))
