"""Window and gap-filling queries (W*): the reference's imputation core,
run on the monthly panel with a sparse yearly census-like item."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import aggregates as A
from panelforge.operators import windows as W
from panelforge.plans import panel as P
from panelforge.plans import sqlparts as Q
from panelforge.plans.registry import query

SPEC = P.PANEL


def R(c, n=4):
    return F.round(c, n)


def _item_panel(spark, sf_dir):
    return P.panel_with_item(spark, sf_dir).select("entity", "yr", "mo", "item")


SCAN_SQL = """scan AS (
  SELECT entity, yr, mo, item, row_number() OVER w AS pos,
         last_value(item IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
         last_value(CASE WHEN item IS NOT NULL THEN row_number END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
         first_value(item IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
         first_value(CASE WHEN item IS NOT NULL THEN row_number END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY yr, mo) AS row_number FROM pitem)
  WINDOW w AS (PARTITION BY entity ORDER BY yr, mo)),
interp AS (SELECT *, CASE WHEN item IS NOT NULL THEN item
                          WHEN pv IS NOT NULL AND nv IS NOT NULL THEN CASE WHEN np = pp THEN pv ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END
                          ELSE coalesce(pv, nv) END AS ip FROM scan)"""


@query("w01_forward_fill", ops=("W1",), sql=Q.with_(Q.SPARSE, SCAN_SQL) + """
SELECT entity, yr, mo, round(coalesce(item, pv), 4) AS item FROM scan""")
def w_ffill(spark, sf_dir):
    d = W.ffill(_item_panel(spark, sf_dir), ["item"], SPEC)
    return d.withColumn("item", R("item"))


@query("w02_backward_fill", ops=("W2",), sql=Q.with_(Q.SPARSE, SCAN_SQL) + """
SELECT entity, yr, mo, round(coalesce(item, nv), 4) AS item FROM scan""")
def w_bfill(spark, sf_dir):
    d = W.bfill(_item_panel(spark, sf_dir), ["item"], SPEC)
    return d.withColumn("item", R("item"))


@query("w03_linear_interpolation", ops=("W3", "X-U1"), sql=Q.with_(Q.SPARSE, SCAN_SQL) + """
SELECT entity, yr, mo, round(ip, 4) AS item FROM interp""")
def w_interp(spark, sf_dir):
    d = W.interpolate(_item_panel(spark, sf_dir), ["item"], SPEC)
    return d.withColumn("item", R("item"))


@query("w04_w05_w06_group_median_fills", ops=("W4", "W5", "W6"), sql=Q.with_(Q.SPARSE) + """
SELECT entity, yr, mo,
  round(coalesce(item, median(item) OVER (PARTITION BY entity)), 4) AS by_entity,
  round(coalesce(item, median(item) OVER (PARTITION BY yr)), 4) AS by_year,
  round(coalesce(item, median(item) OVER ()), 4) AS overall FROM pitem""")
def w_group_medians(spark, sf_dir):
    d = _item_panel(spark, sf_dir)
    e = W.fill_group_median(d, ["item"], "entity").withColumnRenamed("item", "by_entity")
    y = W.fill_group_median(d, ["item"], "yr").withColumnRenamed("item", "by_year")
    o = W.fill_median(d, ["item"]).withColumnRenamed("item", "overall")
    k = ["entity", "yr", "mo"]
    out = e.join(y, k).join(o, k)
    return out.select(*k, *[R(c).alias(c) for c in ("by_entity", "by_year", "overall")])


CASCADE_SQL = SCAN_SQL + """,
s1 AS (SELECT *, ip AS s1 FROM interp),
s2 AS (SELECT *, coalesce(s1, pv) AS s2 FROM s1),
s3 AS (SELECT *, coalesce(s2, nv) AS s3 FROM s2),
s4 AS (SELECT *, coalesce(s3, median(s3) OVER (PARTITION BY entity)) AS s4 FROM s3),
s5 AS (SELECT *, coalesce(s4, median(s4) OVER (PARTITION BY yr)) AS s5 FROM s4),
s6 AS (SELECT *, coalesce(s5, median(s5) OVER ()) AS s6 FROM s5)"""


@query("w07_impute_cascade_values", ops=("W7",), sql=Q.with_(Q.SPARSE, CASCADE_SQL) + """
SELECT entity, yr, mo, round(s6, 4) AS item FROM s6""")
def w_cascade_values(spark, sf_dir):
    d = W.impute_cascade(_item_panel(spark, sf_dir), ["item"], SPEC, with_log=False)
    return d.withColumn("item", R("item"))


@query("w07_impute_cascade_log", ops=("W7", "Q6"), sql=Q.with_(Q.SPARSE, CASCADE_SQL) + """
, c AS (SELECT count_if(item IS NULL) AS c0, count_if(s1 IS NULL) AS c1, count_if(s2 IS NULL) AS c2, count_if(s3 IS NULL) AS c3,
               count_if(s4 IS NULL) AS c4, count_if(s5 IS NULL) AS c5, count_if(s6 IS NULL) AS c6 FROM s6)
SELECT 'item' AS "column", CAST(step AS BIGINT) AS step, stage, CAST(missing AS BIGINT) AS missing, CAST(filled AS BIGINT) AS filled FROM (
  SELECT 0 AS step, 'initial' AS stage, c0 AS missing, 0 AS filled FROM c
  UNION ALL SELECT 1, 'interpolate', c1, c0 - c1 FROM c UNION ALL SELECT 2, 'ffill', c2, c1 - c2 FROM c
  UNION ALL SELECT 3, 'bfill', c3, c2 - c3 FROM c UNION ALL SELECT 4, 'entity_median', c4, c3 - c4 FROM c
  UNION ALL SELECT 5, 'year_median', c5, c4 - c5 FROM c UNION ALL SELECT 6, 'median', c6, c5 - c6 FROM c)""")
def w_cascade_log(spark, sf_dir):
    _, log = W.impute_cascade(_item_panel(spark, sf_dir), ["item"], SPEC)
    return log


REF_CASCADE_SQL = SCAN_SQL + """,
r1 AS (SELECT *, coalesce(item, pv) AS s1 FROM interp),
r2 AS (SELECT *, coalesce(s1, nv) AS s2 FROM r1),
r3 AS (SELECT *, coalesce(s2, pv, nv) AS s3 FROM r2),
r4 AS (SELECT *, coalesce(s3, median(s3) OVER (PARTITION BY entity)) AS s4 FROM r3),
r5 AS (SELECT *, coalesce(s4, median(s4) OVER (PARTITION BY yr)) AS s5 FROM r4),
r6 AS (SELECT *, coalesce(s5, median(s5) OVER ()) AS s6 FROM r5)"""


@query("w07_impute_cascade_reference_order", ops=("W7",), sql=Q.with_(Q.SPARSE, REF_CASCADE_SQL) + """
, c AS (SELECT count_if(item IS NULL) AS c0, count_if(s1 IS NULL) AS c1, count_if(s2 IS NULL) AS c2, count_if(s3 IS NULL) AS c3,
               count_if(s4 IS NULL) AS c4, count_if(s5 IS NULL) AS c5, count_if(s6 IS NULL) AS c6,
               round(sum(s6), 4) AS total FROM r6)
SELECT CAST(c0 AS BIGINT) AS initial, CAST(c1 AS BIGINT) AS after_ffill, CAST(c2 AS BIGINT) AS after_bfill,
       CAST(c3 AS BIGINT) AS after_interpolate, CAST(c4 AS BIGINT) AS after_entity_median,
       CAST(c5 AS BIGINT) AS after_year_median, CAST(c6 AS BIGINT) AS final, total FROM c""")
def w_cascade_reference(spark, sf_dir):
    filled, log = W.impute_cascade(_item_panel(spark, sf_dir), ["item"], SPEC, stages="reference")
    names = ["initial", "after_ffill", "after_bfill", "after_interpolate", "after_entity_median", "after_year_median", "final"]
    wide = log.groupBy().agg(*[F.max(F.when(F.col("step") == i, F.col("missing"))).alias(n) for i, n in enumerate(names)])
    tot = filled.agg(R(F.sum("item")).alias("total"))
    return W._attach_row(wide, tot)


@query("w08_global_row_order_fill", ops=("W8",), sql=Q.with_(Q.SPARSE) + """
, f AS (SELECT *, last_value(item IGNORE NULLS) OVER (ORDER BY entity, yr, mo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff FROM pitem)
SELECT entity, yr, mo, round(coalesce(ff, first_value(item IGNORE NULLS) OVER (ORDER BY entity, yr, mo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS item
FROM f""")
def w_global_fill(spark, sf_dir):
    d = W.ffill_global(_item_panel(spark, sf_dir), ["item"], SPEC)
    return d.withColumn("item", R("item"))


SHARE_SQL = """wide AS (SELECT entity, yr, mo, item, CASE WHEN yr % 2 = 1 THEN v END AS odd_year_v,
                            CASE WHEN mo <> 1 THEN n END AS no_january_n FROM pitem)"""


def _share_panel(spark, sf_dir):
    d = P.panel_with_item(spark, sf_dir)
    return d.select("entity", "yr", "mo", "item", F.when(F.col("yr") % 2 == 1, F.col("v")).alias("odd_year_v"),
                    F.when(F.col("mo") != 1, F.col("n")).alias("no_january_n"))


@query("w09_impute_by_missing_share", ops=("W9", "P15", "W6"), sql=Q.with_(Q.SPARSE, SHARE_SQL) + """
SELECT entity, yr, mo, round(coalesce(odd_year_v, median(odd_year_v) OVER ()), 4) AS odd_year_v,
  CAST(coalesce(no_january_n,
    last_value(no_january_n IGNORE NULLS) OVER (PARTITION BY entity ORDER BY yr, mo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(no_january_n IGNORE NULLS) OVER (PARTITION BY entity ORDER BY yr, mo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS BIGINT) AS no_january_n
FROM wide""")
def w_by_share(spark, sf_dir):
    d = W.impute_by_share(_share_panel(spark, sf_dir), ["item", "odd_year_v", "no_january_n"], SPEC)
    return d.select("entity", "yr", "mo", R("odd_year_v").alias("odd_year_v"), "no_january_n")


@query("w10_pct_change_mean_by_year", ops=("W10",), sql=Q.with_(Q.YEARLY) + """
, c AS (SELECT yr, (total - lag(total) OVER w) / lag(total) OVER w AS pct FROM yearly WINDOW w AS (PARTITION BY entity ORDER BY yr))
SELECT yr, round(avg(pct), 6) AS mean_pct_change, CAST(count(pct) AS BIGINT) AS n FROM c GROUP BY yr""")
def w_pct_change(spark, sf_dir):
    y = W.pct_change(P.yearly_panel(spark, sf_dir), "total", P.YEARLY, out="pct")
    return y.groupBy("yr").agg(R(F.avg("pct"), 6).alias("mean_pct_change"), F.count("pct").alias("n"))


@query("w12_recent_mean", ops=("W12",), sql=Q.with_(Q.YEARLY) + """
SELECT entity, round(avg(total), 4) AS recent_mean, CAST(count(*) AS BIGINT) AS n_recent
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY yr DESC) AS rn FROM yearly) WHERE rn <= 3 GROUP BY entity""")
def w_recent_mean(spark, sf_dir):
    d = W.recent_mean(P.yearly_panel(spark, sf_dir), "entity", "yr", "total", 3)
    return d.withColumn("recent_mean", R("recent_mean"))


@query("w13_recent_history", ops=("W13",), sql=Q.with_(Q.YEARLY) + """
SELECT entity, CAST(row_number() OVER (PARTITION BY entity ORDER BY yr) - 1 AS BIGINT) AS pos, round(total, 4) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY yr DESC) AS rn FROM yearly) WHERE rn <= 5""")
def w_recent_history(spark, sf_dir):
    d = W.recent_history(P.yearly_panel(spark, sf_dir), "entity", "yr", "total", 5)
    return d.select("entity", F.posexplode("history").alias("pos", "value")).withColumn("value", R("value"))


@query("w14_h18_rank_top_entities", ops=("W14", "H18", "A24", "O3"), sql=Q.with_(Q.PANEL) + """
SELECT entity, round(total, 2) AS total, CAST(row_number() OVER (ORDER BY total DESC, entity) AS BIGINT) AS rank
FROM (SELECT entity, sum(total) AS total FROM panel GROUP BY 1) ORDER BY total DESC, entity LIMIT 10""")
def w_rank(spark, sf_dir):
    t = A.entity_totals(P.base_panel(spark, sf_dir), SPEC, "total").select("entity", R("total", 2).alias("total"))
    return W.rank_entities(t, "total", "entity", k=10)


LINES_SQL = """lines AS (
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no,
         unnest(string_split(text, chr(10))) AS line FROM documents)"""


@query("w15_carry_header_lines", ops=("W15",), sql=Q.with_(LINES_SQL) + """
, h AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^[A-Z][^.]*$') THEN line_no END IGNORE NULLS)
                  OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM lines)
SELECT doc_id, CAST(header AS BIGINT) AS header, CAST(count(*) AS BIGINT) AS n_lines FROM h GROUP BY 1, 2""")
def w_carry_header(spark, sf_dir):
    docs = P.table(spark, sf_dir, "documents")
    ln = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no") + 1)
    ln = ln.withColumn("__h", F.when(F.col("line").rlike("^[A-Z][^.]*$"), F.col("line_no")))
    d = W.carry_header(ln, "doc_id", "line_no", "__h")
    return d.groupBy("doc_id", "header").agg(F.count(F.lit(1)).alias("n_lines"))


@query("w16_cumulative_share_threshold", ops=("W16",), sql="""
WITH v AS (SELECT 'l_quantity' AS c, var_samp(l_quantity / 50) AS var FROM lineitem
           UNION ALL SELECT 'l_extendedprice', var_samp(l_extendedprice / 100000) FROM lineitem
           UNION ALL SELECT 'l_discount', var_samp(l_discount * 10) FROM lineitem
           UNION ALL SELECT 'l_tax', var_samp(l_tax * 10) FROM lineitem),
r AS (SELECT c, var / sum(var) OVER () AS ratio, row_number() OVER (ORDER BY var DESC, c) AS idx FROM v),
cum AS (SELECT idx, sum(ratio) OVER (ORDER BY idx) AS cumulative FROM r)
SELECT CAST(min(idx) FILTER (WHERE cumulative >= 0.9) AS BIGINT) AS n_for_90,
       CAST(min(idx) FILTER (WHERE cumulative >= 0.95) AS BIGINT) AS n_for_95 FROM cum""")
def w_components_for(spark, sf_dir):
    li = P.table(spark, sf_dir, "lineitem")
    scaled = li.select((F.col("l_quantity") / 50).alias("l_quantity"), (F.col("l_extendedprice") / 100000).alias("l_extendedprice"),
                       (F.col("l_discount") * 10).alias("l_discount"), (F.col("l_tax") * 10).alias("l_tax"))
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    var = scaled.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    tot = sum(var[c] for c in cols)
    ranked = sorted(((var[c] / tot, c) for c in cols), key=lambda t: (-t[0], t[1]))
    small = spark.createDataFrame([(i + 1, r) for i, (r, _) in enumerate(ranked)], "idx int, ratio double")
    return W.components_for(small, "idx", "ratio")


def _poly_sql(coefficients, x):
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


_TAIL = f"({_poly_sql(W._C, 'q')} / ({_poly_sql(W._D, 'q')} * q + 1))"
_MIDDLE = f"({_poly_sql(W._A, 'r')} * q / ({_poly_sql(W._B, 'r')} * r + 1))"


@query("w17_normal_qq_table", ops=("W17",), sql=f"""
WITH s AS (SELECT o_totalprice AS sample, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders),
u AS (SELECT i, sample, CASE WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n)
                             ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM s),
q AS (SELECT *, CAST(CASE WHEN p < 0.02425::DOUBLE THEN sqrt(-2 * ln(p)) WHEN p > 0.97575::DOUBLE THEN sqrt(-2 * ln(1 - p))
                          ELSE p - 0.5::DOUBLE END AS DOUBLE) AS q FROM u),
r AS (SELECT *, q * q AS r FROM q)
SELECT CAST(i AS BIGINT) AS i, sample,
       round(CASE WHEN p < 0.02425::DOUBLE THEN {_TAIL} WHEN p > 0.97575::DOUBLE THEN -{_TAIL} ELSE {_MIDDLE} END, 6) AS theoretical
FROM r""")
def w_qq(spark, sf_dir):
    d = W.qq_table(P.table(spark, sf_dir, "orders"), "o_totalprice")
    return d.select("i", "sample", R("theoretical", 6).alias("theoretical"))


@query("w04_w05_group_median_fills_sort_based", ops=("W4", "W5"), sql=Q.with_(Q.SPARSE) + """
SELECT entity, yr, mo,
  round(coalesce(item, median(item) OVER (PARTITION BY entity)), 4) AS by_entity,
  round(coalesce(item, median(item) OVER (PARTITION BY yr)), 4) AS by_year FROM pitem""")
def w_group_medians_sorted(spark, sf_dir):
    d = _item_panel(spark, sf_dir)
    e = W.fill_group_median(d, ["item"], "entity", method="percentile").withColumnRenamed("item", "by_entity")
    y = W.fill_group_median(d, ["item"], "yr", method="percentile").withColumnRenamed("item", "by_year")
    k = ["entity", "yr", "mo"]
    return e.join(y, k).select(*k, R("by_entity").alias("by_entity"), R("by_year").alias("by_year"))
