"""Shared SQL fragments for the DuckDB oracle (tables are pre-registered views)."""

PANEL = """panel AS (
  SELECT CAST(c_nationkey AS BIGINT) AS entity, CAST(year(o_orderdate) AS BIGINT) AS yr,
         CAST(month(o_orderdate) AS BIGINT) AS mo,
         avg(o_totalprice) AS v, sum(o_totalprice) AS total, CAST(count(*) AS BIGINT) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""

YEARLY = PANEL + """,
yearly AS (SELECT entity, yr, avg(v) AS v, avg(total) AS total, CAST(sum(n) AS BIGINT) AS n
           FROM panel GROUP BY 1, 2)"""

SPARSE = YEARLY + """,
sparse AS (SELECT entity, yr, CASE WHEN (yr + entity) % 3 = 0 AND entity < 20 THEN v END AS item
           FROM yearly),
pitem AS (SELECT p.*, s.item FROM panel p LEFT JOIN sparse s USING (entity, yr))"""

PRICE = """price AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS yr, CAST(month(l_shipdate) AS BIGINT) AS mo,
                  avg(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"""

DIM = """dim AS (SELECT CAST(s_nationkey AS BIGINT) AS entity, avg(s_acctbal) / 100 AS dist,
                arg_max(s_name, (s_acctbal, s_suppkey)) AS facility
         FROM supplier GROUP BY 1)"""

SURVEY = """survey AS (
  SELECT o_orderkey, CAST(n_regionkey AS VARCHAR) AS state_code,
         printf('%.1f', CAST(c_nationkey AS DOUBLE)) AS county_code,
         CAST(year(o_orderdate) AS BIGINT) AS yr, o_orderpriority AS item,
         CASE WHEN o_orderpriority = '5-LOW' THEN '(D)' ELSE format('{:,.2f}', o_totalprice) END AS value_text
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
