"""The shape views of ``sources/shapes.py`` as portable SQL (DuckDB dialect), used as CTEs by the
oracle queries. Keep both definitions in step."""

from __future__ import annotations

_CCN0 = "concat(CASE WHEN {k} % 10 = 0 THEN '0' ELSE '' END, CAST(100000 + {k} AS VARCHAR))"


def _ccn0(k: str) -> str:
    return _CCN0.format(k=k)


SHAPE_SQL: dict[str, str] = {}

SHAPE_SQL["survey_long"] = f"""
WITH g AS (
  SELECT o_custkey AS k, substr(o_orderpriority, 1, 1) AS p, count(*) AS n,
         sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS nb,
         sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS nm
  FROM orders GROUP BY o_custkey, substr(o_orderpriority, 1, 1)),
s AS (
  SELECT k, n, CASE p WHEN '1' THEN 'RECOMMEND' WHEN '2' THEN 'RATING' WHEN '3' THEN 'SYMPTOMS'
                      WHEN '4' THEN 'TRAINING' ELSE 'EMO_REL' END AS stem,
         CAST(floor(CAST(100 * nb AS DOUBLE) / n) AS INT) AS b,
         CAST(floor(CAST(100 * nm AS DOUBLE) / n) AS INT) AS m
  FROM g),
u AS (
  SELECT k, concat(stem, '_BBV') AS code, b AS v FROM s
  UNION ALL SELECT k, concat(stem, '_MBV'), m FROM s
  UNION ALL SELECT k, concat(stem, '_TBV'), 100 - b - m FROM s)
SELECT {_ccn0('k')} AS ccn, code,
       CASE WHEN k % 7 = 0 THEN 'Not Available' WHEN k % 11 = 0 THEN 'Not  Available'
            WHEN k % 13 = 0 THEN 'Not Applicable' ELSE CAST(v AS VARCHAR) END AS score
FROM u
"""

SHAPE_SQL["facility"] = f"""
SELECT {_ccn0('c_custkey')} AS ccn,
       CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'For-Profit'
            WHEN c_mktsegment = 'MACHINERY' THEN 'Non-Profit' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Government'
            WHEN c_mktsegment = 'FURNITURE' THEN 'Other' ELSE 'Combination Government & Non-Profit' END AS ownership,
       CASE WHEN c_custkey % 3 = 0 THEN 'Yes' WHEN c_custkey % 3 = 1 THEN 'No' ELSE NULL END AS care_home,
       concat(lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0'), '/', lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0'),
              '/', CAST(1990 + c_custkey % 29 AS VARCHAR)) AS cert_date
FROM customer
"""

SHAPE_SQL["provider_ids"] = f"""
WITH b AS (
  SELECT c_custkey AS k, c_name AS name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT {_ccn0('k')} AS ccn, name,
       CASE WHEN k % 53 = 0 THEN NULL WHEN k % 41 = 0 THEN 'PR' ELSE n_name END AS state,
       concat('City', CAST(k % 97 AS VARCHAR)) AS city, concat('County', CAST(k % 31 AS VARCHAR)) AS county
FROM b
UNION ALL
SELECT {_ccn0('k')}, concat('A ', name), n_name, NULL, concat('County', CAST(k % 31 AS VARCHAR))
FROM b WHERE k % 29 = 0
"""

SHAPE_SQL["provider_long"] = f"""
WITH ids AS ({SHAPE_SQL['provider_ids']}),
per AS (
  SELECT {_ccn0('o_custkey')} AS ccn, o_custkey AS k, count(*) AS n,
         sum(CAST(floor(o_totalprice) AS BIGINT)) AS t
  FROM orders GROUP BY o_custkey),
j AS (
  SELECT ids.*, per.k, per.n, per.t, starts_with(ids.name, 'A ') AS dup FROM ids JOIN per ON ids.ccn = per.ccn),
codes AS (
  SELECT *, 'Average_Daily_Census' AS code, CAST(n * 3 AS VARCHAR) AS v FROM j
  UNION ALL SELECT *, 'H_001_01_OBSERVED', CAST(t % 1000 AS VARCHAR) FROM j
  UNION ALL SELECT *, 'H_001_01_DENOMINATOR', CAST(n + 11 AS VARCHAR) FROM j
  UNION ALL SELECT *, 'H_002_01_OBSERVED', CAST((k * 37) % 100 AS VARCHAR) FROM j
  UNION ALL SELECT *, 'Pct_Pts_w_Cancer', CAST((k * 13) % 60 AS VARCHAR) FROM j)
SELECT ccn, name, concat(CAST(k % 900 + 100 AS VARCHAR), ' Main St') AS address, city, state,
       lpad(CAST(k % 99999 AS VARCHAR), 5, '0') AS zip, county, code,
       CASE WHEN k % 19 = 0 AND code = 'Average_Daily_Census' THEN 'Not Available'
            WHEN k % 23 = 0 AND code = 'H_001_01_OBSERVED' THEN '*'
            WHEN k % 17 = 0 AND code = 'Pct_Pts_w_Cancer' THEN 'Less than 11'
            ELSE v END AS score
FROM codes WHERE NOT dup OR code = 'H_001_01_DENOMINATOR'
"""

SHAPE_SQL["city_lookup"] = """
SELECT p_partkey AS ord, concat('CITY', CAST(p_partkey % 49 AS VARCHAR)) AS city, n_name AS state_id,
       25 + CAST((p_partkey * 7919) % 2400 AS DOUBLE) / 100 AS lat,
       -120 + CAST((p_partkey * 104729) % 5000 AS DOUBLE) / 100 AS lng
FROM part JOIN nation ON p_partkey % 25 = n_nationkey
"""

SHAPE_SQL["county_lookup"] = """
SELECT p_partkey AS ord, concat('County', CAST(p_partkey % 29 AS VARCHAR)) AS county, n_name AS state,
       concat('+', CAST(25 + p_partkey % 24 AS VARCHAR), '.5°') AS latitude,
       concat('–', CAST(70 + p_partkey % 50 AS VARCHAR), '.25°') AS longitude
FROM part JOIN nation ON p_partkey % 25 = n_nationkey
"""

SHAPE_SQL["geo_points"] = """
SELECT CAST(100000 + c_custkey AS VARCHAR) AS ccn,
       CASE WHEN c_custkey % 17 = 0 THEN NULL
            ELSE 25 + CAST(((c_custkey - c_custkey % 2) * 7919) % 2400 AS DOUBLE) / 100 END AS lat,
       CASE WHEN c_custkey % 17 = 0 THEN NULL
            ELSE -120 + CAST(((c_custkey - c_custkey % 2) * 104729) % 5000 AS DOUBLE) / 100 END AS lng
FROM customer
"""

SHAPE_SQL["usage_raw"] = """
SELECT CASE WHEN o_custkey % 19 = 0 THEN 'STATE' ELSE 'PROVIDER' END AS summary_category,
       CASE WHEN o_custkey % 23 = 0 THEN 'SNF' ELSE 'HOS' END AS service_category,
       CAST(100000 + o_custkey AS VARCHAR) AS provider_id,
       CASE WHEN o_custkey % 31 = 0 THEN '*' ELSE CAST(count(DISTINCT l_orderkey) AS VARCHAR) END AS distinct_bens,
       CASE WHEN o_custkey % 9 = 0 THEN ' NA ' WHEN o_custkey % 8 = 0 THEN '**'
            ELSE concat(' $', CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS VARCHAR), '.50 ') END AS total_charge,
       concat('1,', lpad(CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS INT) ELSE 0 END) % 1000 AS VARCHAR), 3, '0'))
         AS nurse_visit_ct,
       concat(CAST(o_custkey % 101 AS VARCHAR), '%') AS perc_rural, '*' AS all_missing
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
"""

SHAPE_SQL["shares"] = """
SELECT CAST(100000 + c_custkey AS VARCHAR) AS ccn,
       CAST(60 + c_custkey % 37 AS DOUBLE) AS perc_white,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_custkey % 20 AS DOUBLE) END AS perc_black,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS DOUBLE) END AS perc_asian,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS DOUBLE) END AS perc_hisp,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END AS perc_native,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(1 AS DOUBLE) END AS perc_other
FROM customer
"""

SHAPE_SQL["features_num"] = """
WITH a AS (
  SELECT c_custkey AS k, c_nationkey, c_acctbal, count(o_orderkey) AS n,
         coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS t
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey, c_acctbal)
SELECT CAST(100000 + k AS VARCHAR) AS ccn, c_nationkey AS state,
       CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(60 + n + (k * 31) % 23 AS DOUBLE) END AS y1,
       CASE WHEN k % 4 = 0 THEN NULL ELSE 5 + CAST((n * 7 + k * 13) % 50 AS DOUBLE) / 10 END AS y2,
       CAST(n AS DOUBLE) AS x1, c_acctbal AS x2,
       CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(t AS DOUBLE) / 1000 END AS x3,
       CASE WHEN k % 6 = 0 THEN NULL ELSE CAST((k * 17) % 29 AS DOUBLE) END AS x4
FROM a
"""

SHAPE_SQL["predictions"] = """
SELECT CAST(100000 + c_custkey AS VARCHAR) AS ccn, CAST(70 + c_custkey % 25 AS DOUBLE) AS would_recommend,
       CAST(60 + c_custkey % 40 AS DOUBLE) / 10 AS rating_est
FROM customer WHERE c_custkey % 4 = 0
"""


def with_shapes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named shape views as CTEs."""
    ctes = ",\n".join(f"{n} AS ({SHAPE_SQL[n]})" for n in names)
    return f"WITH {ctes}\n{body}"
