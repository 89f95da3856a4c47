"""Loan applications derived from the order tables of the test warehouse.

Orders become applications, their line items the cash flows. Money is summed
as whole cents and rates as whole percents, so every derived field is exact.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["lineitem", "orders", "customer", "nation"]

APPLICATIONS = """
l AS (
  SELECT l_orderkey, l_returnflag, CAST(l_quantity AS INT) AS q,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(round(l_tax * 100) AS INT) AS taxp, CAST(round(l_discount * 100) AS INT) AS discp
  FROM {lineitem}),
li AS (
  SELECT l_orderkey, count(*) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
         CAST(sum(cents) AS DOUBLE) / 100 AS gross,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE cents END) AS DOUBLE) / 100 AS kept,
         CAST(sum(cents * taxp) AS DOUBLE) / 10000 AS tax_amt,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN cents * discp ELSE 0 END) AS DOUBLE) / 10000 AS salv,
         CAST(sum(q) AS DOUBLE) AS sum_q, CAST(sum(taxp) AS DOUBLE) AS sum_tax
  FROM l GROUP BY l_orderkey),
b AS (
  SELECT o.o_orderkey AS app_id, o.o_orderdate AS app_ts, o.o_orderpriority AS pri, o.o_orderstatus AS st,
         5 * CAST(floor((760.0 - 25.0 * n_lines + (c.c_acctbal - 4500.0) / 11000.0 * 160.0) / 5.0) AS INT) AS score,
         floor(sum_q * 22 / n_lines) / 10 AS dti, o.o_custkey % 12 AS emp_code,
         floor(o.o_totalprice / 12) AS amt, n.n_name AS st_name, c.c_custkey % 50 AS zipc,
         n_ret, gross, kept, tax_amt, salv, CAST(floor(sum_tax / n_lines) AS INT) AS taxp
  FROM {orders} o JOIN li ON l_orderkey = o.o_orderkey
                JOIN {customer} c ON c.c_custkey = o.o_custkey
                JOIN {nation} n ON n.n_nationkey = c.c_nationkey),
app AS (
  SELECT *, CASE WHEN (score >= 650 AND pri <> '5-LOW') OR pri = '1-URGENT' THEN 1 ELSE 0 END AS accepted
  FROM b)"""

ACCEPTED_RAW = """
  SELECT app_id, amt AS loan_amnt, gross AS funded_amnt,
         CASE WHEN app_id % 4 = 0 THEN ' 60 months' ELSE ' 36 months' END AS term,
         concat(CAST(5 + taxp AS VARCHAR(4)), '.5%') AS int_rate,
         concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * (month(app_ts) - 1) + 1 AS INT), 3), '-', CAST(year(app_ts) AS VARCHAR(4))) AS issue_d,
         CASE WHEN st = 'P' THEN 'Current' WHEN n_ret >= 3 THEN 'Charged Off' ELSE 'Fully Paid' END AS loan_status,
         CASE WHEN emp_code = 11 THEN NULL WHEN emp_code = 0 THEN '< 1 year' WHEN emp_code = 1 THEN '1 year'
              WHEN emp_code = 10 THEN '10+ years' ELSE concat(CAST(emp_code AS VARCHAR(4)), ' years') END AS emp_length,
         dti, concat(lpad(CAST(zipc AS VARCHAR(4)), 3, '0'), 'xx') AS zip_code, st_name AS addr_state,
         score - 2 AS fico_range_low, score + 2 AS fico_range_high,
         CASE WHEN n_ret >= 3 THEN kept ELSE gross END AS total_rec_prncp, tax_amt AS total_rec_int,
         CASE WHEN n_ret >= 3 THEN salv ELSE 0.0 END AS recoveries
  FROM app WHERE accepted = 1"""

DECLINED_RAW = """
  SELECT app_id, amt AS amount_requested, CAST(app_ts AS DATE) AS application_date,
         CASE WHEN app_id % 3 = 0 THEN NULL ELSE score END AS risk_score,
         concat(CAST(dti AS VARCHAR(12)), '%') AS dti_ratio,
         CASE WHEN emp_code = 11 THEN NULL WHEN emp_code = 0 THEN '< 1 year' WHEN emp_code = 1 THEN '1 year'
              WHEN emp_code = 10 THEN '10+ years' ELSE concat(CAST(emp_code AS VARCHAR(4)), ' years') END AS emp_length,
         concat(lpad(CAST(zipc AS VARCHAR(4)), 3, '0'), 'xx') AS zip_code, st_name AS state
  FROM app WHERE accepted = 0"""


def _run(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return spark.sql(f"WITH {APPLICATIONS} {select}", **tables)


def accepted_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ACCEPTED_RAW)


def declined_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, DECLINED_RAW)
