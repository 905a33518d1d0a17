"""Canonical tables derived from the given ones, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def portable(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query over the Parquet tables of a folder; no view is registered."""
    used = {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)}
    return spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", sql), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


#: Lines of orders with the fiscal year (April to March) and money in hundredths.
FY_LINES = """
    SELECT c.c_nationkey AS case_id, year(o.o_orderdate) + CASE WHEN month(o.o_orderdate) >= 4 THEN 1 ELSE 0 END AS fy, o.o_orderstatus AS status,
           l.l_returnflag AS flag, l.l_linenumber AS line_no, CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
"""
#: A row for each nation and fiscal year; the first and the last year are stubs.
FISCAL = f"""
    SELECT CAST(case_id AS BIGINT) AS case_id, CAST(fy AS INT) AS fy, CASE WHEN fy = 1995 THEN 3 WHEN fy = 2002 THEN 5 ELSE 12 END AS months, CAST(SUM(cents) AS BIGINT) AS revenue,
           CAST(SUM(CASE WHEN status = 'O' THEN cents ELSE 0 END) AS BIGINT) AS open_value, CAST(SUM(CASE WHEN flag = 'R' THEN cents ELSE 0 END) AS BIGINT) AS returned,
           CAST(SUM(CASE WHEN flag = 'A' THEN cents ELSE 0 END) AS BIGINT) AS accepted, CAST(SUM(CASE WHEN flag = 'N' THEN cents ELSE 0 END) AS BIGINT) AS pending,
           CAST(SUM(CASE WHEN line_no = 7 THEN cents ELSE 0 END) AS BIGINT) AS seventh, COUNT(*) AS n
    FROM ({FY_LINES}) x GROUP BY case_id, fy
"""
#: Yearly facts of suppliers as cases, in millionths of a crore, some missing and some unreliable.
YEARS = """
    SELECT CAST(case_id AS BIGINT) AS case_id, CAST(fy AS INT) AS fy, make_date(CAST(fy AS INT), 3, 31) AS period_end, CASE WHEN fy BETWEEN 1996 AND 2001 THEN 12 ELSE 4 END AS months,
           CASE WHEN (case_id * 5 + fy) % 23 = 0 THEN NULL ELSE CAST(floor(cents * 10 / 1E3) AS BIGINT) END AS nta, (case_id * 3 + fy) % 19 <> 0 AS nta_ok,
           CASE WHEN (case_id * 7 + fy) % 29 = 0 THEN NULL ELSE CAST(floor(cents * (case_id % 4 + 3) / 1E3) AS BIGINT) END AS mon, (case_id + fy) % 31 <> 0 AS mon_ok,
           CASE WHEN (case_id * 2 + fy) % 37 = 0 THEN NULL WHEN (case_id + fy) % 17 = 0 THEN -CAST(floor(cents / 1E3) AS BIGINT) ELSE CAST(floor(cents * 45 / 1E3) AS BIGINT) END AS op, (case_id * 4 + fy) % 41 <> 0 AS op_ok,
           CASE WHEN (case_id * 9 + fy) % 27 = 0 THEN NULL ELSE CAST(floor(cents * 3 / 1E3) AS BIGINT) END AS nw, (case_id * 6 + fy) % 43 <> 0 AS nw_ok
    FROM (SELECT l.l_suppkey AS case_id, year(l.l_shipdate) + CASE WHEN month(l.l_shipdate) >= 4 THEN 1 ELSE 0 END AS fy, CAST(SUM(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
          FROM lineitem l GROUP BY l.l_suppkey, year(l.l_shipdate) + CASE WHEN month(l.l_shipdate) >= 4 THEN 1 ELSE 0 END) x
"""


def _fact(name: str, value: str, missing: str = "FALSE", doubt: str = "FALSE") -> str:
    return f"CASE WHEN {missing} THEN NULL ELSE {value} END AS {name}, NOT ({doubt}) AS {name}_ok"


#: Scalar facts of suppliers as cases, by arithmetic on the key, so that every verdict occurs.
SCALARS = (
    "SELECT k AS case_id, CASE WHEN k % 10 = 0 THEN 'sme' WHEN k % 10 < 4 THEN '6(2)' ELSE '6(1)' END AS route, CASE WHEN k % 8 = 0 THEN 'offer_for_sale' WHEN k % 8 = 1 THEN NULL ELSE 'mixed' END AS issue_type, k % 21 <> 0 AS has_promoter, "
    + ", ".join(
        _fact(*f)
        for f in [
            ("debarred", "k % 29 = 0", "k % 31 = 0", "k % 11 = 0"),
            ("debarred_company", "k % 37 = 0"),
            ("wilful_defaulter", "k % 41 = 0", "FALSE", "k % 13 = 0"),
            ("fugitive_offender", "k < 0"),
            ("convertibles_outstanding", "k < 0", "k % 43 = 0"),
            ("excess_committed", "k % 3 = 0", "k % 3 = 2", "k % 7 = 0"),
            ("name_changed", "k % 5 = 0", "k % 17 = 0", "k % 19 = 0"),
            ("new_name_revenue_pct", "k % 100", "k % 15 = 0", "k % 25 = 0"),
            ("book_built", "k % 4 <> 0", "k % 9 = 0"),
            ("refund_undertaking", "k % 6 <> 0", "k % 14 = 0"),
            ("qib_pct", "60 + k % 30", "k % 16 = 0", "k % 12 = 0"),
            ("promoter_pct", "5 + k % 30", "k % 18 = 0", "k % 22 = 0"),
            ("other_contribution_pct", "k % 15", "k % 4 = 1", "k % 5 = 2"),
            ("lock_in_months", "12 + (k % 5) * 6", "k % 20 = 0", "k % 23 = 0"),
            ("is_capex", "k % 3 = 0", "k % 3 = 2"),
            ("market_cap", "CASE k % 8 WHEN 0 THEN 1600 WHEN 1 THEN 3000 WHEN 2 THEN 20000 WHEN 3 THEN 80000 WHEN 4 THEN 300000 WHEN 5 THEN 900000 WHEN 6 THEN 20 ELSE 0 END", "k % 24 = 0", "k % 26 = 0"),
            ("public_pct", "CAST((k % 60) * 0.5 AS DOUBLE)", "k % 44 = 0", "k % 45 = 0"),
            ("post_issue_capital", "5 + k % 12", "k % 27 = 0", "k % 28 = 0"),
            ("issue_size", "4 + k % 15", "k % 46 = 0", "k % 47 = 0"),
            ("years_of_operation", "k % 8", "k % 30 = 0"),
            ("directors", "CASE WHEN k % 33 = 0 THEN 0 ELSE 3 + k % 9 END", "k % 48 = 0", "k % 49 = 0"),
            ("independent_directors", "k % 6"),
            ("chair_executive", "k % 2 = 0"),
            ("chair_promoter", "k % 3 = 0", "k % 50 = 0"),
            ("committee", "2 + k % 4", "k % 51 = 0", "k % 52 = 0"),
            ("committee_independent", "1 + k % 3"),
            ("committee_chair_independent", "k % 5 <> 0"),
            ("rpt_certified", "k % 6 <> 1", "k % 32 = 0", "k % 34 = 0"),
            ("rpt_value", "k % 50", "k % 35 = 0"),
            ("latest_revenue", "100 + k % 90", "k % 36 = 0", "k % 38 = 0"),
            ("qualified_audit", "k % 9 = 4", "k % 40 = 0", "k % 39 = 0"),
            ("modified_opinion", "k % 10 = 7"),
            ("criminal_cases", "k % 11 = 5", "k % 53 = 0", "k % 54 = 0"),
            ("exposure", "k % 70", "k % 55 = 0", "k % 56 = 0"),
            ("latest_net_worth", "60 + k % 200", "k % 57 = 0", "k % 58 = 0"),
        ]
    )
    + " FROM (SELECT s_suppkey AS k FROM supplier) x"
)
