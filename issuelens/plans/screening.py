"""Eligibility screening: suppliers as cases, with yearly facts from their lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eligibility as e
from .inputs import FISCAL, SCALARS, YEARS, portable

Query = Callable[[SparkSession, str], DataFrame]
FIELDS = {"nta": "net_tangible_assets", "mon": "monetary_assets", "op": "operating_profit", "nw": "net_worth"}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = portable(spark, sf_dir, YEARS)
    money = {FIELDS[x]: (F.col(x).cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(20,6)") for x in FIELDS}
    named = years.select("case_id", "period_end", "months", *[v.alias(n) for n, v in money.items()], *[F.col(f"{x}_ok").alias(f"{n}_ok") for x, n in FIELDS.items()])
    return portable(spark, sf_dir, SCALARS).join(e.yearly(named, tuple(FIELDS.values())), "case_id", "left")


def _rules(*ids: str) -> Query:
    return lambda spark, sf_dir: e.evaluate(cases(spark, sf_dir), list(ids)).select("case_id", "rule_id", "verdict", "review")


def rules_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.evaluate(cases(spark, sf_dir)).select("case_id", "rule_id", "category", "verdict", "review")


def screening_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.outcome(e.evaluate(cases(spark, sf_dir))).select("case_id", "outcome", "total", "n_pass", "n_fail", "n_not_applicable", "n_inconclusive", "n_requires_human_review", "passed_pct")


def gap_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.gap_plan(e.evaluate(cases(spark, sf_dir))).select("case_id", "rule_id", "verdict", "rank", "step")


def fiscal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, FISCAL).select("case_id", F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("period"), "months", "revenue", "open_value")


def full_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = portable(spark, sf_dir, FISCAL).withColumn("period_end", F.make_date("fy", F.lit(3), F.lit(31)))
    return e.last_full_years(years, 3).select("case_id", "fy", "back", "revenue")


def public_offer_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM orders").select("o_orderkey", e.tier(F.col("o_totalprice")).cast("int").alias("tier"))


def directors_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, SCALARS).where("directors is not null and chair_promoter is not null").select("case_id", e.directors_needed().cast("long").alias("needed"))


def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by route for the cases that take it; a rule of the catalogue without code, or code without a rule, would show as a row without cases."""
    known = spark.createDataFrame([(x,) for x in e.RULES], "rule_id string")
    routed = portable(spark, sf_dir, SCALARS).groupBy("route").agg(F.count("*").alias("n_cases"))
    rows = e.catalogue(spark).join(known, "rule_id", "full_outer").select("rule_id", F.explode("routes").alias("route"))
    return rows.join(routed, "route").select("rule_id", "route", "n_cases")


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'manual' ELSE 'ocr' END AS method, CASE WHEN event_type = 'error' THEN 'conflicting_candidates' WHEN event_type = 'view' THEN NULL ELSE 'extracted_high_confidence' END AS status, CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN event_id % 7 = 0 THEN TRUE WHEN event_id % 7 = 1 THEN NULL ELSE FALSE END AS human FROM events"
    return portable(spark, sf_dir, sql).select("event_id", e.reliable(F.col("human"), F.col("method"), F.col("status"), F.col("confidence")).alias("reliable"))


# --- the same in SQL -------------------------------------------------------------------------------------------------
def _gaps(names: str, settled: str) -> str:
    each = names.split()
    return f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n in each)} THEN 'inconclusive' WHEN {' OR '.join(f'NOT {n}_ok' for n in each)} THEN 'requires_human_review' ELSE {settled} END"


def _floor(x: str, least: int) -> str:
    return f"CASE WHEN n_years < 3 THEN 'inconclusive' WHEN {x}_breach THEN 'fail' WHEN {x}_gone THEN 'inconclusive' WHEN {x}_weak THEN 'requires_human_review' ELSE 'pass' END"


_least = lambda x, n: _gaps(x, f"CASE WHEN {x} >= {n} THEN 'pass' ELSE 'fail' END")
_declared = "debarred debarred_company wilful_defaulter fugitive_offender convertibles_outstanding"
_SQL = {
    "ICDR_REG5_INELIGIBLE_ENTITIES": f"CASE WHEN {' OR '.join(f'({d} IS TRUE AND {d}_ok)' for d in _declared.split())} THEN 'fail' ELSE {_gaps(_declared, repr('pass'))} END",
    "NTA_3CR": _floor("nta", 3),
    "MONETARY_ASSETS_50PCT": "CASE WHEN issue_type = 'offer_for_sale' THEN 'not_applicable' WHEN n_years < 3 THEN 'inconclusive' WHEN pct_breach THEN CASE WHEN excess_committed IS NULL OR NOT excess_committed_ok THEN 'inconclusive' WHEN excess_committed THEN 'pass!' ELSE 'fail' END WHEN nta_gone OR mon_gone THEN 'inconclusive' WHEN pct_weak THEN 'requires_human_review' ELSE 'pass' END",
    "AVG_OPERATING_PROFIT_15CR": "CASE WHEN n_years < 3 THEN 'inconclusive' WHEN op_breach THEN 'fail' WHEN op_gone THEN 'inconclusive' WHEN op_weak THEN 'requires_human_review' WHEN op_sum >= 45000000 THEN 'pass' ELSE 'fail' END",
    "NET_WORTH_1CR": _floor("nw", 1),
    "ICDR_REG6_1D_NAME_CHANGE": _gaps("name_changed", f"CASE WHEN NOT name_changed THEN 'not_applicable' ELSE {_least('new_name_revenue_pct', 50)} END"),
    "ICDR_REG6_2_QIB_ROUTE": f"CASE WHEN book_built IS FALSE OR refund_undertaking IS FALSE OR (qib_pct < 75 AND qib_pct_ok) THEN 'fail' ELSE {_gaps('book_built refund_undertaking qib_pct', repr('pass'))} END",
    "PROMOTER_CONTRIBUTION_20": "CASE WHEN NOT has_promoter THEN 'not_applicable' ELSE " + _gaps("promoter_pct", "CASE WHEN promoter_pct >= 20 THEN 'pass' WHEN other_contribution_pct IS NOT NULL AND NOT other_contribution_pct_ok THEN 'requires_human_review' WHEN other_contribution_pct IS NOT NULL AND promoter_pct + least(other_contribution_pct, 10) >= 20 THEN 'pass!' WHEN other_contribution_pct IS NULL AND 20 - promoter_pct <= 10 THEN 'inconclusive' ELSE 'fail' END") + " END",
    "PROMOTER_LOCK_IN": "CASE WHEN NOT has_promoter THEN 'not_applicable' ELSE " + _gaps("lock_in_months", "CASE WHEN is_capex IS NULL AND lock_in_months < 18 THEN 'fail' WHEN is_capex IS NULL AND lock_in_months >= 36 THEN 'pass' WHEN is_capex IS NULL THEN 'inconclusive' WHEN lock_in_months >= CASE WHEN is_capex THEN 36 ELSE 18 END THEN 'pass' ELSE 'fail' END") + " END",
    "PUBLIC_OFFER_MIN": _gaps("market_cap public_pct", """CASE WHEN market_cap <= 0 THEN 'requires_human_review' WHEN market_cap <= 1600 THEN CASE WHEN public_pct < 25 THEN 'fail' ELSE 'pass' END WHEN market_cap <= 4000 THEN CASE WHEN market_cap * public_pct / 100 < 400 THEN 'fail' ELSE 'pass' END WHEN market_cap <= 50000 THEN CASE WHEN public_pct < 10 THEN 'fail' ELSE 'pass' END WHEN market_cap <= 100000 THEN CASE WHEN market_cap * public_pct / 100 < 1000 OR public_pct < 8 THEN 'fail!' ELSE 'pass!' END WHEN market_cap <= 500000 THEN CASE WHEN market_cap * public_pct / 100 < 6250 OR public_pct < 2.75 THEN 'fail!' ELSE 'pass!' END WHEN market_cap * public_pct / 100 < 15000 OR public_pct < 1 THEN 'fail!' WHEN public_pct < 2.5 THEN 'requires_human_review' ELSE 'pass!' END"""),
    "MIN_POST_ISSUE_CAPITAL": _least("post_issue_capital", 10),
    "MIN_MARKET_CAP": _least("market_cap", 25),
    "EXCHANGE_MIN_ISSUE_SIZE": _least("issue_size", 10),
    "TRACK_RECORD_3Y": "CASE WHEN years_of_operation IS NULL THEN 'inconclusive' WHEN years_of_operation >= 3 THEN 'pass' ELSE 'fail' END",
    "BOARD_INDEPENDENCE": _gaps("directors independent_directors chair_executive chair_promoter", "CASE WHEN directors <= 0 THEN 'requires_human_review' WHEN independent_directors * CASE WHEN chair_executive OR chair_promoter THEN 2 ELSE 3 END >= directors THEN 'pass' ELSE 'fail' END"),
    "AUDIT_COMMITTEE": _gaps("committee committee_independent committee_chair_independent", "CASE WHEN committee < 3 OR committee_independent * 3 < committee * 2 OR NOT committee_chair_independent THEN 'fail' ELSE 'pass' END"),
    "RPT_DISCLOSURE": "CASE WHEN rpt_certified IS FALSE AND rpt_certified_ok THEN 'fail' ELSE " + _gaps("rpt_certified rpt_value", "CASE WHEN rpt_value > 0 AND latest_revenue IS NOT NULL AND (NOT latest_revenue_ok OR rpt_value * 100 > latest_revenue * 20) THEN 'pass!' ELSE 'pass' END") + " END",
    "AUDITOR_QUALIFICATION": f"CASE WHEN (qualified_audit IS TRUE AND qualified_audit_ok) OR modified_opinion IS TRUE THEN 'fail' ELSE {_gaps('qualified_audit modified_opinion', repr('pass'))} END",
    "LITIGATION_RISK": "CASE WHEN (criminal_cases IS TRUE AND criminal_cases_ok) OR (exposure > 0 AND exposure_ok AND latest_net_worth > 0 AND latest_net_worth_ok AND exposure * 100 > latest_net_worth * 20) THEN 'fail' ELSE " + _gaps("criminal_cases exposure", "CASE WHEN exposure > 0 AND exposure_ok AND latest_net_worth IS NULL THEN 'inconclusive' WHEN exposure > 0 AND exposure_ok AND NOT latest_net_worth_ok THEN 'requires_human_review' ELSE 'pass' END") + " END",
}
_CASES = f"""
    WITH y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY period_end DESC) AS back FROM ({YEARS}) z WHERE months = 12) t WHERE back <= 3),
    a AS (SELECT case_id, count(*) AS n_years, {', '.join(f"bool_or({x} IS NULL) AS {x}_gone, bool_or({x} IS NOT NULL AND NOT {x}_ok) AS {x}_weak" for x in FIELDS)},
        coalesce(bool_or(nta < 3000000 AND nta_ok), FALSE) AS nta_breach, coalesce(bool_or(nw < 1000000 AND nw_ok), FALSE) AS nw_breach, coalesce(bool_or(op <= 0 AND op_ok), FALSE) AS op_breach, sum(op) AS op_sum,
        coalesce(bool_or(nta_ok AND mon_ok AND mon IS NOT NULL AND nta IS NOT NULL AND (nta <= 0 OR mon * 100 > nta * 50)), FALSE) AS pct_breach,
        coalesce(bool_or(mon IS NOT NULL AND nta IS NOT NULL AND NOT (nta_ok AND mon_ok)), FALSE) AS pct_weak FROM y GROUP BY case_id),
    c AS (SELECT s.*, coalesce(a.n_years, 0) AS n_years, {', '.join(f'a.{x}_{k}' for x in FIELDS for k in ('gone', 'weak'))}, a.nta_breach, a.nw_breach, a.op_breach, a.op_sum, a.pct_breach, a.pct_weak FROM ({SCALARS}) s LEFT JOIN a ON s.case_id = a.case_id)
"""


def _rule_sql(rule_id: str) -> str:
    _, category, routes, _ = next(r for r in e.CATALOGUE if r[0] == rule_id)
    gate = ", ".join(f"'{r}'" for r in routes.split(","))
    return f"SELECT case_id, route, '{rule_id}' AS rule_id, '{category}' AS category, CASE WHEN route IN ({gate}) THEN {_SQL[rule_id]} ELSE 'not_applicable' END AS said FROM c"


def _long(*ids: str) -> str:
    parts = " UNION ALL ".join(_rule_sql(i) for i in ids)
    return f"{_CASES}, r AS (SELECT case_id, route, rule_id, category, replace(said, '!', '') AS verdict, said LIKE '%!' OR said = 'requires_human_review' AS review FROM ({parts}) q)"


_ALL = [r[0] for r in e.CATALOGUE]
QUERIES: dict[str, Query] = {
    "screening_outcome": screening_outcome, "rules_long": rules_long, "gap_plan": gap_plan, "fiscal_series": fiscal_series, "full_years": full_years,
    "public_offer_tier": public_offer_tier, "directors_needed": directors_needed, "rule_catalogue": rule_catalogue, "reliability": reliability,
    **{f"rule_r{k:02d}": _rules(i) for k, i in enumerate(_ALL, 1)},
}
_count = lambda v: f"count(*) FILTER (WHERE verdict = '{v}')"
ORACLE: dict[str, str] = {
    **{f"rule_r{k:02d}": f"{_long(i)} SELECT case_id, rule_id, verdict, review FROM r" for k, i in enumerate(_ALL, 1)},
    "rules_long": f"{_long(*_ALL)} SELECT case_id, rule_id, category, verdict, review FROM r",
    "screening_outcome": f"""{_long(*_ALL)} SELECT case_id, CASE WHEN max(route) NOT IN ('6(1)', '6(2)') THEN 'unsupported_scope' WHEN bool_or(category = 'mandatory' AND verdict = 'fail') THEN 'screening_failure'
        WHEN bool_or(category = 'mandatory' AND verdict = 'requires_human_review') THEN 'awaiting_human_review' WHEN bool_or(category = 'mandatory' AND verdict = 'inconclusive') THEN 'inconclusive' ELSE 'no_failure_identified' END AS outcome,
        count(*) AS total, {', '.join(f'{_count(v)} AS n_{v}' for v in ('pass', 'fail', 'not_applicable', 'inconclusive', 'requires_human_review'))},
        CASE WHEN count(*) = {_count('not_applicable')} THEN 0.0 ELSE CAST(round_even({_count('pass')} * 100.0 / (count(*) - {_count('not_applicable')}), 2) AS DOUBLE) END AS passed_pct FROM r GROUP BY case_id""",
    "gap_plan": f"{_long(*_ALL)} SELECT case_id, rule_id, verdict, CASE verdict WHEN 'fail' THEN 0 WHEN 'inconclusive' THEN 1 ELSE 2 END AS rank, CASE verdict WHEN 'fail' THEN 'remedy the breach' WHEN 'inconclusive' THEN 'provide the missing evidence' ELSE 'have a person verify the evidence' END AS step FROM r WHERE verdict IN ('fail', 'inconclusive', 'requires_human_review')",
    "fiscal_series": f"SELECT case_id, 'FY' || fy AS period, months, revenue, open_value FROM ({FISCAL}) f",
    "full_years": f"SELECT * FROM (SELECT case_id, fy, CAST(row_number() OVER (PARTITION BY case_id ORDER BY fy DESC) AS INT) AS back, revenue FROM ({FISCAL}) f WHERE months = 12) t WHERE back <= 3",
    "public_offer_tier": "SELECT o_orderkey, CAST(CASE WHEN o_totalprice <= 1600 THEN 1 WHEN o_totalprice <= 4000 THEN 2 WHEN o_totalprice <= 50000 THEN 3 WHEN o_totalprice <= 100000 THEN 4 WHEN o_totalprice <= 500000 THEN 5 ELSE 6 END AS INT) AS tier FROM orders",
    "directors_needed": f"SELECT case_id, CAST(greatest(ceil(directors / CASE WHEN chair_executive OR chair_promoter THEN 2.0 ELSE 3.0 END) - independent_directors, 0) AS BIGINT) AS needed FROM ({SCALARS}) s WHERE directors IS NOT NULL AND chair_promoter IS NOT NULL",
    "rule_catalogue": f"SELECT c.rule_id, c.route, count(*) AS n_cases FROM (VALUES {', '.join(repr((r[0], x)) for r in e.CATALOGUE for x in r[2].split(','))}) c(rule_id, route) JOIN ({SCALARS}) s ON s.route = c.route GROUP BY c.rule_id, c.route",
    "reliability": "SELECT event_id, CASE WHEN (event_id % 7 = 0) OR user_id % 4 = 0 THEN TRUE WHEN event_type = 'error' THEN FALSE ELSE event_id % 3 <> 0 END AS reliable FROM events",
}
