"""Eligibility rules as column expressions over one row a case.

A fact x of a case is two columns: x (null: missing) and x_ok (false: there, but unreliable; null counts as true). Yearly
facts come as arrays of the last full years, struct(value, ok), newest last. Missing gives inconclusive, unreliable gives
requires_human_review, and only reliable evidence fails a case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS, FAIL, NA, OPEN, REVIEW = "pass", "fail", "not_applicable", "inconclusive", "requires_human_review"

# Rule, mandatory or advisory, routes, parameters.
CATALOGUE = [
    ("ICDR_REG5_INELIGIBLE_ENTITIES", "mandatory", "6(1),6(2)", {}),
    ("NTA_3CR", "mandatory", "6(1)", {"min": 3, "years": 3}),
    ("MONETARY_ASSETS_50PCT", "mandatory", "6(1)", {"max_pct": 50, "years": 3}),
    ("AVG_OPERATING_PROFIT_15CR", "mandatory", "6(1)", {"min": 15, "years": 3}),
    ("NET_WORTH_1CR", "mandatory", "6(1)", {"min": 1, "years": 3}),
    ("ICDR_REG6_1D_NAME_CHANGE", "mandatory", "6(1)", {"min_pct": 50}),
    ("ICDR_REG6_2_QIB_ROUTE", "mandatory", "6(2)", {"min_pct": 75}),
    ("PROMOTER_CONTRIBUTION_20", "mandatory", "6(1),6(2)", {"min_pct": 20, "cap_pct": 10}),
    ("PROMOTER_LOCK_IN", "mandatory", "6(1),6(2)", {"standard": 18, "capex": 36}),
    ("PUBLIC_OFFER_MIN", "mandatory", "6(1),6(2)", {}),
    ("MIN_POST_ISSUE_CAPITAL", "mandatory", "6(1),6(2)", {"min": 10}),
    ("MIN_MARKET_CAP", "mandatory", "6(1),6(2)", {"min": 25}),
    ("EXCHANGE_MIN_ISSUE_SIZE", "mandatory", "6(1),6(2)", {"min": 10}),
    ("TRACK_RECORD_3Y", "advisory", "6(1),6(2)", {"min": 3}),
    ("BOARD_INDEPENDENCE", "advisory", "6(1),6(2)", {}),
    ("AUDIT_COMMITTEE", "advisory", "6(1),6(2)", {"min": 3}),
    ("RPT_DISCLOSURE", "advisory", "6(1),6(2)", {"max_pct": 20}),
    ("AUDITOR_QUALIFICATION", "advisory", "6(1),6(2)", {}),
    ("LITIGATION_RISK", "advisory", "6(1),6(2)", {"max_pct": 20}),
]
# Tier, largest post-issue capital (crore, inclusive), least offer value, least offer percentage.
TIERS = [(1, 1600, None, 25), (2, 4000, 400, None), (3, 50000, None, 10), (4, 100000, 1000, 8), (5, 500000, 6250, 2.75), (6, None, 15000, 1)]
TIER6_FLOOR = 2.5
DECLARATIONS = ("debarred", "debarred_company", "wilful_defaulter", "fugitive_offender", "convertibles_outstanding")

c = F.col


def ok(name: str) -> Column:
    return F.coalesce(c(f"{name}_ok"), F.lit(True))


def missing(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | c(n).isNull()
    return out


def unreliable(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (c(n).isNotNull() & ~ok(n))
    return out


def reliable(human: Column, method: Column, status: Column, confidence: Column) -> Column:
    """A fact that a person confirmed or entered stands; a conflicting one or one to be verified doesn't; else by confidence."""
    person = F.coalesce(human, F.lit(False)) | F.coalesce(method.isin("manual", "human_corrected"), F.lit(False))
    doubt = F.coalesce(status.isin("conflicting_candidates", "extracted_needs_verification"), F.lit(False))
    return F.when(person, True).when(doubt, False).otherwise(F.coalesce(confidence != "low", F.lit(True)))


def verdict(v: Column | str, review: Column | bool = False) -> Column:
    v = F.lit(v) if isinstance(v, str) else v
    review = F.lit(review) if isinstance(review, bool) else review
    return F.struct(v.alias("verdict"), (review | (v == REVIEW)).alias("review"))


def undetermined(gap: Column, otherwise: Column) -> Column:
    """gap: missing wins over unreliable."""
    return F.when(gap, verdict(OPEN)).otherwise(otherwise)


def gaps(names: tuple[str, ...], settled: Column) -> Column:
    return F.when(missing(*names), verdict(OPEN)).when(unreliable(*names), verdict(REVIEW)).otherwise(settled)


def last_full_years(facts: DataFrame, years: int, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """The last so many periods of 12 months of each case; stubs are passed over."""
    newest = Window.partitionBy(*keys).orderBy(F.col("period_end").desc())
    return facts.where("months = 12").withColumn("back", F.row_number().over(newest)).where(F.col("back") <= years)


def yearly(facts: DataFrame, fields: tuple[str, ...], years: int = 3) -> DataFrame:
    """One row a case: of each field, an array of struct(period_end, value, ok) of the last full years, oldest first."""
    last = last_full_years(facts, years)
    return last.groupBy("case_id").agg(*[F.array_sort(F.collect_list(F.struct("period_end", F.col(f).alias("value"), F.coalesce(F.col(f"{f}_ok"), F.lit(True)).alias("ok")))).alias(f) for f in fields])


def _years(field: str, years: int) -> tuple[Column, Column, Column]:
    """Too few years; any missing; any unreliable."""
    a = c(field)
    return F.coalesce(F.size(a), F.lit(0)) < years, F.exists(a, lambda y: y["value"].isNull()), F.exists(a, lambda y: y["value"].isNotNull() & ~y["ok"])


def _floor_each_year(field: str, least: float, years: int) -> Column:
    few, gone, weak = _years(field, years)
    breach = F.exists(c(field), lambda y: (y["value"] < least) & y["ok"])
    return F.when(few, verdict(OPEN)).when(breach, verdict(FAIL)).when(gone, verdict(OPEN)).when(weak, verdict(REVIEW)).otherwise(verdict(PASS))


def r01(p: dict) -> Column:
    hit = F.lit(False)
    for d in DECLARATIONS:
        hit = hit | F.coalesce(c(d) & ok(d), F.lit(False))
    return F.when(hit, verdict(FAIL)).otherwise(gaps(DECLARATIONS, verdict(PASS)))


def r02(p: dict) -> Column:
    return _floor_each_year("net_tangible_assets", p["min"], p["years"])


def r03(p: dict) -> Column:
    few, gone, _ = _years("net_tangible_assets", p["years"])
    _, gone2, _ = _years("monetary_assets", p["years"])
    both = F.arrays_zip(c("monetary_assets").alias("m"), c("net_tangible_assets").alias("n"))
    there = F.filter(both, lambda z: z["m"]["value"].isNotNull() & z["n"]["value"].isNotNull())
    sure = lambda z: z["m"]["ok"] & z["n"]["ok"]
    breach = F.exists(there, lambda z: sure(z) & ((z["n"]["value"] <= 0) | (z["m"]["value"] * 100 > z["n"]["value"] * p["max_pct"])))
    committed = F.when(ok("excess_committed"), c("excess_committed"))
    after = F.when(committed, verdict(PASS, True)).when(committed.isNull(), verdict(OPEN)).otherwise(verdict(FAIL))
    weak = ~F.forall(there, sure)
    return (
        F.when(F.coalesce(c("issue_type") == "offer_for_sale", F.lit(False)), verdict(NA))
        .when(few, verdict(OPEN))
        .when(breach, after)
        .when(gone | gone2, verdict(OPEN))
        .when(weak, verdict(REVIEW))
        .otherwise(verdict(PASS))
    )


def r04(p: dict) -> Column:
    few, gone, weak = _years("operating_profit", p["years"])
    loss = F.exists(c("operating_profit"), lambda y: (y["value"] <= 0) & y["ok"])
    total = F.aggregate(c("operating_profit"), F.lit(0).cast("decimal(30,6)"), lambda acc, y: (acc + y["value"]).cast("decimal(30,6)"))
    enough = total >= F.size("operating_profit") * F.lit(p["min"])
    return F.when(few, verdict(OPEN)).when(loss, verdict(FAIL)).when(gone, verdict(OPEN)).when(weak, verdict(REVIEW)).otherwise(verdict(F.when(enough, PASS).otherwise(FAIL)))


def r05(p: dict) -> Column:
    return _floor_each_year("net_worth", p["min"], p["years"])


def r06(p: dict) -> Column:
    changed, pct = "name_changed", "new_name_revenue_pct"
    return gaps((changed,), F.when(~c(changed), verdict(NA)).otherwise(gaps((pct,), verdict(F.when(c(pct) >= p["min_pct"], PASS).otherwise(FAIL)))))


def r07(p: dict) -> Column:
    facts = ("book_built", "refund_undertaking", "qib_pct")
    broken = F.coalesce(~c(facts[0]), F.lit(False)) | F.coalesce(~c(facts[1]), F.lit(False)) | F.coalesce((c(facts[2]) < p["min_pct"]) & ok(facts[2]), F.lit(False))
    return F.when(broken, verdict(FAIL)).otherwise(gaps(facts, verdict(PASS)))


def r08(p: dict) -> Column:
    holding, others = c("promoter_pct"), c("other_contribution_pct")
    proviso = holding + F.least(others, F.lit(p["cap_pct"])) >= p["min_pct"]
    short = F.when(others.isNotNull(), F.when(~ok("other_contribution_pct"), verdict(REVIEW)).when(proviso, verdict(PASS, True)).otherwise(verdict(FAIL))).otherwise(F.when(p["min_pct"] - holding <= p["cap_pct"], verdict(OPEN)).otherwise(verdict(FAIL)))
    return F.when(~F.coalesce(c("has_promoter"), F.lit(True)), verdict(NA)).otherwise(gaps(("promoter_pct",), F.when(holding >= p["min_pct"], verdict(PASS)).otherwise(short)))


def r09(p: dict) -> Column:
    months, capex = c("lock_in_months"), c("is_capex")
    unknown = F.when(months < p["standard"], verdict(FAIL)).when(months >= p["capex"], verdict(PASS)).otherwise(verdict(OPEN))
    needed = F.when(capex, p["capex"]).otherwise(p["standard"])
    settled = F.when(capex.isNull(), unknown).otherwise(verdict(F.when(months >= needed, PASS).otherwise(FAIL)))
    return F.when(~F.coalesce(c("has_promoter"), F.lit(True)), verdict(NA)).otherwise(gaps(("lock_in_months",), settled))


def tier(capital: Column) -> Column:
    """The tier of a post-issue capital at offer price; upper bounds belong to their tier."""
    out = F.lit(TIERS[-1][0])
    for number, top, _, _ in reversed(TIERS[:-1]):
        out = F.when(capital <= top, number).otherwise(out)
    return F.when(capital.isNotNull(), out)


def _of_tier(capital: Column, k: int) -> Column:
    out = F.lit(TIERS[-1][k]).cast("double")
    for row in reversed(TIERS[:-1]):
        out = F.when(capital <= row[1], F.lit(row[k]).cast("double")).otherwise(out)
    return out


def r10(p: dict) -> Column:
    capital, pct = c("market_cap"), c("public_pct")
    value, least, share = capital * pct / 100, _of_tier(capital, 2), _of_tier(capital, 3)
    short = F.coalesce(value < least, F.lit(False)) | F.coalesce(pct < share, F.lit(False))
    high = tier(capital) >= 4
    settled = F.when(capital <= 0, verdict(REVIEW)).when(short, verdict(FAIL, high)).when((tier(capital) == 6) & (pct < TIER6_FLOOR), verdict(REVIEW)).otherwise(verdict(PASS, high))
    return gaps(("market_cap", "public_pct"), settled)


def _least(name: str) -> Callable[[dict], Column]:
    return lambda p: gaps((name,), verdict(F.when(c(name) >= p["min"], PASS).otherwise(FAIL)))


def r14(p: dict) -> Column:
    years = c("years_of_operation")
    return F.when(years.isNull(), verdict(OPEN)).otherwise(verdict(F.when(years >= p["min"], PASS).otherwise(FAIL)))


def r15(p: dict) -> Column:
    total, own = c("directors"), c("independent_directors")
    per = F.when(c("chair_executive") | c("chair_promoter"), 2).otherwise(3)
    return gaps(("directors", "independent_directors", "chair_executive", "chair_promoter"), F.when(total <= 0, verdict(REVIEW)).otherwise(verdict(F.when(own * per >= total, PASS).otherwise(FAIL))))


def directors_needed() -> Column:
    per = F.when(c("chair_executive") | c("chair_promoter"), 2).otherwise(3)
    return F.greatest(F.ceil(c("directors") / per) - c("independent_directors"), F.lit(0))


def r16(p: dict) -> Column:
    total, own = c("committee"), c("committee_independent")
    bad = (total < p["min"]) | ((total > 0) & (own * 3 < total * 2)) | ~c("committee_chair_independent")
    return gaps(("committee", "committee_independent", "committee_chair_independent"), verdict(F.when(bad, FAIL).otherwise(PASS)))


def r17(p: dict) -> Column:
    high = F.coalesce((c("rpt_value") > 0) & (c("latest_revenue") > 0) & ok("latest_revenue") & (c("rpt_value") * 100 > c("latest_revenue") * p["max_pct"]), F.lit(False))
    weak_revenue = (c("rpt_value") > 0) & unreliable("latest_revenue")
    return F.when(F.coalesce(~c("rpt_certified") & ok("rpt_certified"), F.lit(False)), verdict(FAIL)).otherwise(gaps(("rpt_certified", "rpt_value"), verdict(F.lit(PASS), high | F.coalesce(weak_revenue, F.lit(False)))))


def r18(p: dict) -> Column:
    facts = ("qualified_audit", "modified_opinion")
    bad = F.coalesce(c(facts[0]) & ok(facts[0]), F.lit(False)) | F.coalesce(c(facts[1]) & ok(facts[1]), F.lit(False))
    return F.when(bad, verdict(FAIL)).otherwise(gaps(facts, verdict(PASS)))


def r19(p: dict) -> Column:
    worth = c("latest_net_worth")
    large = F.coalesce((c("exposure") > 0) & ok("exposure") & (worth > 0) & ok("latest_net_worth") & (c("exposure") * 100 > worth * p["max_pct"]), F.lit(False))
    bad = F.coalesce(c("criminal_cases") & ok("criminal_cases"), F.lit(False)) | large
    # The net worth is asked for only where a reliable exposure is above nothing.
    asked = F.coalesce((c("exposure") > 0) & ok("exposure"), F.lit(False))
    rest = gaps(("criminal_cases", "exposure"), F.when(asked & worth.isNull(), verdict(OPEN)).when(asked & unreliable("latest_net_worth"), verdict(REVIEW)).otherwise(verdict(PASS)))
    return F.when(bad, verdict(FAIL)).otherwise(rest)


RULES: dict[str, Callable[[dict], Column]] = dict(zip([r[0] for r in CATALOGUE], [r01, r02, r03, r04, r05, r06, r07, r08, r09, r10, _least("post_issue_capital"), _least("market_cap"), _least("issue_size"), r14, r15, r16, r17, r18, r19]))


def applies(routes: str) -> Column:
    return F.array_contains(F.array(*[F.lit(r) for r in routes.split(",")]), c("route"))


def rule(rule_id: str) -> Column:
    """struct(verdict, review) of a rule; not applicable off its routes."""
    _, _, routes, parameters = next(r for r in CATALOGUE if r[0] == rule_id)
    return F.when(F.coalesce(applies(routes), F.lit(False)), RULES[rule_id](parameters)).otherwise(verdict(NA))


def evaluate(cases: DataFrame, rule_ids: list[str] | None = None) -> DataFrame:
    """case_id, route, rule_id, category, ord, verdict, review: a row for each case and rule, in one pass over the cases."""
    rows = [F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("category"), F.lit(k).alias("ord"), rule(r[0]).alias("out")) for k, r in enumerate(CATALOGUE, 1) if rule_ids is None or r[0] in rule_ids]
    return cases.select("case_id", "route", F.explode(F.array(*rows)).alias("r")).select("case_id", "route", "r.rule_id", "r.category", "r.ord", "r.out.verdict", "r.out.review")


def outcome(results: DataFrame) -> DataFrame:
    """One row a case: outcome by precedence over mandatory verdicts, counts by verdict, and the share passed of what applies (half even)."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    of = F.col("category") == "mandatory"
    has = lambda v: F.coalesce(F.bool_or(of & (F.col("verdict") == v)), F.lit(False))
    applicable = F.count("*") - count(NA)
    share = F.when(applicable > 0, F.bround((count(PASS) * 100).cast("decimal(20,6)") / applicable, 2)).otherwise(0).cast("double")
    first = (
        F.when(~F.coalesce(F.first("route").isin("6(1)", "6(2)"), F.lit(False)), "unsupported_scope")
        .when(has(FAIL), "screening_failure").when(has(REVIEW), "awaiting_human_review").when(has(OPEN), "inconclusive").otherwise("no_failure_identified")
    )
    return results.groupBy("case_id").agg(first.alias("outcome"), F.count("*").alias("total"), *[count(v).alias(f"n_{v}") for v in (PASS, FAIL, NA, OPEN, REVIEW)], share.alias("passed_pct"), F.count_if("review").alias("n_review"))


def gap_plan(results: DataFrame) -> DataFrame:
    """What stands between a case and a pass, hardest first: failures, then missing, then doubtful evidence."""
    step_for = F.when(F.col("verdict") == FAIL, "remedy the breach").when(F.col("verdict") == OPEN, "provide the missing evidence").otherwise("have a person verify the evidence")
    weight = F.when(F.col("verdict") == FAIL, 0).when(F.col("verdict") == OPEN, 1).otherwise(2)
    return results.where(F.col("verdict").isin(FAIL, OPEN, REVIEW)).select("case_id", "rule_id", "verdict", weight.alias("rank"), step_for.alias("step"), "ord")


def catalogue(spark) -> DataFrame:
    """The catalogue as rows: rule_id, category, routes, ord."""
    return spark.createDataFrame([(r[0], r[1], r[2].split(","), k) for k, r in enumerate(CATALOGUE, 1)], "rule_id string, category string, routes array<string>, ord int")
