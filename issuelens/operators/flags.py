"""Red-flag rules of four kinds over cited facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Id, platforms, severity, valid from and to, excluded sectors, kind, parameters.
RULES = [
    ("OBJ-GCP-CAP-MAINBOARD", "mainboard", "medium", "2018-11-10", None, "", "ratio_vs_cap", {"numerators": "objects.gcp_amount", "denominator": "issue.fresh_issue_amount", "cap": 0.25, "near": 0.9}),
    ("OBJ-GCP-CAP-SME", "sme", "medium", "2025-03-08", None, "", "ratio_vs_cap", {"numerators": "objects.gcp_amount", "denominator": "issue.fresh_issue_amount", "cap": 0.15, "near": 0.9, "abs_cap": 100000000.0}),
    ("OBJ-GCP-CAP-SME-PRE2025", "sme", "medium", "2018-11-10", "2025-03-07", "", "ratio_vs_cap", {"numerators": "objects.gcp_amount", "denominator": "issue.fresh_issue_amount", "cap": 0.25, "near": 0.9}),
    ("OBJ-GCP-UNIDENTIFIED-35-MAINBOARD", "mainboard", "medium", "2022-01-14", None, "", "ratio_vs_cap", {"numerators": "objects.gcp_amount,objects.unidentified_acquisition_amount", "denominator": "issue.fresh_issue_amount", "cap": 0.35, "near": 0.9}),
    ("OBJ-UNIDENTIFIED-ACQ-25-MAINBOARD", "mainboard", "medium", "2022-01-14", None, "", "ratio_vs_cap", {"numerators": "objects.unidentified_acquisition_amount", "denominator": "issue.fresh_issue_amount", "cap": 0.25, "near": 0.9}),
    ("ISSUE-OFS-CAP-SME", "sme", "medium", "2025-03-08", None, "", "ratio_vs_cap", {"numerators": "issue.ofs_amount", "denominator": "issue.total_issue_amount", "cap": 0.20, "near": 0.9}),
    ("OBJ-DEBT-REPAYMENT-SHARE", "mainboard,sme", "low", None, None, "", "ratio_vs_cap", {"numerators": "objects.debt_repayment_amount", "denominator": "issue.fresh_issue_amount", "cap": 0.5, "near": 1.0, "over": "low"}),
    ("OBJ-MONITORING-AGENCY-MAINBOARD", "mainboard", "high", "2018-11-10", None, "", "required_if", {"trigger": "issue.fresh_issue_amount", "threshold": 1000000000.0, "required": "objects.monitoring_agency_appointed"}),
    ("OBJ-MONITORING-AGENCY-SME", "sme", "high", "2025-03-08", None, "", "required_if", {"trigger": "issue.fresh_issue_amount", "threshold": 500000000.0, "required": "objects.monitoring_agency_appointed"}),
    ("OBJ-MONITORING-AGENCY-SME-PRE2025", "sme", "high", "2018-11-10", "2025-03-07", "", "required_if", {"trigger": "issue.fresh_issue_amount", "threshold": 1000000000.0, "required": "objects.monitoring_agency_appointed"}),
    ("FIN-CFO-BELOW-PAT", "mainboard,sme", "medium", None, None, "lender,real_estate", "persistent_below", {"left": "cash_from_operations", "right": "profit_after_tax", "periods": 3, "breaches": 2}),
    ("FIN-RECEIVABLES-OUTGROW-REVENUE", "mainboard,sme", "medium", None, None, "", "growth_gap", {"left": "trade_receivables", "right": "revenue_from_operations", "gap_pp": 20.0, "base_ratio": 0.01}),
]


def usable(facts: DataFrame) -> DataFrame:
    """Facts without a citation count as missing."""
    return facts.where(F.size("citations") > 0)


def in_force(as_of: Column, valid_from: Column, valid_to: Column) -> Column:
    """Both ends inclusive, open where null."""
    return (valid_from.isNull() | (valid_from <= as_of)) & (valid_to.isNull() | (as_of <= valid_to))


def catalogue(spark) -> DataFrame:
    shape = {"rule_id": "string", "platforms": "array<string>", "severity": "string", "valid_from": "string", "valid_to": "string", "not_for": "array<string>", "kind": "string", "tops": "array<string>", "bottom": "string", "ord": "int"}
    numbers = {"cap": "double", "near": "double", "abs_cap": "double", "over": "string", "threshold": "double", "left": "string", "right": "string", "periods": "int", "breaches": "int", "gap_pp": "double", "base_ratio": "double"}
    rows = [
        (rule, platforms.split(","), severity, start, end, [x for x in not_for.split(",") if x], kind, p.get("numerators", p.get("trigger", "")).split(","), p.get("denominator", p.get("required")), n, *[p.get(k, "high" if k == "over" else None) for k in numbers])
        for n, (rule, platforms, severity, start, end, not_for, kind, p) in enumerate(RULES, 1)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in (shape | numbers).items())).withColumns({x: F.col(x).cast("date") for x in ("valid_from", "valid_to")})


def series(known: Column, prefix: Column, form: str = r"^FY\d{4}$") -> Column:
    """period to value of the facts prefix.<period> whose period has the form (P12). known: map of key to value."""
    start = F.concat(prefix, F.lit("."))
    period = lambda key: F.substr(key, F.length(start) + 1)
    return F.transform_keys(F.map_filter(known, lambda k, v: F.startswith(k, start) & period(k).rlike(form)), lambda k, v: period(k))


def _common(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_intersect(F.map_keys(left), F.map_keys(right)))


def series_below(left: Column, right: Column, periods: Column, breaches: Column, severity: Column) -> Column:
    """Of the last common periods, those where left is below a positive right."""
    common = _common(left, right)
    last = F.slice(common, F.greatest(F.size(common) - periods + 1, F.lit(1)), periods)
    below = F.size(F.filter(last, lambda p: (right[p] > 0) & (left[p] < right[p])))
    return F.when(F.size(common) < periods, _said("missing_inputs")).when(below >= breaches, _said("flagged", severity)).otherwise(_said("clear"))


def series_gap(left: Column, right: Column, gap_pp: Column, base_ratio: Column, severity: Column) -> Column:
    """Growth of left over that of right between the last two common fiscal years, where they follow each other, bases are positive and left is material."""
    common = _common(left, right)
    p0, p1 = F.try_element_at(common, F.lit(-2)), F.try_element_at(common, F.lit(-1))
    year = lambda p: F.substring(p, 3, 4).cast("int")
    l0, r0 = left[p0], right[p0]
    gap = ((left[p1] / l0 - 1) - (right[p1] / r0 - 1)) * 100
    return (
        F.when((F.size(common) < 2) | (year(p1) - year(p0) != 1), _said("missing_inputs"))
        .when((l0 <= 0) | (r0 <= 0), _said("missing_inputs"))
        .when((l0 / r0 >= base_ratio) & (gap >= gap_pp), _said("flagged", severity))
        .otherwise(_said("clear"))
    )


def citations_of(facts: Column) -> Column:
    """The citations (page and span) of some facts, each once, in the order in which the facts bring them."""
    return F.array_distinct(F.flatten(F.transform(facts, lambda f: f["citations"])))


def ratio_vs_cap(top: Column, bottom: Column, cap: Column, near: Column, abs_cap: Column, severity: Column, over: Column) -> Column:
    """struct(status, severity): over the cap, near it, or clear; the cap shrinks to abs_cap over the denominator."""
    limit = F.least(cap, abs_cap / bottom)
    share = top / bottom
    missing = top.isNull() | bottom.isNull() | (bottom <= 0)
    return F.when(missing, _said("missing_inputs")).when(share > limit, _said("flagged", over)).when(share >= limit * near, _said("flagged", severity)).otherwise(_said("clear"))


def required_if(trigger: Column, threshold: Column, required: Column, severity: Column) -> Column:
    return F.when(trigger.isNull() | required.isNull(), _said("missing_inputs")).when((trigger > threshold) & (required == 0), _said("flagged", severity)).otherwise(_said("clear"))


def _said(status: str, severity: Column | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(None).cast("string") if severity is None else severity.cast("string")).alias("severity"))


def persistent_below(series: DataFrame, left: str, right: str, periods: int = 3, breaches: int = 2) -> DataFrame:
    """doc_id, n_periods, n_breaches, status: of the last common years, those where left is below a positive right. series: doc_id, concept, fy, value."""
    both = _paired(series, left, right)
    last = both.withColumn("back", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("fy").desc()))).where(F.col("back") <= periods)
    out = last.groupBy("doc_id").agg(F.count("*").alias("n_periods"), F.count_if((F.col("right") > 0) & (F.col("left") < F.col("right"))).alias("n_breaches"))
    return out.withColumn("status", F.when(F.col("n_periods") < periods, "missing_inputs").when(F.col("n_breaches") >= breaches, "flagged").otherwise("clear"))


def _paired(series: DataFrame, left: str, right: str) -> DataFrame:
    """Years in which both concepts have a value; one shuffle, no self-join."""
    pick = lambda name: F.max(F.when(F.col("concept") == name, F.col("value")))
    both = series.where(F.col("concept").isin(left, right)).groupBy("doc_id", "fy").agg(pick(left).alias("left"), pick(right).alias("right"))
    return both.where("left is not null and right is not null")


def growth_gap(series: DataFrame, left: str, right: str, gap_pp: float = 20.0, base_ratio: float = 0.01) -> DataFrame:
    """doc_id, fy, gap_pp, flagged: growth of left over that of right between consecutive years, where left is material and both bases positive."""
    by = Window.partitionBy("doc_id").orderBy("fy")
    both = _paired(series, left, right)
    before = both.withColumns({"l0": F.lag("left").over(by), "r0": F.lag("right").over(by), "y0": F.lag("fy").over(by)})
    pairs = before.where((F.col("fy") - F.col("y0") == 1) & (F.col("l0") > 0) & (F.col("r0") > 0) & (F.col("l0").cast("double") >= base_ratio * F.col("r0").cast("double")))
    gap = (F.col("left").cast("double") / F.col("l0").cast("double") - F.col("right").cast("double") / F.col("r0").cast("double")) * 100
    return pairs.select("doc_id", "fy", gap.alias("gap_pp"), (gap >= gap_pp).alias("flagged"))


def audit(docs: DataFrame, facts: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """doc_id, rule_id, status, severity: every rule for every document. docs: doc_id, platform, sectors; facts: doc_id, key, value, citations."""
    return _judged(docs, facts, rules, as_of).select("doc_id", "rule_id", "o.status", "o.severity")


def cited_flags(docs: DataFrame, facts: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """doc_id, rule_id, severity, inputs, citations of every flag: the keys that the rule used, and their citations, each once, in the order in which the inputs bring them."""
    flagged = _judged(docs, facts, rules, as_of).where("o.status = 'flagged'")
    cited = F.transform("inputs", lambda key: F.struct(F.try_element_at(F.col("cites"), key).alias("citations")))
    return flagged.select("doc_id", "rule_id", "o.severity", "inputs", citations_of(cited).alias("citations"))


def _inputs() -> Column:
    """The keys of the facts that a rule looks at: those it names, or two series in the periods that it compares."""
    key = lambda side, period: F.concat(F.lit("financials."), F.col(side), F.lit("."), period)
    common = _common(*(series(F.col("known"), F.concat(F.lit("financials."), F.col(k))) for k in ("left", "right")))
    last = lambda n: F.slice(common, F.greatest(F.size(common) - n + 1, F.lit(1)), n)
    by_period = F.flatten(F.transform(last(F.col("periods")), lambda p: F.array(key("left", p), key("right", p))))
    of_side = lambda side: F.transform(last(F.lit(2)), lambda p: key(side, p))
    by_series = F.concat(of_side("left"), of_side("right"))
    named = F.concat("tops", F.array("bottom"))
    return F.when(F.col("kind").isin("ratio_vs_cap", "required_if"), named).when(F.col("kind") == "persistent_below", by_period).otherwise(by_series)


def _judged(docs: DataFrame, facts: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """doc_id, rule_id, o (status, severity), inputs, cites for every rule and document.

    Facts gather into one map a document before they meet the rules, a table of a dozen rows, so no fact is copied.
    """
    maps = [F.map_from_entries(F.collect_list(F.struct("key", x))).alias(name) for name, x in (("known", F.col("value").cast("double")), ("cites", F.col("citations")))]
    known = usable(facts).groupBy("doc_id").agg(*maps)
    pairs = docs.join(known, "doc_id", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,double>"))).crossJoin(F.broadcast(rules))
    value = lambda key: F.try_element_at(F.col("known"), key)
    tops = F.transform("tops", value)
    top = F.when(F.exists(tops, lambda v: v.isNull()), None).otherwise(F.aggregate(tops, F.lit(0.0), lambda a, v: a + v))
    bottom = value(F.col("bottom"))
    ratio = ratio_vs_cap(top, bottom, F.col("cap"), F.col("near"), F.col("abs_cap"), F.col("severity"), F.col("over"))
    needed = required_if(top, F.col("threshold"), bottom, F.col("severity"))
    left, right = (series(F.col("known"), F.concat(F.lit("financials."), F.col(k))) for k in ("left", "right"))
    below, gap = series_below(left, right, F.col("periods"), F.col("breaches"), F.col("severity")), series_gap(left, right, F.col("gap_pp"), F.col("base_ratio"), F.col("severity"))
    out = (
        F.when(~F.array_contains("platforms", F.col("platform")), _said("other_platform"))
        .when(~in_force(as_of, F.col("valid_from"), F.col("valid_to")), _said("not_in_force"))
        .when(F.arrays_overlap("not_for", "sectors"), _said("not_applicable"))
        .when(F.col("kind") == "ratio_vs_cap", ratio).when(F.col("kind") == "required_if", needed).when(F.col("kind") == "persistent_below", below).otherwise(gap)
    )
    return pairs.select("doc_id", "rule_id", out.alias("o"), _inputs().alias("inputs"), "cites")
