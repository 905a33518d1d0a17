"""Red flags, footing, consensus, decisions, differences and accuracy over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, compare, consensus, flags, ranking
from .inputs import FISCAL, FY_LINES, portable

Query = Callable[[SparkSession, str], DataFrame]

#: Nations as documents: facts of an issue in rupees, by what their orders add up to.
ISSUE = f"""
    SELECT case_id AS doc_id, CASE WHEN case_id % 3 = 0 THEN 'sme' ELSE 'mainboard' END AS platform, CASE WHEN case_id % 5 = 0 THEN 'lender' ELSE 'other' END AS sector,
           CASE WHEN case_id % 11 = 7 THEN NULL ELSE SUM(revenue) END AS fresh, CASE WHEN case_id % 7 = 3 THEN NULL ELSE SUM(open_value) END AS gcp, SUM(returned) AS debt, SUM(accepted) AS ofs, SUM(accepted) + SUM(pending) AS total,
           CASE WHEN case_id % 6 = 2 THEN NULL ELSE SUM(seventh) END AS unidentified, CASE WHEN case_id % 4 = 0 THEN 0 ELSE 1 END AS agency
    FROM ({FISCAL}) f GROUP BY case_id
"""
#: Yearly series of nations: what is owed against revenue.
SERIES = f"SELECT case_id AS doc_id, fy, CAST(revenue AS BIGINT) AS revenue, CAST(returned AS BIGINT) AS receivables, CAST(open_value AS BIGINT) AS cash, CAST(accepted AS BIGINT) AS profit FROM ({FISCAL}) f WHERE months = 12"
SERIES_KEYS = {"revenue": "revenue_from_operations", "receivables": "trade_receivables", "cash": "cash_from_operations", "profit": "profit_after_tax"}
#: Statement columns of nations: three parts and a total that leaves out line 7 for odd nations.
COLUMNS = f"SELECT case_id AS table_id, fy AS period, revenue, accepted, returned + pending AS rest, CASE WHEN case_id % 2 = 1 THEN revenue - seventh ELSE revenue END AS printed, CASE WHEN case_id % 9 = 4 THEN 'lakh' ELSE 'crore' END AS unit FROM ({FISCAL}) f"
#: Readings of quantities by supplier: tables are line numbers, figures return flag and line status.
READINGS = """
    SELECT l_suppkey AS doc_id, l_linenumber AS table_id, concat('c', l_returnflag, l_linestatus) AS concept, concat('FY', CAST(year(l_shipdate) AS VARCHAR(4))) AS period, floor(l_quantity / 10) * 10 AS value, l_orderkey AS page
    FROM lineitem
"""
#: Readings of four anchors: figures lie 0, 0.75 or 1.5 above a base (so that they chain, with a step of 1), one table of each supplier far off; another entity's tables and front pages weigh otherwise.
CONTRADICTING = """
    SELECT l_suppkey AS doc_id, l_linenumber AS table_id, CASE l_orderkey % 4 WHEN 0 THEN 'revenue_from_operations' WHEN 1 THEN 'total_income' WHEN 2 THEN 'profit_before_tax' ELSE 'profit_after_tax' END AS concept,
           concat('FY', CAST(year(l_shipdate) AS VARCHAR(4))) AS period, CAST((l_suppkey % 50 + 1) * 100 + (year(l_shipdate) % 7) * 10 AS DOUBLE) + CASE WHEN l_linenumber = l_suppkey % 7 + 1 THEN 5000.0 ELSE CAST(l_partkey % 3 AS DOUBLE) * 0.75 END AS value,
           l_orderkey % 40 + 1 AS page, 40 AS n_pages, CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 'Standalone' END AS header
    FROM lineitem
"""
EDITS = "SELECT c_custkey AS doc_id, {side} FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderdate {op} TIMESTAMP '1998-06-01 00:00:00' GROUP BY c_custkey, o_orderpriority"


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    issue = portable(spark, sf_dir, ISSUE)
    docs = issue.select("doc_id", "platform", F.array("sector").alias("sectors"))
    keys = {"issue.fresh_issue_amount": "fresh", "objects.gcp_amount": "gcp", "objects.debt_repayment_amount": "debt", "issue.ofs_amount": "ofs", "issue.total_issue_amount": "total", "objects.unidentified_acquisition_amount": "unidentified", "objects.monitoring_agency_appointed": "agency"}
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("double").alias("value")) for k, c in keys.items()])
    # Some documents state the amount for general purposes on no page that could be cited.
    cited = F.when((F.col("r.key") == "objects.gcp_amount") & (F.col("doc_id") % 8 == 5), F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    facts = issue.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.key", "r.value", cited.alias("citations")).where("value is not null")
    names = F.create_map(*[F.lit(x) for pair in SERIES_KEYS.items() for x in pair])
    yearly = _series(spark, sf_dir).select("doc_id", F.concat(F.lit("financials."), names[F.col("concept")], F.lit(".FY"), F.col("fy").cast("string")).alias("key"), F.col("value").cast("double").alias("value"), F.array(F.lit(1)).alias("citations"))
    return docs, facts.unionByName(yearly)


def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, facts = _facts(spark, sf_dir)
    return flags.audit(docs, facts, flags.catalogue(spark), F.lit("2025-06-30").cast("date"))


def rule_audit_2020(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, facts = _facts(spark, sf_dir)
    return flags.audit(docs, facts, flags.catalogue(spark), F.lit("2020-01-01").cast("date"))


#: A page and a span for each fact by the length of its key, and a second one that all facts share.
def flag_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, facts = _facts(spark, sf_dir)
    cite = lambda page, span: F.struct(page.cast("int").alias("page"), span.alias("span"))
    own = cite((F.length("key") + F.col("doc_id")) % 4, F.concat(F.lit("s"), (F.length("key") % 2).cast("string")))
    told = facts.withColumn("citations", F.when(F.size("citations") > 0, F.array(own, cite(F.lit(9), F.lit("cover")))).otherwise(F.array().cast("array<struct<page:int,span:string>>")))
    found = flags.cited_flags(docs, told, flags.catalogue(spark), F.lit("2025-06-30").cast("date"))
    said = F.array_join(F.transform("citations", lambda c: F.concat(c["page"].cast("string"), F.lit(":"), c["span"])), ",")
    return found.select("doc_id", "rule_id", "severity", F.array_join("inputs", ",").alias("inputs"), said.alias("citations"))


def filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.filing_index(rule_audit(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = portable(spark, sf_dir, SERIES)
    return wide.select("doc_id", "fy", F.explode(F.array(*[F.struct(F.lit(n).alias("concept"), F.col(n).alias("value")) for n in ("revenue", "receivables", "cash", "profit")])).alias("r")).select("doc_id", "fy", "r.*")


def growth_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.growth_gap(_series(spark, sf_dir), "receivables", "revenue").withColumn("gap_pp", F.round("gap_pp", 4))


def persistent_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags.persistent_below(_series(spark, sf_dir), "cash", "profit")


def newest_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.newest_growth(_series(spark, sf_dir))


def _footing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = portable(spark, sf_dir, COLUMNS)
    parts = [("total_income", "printed", F.lit("crore")), ("revenue_from_operations", "accepted", F.lit("crore")), ("other_income", "rest", F.col("unit"))]
    rows = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(v).alias("value"), u.alias("unit"), F.lit(1.0).alias("step")) for c, v, u in parts])
    return wide.select("table_id", "period", F.explode(rows).alias("r")).select("table_id", "period", "r.*")


def footing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.footing(_footing_values(spark, sf_dir))


def trusted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.trusted_columns(footing(spark, sf_dir))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, READINGS)


def drop_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.without_ambiguous(_readings(spark, sf_dir)).select("doc_id", "table_id", "concept", "period", "value", "page")


def _weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).withColumns({"step": F.lit(1.0), "confidence": F.lit(0.9), "trusted": F.col("table_id") <= 2, "header": F.lit(None).cast("string"), "n_pages": F.lit(None).cast("int")})
    return consensus.weigh(rows)


def consensus_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(_weighed(spark, sf_dir)).select("doc_id", "concept", "period", F.col("value").cast("double").alias("value"), "total", "supporters", "strength", "rival")


def facts_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(_weighed(spark, sf_dir)).where(consensus.keep()).select("doc_id", "concept", "period", "supporters")


def withheld_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.withheld(consensus.consensus(_weighed(spark, sf_dir))).select("doc_id", "concept", "period", "total", "supporters")


def withheld_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = withheld_figures(spark, sf_dir).withColumn("fy", F.substring("period", 3, 4).cast("int"))
    return ranking.withheld_years(rows)


def _contradicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.weigh(portable(spark, sf_dir, CONTRADICTING).withColumns({"step": F.lit(1.0), "confidence": F.lit(1.0), "trusted": F.lit(False)}))


def weighed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by page and header, summed over the readings of each table."""
    return _contradicting(spark, sf_dir).groupBy("doc_id", "table_id").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose anchors all contradict what the other tables agree on."""
    rows = _contradicting(spark, sf_dir)
    return consensus.quarantined(rows, consensus.consensus(rows))


def facts_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.facts(_contradicting(spark, sf_dir))


def fy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir).select("doc_id", "concept", F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("period"), "value")
    return consensus.matrix(rows, ["FY1997", "FY1998", "FY1999", "FY2000", "FY2001"])


#: Candidates for the revenue of a nation's year: one from each return flag's table, scored by how many lines it has.
CANDIDATES = f"SELECT case_id * 10000 + fy AS doc_id, 'net_worth' AS field, flag AS source, row_number() OVER (PARTITION BY case_id, fy ORDER BY flag, status) AS ord, floor(SUM(cents) / 1E9) * 10 AS value, 0.5 AS tol, CAST(0.60 + (COUNT(*) % 8) * 0.05 AS DOUBLE) AS score FROM ({FY_LINES}) x GROUP BY case_id, fy, flag, status"


def decide_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.decide(portable(spark, sf_dir, CANDIDATES))


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.top_candidates(portable(spark, sf_dir, CANDIDATES), 3).select("doc_id", "ord", "score", "rank")


def validate_cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = portable(spark, sf_dir, SERIES)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("total_assets", "profit"), ("net_tangible_assets", "receivables"), ("revenue", "revenue"))])
    long = wide.select("doc_id", F.col("fy").alias("period"), F.explode(rows).alias("r")).select("doc_id", "period", "r.*", F.when(F.col("doc_id") % 2 == 0, "extracted_high_confidence").otherwise("not_found").alias("status"))
    return candidates.cross_checked(long).select("doc_id", "period", "field", "checked")


def _side(spark: SparkSession, sf_dir: str, op: str) -> DataFrame:
    return portable(spark, sf_dir, EDITS.format(op=op, side="concat('issue.', o_orderpriority) AS key, CAST(SUM(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS value, CAST(1000 AS DOUBLE) AS step"))


def value_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.changes(_side(spark, sf_dir, "<"), _side(spark, sf_dir, ">="), ("doc_id", "key"))
    return out.withColumns({"pct": F.round("pct", 3), "old": F.col("old").cast("double"), "new": F.col("new").cast("double")})


def flag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.status_changes(rule_audit_2020(spark, sf_dir).where("status = 'flagged'"), rule_audit(spark, sf_dir).where("status = 'flagged'"), ("doc_id", "rule_id"))


def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of quality against a heuristic on length, by language."""
    truth = portable(spark, sf_dir, "SELECT l.doc_id, 'quality.value' AS key, CASE WHEN l.toxic = 1 THEN 'absent' ELSE 'present' END AS status, CAST(l.quality AS DOUBLE) AS value, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
    guess = portable(spark, sf_dir, "SELECT doc_id, 'quality.value' AS key, CASE WHEN n_chars > 400 THEN 1.0 ELSE 0.0 END AS value, 0.0 AS step, 1 AS page, doc_id AS seq FROM documents WHERE doc_id % 9 <> 4")
    judged = compare.scored(truth.withColumns({"step": F.lit(0.0), "pages": F.array(F.lit(1))}), guess).join(truth.select("doc_id", "lang"), "doc_id")
    return compare.report(judged, F.col("lang")).select(F.coalesce("part", F.lit("all")).alias("part"), "n_correct", "n_wrong", "n_abstained", "n_hallucinated", "n_cited", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_audit(spark, sf_dir).where("status in ('flagged', 'missing_inputs')").select("doc_id", F.when(F.col("status") == "flagged", "flag").otherwise("unchecked").alias("kind"), "severity", F.length("rule_id").alias("page"), F.col("rule_id").alias("key"))


def read_first_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.read_first(_items(spark, sf_dir), 3).select("doc_id", "key", "rank")


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.triage(_items(spark, sf_dir))


# --- the same in SQL -------------------------------------------------------------------------------------------------
_COLUMN_OF = {key: column for column, key in SERIES_KEYS.items()}


def _audit_sql(day: str) -> str:
    parts = []
    for rule_id, platforms, severity, start, end, not_for, kind, p in flags.RULES:
        column = {"issue.fresh_issue_amount": "fresh", "objects.gcp_amount": "CASE WHEN doc_id % 8 = 5 THEN NULL ELSE gcp END", "objects.debt_repayment_amount": "debt", "issue.ofs_amount": "ofs", "issue.total_issue_amount": "total", "objects.unidentified_acquisition_amount": "unidentified", "objects.monitoring_agency_appointed": "agency"}
        on = ", ".join(f"'{x}'" for x in platforms.split(","))
        live = (start is None or start <= day) and (end is None or day <= end)
        if kind == "ratio_vs_cap":
            top, bottom = " + ".join(f"CAST({column[x]} AS DOUBLE)" for x in p["numerators"].split(",")), f"CAST({column[p['denominator']]} AS DOUBLE)"
            cap = f"least({p['cap']}, {p['abs_cap']} / {bottom})" if "abs_cap" in p else str(p["cap"])
            over = p.get("over", "high")
            said = f"CASE WHEN ({top}) IS NULL OR {bottom} IS NULL OR {bottom} <= 0 THEN 'missing_inputs' WHEN ({top}) / {bottom} > {cap} THEN 'flagged|{over}' WHEN ({top}) / {bottom} >= CAST({cap} AS DOUBLE) * {p['near']} THEN 'flagged|{severity}' ELSE 'clear' END"
        elif kind == "persistent_below":
            a, b = _COLUMN_OF[p["left"]], _COLUMN_OF[p["right"]]
            said = f"coalesce((SELECT CASE WHEN count(*) < {p['periods']} THEN 'missing_inputs' WHEN count(*) FILTER (WHERE {b} > 0 AND {a} < {b}) >= {p['breaches']} THEN 'flagged|{severity}' ELSE 'clear' END FROM s WHERE s.doc_id = i.doc_id AND s.back <= {p['periods']}), 'missing_inputs')"
        elif kind == "growth_gap":
            a, b = _COLUMN_OF[p["left"]], _COLUMN_OF[p["right"]]
            said = f"coalesce((SELECT CASE WHEN n.fy - o.fy <> 1 OR o.{a} <= 0 OR o.{b} <= 0 THEN 'missing_inputs' WHEN CAST(o.{a} AS DOUBLE) / o.{b} >= {p['base_ratio']} AND ((CAST(n.{a} AS DOUBLE) / o.{a} - 1) - (CAST(n.{b} AS DOUBLE) / o.{b} - 1)) * 100 >= {p['gap_pp']} THEN 'flagged|{severity}' ELSE 'clear' END FROM s n JOIN s o ON n.doc_id = o.doc_id AND n.back = 1 AND o.back = 2 WHERE n.doc_id = i.doc_id), 'missing_inputs')"
        else:
            a, b = column[p["trigger"]], column[p["required"]]
            said = f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'missing_inputs' WHEN {a} > {p['threshold']} AND {b} = 0 THEN 'flagged|{severity}' ELSE 'clear' END"
        parts.append(f"SELECT doc_id, '{rule_id}' AS rule_id, CASE WHEN platform NOT IN ({on}) THEN 'other_platform' WHEN {'FALSE' if live else 'TRUE'} THEN 'not_in_force' WHEN sector IN ({', '.join(f"'{x}'" for x in not_for.split(','))}) THEN 'not_applicable' ELSE {said} END AS said FROM i")
    return f"WITH i AS ({ISSUE}), s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fy DESC) AS back FROM ({SERIES}) x), q AS ({' UNION ALL '.join(parts)}), audit AS (SELECT doc_id, rule_id, split_part(said, '|', 1) AS status, nullif(split_part(said, '|', 2), '') AS severity FROM q)"


_NOW, _THEN = _audit_sql("2025-06-30"), _audit_sql("2020-01-01")
_CONS = f"""
    WITH r AS ({READINGS}), x AS (SELECT doc_id, concept, period, value, count(*) AS n, count(*) FILTER (WHERE table_id <= 2) AS t FROM r GROUP BY ALL),
    g AS (SELECT *, sum(n) OVER w AS total, sum(t) OVER w > 0 AS any_t FROM x WINDOW w AS (PARTITION BY doc_id, concept, period)),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, concept, period ORDER BY n DESC, value) AS place FROM g WHERE t > 0 OR NOT any_t),
    c AS (SELECT doc_id, concept, period, CAST(max(total) AS BIGINT) AS total, CAST(max(value) FILTER (WHERE place = 1) AS DOUBLE) AS value, CAST(max(n) FILTER (WHERE place = 1) AS BIGINT) AS supporters, CAST(max(n) FILTER (WHERE place = 1) AS DOUBLE) AS strength, CAST(coalesce(max(n) FILTER (WHERE place = 2), 0) AS DOUBLE) AS rival FROM k GROUP BY ALL)
"""


def _agreed_sql(rows: str, name: str) -> str:
    """Consensus over CTE rows, as CTEs that end in name: clusters by what lies 0, 0.75, 1.5 or 5000 above the base."""
    key = "doc_id, concept, period"
    return f"""
        {name}_o AS (SELECT *, value - min(base) OVER (PARTITION BY {key}) AS above FROM {rows}),
        {name}_h AS (SELECT *, bool_or(above = 0) OVER (PARTITION BY {key}) AS has0, bool_or(above = 0.75) OVER (PARTITION BY {key}) AS has1, count(*) OVER (PARTITION BY {key}) AS total FROM {name}_o),
        {name}_c AS (SELECT *, CASE WHEN above > 100 THEN 3 WHEN has0 THEN CASE WHEN above = 1.5 THEN 2 ELSE 1 END ELSE 1 END AS cluster FROM {name}_h),
        {name}_v AS (SELECT {key}, cluster, value, count(*) AS n, max(total) AS total, sum(weight) AS weight FROM {name}_c GROUP BY ALL),
        {name}_k AS (SELECT {key}, cluster, max(total) AS total, sum(n) AS supporters, sum(weight) AS strength, min(value) AS head, arg_max(value, n * 1000000.0 + value) AS value FROM {name}_v GROUP BY ALL),
        {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY strength DESC, head) AS place, max(head) OVER (PARTITION BY {key}) AS top FROM {name}_k),
        {name} AS (SELECT {key}, max(total) AS total, max(value) FILTER (WHERE place = 1) AS agreed, max(supporters) FILTER (WHERE place = 1) AS supporters, max(strength) FILTER (WHERE place = 1) AS strength, coalesce(max(strength) FILTER (WHERE place = 2), 0) AS rival, bool_or(place = 1 AND head >= top) AS largest FROM {name}_r GROUP BY {key})"""


_WEIGHED = f"""
    WITH raw AS ({CONTRADICTING}), q AS (SELECT *, coalesce(header, '') = 'Standalone' AS other FROM raw),
    w AS (SELECT *, CAST((doc_id % 50 + 1) * 100 + (CAST(substr(period, 3) AS INT) % 7) * 10 AS DOUBLE) AS base, CASE WHEN other AND NOT bool_and(other) OVER (PARTITION BY doc_id, concept, period) THEN 0.0 WHEN page * 4 <= n_pages THEN 2.0 ELSE 1.0 END AS weight FROM q)
"""
_QUARANTINE = f"""{_WEIGHED}, {_agreed_sql('w', 'a')},
    bad AS (SELECT w.doc_id, w.table_id, w.period FROM w JOIN a ON w.doc_id = a.doc_id AND w.concept = a.concept AND w.period = a.period WHERE a.supporters >= 2 AND a.strength >= 2 * a.rival GROUP BY ALL HAVING NOT bool_or(abs(w.value - a.agreed) <= 1.0))
"""
_KEEP = "(total = 1 OR (supporters >= 2 AND strength >= 2 * rival))"
_ITEMS = "i2 AS (SELECT doc_id, CASE status WHEN 'flagged' THEN 'flag' ELSE 'unchecked' END AS kind, severity, length(rule_id) AS page, rule_id AS key FROM audit WHERE status IN ('flagged', 'missing_inputs'))"
_SEV = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
_EDIT = lambda op: EDITS.format(op=op, side="concat('issue.', o_orderpriority) AS key, CAST(SUM(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS value")
QUERIES: dict[str, Query] = {f.__name__: f for f in (rule_audit, rule_audit_2020, flag_citations, filing_index, growth_gap, persistent_below, newest_growth, footing, trusted_columns, drop_ambiguous, consensus_figures, facts_keep, withheld_figures, withheld_years, weighed_readings, quarantine, facts_two_pass, fy_matrix, decide_field, top_candidates, validate_cross_field, value_diff, flag_diff, eval_score, read_first_topk, triage)}
ORACLE: dict[str, str] = {
    "rule_audit": f"{_NOW} SELECT doc_id, rule_id, status, severity FROM audit",
    "rule_audit_2020": f"{_THEN} SELECT doc_id, rule_id, status, severity FROM audit",
    "filing_index": f"{_NOW} SELECT doc_id, count(*) FILTER (WHERE status = 'flagged') AS n_flags, coalesce(string_agg(DISTINCT CASE WHEN status = 'flagged' THEN severity END, ',' ORDER BY CASE WHEN status = 'flagged' THEN severity END), '') AS severities, count(*) FILTER (WHERE status IN ('flagged', 'clear')) AS n_decided, count(*) FILTER (WHERE status IN ('flagged', 'clear', 'missing_inputs')) AS n_applicable FROM audit GROUP BY doc_id",
    "growth_gap": f"SELECT doc_id, fy, round(((receivables / l0) - (CAST(revenue AS DOUBLE) / r0)) * 100, 4) AS gap_pp, ((receivables / l0) - (CAST(revenue AS DOUBLE) / r0)) * 100 >= 20 AS flagged FROM (SELECT *, CAST(lag(receivables) OVER w AS DOUBLE) AS l0, CAST(lag(revenue) OVER w AS DOUBLE) AS r0, lag(fy) OVER w AS y0 FROM ({SERIES}) s WINDOW w AS (PARTITION BY doc_id ORDER BY fy)) t WHERE fy - y0 = 1 AND l0 > 0 AND r0 > 0 AND l0 >= 0.01 * r0",
    "persistent_below": f"SELECT doc_id, count(*) AS n_periods, count(*) FILTER (WHERE profit > 0 AND cash < profit) AS n_breaches, CASE WHEN count(*) < 3 THEN 'missing_inputs' WHEN count(*) FILTER (WHERE profit > 0 AND cash < profit) >= 2 THEN 'flagged' ELSE 'clear' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fy DESC) AS back FROM ({SERIES}) s) t WHERE back <= 3 GROUP BY doc_id",
    "newest_growth": f"WITH l AS (SELECT doc_id, fy, unnest(['revenue', 'receivables', 'cash', 'profit']) AS concept, unnest([revenue, receivables, cash, profit]) AS value FROM ({SERIES}) s), t AS (SELECT *, row_number() OVER w AS back, lead(value) OVER w AS before, lead(fy) OVER w AS fy_before FROM l WINDOW w AS (PARTITION BY doc_id, concept ORDER BY fy DESC)) SELECT doc_id, concept, fy, CASE WHEN value > 0 AND before > 0 AND fy - fy_before = 1 THEN round(CAST(value - before AS DOUBLE) / before * 100, 1) END AS growth_pct FROM t WHERE back = 1",
    "footing": f"SELECT table_id, period, 'total_income' AS identity, abs(printed - accepted - rest) <= 3 AS ok FROM ({COLUMNS}) c WHERE unit = 'crore'",
    "trusted_columns": f"SELECT table_id, period FROM ({COLUMNS}) c WHERE unit = 'crore' AND abs(printed - accepted - rest) <= 3",
    "drop_ambiguous": f"SELECT doc_id, table_id, concept, period, value, page FROM (SELECT *, min(value) OVER w = max(value) OVER w AS one FROM ({READINGS}) r WINDOW w AS (PARTITION BY doc_id, table_id, concept, period)) t WHERE one",
    "consensus_figures": f"{_CONS} SELECT doc_id, concept, period, value, total, supporters, strength, rival FROM c",
    "facts_keep": f"{_CONS} SELECT doc_id, concept, period, supporters FROM c WHERE {_KEEP}",
    "withheld_figures": f"{_CONS} SELECT doc_id, concept, period, total, supporters FROM c WHERE NOT {_KEEP}",
    "withheld_years": f"{_CONS}, w AS (SELECT doc_id, CAST(substr(period, 3, 4) AS INT) AS fy FROM c WHERE NOT {_KEEP}), m AS (SELECT *, max(fy) OVER (PARTITION BY doc_id) AS newest FROM w) SELECT doc_id, count(*) FILTER (WHERE fy > newest - 2) AS n_listed, count(*) FILTER (WHERE fy <= newest - 2) AS n_older FROM m GROUP BY doc_id",
    "weighed_readings": f"{_WEIGHED} SELECT doc_id, table_id, sum(weight) AS weight, count(*) AS n FROM w GROUP BY ALL",
    "quarantine": f"{_QUARANTINE} SELECT * FROM bad",
    "facts_two_pass": f"""{_QUARANTINE}, w2 AS (SELECT * FROM w ANTI JOIN bad USING (doc_id, table_id, period)), {_agreed_sql('w2', 'b')}
        SELECT doc_id, 'financials.' || concept || '.' || period AS key, agreed AS value, CAST(supporters AS BIGINT) AS supporters FROM b
        WHERE total = 1 OR (supporters >= 2 AND strength >= 2 * rival) OR (concept IN ('revenue_from_operations', 'total_income') AND largest AND supporters >= 2 AND strength > rival)""",
    "fy_matrix": f"WITH l AS (SELECT doc_id, fy, unnest(['revenue', 'receivables', 'cash', 'profit']) AS concept, unnest([revenue, receivables, cash, profit]) AS value FROM ({SERIES}) s) SELECT doc_id, concept, {', '.join(f'max(CASE WHEN fy = {y} THEN value END) AS FY{y}' for y in range(1997, 2002))} FROM l GROUP BY doc_id, concept",
    "decide_field": f"""WITH c AS ({CANDIDATES}), k AS (SELECT doc_id, field, value, max(score) AS top, max(score) + least(CAST(0.1 AS DOUBLE), CAST(0.05 AS DOUBLE) * (count(DISTINCT source) - 1)) AS score, count(DISTINCT source) AS sources, arg_max(ord, score * 1000 - ord) AS first FROM c GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, top DESC, first) AS place, max(score) OVER (PARTITION BY doc_id, field) AS best FROM k),
        d AS (SELECT doc_id, field, max(value) FILTER (WHERE place = 1) AS value, max(best) AS best, max(sources) FILTER (WHERE place = 1) AS sources, count(*) FILTER (WHERE score >= best - 0.15 - 1e-9) - 1 AS rivals FROM r GROUP BY doc_id, field)
        SELECT doc_id, field, CAST(value AS DOUBLE) AS value, round(best, 4) AS score, sources, rivals, CASE WHEN rivals > 0 THEN 'conflicting_candidates' WHEN best >= 0.78 AND sources >= 2 THEN 'extracted_high_confidence' ELSE 'extracted_needs_verification' END AS status FROM d""",
    "top_candidates": f"SELECT * FROM (SELECT doc_id, ord, score, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, ord) AS INT) AS rank FROM ({CANDIDATES}) c) t WHERE rank <= 3",
    "validate_cross_field": f"WITH l AS (SELECT doc_id, fy AS period, profit, unnest(['total_assets', 'net_tangible_assets', 'revenue']) AS field, unnest([profit, receivables, revenue]) AS value FROM ({SERIES}) s) SELECT doc_id, period, field, CASE WHEN doc_id % 2 = 1 THEN 'not_found' WHEN (field = 'net_tangible_assets' AND value * 1000 > profit * 1001) OR (field = 'revenue' AND value < 0) THEN 'extracted_needs_verification' ELSE 'extracted_high_confidence' END AS checked FROM l",
    "value_diff": f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.key, n.key) AS key, CAST(o.value AS DOUBLE) AS old, CAST(n.value AS DOUBLE) AS new, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' WHEN abs(n.value - o.value) <= 1000 THEN 'same' ELSE 'moved' END AS kind, CASE WHEN o.value <> 0 THEN round((n.value - o.value) / CAST(abs(o.value) AS DOUBLE) * 100, 3) END AS pct FROM ({_EDIT('<')}) o FULL JOIN ({_EDIT('>=')}) n ON o.doc_id = n.doc_id AND o.key = n.key",
    "flag_diff": f"WITH o AS ({_THEN} SELECT doc_id, rule_id FROM audit WHERE status = 'flagged'), n AS ({_NOW} SELECT doc_id, rule_id FROM audit WHERE status = 'flagged') SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.rule_id, n.rule_id) AS rule_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'kept' END AS kind FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.rule_id = n.rule_id",
    "eval_score": """WITH j AS (SELECT d.lang, l.toxic = 1 AS absent, d.doc_id % 9 = 4 AS silent, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END = l.quality AS near FROM labels l JOIN documents d ON l.doc_id = d.doc_id), v AS (SELECT lang, CASE WHEN absent THEN CASE WHEN silent THEN 'absent' ELSE 'hallucinated' END WHEN silent THEN 'abstained' WHEN near THEN 'correct' ELSE 'wrong' END AS verdict, NOT silent AND near AS cited FROM j),
        s AS (SELECT coalesce(lang, 'all') AS part, count(*) FILTER (WHERE verdict = 'correct') AS n_correct, count(*) FILTER (WHERE verdict = 'wrong') AS n_wrong, count(*) FILTER (WHERE verdict = 'abstained') AS n_abstained, count(*) FILTER (WHERE verdict = 'hallucinated') AS n_hallucinated, count(*) FILTER (WHERE cited) AS n_cited FROM v GROUP BY GROUPING SETS ((lang), ()))
        SELECT *, round(n_correct / CAST(nullif(n_correct + n_wrong, 0) AS DOUBLE), 6) AS precision, round(n_correct / CAST(nullif(n_correct + n_wrong + n_abstained, 0) AS DOUBLE), 6) AS recall FROM s""",
    "read_first_topk": f"{_NOW}, {_ITEMS} SELECT * FROM (SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'flag' THEN {_SEV} ELSE 4 END, CASE kind WHEN 'flag' THEN 1 ELSE 3 END, page, key) AS INT) AS rank FROM i2) t WHERE rank <= 3",
    "triage": f"{_NOW}, {_ITEMS} SELECT doc_id, CAST(min({_SEV}) AS INT) AS worst, count(*) AS n FROM i2 WHERE kind = 'flag' GROUP BY doc_id",
}

_NAMED = " UNION ALL ".join(f"SELECT '{r[0]}' AS rule_id, {k} AS place, '{key}' AS key" for r in flags.RULES if r[6] in ("ratio_vs_cap", "required_if") for k, key in enumerate([*r[7].get("numerators", r[7].get("trigger", "")).split(","), r[7].get("denominator", r[7].get("required"))], 1))
_PERIODS = f"SELECT doc_id, fy, row_number() OVER (PARTITION BY doc_id ORDER BY fy DESC) AS back FROM ({SERIES}) s"
ORACLE["flag_citations"] = f"""
    WITH a AS ({ORACLE["rule_audit"]}), f AS (SELECT doc_id, rule_id, severity FROM a WHERE status = 'flagged'), p AS ({_PERIODS}),
    used AS (
        SELECT f.doc_id, f.rule_id, n.place, n.key FROM f JOIN ({_NAMED}) n ON f.rule_id = n.rule_id
        UNION ALL SELECT f.doc_id, f.rule_id, 10 * (4 - back) + s, 'financials.' || CASE s WHEN 1 THEN 'cash_from_operations' ELSE 'profit_after_tax' END || '.FY' || fy FROM f JOIN p ON p.doc_id = f.doc_id AND back <= 3 CROSS JOIN (SELECT unnest([1, 2]) AS s) x WHERE rule_id = 'FIN-CFO-BELOW-PAT'
        UNION ALL SELECT f.doc_id, f.rule_id, 10 * s + 3 - back, 'financials.' || CASE s WHEN 1 THEN 'trade_receivables' ELSE 'revenue_from_operations' END || '.FY' || fy FROM f JOIN p ON p.doc_id = f.doc_id AND back <= 2 CROSS JOIN (SELECT unnest([1, 2]) AS s) x WHERE rule_id = 'FIN-RECEIVABLES-OUTGROW-REVENUE'
    ), c AS (SELECT doc_id, rule_id, 2 * place AS place, ((length(key) + doc_id) % 4) || ':s' || (length(key) % 2) AS c FROM used UNION ALL SELECT doc_id, rule_id, 2 * place + 1, '9:cover' FROM used),
    once AS (SELECT doc_id, rule_id, c, min(place) AS place FROM c GROUP BY ALL), said AS (SELECT doc_id, rule_id, string_agg(c, ',' ORDER BY place) AS citations FROM once GROUP BY ALL), inputs AS (SELECT doc_id, rule_id, string_agg(key, ',' ORDER BY place) AS inputs FROM used GROUP BY ALL)
    SELECT f.doc_id, f.rule_id, severity, inputs, citations FROM f JOIN said s ON f.doc_id = s.doc_id AND f.rule_id = s.rule_id JOIN inputs i ON f.doc_id = i.doc_id AND f.rule_id = i.rule_id
"""
