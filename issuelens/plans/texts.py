"""Numbers, units, periods, labels and prose over strings made from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, numbers, periods, units
from ..operators import documents as d
from .inputs import portable

Query = Callable[[SparkSession, str], DataFrame]

_GROUPED = "CASE WHEN floor(l_extendedprice) < 1000 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)) ELSE concat(CAST(CAST(floor(l_extendedprice / 1E3) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS VARCHAR(20)), 3, '0')) END"
#: Prices as documents print them, seven ways.
PRINTED = f"SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS price, CASE l_linenumber % 7 WHEN 0 THEN g WHEN 1 THEN concat('(', g, ')') WHEN 2 THEN concat('–', g) WHEN 3 THEN concat('Rs. ', g, '.50') WHEN 4 THEN concat(g, '-') WHEN 5 THEN 'nil' ELSE concat(g, '%') END AS raw FROM (SELECT *, {_GROUPED} AS g FROM lineitem) x"
_MON = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST((month(o_orderdate) - 1) * 3 + 1 AS INT), 3)"
_Y, _D, _M = (f"CAST({f}(o_orderdate) AS VARCHAR(4))" for f in ("year", "day", "month"))
#: Headers with the dates of orders, six ways.
HEADERS = f"SELECT o_orderkey, o_orderdate, CASE o_orderkey % 6 WHEN 0 THEN concat('As at ', {_MON}, ' ', {_D}, ', ', {_Y}) WHEN 1 THEN concat('year ended ', {_D}, '-', {_MON}, '-', {_Y}) WHEN 2 THEN concat({_D}, '.', {_M}, '.', {_Y}) WHEN 3 THEN concat('FY ', {_Y}, '-', CAST(year(o_orderdate) + 1 AS VARCHAR(4))) WHEN 4 THEN concat('nine months ended ', {_MON}, ' ', {_D}, ', ', {_Y}) ELSE concat('Fiscal ', {_Y}) END AS header FROM orders"
CAPTIONS = ["(₹ in lakhs)", "Amount in millions", "Rs. in crore and lakhs", "a fresh issue of 30 million shares", "figures in Rs. billion", "(₹)", "particulars"]
LABELS = ["Restated net worth", "Net tangible assets (A)", "Return on net worth %", "Revenue from operations", "Total revenue from operations", "Profit before tax", "T otal assets", "Total equity and liabilities", "Other income (net)", "Operating profit margin", "Trade receivables", "Net cash from operating activities", "Average operating profit"]


def _element(values: list[str], key: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def number_parse_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, PRINTED).select("l_orderkey", "l_linenumber", numbers.parse_a(F.col("raw")).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", F.col("p.value").cast("double").alias("value"), "p.is_null_mark", "p.is_percent", "p.negative_by")


def number_parse_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, PRINTED).select("l_orderkey", "l_linenumber", numbers.parse_b(F.col("raw")).cast("double").alias("value"))


def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS v FROM lineitem")
    return rows.select("l_orderkey", "l_linenumber", numbers.to_crore(F.col("v"), _element(list(numbers.CRORE_PER), "l_linenumber")).cast("double").alias("crore"), numbers.to_rupees(F.col("v"), _element(list(numbers.RUPEES_PER), "l_linenumber")).cast("double").alias("rupees"))


def unit_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT event_id FROM events").withColumn("caption", _element(CAPTIONS, "event_id"))
    return rows.select("event_id", units.unit_a(F.col("caption")).alias("unit_a"), units.unit_b(F.col("caption"))["unit"].alias("unit_b"))


def format_indian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 1000) AS v FROM orders").select("o_orderkey", numbers.indian(F.col("v")).alias("text"))


def printed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, PRINTED).select("l_orderkey", "l_linenumber", numbers.step(F.col("raw"), F.lit(10)).alias("step"), numbers.half_unit(F.col("raw"), F.lit(10)).alias("half"))


def period_parse_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, HEADERS).select("o_orderkey", periods.period_a(F.col("header")).alias("p")).select("o_orderkey", "p.label", "p.months")


def period_parse_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = portable(spark, sf_dir, HEADERS).select("o_orderkey", periods.period_b(F.col("header")).alias("p"))
    return p.select("o_orderkey", periods.period_key(F.col("p")).alias("period_key"), periods.fiscal_key(F.col("p")).alias("fiscal_key"))


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT p_partkey FROM part").withColumn("label", _element(LABELS, "p_partkey"))
    return rows.select("p_partkey", labels.match_a(F.col("label"))["field"].alias("field"), labels.concept_b(F.col("label")).alias("concept"))


def key_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT concat(CASE WHEN o_orderkey % 2 = 0 THEN 'financials.' ELSE 'issue.' END, lower(substr(o_orderpriority, 3, 10)), '.FY', CAST(year(o_orderdate) AS VARCHAR(4))) AS key FROM orders")
    return rows.groupBy(labels.family(F.col("key")).alias("family")).agg(F.count("*").alias("n"))


def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars FROM pages".replace(", 'g'", ""))
    return rows.select("page_id", d.page_kind(F.col("chars") % 60, F.col("page_id") % 3 * 0.02, F.col("page_id") % 4 * 0.25, F.col("page_id") % 5 * 0.06).alias("kind"), d.needs_ocr(F.col("chars") % 60, F.col("page_id") % 2).alias("needs_ocr"))


def garbled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT doc_id, concat(text, CASE doc_id % 3 WHEN 0 THEN '(cid:12)' WHEN 1 THEN chr(127) ELSE '' END) AS text FROM documents")
    return rows.select("doc_id", F.round(d.garbled_ratio(F.col("text")), 9).alias("ratio"))


def sector_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents, their texts as pages; words of the corpus stand for a sector's."""
    pages = portable(spark, sf_dir, "SELECT source AS doc_id, doc_id AS page, text FROM documents")
    return d.sectors(pages, front=10**12, found={"lender": (["the"], 30), "real_estate": (["und", "der"], 30)})


TYPE_HEADS = ["DRAFT RED HERRING PROSPECTUS dated", "Red Herring Prospectus", "prospectus", "Annual Report 2024", "Report of the auditor", "minutes"]
ISSUE_HEADS = ["a fresh issue and an offer for sale", "a fresh issue aggregating up to ₹7,000 million", "an offer for sale of Rs. 1,200.50 lakhs", "made pursuant to Regulation 6(1) of the regulations", "made pursuant to Regulation 6 (2) of them"]


def _whole_texts(spark: SparkSession, sf_dir: str, heads: list[str]) -> DataFrame:
    """Whole texts with wording added at their end, so that all of a text is searched before it."""
    rows = portable(spark, sf_dir, "SELECT doc_id, coalesce(text, '') AS text FROM documents")
    return rows.select("doc_id", F.concat("text", F.lit(" "), _element(heads, "doc_id")).alias("t"))


def doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole_texts(spark, sf_dir, TYPE_HEADS).select("doc_id", d.document_type(F.col("t")).alias("doc_type"))


def narrative_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = portable(spark, sf_dir, "SELECT source AS doc_id, doc_id AS page, text FROM documents")
    return d.first_hits(pages, {"licensed": d.said(F.col("words"), "licensed under"), "password": d.said(F.col("words"), "password", "token")}).select("doc_id", "fact", "page")


#: Statements of offer documents, true and otherwise, each behind a whole given text.
STATEMENTS = [
    "Our Company, its Promoters and its Directors have not been debarred from accessing the capital markets.", "None of our Promoters or Directors are promoters or directors of any other company which is debarred.", "Neither our Company nor any of its Directors has been identified as a Wilful Defaulter.",
    "None of our Directors is a fugitive economic offender.", "Not less than 75% of the Net Offer shall be available for allocation to QIBs.", "The Promoter contribution shall be locked-in for a period of eighteen months.", "Shares of the Promoter are locked in for a period of three years.",
    "One of our Directors is a wilful defaulter.", "Our Directors were debarred from the securities market.", "Whether or not he is a fugitive economic offender is unknown.", "Not less than 75% of the votes were cast.", "Shares shall be locked-in for a period of one year.",
]


def narrative_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.narrative(_whole_texts(spark, sf_dir, [f". {x}" for x in STATEMENTS]).select("doc_id", F.lit(1).alias("page"), F.col("t").alias("text"))).select("doc_id", "fact", "value")


def issue_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _whole_texts(spark, sf_dir, ISSUE_HEADS)
    return rows.select("doc_id", d.issue_type(F.col("t")).alias("issue_type"), d.route(F.col("t")).alias("route"), F.size(d.amounts(F.col("t"))).alias("n_amounts"))


MENTIONS = "SELECT l_suppkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'ofs' ELSE 'total' END AS key, CAST(floor(l_quantity / 10) AS BIGINT) AS value, l_orderkey * 10 + l_linenumber AS place FROM lineitem"


def most_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.most_printed(portable(spark, sf_dir, MENTIONS))


def issue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.issue_totals(portable(spark, sf_dir, MENTIONS), 0.0)


def debt_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_custkey AS doc_id, CAST(o_orderkey % 5 + 1 AS DOUBLE) AS value FROM orders")
    return d.debt_total(rows)


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT l_orderkey AS table_id, l_linenumber AS row_no, 'part' AS label, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey AS table_id, 100 AS row_no, 'Total' AS label, SUM(l_quantity) + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS value FROM lineitem GROUP BY l_orderkey")
    return d.running_totals(rows)


def objects_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT l_orderkey AS table_id, CASE WHEN l_linenumber = 1 THEN 'lakh' END AS unit, CASE WHEN l_returnflag = 'R' THEN 'Net Proceeds' ELSE 'other' END AS label, l_quantity > 45 AS foots FROM lineitem")
    return d.objects_table(rows)


def tabular_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_custkey AS doc_id, 1 AS page, CASE WHEN o_orderkey % 4 = 0 THEN 'as at March' WHEN o_orderkey % 4 = 1 THEN concat(CAST(o_orderkey AS VARCHAR(20)), ' 12.5') ELSE 'prose' END AS text FROM orders")
    return d.tabular(rows)


def monitoring_agency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN 'We have appointed X as the monitoring agency' WHEN o_orderkey % 13 = 0 THEN 'we are not required to appoint a monitoring agency' ELSE 'prose' END AS text FROM orders")
    return d.monitoring_agency(rows)


def _case(key: str, values: list) -> str:
    said = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {said(v)}" for k, v in enumerate(values)) + " END"


_NEG = "l_linenumber % 7 IN (1, 2, 4)"
_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
_FYM = "CASE WHEN month(o_orderdate) = 3 THEN 'FY' || year(o_orderdate) ELSE 'YE' || strftime(o_orderdate, '%Y-%m') END"
_IND = "CASE WHEN v < 1000 THEN v::VARCHAR WHEN v < 100000 THEN (v // 1000) || ',' || lpad((v % 1000)::VARCHAR, 3, '0') WHEN v < 10000000 THEN (v // 100000) || ',' || lpad((v // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((v % 1000)::VARCHAR, 3, '0') ELSE (v // 10000000) || ',' || lpad((v // 100000 % 100)::VARCHAR, 2, '0') || ',' || lpad((v // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((v % 1000)::VARCHAR, 3, '0') END"
_BKEY = f"""CASE o_orderkey % 6 WHEN 0 THEN 'AT-' || {_ISO} WHEN 1 THEN CASE WHEN strftime(o_orderdate, '%m-%d') = '03-31' THEN 'FY' || year(o_orderdate) ELSE '12M-' || {_ISO} END WHEN 2 THEN '?-' || {_ISO} WHEN 3 THEN 'FY' || (year(o_orderdate) + 1) WHEN 4 THEN '9M-' || {_ISO} ELSE 'FY' || year(o_orderdate) END"""
QUERIES: dict[str, Query] = {f.__name__: f for f in (number_parse_a, number_parse_b, unit_convert, unit_detect, format_indian, printed_steps, period_parse_a, period_parse_b, label_match, key_families, page_classify, garbled_ratio, sector_mentions, doc_type, narrative_first_hit, narrative_facts, issue_prose, most_printed, issue_totals, debt_total, running_totals, objects_table, tabular_pages, monitoring_agency)}
ORACLE: dict[str, str] = {
    "number_parse_a": f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 5 THEN NULL WHEN {_NEG} THEN -floor(l_extendedprice) WHEN l_linenumber % 7 = 3 THEN floor(l_extendedprice) + 0.5 ELSE floor(l_extendedprice) END AS value, l_linenumber % 7 = 5 AS is_null_mark, l_linenumber % 7 = 6 AS is_percent, CASE l_linenumber % 7 WHEN 1 THEN 'parentheses' WHEN 2 THEN 'minus' WHEN 4 THEN 'trailing minus' END AS negative_by FROM lineitem",
    "number_parse_b": "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN floor(l_extendedprice) WHEN 1 THEN -floor(l_extendedprice) WHEN 2 THEN -floor(l_extendedprice) WHEN 3 THEN floor(l_extendedprice) + 0.5 WHEN 5 THEN 0.0 END AS value FROM lineitem",
    "unit_convert": "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) * CASE l_linenumber % 6 WHEN 0 THEN 0.0000001 WHEN 1 THEN 0.0001 WHEN 2 THEN 0.01 WHEN 3 THEN 0.1 WHEN 4 THEN 1 ELSE 100 END AS DOUBLE) AS crore, CAST(floor(l_extendedprice) * CASE l_linenumber % 6 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 WHEN 3 THEN 1000000 WHEN 4 THEN 10000000 ELSE 1000000000 END AS DOUBLE) AS rupees FROM lineitem",
    "unit_detect": f"SELECT event_id, {_case('event_id', ['INR_LAKH', 'INR_MILLION', None, None, 'INR_BILLION', 'INR', None])} AS unit_a, {_case('event_id', ['lakh', 'million', 'crore', None, 'billion', None, None])} AS unit_b FROM events",
    "format_indian": f"SELECT o_orderkey, {_IND} AS text FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 1000) AS v FROM orders) t",
    "printed_steps": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 3 THEN 0.1 ELSE 10.0 END AS step, CASE WHEN l_linenumber % 7 = 3 THEN 0.05 ELSE 5.0 END AS half FROM lineitem",
    "period_parse_a": f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 'FY' || (year(o_orderdate) + 1) WHEN 4 THEN 'P' || {_ISO} || '-9M' WHEN 5 THEN 'FY' || year(o_orderdate) ELSE {_FYM} END AS label, CAST(CASE o_orderkey % 6 WHEN 4 THEN 9 ELSE 12 END AS INT) AS months FROM orders",
    "period_parse_b": f"WITH k AS (SELECT o_orderkey, o_orderdate, {_BKEY} AS period_key FROM orders) SELECT o_orderkey, period_key, CASE WHEN strftime(o_orderdate, '%m-%d') = '03-31' AND o_orderkey % 6 IN (0, 1, 2) THEN 'FY' || year(o_orderdate) ELSE period_key END AS fiscal_key FROM k",
    "label_match": f"SELECT p_partkey, {_case('p_partkey', ['net_worth', 'net_tangible_assets', None, 'revenue', 'revenue', None, None, None, None, None, None, None, None])} AS field, {_case('p_partkey', [None, None, None, 'revenue_from_operations', 'revenue_from_operations', 'profit_before_tax', 'total_assets', 'total_equity_and_liabilities', 'other_income', None, 'trade_receivables', 'cash_from_operations', None])} AS concept FROM part",
    "key_families": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'financials.' || lower(substr(o_orderpriority, 3, 10)) ELSE 'issue' END AS family, count(*) AS n FROM orders GROUP BY ALL",
    "page_classify": "WITH p AS (SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) % 60 AS c FROM pages) SELECT page_id, CASE WHEN c < 25 AND page_id % 3 * 0.02 < 0.05 THEN 'blank' WHEN c < 25 THEN 'scanned' WHEN page_id % 5 * 0.06 > 0.2 THEN 'garbled' WHEN page_id % 4 * 0.25 < 0.5 THEN 'rotated' ELSE 'native' END AS kind, c < 25 AND page_id % 2 > 0 AS needs_ocr FROM p",
    "garbled_ratio": r"WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN '(cid:12)' WHEN 1 THEN chr(127) ELSE '' END AS text FROM documents) SELECT doc_id, round(least(1.0, CAST(length(text) - length(regexp_replace(text, '[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0E-\x1F\x7F]', '', 'g')) + 5 * len(regexp_extract_all(text, '\(cid:')) AS DOUBLE) / greatest(length(text), 1)), 9) AS ratio FROM t",
    "sector_mentions": r"WITH m AS (SELECT source AS doc_id, sum(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w = 'the'))) AS a, sum(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ('und', 'der')))) AS b FROM documents GROUP BY source), l AS (SELECT doc_id, 'lender' AS sector, CAST(a AS BIGINT) AS mentions FROM m UNION ALL SELECT doc_id, 'real_estate', CAST(b AS BIGINT) FROM m) SELECT doc_id, sector, mentions, CAST(30 AS INT) AS threshold FROM l WHERE mentions >= 30",
    "doc_type": f"SELECT doc_id, {_case('doc_id', ['drhp', 'rhp', 'prospectus', 'annual_report', 'financial_statements', None])} AS doc_type FROM documents",
    "narrative_first_hit": "SELECT source AS doc_id, 'licensed' AS fact, min(doc_id) AS page FROM documents WHERE regexp_matches(text, '(?i)(^|[^a-z])licensed[^a-z0-9()]+under([^a-z]|$)') GROUP BY source UNION ALL SELECT source, 'password', min(doc_id) FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: w IN ('password', 'token'))) > 0 GROUP BY source",
    "issue_prose": f"SELECT doc_id, {_case('doc_id', ['mixed', 'fresh', 'offer_for_sale', None, None])} AS issue_type, {_case('doc_id', [None, None, None, '6(1)', '6(2)'])} AS route, CAST(CASE WHEN doc_id % 5 IN (1, 2) THEN 1 ELSE 0 END AS INT) AS n_amounts FROM documents",
    "most_printed": f"SELECT doc_id, key, value, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY n DESC, first) AS r FROM (SELECT doc_id, key, value, count(*) AS n, min(place) AS first FROM ({MENTIONS}) m GROUP BY ALL) c) t WHERE r = 1",
    "issue_totals": f"WITH c AS (SELECT doc_id, key, CAST(value AS DOUBLE) AS v, count(*) AS n, min(place) AS first FROM ({MENTIONS}) m GROUP BY ALL), t AS (SELECT f.doc_id, f.v AS fresh, o.v AS ofs, t.v AS total, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.n + o.n + t.n DESC, f.first + o.first + t.first, f.v DESC) AS r FROM c f JOIN c o ON f.doc_id = o.doc_id JOIN c t ON f.doc_id = t.doc_id WHERE f.key = 'fresh' AND o.key = 'ofs' AND t.key = 'total' AND f.v + o.v = t.v), k AS (SELECT doc_id, key, v, row_number() OVER (PARTITION BY doc_id, key ORDER BY n DESC, first) AS r FROM c), w AS (SELECT doc_id, max(v) FILTER (WHERE key = 'fresh') AS fresh, max(v) FILTER (WHERE key = 'ofs') AS ofs, max(v) FILTER (WHERE key = 'total') AS total FROM k WHERE r = 1 GROUP BY doc_id) SELECT w.doc_id, coalesce(t.fresh, w.fresh) AS fresh, coalesce(t.ofs, w.ofs) AS ofs, coalesce(t.total, w.total) AS total FROM w LEFT JOIN t ON t.doc_id = w.doc_id AND t.r = 1",
    "debt_total": "SELECT o_custkey AS doc_id, CASE WHEN sum(o_orderkey % 5 + 1) = 2 * max(o_orderkey % 5 + 1) THEN CAST(max(o_orderkey % 5 + 1) AS DOUBLE) ELSE CAST(sum(o_orderkey % 5 + 1) AS DOUBLE) END AS value FROM orders GROUP BY o_custkey",
    "running_totals": "SELECT l_orderkey AS table_id, count(*) >= 2 AND l_orderkey % 3 <> 0 AS foots FROM lineitem GROUP BY l_orderkey",
    "objects_table": "SELECT l_orderkey AS table_id FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_linenumber = 1) AND (bool_or(l_returnflag = 'R') OR bool_or(l_quantity > 45))",
    "tabular_pages": "SELECT o_custkey AS doc_id, 1 AS page, count(*) FILTER (WHERE o_orderkey % 4 = 0) >= 2 OR count(*) FILTER (WHERE o_orderkey % 4 = 1) >= 4 AS tabular FROM orders GROUP BY o_custkey",
    "monitoring_agency": "SELECT o_custkey AS doc_id, CAST(bool_or(o_orderkey % 11 = 0) AS INT) AS appointed FROM orders GROUP BY o_custkey HAVING bool_or(o_orderkey % 11 = 0) <> bool_or(o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0)",
}
# The SQL of doc_type and issue_prose goes by the wording alone; the same queries again, with SQL that searches the texts as well.
QUERIES |= {"doc_type_whole": doc_type, "issue_prose_whole": issue_prose}
_WHOLE = "SELECT doc_id, coalesce(text, '') || ' ' || {} AS t FROM documents"
ORACLE["doc_type_whole"] = f"WITH w AS ({_WHOLE.format(_case('doc_id', TYPE_HEADS))}) SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(t), '{words}') THEN '{kind}'" for words, kind in d.TYPES) + " END AS doc_type FROM w"
_SAID = {
    ("declarations.debarred_by_sebi", "false"): "(is|are|has|have) not (been )?(debarred|prohibited)[^.]*(securities|capital market)",
    ("declarations.promoter_or_director_of_debarred_company", "false"): "(none|neither)[^.]*(promoter|director)[^.]*compan(y|ies) which (is|are) debarred",
    ("declarations.wilful_defaulter_or_fraudulent_borrower", "false"): "(none|neither|(is|are|has|have) not)[^.]*wilful defaulter",
    ("declarations.fugitive_economic_offender", "false"): "(none|neither|(is|are|has|have) not)[^.]*fugitive economic offender",
    ("issue_details.qib_net_offer_allocation", "75"): "not less than 75% of the net offer[^.]*all?o[ct]",
    ("promoter.lock_in_months", "18"): "promoter[^.]*locked.in for a period of eighteen months",
    ("promoter.lock_in_months", "36"): "promoter[^.]*locked.in for a period of three years",
}
ORACLE["narrative_facts"] = f"WITH w AS ({_WHOLE.format(_case('doc_id', ['. ' + x for x in STATEMENTS]))}) " + " UNION ALL ".join(f"SELECT doc_id, '{fact}' AS fact, '{value}' AS value FROM w WHERE regexp_matches(lower(t), '{form}')" for (fact, value), form in _SAID.items())
ORACLE["issue_prose_whole"] = f"""
    WITH w AS ({_WHOLE.format(_case('doc_id', ISSUE_HEADS))}), f AS (SELECT *, contains(lower(t), 'fresh issue') AS fresh, contains(lower(t), 'offer for sale') AS ofs, regexp_extract(lower(t), 'made pursuant to regulation 6 *[(] *([12]) *[)] of ', 1) AS r FROM w)
    SELECT doc_id, CASE WHEN fresh AND ofs THEN 'mixed' WHEN fresh THEN 'fresh' WHEN ofs THEN 'offer_for_sale' END AS issue_type, CASE WHEN r <> '' THEN '6(' || r || ')' END AS route, CAST(len(regexp_extract_all(lower(t), '(₹|rs[.]|inr) ?[0-9][0-9,.]* (lakh|lakhs|million|crore)')) AS INT) AS n_amounts FROM f
"""
