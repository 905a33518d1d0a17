"""Headers of statements, hidden text, amounts in prose and summaries, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, numbers
from ..operators import candidates, consensus, documents, evidence, headers, layout, prose, ranking, summaries, workflow
from ..sources import files
from .geometry import ALL_BOXES, ALL_COLUMNS, LINES, WORDS
from .inputs import portable
from .texts import HEADERS, _FYM, _ISO

Query = Callable[[SparkSession, str], DataFrame]
VERSIONS = "SELECT concat(CAST(o_orderkey % 12 AS VARCHAR(5)), '.', CAST(o_custkey % 11 AS VARCHAR(5))) AS version, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'superseded' ELSE 'current' END AS status FROM orders"


def head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, WORDS).select("doc_id", "page", F.col("no").alias("word_no"), F.col("y").alias("top"), F.col("x").alias("x0"))
    return headers.lines_by_head(rows, 0.5).select("doc_id", "page", "word_no", "line")


BAND = "SELECT o_custkey AS doc_id, 1 AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey FROM orders"
BAND_LINES = f"SELECT doc_id, page, line, CAST(line * 20 + o_orderkey % 3 * 8 AS DOUBLE) AS top, CAST(line * 20 + o_orderkey % 3 * 8 + 10 AS DOUBLE) AS bottom, o_orderkey % 5 = 0 AS is_data, o_orderkey % 17 = 1 AND o_orderkey % 5 <> 0 AS is_caption, o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS is_header FROM ({BAND}) b"


def header_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.header_band(portable(spark, sf_dir, BAND_LINES), 3, 18.0).select("doc_id", "line", "data_line")


def header_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.headed(portable(spark, sf_dir, WORDS).select("doc_id", "page", "no", "x"), portable(spark, sf_dir, ALL_COLUMNS))


def header_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, f"SELECT l_orderkey AS doc_id, 1 AS page, 1 AS line, CAST(l_linenumber * 20 AS DOUBLE) AS x0, CAST(l_linenumber * 20 + 10 + l_partkey % 8 AS DOUBLE) AS x1, l_returnflag AS text FROM {LINES}")
    return headers.phrases(rows).select("doc_id", "phrase", "x", "text")


def period_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = portable(spark, sf_dir, HEADERS).select("o_orderkey", F.posexplode(F.split(F.concat(F.lit("Particulars "), "header"), " ")).alias("word_no", "text"))
    return headers.period_windows(words, ["o_orderkey"]).select("o_orderkey", "label")


def wrapped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_custkey AS doc_id, 1 AS page, o_orderkey AS line, make_date(CAST(year(o_orderdate) AS INT), 3, 31) AS end_day, CASE o_orderkey % 3 WHEN 0 THEN concat('31, ', CAST(year(o_orderdate) + 1 AS VARCHAR(4))) WHEN 1 THEN concat('30, ', CAST(year(o_orderdate) AS VARCHAR(4))) ELSE 'Total' END AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'year ended March' ELSE 'year ended' END AS above FROM orders")
    at = lambda a, b: (F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("x1"))
    on = ("doc_id", "page", "line")
    return headers.completed(rows.select(*on, F.col("end_day").alias("end"), *at(0, 50)), rows.select(*on, "text", *at(60, 100)), rows.select(*on, F.col("above").alias("text"))).select("line", "label")


def column_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_custkey AS doc_id, 1 AS page, o_orderkey * 4 AS line, o_orderkey FROM orders")
    word = lambda text, x: F.struct(F.lit(text).alias("text"), F.lit(float(x)).alias("x"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.array(word("(Consolidated)", 100), word("Standalone", 205))).otherwise(F.array(word("Revenue", 10), word("standalone", 205), word("figures", 240)))
    words = rows.select("doc_id", "page", (F.col("line") + 1).alias("line"), F.explode(said).alias("w")).select("doc_id", "page", "line", "w.x", "w.text")
    columns = rows.select("doc_id", "page", "line", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(float(x)).alias("x")) for c, x in ((1, 110), (2, 190))])).alias("c")).select("doc_id", "page", "line", "c.*")
    return headers.column_basis(words, columns).select("line", "col", "basis")


def nearest_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, f"SELECT l_orderkey AS doc_id, 1 AS table_no, l_linenumber AS col, concat('h', CAST(l_linenumber AS VARCHAR(3))) AS header, l_returnflag = 'R' AS dated, CAST(l_quantity AS INT) % 5 AS figures FROM {LINES}")
    return headers.nearest_dated(rows).select("doc_id", "col", "header")


OWN = "SELECT o_custkey AS doc_id, o_orderkey % 3 AS page, o_orderkey AS table_no, CASE WHEN o_orderkey % 2 = 0 THEN 'own' END AS caption FROM orders"
LENT = "SELECT o_custkey AS doc_id, o_orderkey % 3 AS page, o_orderkey AS line, o_orderpriority AS caption FROM orders WHERE o_orderkey % 5 = 0"


def borrowed_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.borrowed_caption(portable(spark, sf_dir, OWN), portable(spark, sf_dir, LENT)).select("doc_id", "table_no", "caption")


def prose_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT conv_id AS doc_id, 1 AS page, turn AS line, text FROM conversations")
    words = rows.select("doc_id", "page", "line", F.posexplode(F.split("text", " ")).alias("x", "text")).withColumn("x", F.col("x").cast("double"))
    columns = rows.where("line % 2 = 0").select("doc_id", "page", "line", F.lit(2.0).alias("x0"), F.lit(4.0).alias("x1"))
    return headers.prose_words(words, columns).select("doc_id", "line", "n")


def readable_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, WORDS).select("doc_id", "page", "no", F.col("x").alias("x0"), (F.col("x") + 5).alias("x1"), F.col("y").alias("top"), (F.col("y") + 10).alias("bottom"), (F.col("width") / 10).alias("size"))
    return headers.readable(rows, 5000.0, 700.0).select("doc_id", "page", "no")


def invisible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.invisible(portable(spark, sf_dir, WORDS).select("doc_id", "page", "x", "y", (F.col("no") % 7 == 0).alias("is_white")), portable(spark, sf_dir, ALL_BOXES))


CHARS = f"SELECT doc_id, page, no, CAST(no * 37 % 200 AS DOUBLE) AS x0, CAST(no * 37 % 200 + 3 + no % 5 AS DOUBLE) AS x1, CAST(no * 13 % 20 AS DOUBLE) AS top, no % 3 = 0 AS is_blank FROM ({WORDS}) w"


def overlapping_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.overlapping_spaces(portable(spark, sf_dir, CHARS))


OFFER = "SELECT o_orderkey AS doc_id, 1 AS page, o_orderkey, CAST(floor(o_totalprice / 1E3) AS BIGINT) AS a, o_custkey % 900 + 1 AS b FROM orders"


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sentences on an offer, five ways."""
    said = F.array(
        F.concat(F.lit("The offer comprises a fresh issue of shares aggregating up to ₹"), "a", F.lit(" million and an offer for sale of shares aggregating to Rs. "), "b", F.lit(" crore. Risk Factors follow.")),
        F.concat(F.lit("Initial public issue aggregating to ₹ "), "a", F.lit('.50 lakhs (the "Issue" or "Fresh Issue").')),
        F.concat(F.lit("Offer aggregating up to INR "), "a", F.lit(" mn comprising of a fresh issue of shares.")),
        F.concat(F.lit("Fresh Issue ₹"), "a", F.lit(" Lakhs Nil ₹"), "a", F.lit(" Lakhs")),
        F.concat(F.lit("A fresh issue and a private placement aggregating to ₹"), "a", F.lit(" million.")),
    )
    return portable(spark, sf_dir, OFFER).select("doc_id", "page", F.get(said, (F.col("o_orderkey") % 5).cast("int")).alias("text"))


def issue_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.with_total(prose.issue_mentions(_offers(spark, sf_dir)).select("doc_id", "key", "value"))


def cover_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, OFFER)
    money = lambda c: F.concat(F.lit("aggregating up to ₹ "), F.col(c).cast("string"), F.lit(" crore"))
    head = F.when(F.col("o_orderkey") % 4 == 0, F.array(*map(F.lit, ("Type", "Total", "Offer for sale", "Fresh issue")))).otherwise(F.array(*map(F.lit, ("Type", "Fresh Issue size", "Offer for Sale size", "Total size"))))
    body = F.array(F.lit("Fresh Issue and Offer for Sale"), money("a"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("[●]")).otherwise(money("b")), money("a"))
    table = rows.select("doc_id", F.lit(1).alias("table_id"), F.posexplode(F.array(head, body)).alias("row_no", "cells"))
    return prose.cover_amounts(table).select("doc_id", "key", "value")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, ("We are eligible under Regulation 6(1) of the rules.", "It is eligible under Regulation 6(2). Terms follow.", "The Book Building Process applies.", "A fresh issue and an offer for sale.", "prose")))
    pages = portable(spark, sf_dir, "SELECT source AS doc_id, doc_id AS page, coalesce(text, '') AS text FROM documents").select("doc_id", "page", F.concat("text", F.lit(". "), F.get(said, (F.col("page") % 5).cast("int"))).alias("text"))
    return documents.suggestions(pages).select("doc_id", "suggestion", "value")


def statement_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.statement_basis(portable(spark, sf_dir, "SELECT l_orderkey AS doc_id, CASE l_returnflag WHEN 'R' THEN 'consolidated' WHEN 'A' THEN 'standalone' END AS basis FROM lineitem"))


RUN_PAGES = "SELECT l_suppkey AS doc_id, l_orderkey AS page, CASE WHEN l_linenumber % 3 = 0 THEN 'ocr' ELSE 'native' END AS method, l_linenumber % 5 <> 4 AS readable, l_linestatus AS warning FROM (SELECT l_suppkey, l_orderkey, MIN(l_linenumber) AS l_linenumber, MIN(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_suppkey, l_orderkey) x"
OUTCOMES = "SELECT s_suppkey AS doc_id, CASE (s_suppkey + k) % 4 WHEN 0 THEN 'extracted_high_confidence' WHEN 1 THEN 'extracted_needs_verification' WHEN 2 THEN 'conflicting_candidates' ELSE 'not_found' END AS status FROM supplier CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 6) y"


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.run_metrics(portable(spark, sf_dir, RUN_PAGES), portable(spark, sf_dir, OUTCOMES))


def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, RUN_PAGES).withColumn("warnings", F.array(F.concat(F.lit("page status "), "warning"), F.lit("deskew of 2 degrees")))
    return summaries.run_warnings(rows).select("doc_id", F.array_join("warnings", "|").alias("warnings"))


BENCH_ROWS = "SELECT l_suppkey AS doc_id, CASE WHEN l_suppkey % 3 = 0 THEN 'holdout' ELSE 'dev' END AS split, concat('f', CAST(l_linenumber AS VARCHAR(2))) AS field, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE 1 END AS expected, CASE WHEN l_orderkey % 9 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'correct_abstention' ELSE 'wrong_abstention' END WHEN l_returnflag = 'R' THEN 'correct' WHEN l_orderkey % 4 = 1 THEN 'wrong' WHEN l_orderkey % 4 = 2 THEN 'wrong_page' ELSE 'missing' END AS outcome, l_linestatus = 'O' AS high, CASE WHEN l_orderkey % 5 = 0 THEN 'conflicting_candidates' ELSE 'found' END AS status FROM lineitem"


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.benchmark(portable(spark, sf_dir, BENCH_ROWS))


PARSED = "SELECT o_custkey AS doc_id, o_orderkey AS page, o_orderkey % 60 AS alnum, o_orderkey % 60 < 25 AND o_orderkey % 2 = 0 AS needs_ocr, CASE WHEN o_orderkey % 19 = 0 THEN 'bad' END AS error, o_orderkey % 7 AS blocks, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS printed_page FROM orders"
PARSED_TABLES = "SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'lakh' END AS unit, o_orderkey % 3 AS stitched_from, o_orderkey % 10 = 0 AS transposed FROM orders WHERE o_orderstatus = 'F'"


def parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.parse_statistics(portable(spark, sf_dir, PARSED), portable(spark, sf_dir, PARSED_TABLES))


VALUES = "SELECT l_suppkey AS doc_id, l_orderkey % 3 <> 0 AS verified, CASE WHEN l_linenumber <> 7 THEN 'FY' END AS period, CASE WHEN l_linenumber <> 6 THEN 'lakh' END AS unit FROM lineitem"
GROUPS = "SELECT l_suppkey AS doc_id, COUNT(*) AS total, COUNT(CASE WHEN l_linestatus = 'O' THEN 1 END) AS supporters, MIN(l_orderkey) AS k FROM lineitem GROUP BY l_suppkey, l_linenumber"


def analysis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = portable(spark, sf_dir, GROUPS)
    status = F.element_at(F.array(*map(F.lit, ("flagged", "clear", "missing_inputs", "not_in_force"))), (F.col("k") % 4 + 1).cast("int"))
    return summaries.analysis_summary(portable(spark, sf_dir, VALUES), groups.select("doc_id", (F.col("k") % 2 == 0).alias("ok")), groups.select("doc_id", "total", "supporters"), groups.select("doc_id", status.alias("status")))


RESULTS = "SELECT o_custkey AS case_id, o_orderkey AS ord, CASE o_orderkey % 7 WHEN 0 THEN 'NTA_3CR' WHEN 1 THEN 'NET_WORTH_1CR' ELSE 'RULE' END AS rule_id, CASE o_orderstatus WHEN 'F' THEN 'fail' WHEN 'O' THEN 'inconclusive' ELSE 'pass' END AS verdict, o_orderkey % 2 = 0 AS review, o_orderkey % 3 <> 0 AS mandatory FROM orders"
CASE_YEARS = "SELECT o_custkey AS case_id, year(o_orderdate) AS fy, CAST(floor(SUM(o_totalprice)) AS BIGINT) AS revenue, o_custkey % 5 <> 0 AS reliable FROM orders GROUP BY o_custkey, year(o_orderdate)"


def unresolved_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = {"missing": F.when(F.col("ord") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")), "reasons": F.array(F.lit("low"), F.lit("old"))}
    return summaries.unresolved(portable(spark, sf_dir, RESULTS).withColumns(lists)).select("case_id", F.array_join("issues", "|").alias("issues"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.observations(portable(spark, sf_dir, RESULTS), portable(spark, sf_dir, CASE_YEARS))


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summaries.timings(portable(spark, sf_dir, "SELECT event_type AS name, floor(value * 100) AS seconds FROM events"))
    return rows.withColumn("mean", F.round("mean", 6))


KINDS = "SELECT o_custkey AS doc_id, concat('financials.', o_orderstatus, '.FY', CAST(o_orderkey AS VARCHAR(12))) AS key, CASE o_orderkey % 4 WHEN 0 THEN 'moved' WHEN 1 THEN 'same' WHEN 2 THEN 'added' ELSE 'removed' END AS kind FROM orders"


def difference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.shown(portable(spark, sf_dir, KINDS)).select("doc_id", "key", "place")


def one_sided_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.one_sided(portable(spark, sf_dir, KINDS))


# --- code that had no query ------------------------------------------------------------------------------------------
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'conflicting_candidates' WHEN 1 THEN 'extracted_needs_verification' ELSE 'extracted_high_confidence' END AS status, CASE WHEN o_custkey % 4 = 1 THEN 'high' WHEN o_custkey % 4 = 2 THEN 'medium' ELSE 'high' END AS confidence FROM orders")
    return rows.select("o_orderkey", evidence.review_reason(F.col("status"), F.col("confidence")).alias("reason"))


def statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_orderkey, o_orderkey % 2 = 0 AS instant, CAST(o_orderdate AS DATE) AS day FROM orders")
    return rows.select("o_orderkey", consensus.statement_kind(F.col("instant"), F.lit(12), F.col("day")).alias("kind"))


def skipped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Notes' WHEN 1 THEN concat('FY', CAST(year(o_orderdate) AS VARCHAR(4))) WHEN 2 THEN 'Sr. No.' WHEN 3 THEN '% of total' ELSE 'Notebook' END AS header FROM orders")
    return rows.select("o_orderkey", labels.skipped_column(F.col("header")).alias("skipped"))


def note_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT l_orderkey AS table_no, l_linenumber AS col, CAST(CAST(l_quantity AS INT) % 40 AS VARCHAR(5)) AS text FROM lineitem")
    return labels.note_columns(rows).select("table_no", "col")


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: (F.col("l_orderkey") % n) / F.lit(float(n))
    rows = portable(spark, sf_dir, "SELECT l_orderkey, l_linenumber FROM lineitem").select("l_orderkey", "l_linenumber", candidates.score(part(2), part(4), part(5), part(8), part(10), F.lit(1.0)).alias("score"))
    return rows.select("l_orderkey", "l_linenumber", "score", candidates.confidence(F.col("score")).alias("confidence"))


def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT doc_id, concat(coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN concat(' page ', CAST(doc_id % 900 AS VARCHAR(5))) ELSE ' end.' END) AS text FROM documents")
    return rows.select("doc_id", labels.printed_page(F.col("text")).alias("printed"))


def rejected_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_custkey AS document_id, o_orderkey AS seq FROM orders")
    return workflow.rejected(rows, portable(spark, sf_dir, "SELECT c_custkey AS document_id FROM customer WHERE c_custkey % 3 = 0"), "document_id", "seq").select("document_id", "seq")


def executable_rulesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.executable(portable(spark, sf_dir, VERSIONS)).select("o_orderkey", "version")


def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, VERSIONS)
    return rows.groupBy("status").agg(F.max_by("version", ranking.version_key(F.col("version"))).alias("version"), F.countDistinct("version").alias("n"))


def money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders")
    return rows.select("o_orderkey", numbers.crore_text(F.col("v") / 8).alias("crore"), numbers.percent_text(F.col("v") % 1000 / 8).alias("percent"))


TALL = f"SELECT doc_id, page, no, y AS y0, y + width AS y1 FROM ({WORDS}) w"
BOXED = f"SELECT doc_id, page, 1 AS box, y0, y1 FROM ({ALL_BOXES}) b UNION ALL SELECT doc_id, page, 2 AS box, y0 + 300 AS y0, y0 + 310 AS y1 FROM ({ALL_BOXES}) c"


def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlapping(portable(spark, sf_dir, TALL), portable(spark, sf_dir, BOXED))


LOG = "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events WHERE event_type <> 'error'"
ENTRIES = "SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'"


def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.logged(portable(spark, sf_dir, LOG), portable(spark, sf_dir, ENTRIES), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("seq").cast("long").alias("seq"))


# --- the same in SQL -------------------------------------------------------------------------------------------------
_VOCAB = ", ".join(f"'{w}'" for w in headers.VOCABULARY)
_RATES = "round(correct / CAST(nullif(correct + wrong, 0) AS DOUBLE), 4) AS precision, round(correct / CAST(nullif(scored, 0) AS DOUBLE), 4) AS recall, round(missing / CAST(nullif(scored, 0) AS DOUBLE), 4) AS missing_rate, round(false_high / CAST(nullif(scored, 0) AS DOUBLE), 4) AS false_high_rate"
_N = lambda c: f"count(*) FILTER (WHERE {c})"
ORACLE: dict[str, str] = {
    "head_lines": f"SELECT doc_id, page, no AS word_no, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY y) AS line FROM ({WORDS}) w",
    "header_band": f"""WITH l AS (SELECT *, is_caption OR coalesce(lead(top) OVER (PARTITION BY doc_id ORDER BY line) - bottom > 18, FALSE) AS stops FROM ({BAND_LINES}) b), h AS (SELECT *, (SELECT min(d.line) FROM l d WHERE d.doc_id = l.doc_id AND d.line >= l.line AND d.is_data) AS data_line FROM l)
        SELECT doc_id, line, data_line FROM h WHERE is_header AND data_line - line <= 3 AND NOT EXISTS (SELECT 1 FROM l s WHERE s.doc_id = h.doc_id AND s.line >= h.line AND s.line < h.data_line AND s.stops)""",
    "header_columns": f"WITH b AS (SELECT doc_id, page, col, coalesce(((lag(c.at) OVER w) + c.at) / 2, c.at - ((lead(c.at) OVER w) - c.at) / 2, c.at - 60) AS x FROM ({ALL_COLUMNS}) c WINDOW w AS (PARTITION BY doc_id, page ORDER BY c.at)) SELECT w.doc_id, w.page, w.no, b.col FROM ({WORDS}) w ASOF LEFT JOIN b ON w.doc_id = b.doc_id AND w.page = b.page AND w.x >= b.x",
    "header_phrases": f"""WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber * 20 AS x0, l_linenumber * 20 + 10 + l_partkey % 8 AS x1, l_returnflag AS text FROM {LINES}), g AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x0) > 6, TRUE) AS apart FROM t),
        p AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY doc_id ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS phrase FROM g) SELECT doc_id, CAST(phrase AS BIGINT) AS phrase, (min(x0) + max(x1)) / 2.0 AS x, string_agg(text, ' ' ORDER BY x0) AS text FROM p GROUP BY doc_id, phrase""",
    "period_windows": f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 'FY' || (year(o_orderdate) + 1) WHEN 4 THEN 'P' || {_ISO} || '-9M' WHEN 5 THEN 'FY' || year(o_orderdate) ELSE {_FYM} END AS label FROM orders",
    "wrapped_headers": "SELECT o_orderkey AS line, 'FY' || (year(o_orderdate) + 1) AS label FROM orders WHERE o_orderkey % 6 = 0",
    "column_basis": "SELECT o_orderkey * 4 AS line, unnest([1, 2]) AS col, unnest(['consolidated', 'standalone']) AS basis FROM orders WHERE o_orderkey % 3 = 0",
    "nearest_dated": f"WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS col, l_returnflag = 'R' AS dated, CAST(l_quantity AS INT) % 5 AS figures FROM {LINES}), m AS (SELECT b.doc_id, b.col, 'h' || d.col AS header, row_number() OVER (PARTITION BY b.doc_id, b.col ORDER BY abs(d.col - b.col), d.col DESC) AS r FROM h b JOIN h d ON b.doc_id = d.doc_id AND abs(b.col - d.col) <= 2 WHERE NOT b.dated AND b.figures >= 2 AND d.dated) SELECT doc_id, col, header FROM m WHERE r = 1",
    "borrowed_caption": f"WITH f AS (SELECT doc_id, page, arg_min(caption, line) AS lent FROM ({LENT}) l GROUP BY ALL) SELECT t.doc_id, t.table_no, coalesce(t.caption, f.lent) AS caption FROM ({OWN}) t LEFT JOIN f ON t.doc_id = f.doc_id AND t.page = f.page",
    "prose_words": f"""WITH s AS (SELECT conv_id AS doc_id, turn AS line, string_split(text, ' ') AS w FROM conversations), e AS (SELECT doc_id, line, unnest(w) AS text, unnest(range(len(w))) AS x FROM s)
        SELECT doc_id, line, count(*) AS n FROM e WHERE regexp_matches(text, '\\p{{L}}') AND regexp_replace(lower(text), '^[(),.:]+|[(),.:]+$', '', 'g') NOT IN ({_VOCAB}) AND NOT (line % 2 = 0 AND x BETWEEN 1 AND 5) GROUP BY ALL""",
    "readable_chars": f"SELECT doc_id, page, no FROM ({WORDS}) w WHERE width / 10 >= 1 AND x <= 5005 AND y <= 705",
    "invisible_text": f"SELECT doc_id, page, count(*) AS n FROM ({WORDS}) w WHERE no % 7 = 0 AND NOT EXISTS (SELECT 1 FROM ({ALL_BOXES}) b WHERE b.doc_id = w.doc_id AND b.page = w.page AND w.x BETWEEN b.x0 AND b.x1 AND w.y BETWEEN b.y0 AND b.y1) GROUP BY ALL",
    "overlapping_spaces": f"WITH c AS ({CHARS}) SELECT DISTINCT b.doc_id, b.page, b.no FROM c b JOIN c g ON b.doc_id = g.doc_id AND b.page = g.page AND abs(b.top - g.top) <= 1 AND (b.x0 + b.x1) / 2 > g.x0 + 0.3 AND (b.x0 + b.x1) / 2 < g.x1 - 0.3 WHERE b.is_blank AND NOT g.is_blank",
    "issue_amounts": f"""WITH o AS ({OFFER}), r AS (SELECT doc_id, 'fresh' AS key, a * 1e6 AS value, 'stated' AS method FROM o WHERE o_orderkey % 5 = 0 UNION ALL SELECT doc_id, 'ofs', b * 1e7, 'stated' FROM o WHERE o_orderkey % 5 = 0 UNION ALL SELECT doc_id, 'total', a * 1e6 + b * 1e7, 'derived' FROM o WHERE o_orderkey % 5 = 0
        UNION ALL SELECT doc_id, unnest(['fresh', 'total']), (a + 0.5) * 1e5, 'stated' FROM o WHERE o_orderkey % 5 = 1 UNION ALL SELECT doc_id, 'total', a * 1e6, 'stated' FROM o WHERE o_orderkey % 5 = 2 UNION ALL SELECT doc_id, unnest(['fresh', 'total']), a * 1e5, 'stated' FROM o WHERE o_orderkey % 5 = 3) SELECT doc_id, key, CAST(value AS DOUBLE) AS value, method FROM r""",
    "cover_amounts": f"SELECT doc_id, unnest(['fresh', 'ofs', 'total']) AS key, CAST(unnest([a, b, a]) * 1e7 AS DOUBLE) AS value FROM ({OFFER}) o WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0",
    "suggestions": f"""WITH p AS (SELECT source AS doc_id, doc_id AS page FROM documents), s AS (SELECT doc_id, {_N('page % 5 = 1')} AS two, {_N('page % 5 = 0')} AS one, {_N('page % 5 = 2')} AS built, {_N('page % 5 = 3')} AS mixed FROM p GROUP BY doc_id)
        SELECT doc_id, 'listing_route' AS suggestion, CASE WHEN two > 0 THEN 'mainboard_reg6_2' ELSE 'mainboard_reg6_1' END AS value FROM s WHERE one + two > 0 UNION ALL SELECT doc_id, 'is_book_built', 'true' FROM s WHERE built > 0 UNION ALL SELECT doc_id, 'issue_type', 'mixed' FROM s WHERE mixed > 0""",
    "statement_basis": "SELECT l_orderkey AS doc_id, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') >= count(*) FILTER (WHERE l_returnflag = 'A') AND count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'consolidated' WHEN count(*) FILTER (WHERE l_returnflag = 'A') > 0 THEN 'standalone' ELSE 'unknown' END AS statement_basis FROM lineitem GROUP BY l_orderkey",
    "run_metrics": f"WITH p AS (SELECT doc_id, count(*) AS pages, {_N(chr(39).join(('method = ', 'native', '')))} AS native_pages, {_N(chr(39).join(('method = ', 'ocr', '')))} AS ocr_pages, {_N('NOT readable')} AS unreadable_pages FROM ({RUN_PAGES}) a GROUP BY doc_id), o AS (SELECT doc_id, count(*) FILTER (WHERE status = 'extracted_high_confidence') AS fields_high, count(*) FILTER (WHERE status = 'extracted_needs_verification') AS fields_needs_verification, count(*) FILTER (WHERE status = 'conflicting_candidates') AS fields_conflicting, count(*) FILTER (WHERE status = 'not_found') AS fields_not_found FROM ({OUTCOMES}) b GROUP BY doc_id) SELECT p.*, fields_high, fields_needs_verification, fields_conflicting, fields_not_found FROM p JOIN o USING (doc_id)",
    "run_warnings": f"WITH p AS (SELECT doc_id, list_sort(list(page) FILTER (WHERE NOT readable)) AS bad, string_agg(DISTINCT 'page status ' || warning, '|' ORDER BY 'page status ' || warning) AS said FROM ({RUN_PAGES}) a GROUP BY doc_id) SELECT doc_id, CASE WHEN len(bad) > 0 THEN len(bad) || ' page(s) could not be read: [' || array_to_string(bad[1:20], ', ') || ']|' ELSE '' END || said AS warnings FROM p",
    "benchmark_summary": f"""WITH b AS ({BENCH_ROWS}), s AS (SELECT split, field, count(DISTINCT doc_id) AS documents, count(expected) AS scored, count(*) FILTER (WHERE expected = 1 AND outcome = 'correct') AS correct, count(*) FILTER (WHERE expected = 1 AND outcome IN ('wrong', 'wrong_page')) AS wrong, count(*) FILTER (WHERE expected = 1 AND outcome = 'missing') AS missing,
        count(*) FILTER (WHERE expected = 1 AND status = 'conflicting_candidates') AS flagged, count(*) FILTER (WHERE expected = 1 AND outcome IN ('wrong', 'wrong_page') AND high) AS false_high, count(*) FILTER (WHERE expected IS NULL) AS abstention_cases, count(*) FILTER (WHERE expected IS NULL AND outcome = 'correct_abstention') AS correct_abstentions FROM b GROUP BY GROUPING SETS ((split), (field), ())) SELECT *, {_RATES} FROM s""",
    "parse_statistics": f"""WITH p AS (SELECT doc_id, count(*) AS n_pages, {_N('alnum < 25')} AS pages_no_text_layer, {_N('needs_ocr')} AS pages_needs_ocr, count(error) AS pages_with_errors, CAST(sum(blocks) AS BIGINT) AS blocks, count(printed_page) AS pages_with_printed_number FROM ({PARSED}) a GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS logical_tables, {_N('stitched_from > 1')} AS multi_page_tables, {_N('transposed')} AS transposed_suspect_tables, count(unit) AS tables_with_unit FROM ({PARSED_TABLES}) b GROUP BY doc_id)
        SELECT p.*, coalesce(logical_tables, 0) AS logical_tables, coalesce(multi_page_tables, 0) AS multi_page_tables, coalesce(transposed_suspect_tables, 0) AS transposed_suspect_tables, coalesce(tables_with_unit, 0) AS tables_with_unit, round(100.0 * pages_needs_ocr / CAST(n_pages AS DOUBLE), 1) AS pct_needs_ocr, round(100.0 * coalesce(tables_with_unit, 0) / CAST(greatest(coalesce(logical_tables, 0), 1) AS DOUBLE), 1) AS pct_tables_with_unit FROM p LEFT JOIN t USING (doc_id)""",
    "analysis_summary": f"""WITH v AS (SELECT doc_id, count(*) AS values_total, {_N('verified')} AS values_verified, {_N('period IS NULL')} AS values_without_period, {_N('unit IS NULL')} AS values_without_unit FROM ({VALUES}) a GROUP BY doc_id),
        g AS (SELECT doc_id, count(*) AS footing_checked, {_N('k % 2 = 0')} AS footing_passed, count(*) AS consensus_groups, {_N('total > 1')} AS consensus_multi_source, {_N('total > 1 AND supporters = total')} AS consensus_unanimous_multi, {_N('k % 4 = 0')} AS flags, {_N('k % 4 IN (0, 1)')} AS rules_decisive, {_N('k % 4 <> 3')} AS rules_applicable FROM ({GROUPS}) b GROUP BY doc_id) SELECT * FROM v JOIN g USING (doc_id)""",
    "unresolved_issues": f"SELECT case_id, string_agg(CASE verdict WHEN 'inconclusive' THEN rule_id || ': missing evidence — ' || CASE WHEN ord % 3 = 0 THEN 'a, b' ELSE 'see rule' END ELSE rule_id || ': review required — low; old' END, '|' ORDER BY ord) AS issues FROM ({RESULTS}) r WHERE verdict = 'inconclusive' OR review GROUP BY case_id",
    "observations": f"""WITH r AS ({RESULTS}), y AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fy DESC) AS back FROM ({CASE_YEARS}) c)
        SELECT case_id, 'reg6_1_failed' AS kind, string_agg(rule_id, ', ' ORDER BY ord) AS rules FROM r WHERE verdict = 'fail' AND mandatory AND rule_id <> 'RULE' GROUP BY case_id UNION ALL SELECT case_id, 'advisory_flagged', string_agg(rule_id, ', ' ORDER BY ord) FROM r WHERE verdict = 'fail' AND NOT mandatory GROUP BY case_id
        UNION ALL SELECT n.case_id, 'revenue_declined', '' FROM y n JOIN y o ON n.case_id = o.case_id AND n.back = 1 AND o.back = 3 WHERE n.reliable AND n.revenue < o.revenue""",
    "timing_summary": "SELECT event_type AS name, count(*) AS n, round(avg(floor(value * 100)), 6) AS mean, median(floor(value * 100)) AS median, max(floor(value * 100)) AS slowest FROM events GROUP BY event_type",
    "difference_order": f"SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'moved' THEN 0 WHEN 'same' THEN 1 WHEN 'added' THEN 2 ELSE 3 END, key) AS INT) AS place FROM ({KINDS}) k",
    "one_sided_periods": f"SELECT doc_id, kind, regexp_extract(key, '^(.*)[.][^.]*$', 1) AS concept, string_agg(DISTINCT split_part(key, '.', 3), ', ' ORDER BY split_part(key, '.', 3)) AS periods FROM ({KINDS}) k WHERE kind IN ('added', 'removed') GROUP BY ALL",
    "overlapping_boxes": f"SELECT w.doc_id, w.page, w.no, b.box FROM ({TALL}) w JOIN ({BOXED}) b ON w.doc_id = b.doc_id AND w.page = b.page WHERE least(w.y1, b.y1) - greatest(w.y0, b.y0) > 0 AND least(w.y1, b.y1) - greatest(w.y0, b.y0) >= 0.5 * least(w.y1 - w.y0, b.y1 - b.y0)",
    "audit_append": f"WITH l AS (SELECT user_id, max(seq) AS last FROM ({LOG}) a GROUP BY user_id) SELECT e.user_id, e.event_id, CAST(coalesce(l.last, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS BIGINT) AS seq FROM ({ENTRIES}) e LEFT JOIN l ON e.user_id = l.user_id",
    "review_reasons": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'candidates conflict' WHEN 1 THEN 'needs verification' END AS reason FROM orders",
    "statement_kinds": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN strftime(o_orderdate, '%m-%d') = '03-31' THEN 'stock or income' ELSE 'stock' END ELSE 'flow or income' END AS kind FROM orders",
    "skipped_columns": "SELECT o_orderkey, o_orderkey % 5 IN (0, 2, 3) AS skipped FROM orders",
    "note_references": "SELECT l_orderkey AS table_no, l_linenumber AS col FROM lineitem GROUP BY ALL HAVING bool_and(CAST(l_quantity AS INT) % 40 BETWEEN 1 AND 99)",
    "candidate_scores": "WITH s AS (SELECT l_orderkey, l_linenumber, round(0.35 * ((l_orderkey % 2) / 2.0) + 0.2 * ((l_orderkey % 4) / 4.0) + 0.15 * ((l_orderkey % 5) / 5.0) + 0.1 * ((l_orderkey % 8) / 8.0) + 0.1 * ((l_orderkey % 10) / 10.0) + 0.1, 4) AS score FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM s",
    "printed_pages": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 900 AS INT) ELSE TRY_CAST(nullif(regexp_extract(coalesce(text, ''), '^\\s*(\\d{1,4})\\b', 1), '') AS INT) END AS printed FROM documents",
    "rejected_uploads": "SELECT document_id, seq FROM (SELECT o_custkey AS document_id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o WHERE r > 1 OR document_id % 3 = 0",
    "executable_rulesets": f"SELECT o_orderkey, version FROM ({VERSIONS}) v WHERE status <> 'superseded'",
    "money_text": "SELECT o_orderkey, '₹' || format('{:,.2f}', v / 8.0) || ' Cr' AS crore, format('{:,.2f}', v % 1000 / 8.0) || '%' AS percent FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders) o",
    "newest_version": f"SELECT status, arg_max(version, CAST(split_part(version, '.', 1) AS INT) * 100 + CAST(split_part(version, '.', 2) AS INT)) AS version, count(DISTINCT version) AS n FROM ({VERSIONS}) v GROUP BY status",
}
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        head_lines, header_band, header_columns, header_phrases, period_windows, wrapped_headers, column_basis, nearest_dated, borrowed_caption, prose_words, readable_chars, invisible_text, overlapping_spaces, issue_amounts, cover_amounts, suggestions, statement_basis, run_metrics, run_warnings,
        benchmark_summary, parse_statistics, analysis_summary, unresolved_issues, observations, timing_summary, difference_order, one_sided_periods, review_reasons, statement_kinds, skipped_columns, note_references, candidate_scores, printed_pages, rejected_uploads, executable_rulesets, newest_version, money_text, overlapping_boxes, audit_append,
    )
}
