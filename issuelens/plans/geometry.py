"""Words, columns and tables on pages, with lines of orders as words: supplier as document, line number as page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout
from .inputs import portable

#: One line for each order and number.
LINES = "(SELECT l_orderkey, l_linenumber, MIN(l_returnflag) AS l_returnflag, MIN(l_linestatus) AS l_linestatus, MIN(l_partkey) AS l_partkey, MIN(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) x"
Query = Callable[[SparkSession, str], DataFrame]

WORDS = "SELECT l_suppkey AS doc_id, l_linenumber AS page, l_orderkey AS no, CAST((l_orderkey * 7919) % 6000 AS DOUBLE) + l_orderkey / 1E8 AS x, CAST((l_orderkey * 104729) % 800 AS DOUBLE) AS y, width FROM (SELECT l_suppkey, l_linenumber, l_orderkey, MIN(l_quantity) AS width FROM lineitem GROUP BY l_suppkey, l_linenumber, l_orderkey) x"
BOXES = "SELECT s_suppkey AS doc_id, p.page, CAST(500 + (s_suppkey * 13) % 300 AS DOUBLE) AS x0, CAST(2500 + (s_suppkey * 17) % 900 AS DOUBLE) AS x1, CAST(100 + s_suppkey % 50 AS DOUBLE) AS y0, CAST(420 + s_suppkey % 99 AS DOUBLE) AS y1 FROM supplier CROSS JOIN (SELECT 1 AS page UNION ALL SELECT 2) p"
#: The same columns and boxes on every page that occurs.
_PAGES = "(SELECT DISTINCT l_suppkey AS doc_id, l_linenumber AS page FROM lineitem) p"
ALL_COLUMNS = f"SELECT p.doc_id, p.page, c.col, CAST(c.col * 700 + (p.doc_id * 31) % 200 AS DOUBLE) AS at FROM {_PAGES} CROSS JOIN (SELECT 1 AS col UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 7) c"
ALL_BOXES = f"SELECT p.doc_id, p.page, CAST(500 + (p.doc_id * 13) % 300 AS DOUBLE) AS x0, CAST(2500 + (p.doc_id * 17) % 900 AS DOUBLE) AS x1, CAST(100 + p.doc_id % 50 AS DOUBLE) AS y0, CAST(420 + p.doc_id % 99 AS DOUBLE) AS y1 FROM {_PAGES}"
TURNS = "SELECT conv_id AS doc_id, turn AS line, CASE WHEN turn % 3 = 0 THEN role END AS caption, length(text) AS size, text FROM conversations"
TABLES = "SELECT l_suppkey AS doc_id, CAST(l_orderkey % 40 AS INT) AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 40, l_orderkey) AS table_no, (l_orderkey % 10) / 10E0 + l_orderkey / 1E9 AS top, (l_partkey % 10) / 10E0 AS bottom, l_linenumber % 3 AS width, CASE WHEN l_linenumber % 2 = 0 THEN 'h' END AS header, CASE WHEN l_orderkey % 4 = 0 THEN CASE l_linenumber % 5 WHEN 0 THEN 'crore' ELSE 'lakh' END END AS unit, CAST(l_linenumber AS INT) AS dates FROM (SELECT l_suppkey, l_orderkey, MIN(l_linenumber) AS l_linenumber, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY l_suppkey, l_orderkey) x"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portable(spark, sf_dir, WORDS)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("doc_id", "page", F.col("no").alias("word_no"), F.col("y").alias("top"), (F.col("y") + 10).alias("bottom"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"), F.lit("w").alias("text"))
    return layout.lines(rows).select("doc_id", "page", "word_no", "line")


def page_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _words(spark, sf_dir).select("doc_id", "page", "no", F.lit(1).alias("line"), F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"), F.lit("words").alias("text"))
    return layout.cells(rows).select("doc_id", "page", "no", "cell")


def column_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.anchors(_words(spark, sf_dir).select("doc_id", "page", F.col("x").alias("x1")), 30.0).select("doc_id", "page", "anchor", F.round("at", 3).alias("at"), "n")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT conv_id AS doc_id, 1 AS page, turn AS line, CAST(turn * 20 + length(text) % 13 AS DOUBLE) AS top, CAST(turn * 20 + length(text) % 13 + 12 AS DOUBLE) AS bottom FROM conversations")
    return layout.blocks(rows, 0.5).select("doc_id", "line", "block")


def statement_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT o_custkey AS doc_id, 1 AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey % 3 <> 0 AS is_data FROM orders")
    return layout.segments(rows, 1, 2).select("doc_id", "first_line", "last_line", "n")


def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.inside(_words(spark, sf_dir).select("doc_id", "page", "no", "x", "y"), portable(spark, sf_dir, BOXES)).select("doc_id", "page", "no")


def nearest_column_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nearest_column(_words(spark, sf_dir), portable(spark, sf_dir, ALL_COLUMNS), 0.25).select("doc_id", "page", "no", "col")


def band_assign_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.banded(_words(spark, sf_dir).select("doc_id", "page", "no", "x"), portable(spark, sf_dir, ALL_COLUMNS).withColumnRenamed("at", "x"))


def outside_boxes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.inside(_words(spark, sf_dir).select("doc_id", "page", "no", "x", "y"), portable(spark, sf_dir, ALL_BOXES), outside=True).select("doc_id", "page", "no")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.carried(portable(spark, sf_dir, TURNS), ["doc_id"], "line", "caption", 10).select("doc_id", "line", "caption_above")


def lookback_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.any_above(portable(spark, sf_dir, TURNS), ["doc_id"], "line", F.col("size") > 60, 2).select("doc_id", "line", "any_above")


def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.stitched(portable(spark, sf_dir, TABLES)).select("doc_id", "table_no", "whole")


def unit_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.unit_donors(portable(spark, sf_dir, TABLES)).select("doc_id", "table_no", "unit")


def header_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.inherited(portable(spark, sf_dir, TABLES).select("doc_id", "page", "table_no", "dates", "unit"), "unit", same=("dates",)).select("doc_id", "table_no", "unit")


def label_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT l_suppkey AS doc_id, l_orderkey % 50 AS table_no, l_linenumber - 1 AS col, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN '1,234' ELSE 'Revenue' END AS text FROM lineitem")
    return layout.label_column(rows)


def transposed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.transposed(portable(spark, sf_dir, "SELECT l_suppkey AS doc_id, l_orderkey % 50 AS table_no, l_linenumber - 1 AS col, l_orderkey % 3 = 0 AS is_period FROM lineitem"))


def header_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.filled_from_sides(portable(spark, sf_dir, f"SELECT l_orderkey AS doc_id, 1 AS table_no, l_linenumber AS col, CASE WHEN l_returnflag = 'R' THEN concat('year ', l_linestatus) END AS wording FROM {LINES}")).select("doc_id", "col", "wording")


def slot_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.placed(portable(spark, sf_dir, "SELECT l_orderkey AS doc_id, 1 AS table_no, 1 AS row, l_suppkey % 5 AS slot, l_linenumber FROM lineitem")).select("doc_id", "l_linenumber", "clash")


def joined_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, f"SELECT l_orderkey AS doc_id, 1 AS page, 1 AS line, CAST(l_linenumber * 10 AS DOUBLE) AS x0, CAST(l_linenumber * 10 + 7 + l_partkey % 4 AS DOUBLE) AS x1, CAST(CAST(l_quantity AS INT) AS VARCHAR(10)) AS text FROM {LINES}")
    return layout.joined_numbers(rows).select("doc_id", "token", "text")


def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.covered_share(portable(spark, sf_dir, BOXES), 4e6).select("doc_id", "page", F.round("coverage", 9).alias("coverage"))


def scanned_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT conv_id AS doc_id, 1 AS page, turn AS line, role AS label, length(text) % 3 AS n_figures FROM conversations")
    return layout.scanned_statements(rows)


_IN = f"EXISTS (SELECT 1 FROM ({BOXES}) b WHERE b.doc_id = w.doc_id AND b.page = w.page AND w.x BETWEEN b.x0 AND b.x1 AND w.y BETWEEN b.y0 AND b.y1)"
QUERIES: dict[str, Query] = {f.__name__: f for f in (page_lines, page_cells, column_anchors, page_blocks, statement_segments, point_in_box, nearest_column_all, band_assign_all, outside_boxes_all, carry_forward, lookback_context, stitch, unit_donors, header_inheritance, label_column, transposed_tables, header_wording, slot_clashes, joined_numbers, image_coverage, scanned_statements)}
ORACLE: dict[str, str] = {
    "page_cells": f"WITH w AS (SELECT doc_id, page, no, x, width FROM ({WORDS}) a), s AS (SELECT *, quantile_cont(width / 5, 0.5) OVER (PARTITION BY doc_id, page) AS sp, x - lag(x + width) OVER (PARTITION BY doc_id, page ORDER BY x) AS gap FROM w) SELECT doc_id, page, no, CAST(sum(CASE WHEN gap IS NULL OR gap > 2.2 * sp THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cell FROM s",
    "column_anchors": f"WITH s AS (SELECT *, x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS gap FROM ({WORDS}) a), g AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS anchor FROM s) SELECT doc_id, page, anchor, round(quantile_cont(x, 0.5), 3) AS at, count(*) AS n FROM g GROUP BY doc_id, page, anchor",
    "page_blocks": "WITH t AS (SELECT conv_id AS doc_id, turn AS line, turn * 20 + length(text) % 13 AS top FROM conversations), g AS (SELECT *, top - lag(top + 12) OVER (PARTITION BY doc_id ORDER BY line) AS gap FROM t) SELECT doc_id, line, CAST(sum(CASE WHEN gap IS NULL OR gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM g",
    "statement_segments": "WITH r AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, o_orderkey % 3 <> 0 AS is_data FROM orders), d AS (SELECT *, line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS skip FROM r WHERE is_data), g AS (SELECT *, sum(CASE WHEN skip IS NULL OR skip > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS s FROM d) SELECT doc_id, min(line) AS first_line, max(line) AS last_line, count(*) AS n FROM g GROUP BY doc_id, s HAVING count(*) >= 2",
    "point_in_box": f"SELECT doc_id, page, no FROM ({WORDS}) w WHERE {_IN}",
    "carry_forward": f"SELECT doc_id, line, last_value(caption IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS caption_above FROM ({TURNS}) t",
    "lookback_context": f"SELECT doc_id, line, coalesce(bool_or(size > 60) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), FALSE) AS any_above FROM ({TURNS}) t",
    "stitch": f"WITH l AS (SELECT *, lag(page) OVER w AS p0, lag(bottom) OVER w AS b0, lag(width) OVER w AS w0, lag(header) OVER w AS h0, lag(unit) OVER w AS u0 FROM ({TABLES}) t WINDOW w AS (PARTITION BY doc_id ORDER BY page, top)) SELECT doc_id, table_no, CAST(sum(CASE WHEN coalesce(page = p0 + 1 AND b0 >= 0.8 AND top <= 0.25 AND width = w0 AND (header IS NULL OR header IS NOT DISTINCT FROM h0) AND coalesce(unit = u0, TRUE), FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page, top ROWS UNBOUNDED PRECEDING) AS BIGINT) AS whole FROM l",
    "unit_donors": f"""WITH t AS ({TABLES}), m AS (SELECT a.doc_id, a.table_no, min(b.unit) FILTER (WHERE b.table_no < a.table_no) AS b0, max(b.unit) FILTER (WHERE b.table_no < a.table_no) AS b1, min(b.unit) FILTER (WHERE b.table_no > a.table_no) AS a0, max(b.unit) FILTER (WHERE b.table_no > a.table_no) AS a1
        FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.dates = b.dates AND abs(a.page - b.page) <= 2 WHERE a.unit IS NULL AND b.unit IS NOT NULL GROUP BY ALL) SELECT doc_id, table_no, coalesce(b0, a0) AS unit FROM m WHERE CASE WHEN b0 IS NOT NULL THEN b0 = b1 ELSE a0 = a1 END""",
    "label_column": "SELECT doc_id, table_no, min(col) AS col FROM (SELECT l_suppkey AS doc_id, l_orderkey % 50 AS table_no, l_linenumber - 1 AS col FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL HAVING avg(CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 0 ELSE 1 END) >= 0.5) t GROUP BY doc_id, table_no",
    "transposed_tables": "SELECT l_suppkey AS doc_id, l_orderkey % 50 AS table_no, avg(CASE WHEN l_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END) >= 0.5 AS transposed FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL",
    "header_wording": f"WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS col, CASE WHEN l_returnflag = 'R' THEN 'year ' || l_linestatus END AS wording FROM {LINES}) SELECT doc_id, col, coalesce(wording, last_value(wording IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(wording IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS wording FROM h",
    "slot_clashes": "SELECT l_orderkey AS doc_id, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 5) > 1 AS clash FROM lineitem",
    "image_coverage": f"SELECT doc_id, page, round(least(1.0, sum((x1 - x0) * (y1 - y0)) / 4e6), 9) AS coverage FROM ({BOXES}) b GROUP BY doc_id, page",
}
ORACLE["nearest_column_all"] = f"WITH m AS (SELECT w.doc_id, w.page, w.no, c.col, abs(w.x - c.at) AS away, row_number() OVER (PARTITION BY w.doc_id, w.page, w.no ORDER BY abs(w.x - c.at), c.col) AS r FROM ({WORDS}) w JOIN ({ALL_COLUMNS}) c ON w.doc_id = c.doc_id AND w.page = c.page) SELECT doc_id, page, no, col FROM m WHERE r = 1 AND away <= 175"
ORACLE["band_assign_all"] = f"SELECT w.doc_id, w.page, w.no, c.col FROM ({WORDS}) w ASOF LEFT JOIN ({ALL_COLUMNS}) c ON w.doc_id = c.doc_id AND w.page = c.page AND w.x >= c.at"
ORACLE["outside_boxes_all"] = f"SELECT doc_id, page, no FROM ({WORDS}) w WHERE NOT EXISTS (SELECT 1 FROM ({ALL_BOXES}) b WHERE b.doc_id = w.doc_id AND b.page = w.page AND w.x BETWEEN b.x0 AND b.x1 AND w.y BETWEEN b.y0 AND b.y1)"
# The same under the names without _all.
QUERIES |= {name: QUERIES[f"{name}_all"] for name in ("nearest_column", "band_assign", "outside_boxes")}
ORACLE |= {name: ORACLE[f"{name}_all"] for name in ("nearest_column", "band_assign", "outside_boxes")}
ORACLE["header_inheritance"] = f"""WITH b AS (SELECT *, unit IS NOT NULL OR coalesce(page - lag(page) OVER (PARTITION BY doc_id, dates ORDER BY page, table_no) > 2, TRUE) AS begins FROM ({TABLES}) t),
    g AS (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY doc_id, dates ORDER BY page, table_no ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT doc_id, table_no, first_value(unit) OVER (PARTITION BY doc_id, dates, run ORDER BY page, table_no) AS unit FROM g"""
ORACLE["page_lines"] = f"""WITH RECURSIVE w AS (SELECT doc_id, page, no, y + 5 AS mid, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, no) AS n FROM ({WORDS}) a),
    r AS (SELECT doc_id, page, no, n, CAST(1 AS BIGINT) AS line, mid AS mean, 1 AS k FROM w WHERE n = 1
        UNION ALL SELECT w.doc_id, w.page, w.no, w.n, CASE WHEN abs(w.mid - r.mean) > 5 THEN r.line + 1 ELSE r.line END, CASE WHEN abs(w.mid - r.mean) > 5 THEN w.mid ELSE r.mean + (w.mid - r.mean) / (r.k + 1) END, CASE WHEN abs(w.mid - r.mean) > 5 THEN 1 ELSE r.k + 1 END
        FROM r JOIN w ON w.doc_id = r.doc_id AND w.page = r.page AND w.n = r.n + 1) SELECT doc_id, page, no AS word_no, line FROM r"""
ORACLE["scanned_statements"] = """WITH RECURSIVE w AS (SELECT conv_id AS doc_id, turn AS line, coalesce(role, '') AS label, length(text) % 3 AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS table_no, 0 AS blank, '' AS pending, '' AS label, FALSE AS out FROM w
        UNION ALL SELECT w.doc_id, w.line, w.n, CASE WHEN w.f > 0 AND (r.blank > 6 OR r.table_no = 0) THEN r.table_no + 1 ELSE r.table_no END, CASE WHEN w.f > 0 THEN 0 ELSE r.blank + 1 END, CASE WHEN w.f > 0 OR r.blank + 1 > 6 THEN '' ELSE w.label END, trim(r.pending || ' ' || w.label), w.f > 0
        FROM r JOIN w ON w.doc_id = r.doc_id AND w.n = r.n + 1) SELECT doc_id, table_no, CAST(1 AS BIGINT) AS page, line, label FROM r WHERE out"""
ORACLE["joined_numbers"] = f"""
    WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber * 10 AS x0, l_linenumber * 10 + 7 + l_partkey % 4 AS x1, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS text FROM {LINES}),
    c AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY doc_id ORDER BY x0) <= 2, FALSE) AS close FROM t),
    g AS (SELECT *, CAST(sum(CASE WHEN close THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS token FROM c)
    SELECT doc_id, token, string_agg(text, '' ORDER BY x0) AS text FROM g GROUP BY doc_id, token
"""
