"""Tables of pages as queries: lines of orders as the cells, words and lines of a supplier's pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from .inputs import portable

Query = Callable[[SparkSession, str], DataFrame]

_INT = "CAST(floor(l_extendedprice) AS BIGINT)"
_GROUPED = f"CASE WHEN l_extendedprice < 1000 THEN CAST({_INT} AS VARCHAR(20)) ELSE concat(CAST(CAST(floor(l_extendedprice / 1E3) AS BIGINT) AS VARCHAR(20)), ',', lpad(CAST({_INT} % 1000 AS VARCHAR(20)), 3, '0')) END"
_COLS = "(SELECT 0 AS col UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) c"
_PAGED = f"SELECT l_suppkey AS doc_id, CAST(l_orderkey % 30 AS INT) AS page, 1 AS table_no, CAST(row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 30 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) AS INT) AS row, l_partkey AS k, l_linenumber AS n, {_GROUPED} AS g FROM lineitem"
#: Grids of five columns, whose periods stand in one of the first five rows, or twice the same; captions above, notes and amounts below.
CELLS = f"""
    SELECT doc_id, page, table_no, row, col, CASE
        WHEN row = 1 + page % 5 THEN CASE WHEN col = 0 THEN concat('Particulars', chr(10), 'of it') WHEN col = 1 THEN 'Notes' WHEN page % 7 = 0 THEN 'Fiscal 2020' WHEN col = 4 AND page % 4 = 1 THEN '% of total' ELSE concat(CASE WHEN page % 2 = 0 THEN 'Fiscal ' ELSE 'March 31, ' END, CAST(2024 - col AS VARCHAR(4))) END
        WHEN row < 1 + page % 5 THEN CASE WHEN col > 0 THEN NULL WHEN page % 3 = 0 THEN '(₹ in lakhs)' WHEN page % 3 = 1 THEN 'Amounts in million' ELSE 'Statement of assets' END
        WHEN col = 0 THEN CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'Revenue' WHEN 3 THEN concat('Total', chr(10), 'assets') ELSE g END
        WHEN col = 1 THEN CASE (k + n) % 3 WHEN 0 THEN 'note 5' WHEN 1 THEN '12' END
        ELSE CASE (k + col) % 6 WHEN 0 THEN g WHEN 1 THEN concat('(', g, ')') WHEN 2 THEN '-' WHEN 3 THEN 'nil' WHEN 4 THEN concat(g, '.50') ELSE 'n.m.x' END END AS text
    FROM ({_PAGED}) x CROSS JOIN {_COLS}
"""
#: Boxes of three columns and four rows on every page; on some, cells hold several amounts, or a cell spans two columns.
_PAGES = "(SELECT DISTINCT l_suppkey AS doc_id, l_linenumber AS page FROM lineitem) p"
BOXED = f"""
    SELECT doc_id, page, 1 AS table_no, r.row, c.col, 100E0 + 40 * c.col * c.col AS x0, 100E0 + 40 * (c.col + 1) * (c.col + 1) + CASE WHEN c.col = 1 AND r.row = 0 AND doc_id % 4 = 0 THEN 200 ELSE 0 END AS x1, 50E0 + 150 * r.row AS y0, 200E0 + 150 * r.row AS y1,
           CASE WHEN c.col = 0 THEN 'Revenue' WHEN doc_id % 3 = 0 AND r.row = 1 THEN '1,234 5,678 9.5' WHEN doc_id % 3 = 1 AND c.col = 2 THEN '1,234 567' WHEN doc_id % 5 = 0 THEN '2022 2023 12 7' ELSE '1,234' END AS text
    FROM {_PAGES} CROSS JOIN (SELECT 0 AS row UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) r CROSS JOIN (SELECT 0 AS col UNION ALL SELECT 1 UNION ALL SELECT 2) c
"""
BOX_WORDS = "SELECT l_suppkey AS doc_id, l_linenumber AS page, no, CAST(60 + no % 420 AS DOUBLE) + no / 1E8 AS x0, CAST(80 + no % 420 + no % 35 AS DOUBLE) + no / 1E8 AS x1, CAST((no * 104729) % 800 AS DOUBLE) AS y0, CAST((no * 104729) % 800 + 8 AS DOUBLE) AS y1, CAST(no AS VARCHAR(20)) AS text FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_orderkey AS no FROM lineitem) x"
#: Tables of a page: statements, ruled boxes and tables found by blanks, at heights that overlap at times.
FOUND = "SELECT l_suppkey AS doc_id, CAST(l_orderkey % 60 AS INT) AS page, row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 60 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) AS table_no, CASE WHEN l_orderkey % 60 % 5 = 0 THEN CASE l_partkey % 2 WHEN 0 THEN 'text' ELSE 'statement' END ELSE CASE l_partkey % 4 WHEN 0 THEN 'statement' WHEN 3 THEN 'text' ELSE 'lines' END END AS strategy, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_partkey % 300 + 60 + l_linenumber * 30 AS DOUBLE) AS x1, CAST(l_orderkey * 7 % 700 AS DOUBLE) AS y0, CAST(l_orderkey * 7 % 700 + 10 + l_quantity AS DOUBLE) AS y1, CAST(1 + l_linenumber * 2 AS INT) AS n_rows, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 5 END AS n_amounts, l_discount * 4 AS density, l_linenumber % 2 = 0 AS labelless FROM lineitem"
VALUES = "SELECT l_suppkey AS doc_id, CAST(l_orderkey % 20 AS INT) AS table_no, l_orderkey AS row, l_linenumber AS no, CAST((l_partkey * 37 + l_linenumber * 90) % 600 AS DOUBLE) + l_linenumber / 1E3 AS x1 FROM (SELECT l_suppkey % 40 AS l_suppkey, l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY l_suppkey % 40, l_orderkey, l_linenumber) x"
SLOTS = "SELECT DISTINCT l_suppkey % 40 AS doc_id, CAST(l_orderkey % 20 AS INT) AS table_no, CAST(2 + l_orderkey % 4 AS INT) AS n_cols, CASE WHEN l_orderkey % 20 = 7 THEN array(100E0, 400E0) ELSE CASE l_orderkey % 4 WHEN 0 THEN array(150E0, 450E0) WHEN 1 THEN array(100E0, 300E0, 500E0) WHEN 2 THEN array(80E0, 200E0, 350E0, 550E0) ELSE array(60E0, 180E0, 300E0, 420E0, 540E0) END END AS anchors FROM lineitem"
TOKENS = "SELECT l_suppkey % 40 AS doc_id, CAST(l_orderkey % 20 AS INT) AS table_no, l_orderkey AS line, l_linenumber AS no, CAST((l_partkey * 37 + l_linenumber * 90) % 600 AS DOUBLE) AS x1, CASE WHEN l_partkey % 3 = 0 THEN 'assets' WHEN l_partkey % 5 = 0 THEN '2022' ELSE '1,234' END AS text, l_partkey % 3 <> 0 AS is_value, l_orderkey % 7 = 0 AS is_row FROM (SELECT l_suppkey % 40 AS l_suppkey, l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY l_suppkey % 40, l_orderkey, l_linenumber) x"
#: Lines of long documents, fourteen a page, every tenth page left out; headers, rows, labels and figures too many.
LINES = """
    SELECT doc_id, CAST(floor((n - 1) / 14E0) + floor((n - 1) / 126E0) AS INT) + 1 AS page, CAST((n - 1) % 14 + 1 AS INT) AS line, ((n - 1) % 14 + 1) / 14E0 AS top,
           CASE (k + n) % 5 WHEN 0 THEN 'Total assets' WHEN 1 THEN 'of which current' WHEN 2 THEN NULL WHEN 3 THEN 'PL' ELSE 'Revenue from sales' END AS label,
           CASE WHEN head THEN 0 WHEN k % 10 < few THEN 0 ELSE CAST(q % 4 AS INT) END AS n_figures, CASE WHEN head THEN CAST(2 + k % 2 AS INT) END AS n_cols, CASE WHEN head THEN concat('Fiscal ', CAST(2020 + k % 2 AS VARCHAR(4))) END AS columns, CASE WHEN head AND n % 3 = 0 THEN CASE k % 2 WHEN 0 THEN 'lakh' ELSE 'crore' END END AS unit
    FROM (SELECT l_suppkey AS doc_id, l_partkey AS k, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) AS n, (l_partkey + l_linenumber) % 37 = 0 AS head, 2 + l_suppkey % 6 AS few FROM lineitem) x
"""


#: Lines above and between headers: captions, titles of either basis, blanks, and talk of eligibility.
CONTEXT = """
    SELECT l_suppkey AS doc_id, CAST(l_orderkey % 25 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_suppkey, l_orderkey % 25 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) AS INT) AS line, (l_partkey + l_linenumber) % 9 = 0 AS is_header, l_partkey % 23 = 4 AS names_rules,
           CASE WHEN (l_partkey + l_linenumber) % 9 = 0 THEN CASE l_partkey % 4 WHEN 0 THEN 'Particulars (in million) Fiscal 2023 Fiscal 2022' ELSE 'Particulars Fiscal 2023 Fiscal 2022' END
                WHEN l_partkey % 19 = 3 THEN '(₹ in lakhs)' WHEN l_partkey % 17 = 2 THEN 'Restated Consolidated Statement' WHEN l_partkey % 17 = 5 THEN 'Standalone  figures' WHEN l_partkey % 17 = 7 THEN 'consolidated and standalone' WHEN l_partkey % 5 = 1 THEN ' ' WHEN l_partkey % 5 = 2 THEN NULL ELSE concat('Line ', CAST(l_partkey % 50 AS VARCHAR(4))) END AS text
    FROM lineitem
"""
GRIDS = "SELECT DISTINCT l_suppkey AS doc_id, CAST(l_orderkey % 25 AS INT) AS page, 1 AS table_no, CASE WHEN l_orderkey % 25 % 4 = 1 THEN 'INR_CRORE' END AS unit FROM lineitem"


def lent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lent(portable(spark, sf_dir, GRIDS), portable(spark, sf_dir, CONTEXT)).drop("table_no")


def ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ruled(portable(spark, sf_dir, CELLS)).select("doc_id", "page", "row", "label", "unit", "col", "period", F.col("value").cast("double").alias("value"), "is_null_mark")


def clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_info(portable(spark, sf_dir, CELLS)).select("doc_id", "page", "n_header", "col", "header")


#: The same grids laid on their side on every other page.
LAID = f"SELECT doc_id, page, table_no, CASE WHEN page % 2 = 0 THEN col ELSE row END AS row, CASE WHEN page % 2 = 0 THEN row - 1 ELSE col END AS col, text FROM ({CELLS}) l WHERE row > page % 5"


def transposed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.turned(portable(spark, sf_dir, LAID)).select("doc_id", "page", "row", "col", "text", "turned")


def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.recut(portable(spark, sf_dir, BOXED), portable(spark, sf_dir, BOX_WORDS)).select("doc_id", "page", "row", "col", "text")


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.facts(portable(spark, sf_dir, CELLS)).select("doc_id", "page", "n_rows", "n_cols", "n_amounts", F.round("density", 9).alias("density"), "labelless")


def preferred_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.preferred(portable(spark, sf_dir, FOUND)).select("doc_id", "page", "table_no", "strategy", "kept", "reason")


def placed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.placed_values(portable(spark, sf_dir, VALUES), portable(spark, sf_dir, SLOTS))


def promoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.promoted_rows(portable(spark, sf_dir, TOKENS), portable(spark, sf_dir, SLOTS))


def statement_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan(portable(spark, sf_dir, LINES))


QUERIES: dict[str, Query] = {f.__name__: f for f in (ruled_tables, clean_tables, transposed_cells, merged_cells, table_facts, preferred_tables, placed_values, promoted_rows, statement_scan, lent_context)}

_CLEAN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_PERIOD = "CASE WHEN regexp_matches(t, '^(Fiscal|March 31,) \\d{4}$') THEN 'FY' || right(t, 4) END"
#: A number as printed here, read by its form.
_AMOUNT = "CASE WHEN regexp_matches(t, '^\\(?\\d{1,3}(,\\d{3})*(\\.\\d+)?\\)?$') THEN CAST(replace(replace(replace(t, ',', ''), '(', ''), ')', '') AS DOUBLE) * CASE WHEN t LIKE '(%' THEN -1 ELSE 1 END END"
_IS_AMOUNT = f"({_AMOUNT}) IS NOT NULL"
_MONEY = f"len(list_filter(string_split(t, ' '), lambda x: (x LIKE '%,%' OR x LIKE '%.%' OR length(x) >= 3) AND NOT regexp_matches(x, '^(19|20)\\d\\d$') AND (regexp_matches(x, '^\\(?\\d{{1,3}}(,\\d{{2,3}})*(\\.\\d+)?\\)?$') OR regexp_matches(x, '^\\(?\\d+(\\.\\d+)?\\)?$') OR x = 'nil')))"
_ARRAYS = SLOTS.replace("array(", "list_value(")
ORACLE: dict[str, str] = {
    "ruled_tables": f"""
        WITH c AS (SELECT doc_id, page, row, col, {_CLEAN} AS t FROM ({CELLS}) x), p AS (SELECT *, {_PERIOD} AS period FROM c),
        h AS (SELECT doc_id, page, min(row) AS h FROM (SELECT doc_id, page, row FROM p WHERE row <= 4 GROUP BY ALL HAVING count(period) >= 2 AND count(DISTINCT period) = count(period)) y GROUP BY ALL),
        u AS (SELECT p.doc_id, p.page, h.h, CASE WHEN string_agg(t, ' ') LIKE '%lakhs%' THEN 'INR_LAKH' WHEN string_agg(t, ' ') LIKE '%million%' THEN 'INR_MILLION' END AS unit FROM p JOIN h ON p.doc_id = h.doc_id AND p.page = h.page AND p.row <= h.h GROUP BY ALL),
        k AS (SELECT p.doc_id, p.page, p.col, p.period FROM p JOIN h ON p.doc_id = h.doc_id AND p.page = h.page AND p.row = h.h WHERE period IS NOT NULL),
        b AS (SELECT c.*, u.unit, k.period, {_AMOUNT} AS value, t IN ('-', 'nil') AS mark FROM c JOIN u ON c.doc_id = u.doc_id AND c.page = u.page AND c.row > u.h LEFT JOIN k ON k.doc_id = c.doc_id AND k.page = c.page AND k.col = c.col),
        l AS (SELECT doc_id, page, row, string_agg(t, ' ' ORDER BY col) AS label FROM b WHERE period IS NULL AND value IS NULL AND t <> '' GROUP BY ALL)
        SELECT b.doc_id, b.page, b.row, label, unit, b.col, period, value, mark AS is_null_mark FROM b JOIN l ON b.doc_id = l.doc_id AND b.page = l.page AND b.row = l.row WHERE period IS NOT NULL AND (value IS NOT NULL OR mark)
    """,
    "clean_tables": f"""
        WITH c AS (SELECT doc_id, page, row, col, {_CLEAN} AS t FROM ({CELLS}) x), d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY row) AS place FROM c WHERE t <> ''),
        m AS (SELECT doc_id, page, max(place) AS rows, min(place) FILTER (WHERE col > 0 AND ({_IS_AMOUNT} OR t = 'nil') AND NOT regexp_matches(t, '^(19|20)\\d\\d$')) AS first FROM d GROUP BY ALL),
        n AS (SELECT doc_id, page, rows, least(coalesce(first - 1, rows), 8) AS n FROM m)
        SELECT d.doc_id, d.page, n.n AS n_header, d.col, string_agg(t, ' ' ORDER BY row) AS header FROM d JOIN n ON d.doc_id = n.doc_id AND d.page = n.page WHERE n.n > 0 AND n.n < n.rows AND place <= n.n GROUP BY ALL
    """,
    "transposed_cells": f"""
        WITH c AS (SELECT doc_id, page, row, col, {_CLEAN} AS t FROM ({LAID}) x), s AS (SELECT *, bool_or(t <> '') OVER (PARTITION BY doc_id, page, row) AS has FROM c), d AS (SELECT doc_id, page, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY row) - 1 AS row, col, t, regexp_matches(t, '^(Fiscal|March 31,) \\d{{4}}$') AS p FROM s WHERE has),
        f AS (SELECT doc_id, page, avg(CAST(p AS INT)) FILTER (WHERE col = 0 AND row > 0 AND t <> '') AS side, avg(CAST(p AS INT)) FILTER (WHERE row = 0 AND col > 0 AND t <> '') AS head, max(row) + 1 AS rows, max(col) FILTER (WHERE row = 0) + 1 AS wide FROM d GROUP BY ALL),
        g AS (SELECT d.*, coalesce(side >= 0.6 AND head <= 0.3 AND rows >= 3 AND wide >= 3, FALSE) AS turned FROM d JOIN f ON d.doc_id = f.doc_id AND d.page = f.page)
        SELECT doc_id, page, CASE WHEN turned THEN col ELSE row END AS row, CASE WHEN turned THEN row ELSE col END AS col, t AS text, turned FROM g
    """,
    "merged_cells": f"""
        WITH b AS (SELECT *, {_CLEAN} AS t FROM ({BOXED}) x), n AS (SELECT *, {_MONEY.replace("{{", "{").replace("}}", "}")} AS n FROM b), f AS (SELECT doc_id, page FROM n GROUP BY ALL HAVING max(n) >= 3 OR count(*) FILTER (WHERE n >= 2) >= 2),
        e AS (SELECT doc_id, page, x, lead(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS nx, row_number() OVER (PARTITION BY doc_id, page ORDER BY x) - 1 AS col FROM (SELECT doc_id, page, x0 AS x FROM b UNION SELECT doc_id, page, x1 FROM b) z),
        box AS (SELECT b.doc_id, b.page, min(x0) AS a, max(x1) AS z, min(y0) AS s, max(y1) AS t FROM b JOIN f ON b.doc_id = f.doc_id AND b.page = f.page GROUP BY ALL),
        w AS (SELECT w.*, (y0 + y1) / 2 AS mid FROM ({BOX_WORDS}) w JOIN box ON w.doc_id = box.doc_id AND w.page = box.page AND (x0 + x1) / 2 BETWEEN a AND z AND (y0 + y1) / 2 BETWEEN s AND t),
        r AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 0.5 * (y1 - y0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY mid, no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row FROM (SELECT *, mid - lag(mid) OVER (PARTITION BY doc_id, page ORDER BY mid, no) AS gap FROM w) y),
        o AS (SELECT r.doc_id, r.page, r.no, r.row, r.x0, r.text, e.col, row_number() OVER (PARTITION BY r.doc_id, r.page, r.no ORDER BY greatest(0, least(r.x1, e.nx) - greatest(r.x0, e.x)) DESC, e.col) AS k FROM r JOIN e ON r.doc_id = e.doc_id AND r.page = e.page AND e.nx IS NOT NULL)
        SELECT doc_id, page, row, CAST(col AS INT) AS col, string_agg(text, ' ' ORDER BY x0, no) AS text FROM o WHERE k = 1 GROUP BY ALL
    """,
    "table_facts": f"""
        WITH c AS (SELECT doc_id, page, row, col, {_CLEAN} AS t FROM ({CELLS}) x)
        SELECT doc_id, page, count(DISTINCT row) FILTER (WHERE t <> '') AS n_rows, max(col) + 1 AS n_cols, CAST(sum({_MONEY.replace("{{", "{").replace("}}", "}")}) AS BIGINT) AS n_amounts, round(coalesce(avg(CASE WHEN {_IS_AMOUNT} OR t = 'nil' THEN 1.0 ELSE 0.0 END) FILTER (WHERE t <> ''), 0), 9) AS density, NOT bool_or(col = 0 AND regexp_matches(t, '[A-Za-z]{{2}}')) AS labelless
        FROM c GROUP BY doc_id, page
    """,
    "preferred_tables": f"""
        WITH t AS (SELECT *, strategy = 'lines' AND n_rows <= 6 AND n_amounts = 0 AS band FROM ({FOUND}) x),
        m AS (SELECT t.doc_id, t.page, t.table_no, bool_or(least(t.y1, s.y1) - greatest(t.y0, s.y0) > 0.5 * least(t.y1 - t.y0, s.y1 - s.y0)) AS covered,
              bool_or(least(t.x1, s.x1) > greatest(t.x0, s.x0) AND (least(t.y1, s.y1) - greatest(t.y0, s.y0) >= 0.5 * (t.y1 - t.y0) OR s.y0 - t.y1 BETWEEN -2 AND 30)) AS feeds
              FROM t JOIN t s ON s.doc_id = t.doc_id AND s.page = t.page AND s.strategy = 'statement' WHERE t.strategy <> 'statement' GROUP BY ALL),
        j AS (SELECT t.*, coalesce(covered, FALSE) AS covered, coalesce(feeds, FALSE) AS feeds FROM t LEFT JOIN m ON m.doc_id = t.doc_id AND m.page = t.page AND m.table_no = t.table_no),
        r AS (SELECT *, bool_or(strategy = 'lines' AND (band OR NOT (labelless AND covered))) OVER (PARTITION BY doc_id, page) AS ruled FROM j),
        z AS (SELECT *, CASE WHEN strategy = 'text' THEN CASE WHEN density < 0.2 THEN 'prose' WHEN ruled THEN 'ruled page' WHEN covered THEN 'covered' END WHEN band AND feeds THEN 'band of a statement' WHEN strategy = 'lines' AND NOT band AND labelless AND covered THEN 'box without labels' END AS reason FROM r)
        SELECT doc_id, page, table_no, strategy, reason IS NULL AS kept, reason FROM z
    """,
    "placed_values": f"""
        WITH v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no, row ORDER BY x1, no) AS i, count(*) OVER (PARTITION BY doc_id, table_no, row) AS k FROM ({VALUES}) x),
        m AS (SELECT v.*, c.n_cols, len(c.anchors) = c.n_cols AS anchored, c.anchors FROM v JOIN ({_ARRAYS}) c ON c.doc_id = v.doc_id AND c.table_no = v.table_no WHERE k <= n_cols),
        a AS (SELECT * EXCLUDE (anchors), unnest(anchors) AS edge, unnest(range(len(anchors))) AS slot FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, table_no, row, no ORDER BY abs(edge - x1), slot) AS r FROM a),
        n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, table_no, row, slot) AS same FROM b WHERE r = 1), s AS (SELECT *, max(same) OVER (PARTITION BY doc_id, table_no, row) AS most FROM n)
        SELECT doc_id, table_no, row, no, CAST(CASE WHEN NOT anchored THEN i - 1 WHEN most > 1 THEN n_cols - k + i - 1 ELSE slot END AS INT) AS slot FROM s
    """,
    "promoted_rows": f"""
        WITH t AS (SELECT *, max(CASE WHEN NOT is_value THEN no ELSE 0 END) OVER (PARTITION BY doc_id, table_no, line) AS w FROM ({TOKENS}) x WHERE NOT is_row),
        a AS (SELECT t.doc_id, t.table_no, t.line, t.no, t.text, min(abs(z.edge - t.x1)) AS away FROM t JOIN (SELECT doc_id, table_no, unnest(anchors) AS edge FROM ({_ARRAYS}) c) z ON z.doc_id = t.doc_id AND z.table_no = t.table_no WHERE is_value AND no > w GROUP BY ALL)
        SELECT doc_id, table_no, line, CAST(count(*) AS INT) AS n FROM a GROUP BY ALL HAVING max(away) <= 15 AND NOT bool_and(regexp_matches(text, '^(19|20)\\d\\d$'))
    """,
    "statement_scan": f"""
        WITH RECURSIVE w AS (SELECT *, trim(coalesce(label, '')) AS said, row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS place FROM ({LINES}) x),
        r AS (
            SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, -9 AS page, 0 AS line, '' AS label, 0 AS n_figures, FALSE AS shown, CAST(NULL AS STRUCT(k INT, c VARCHAR, u VARCHAR, p INT, s INT)) AS cur, CAST(NULL AS STRUCT(k INT, c VARCHAR, u VARCHAR, p INT, s INT)) AS carry,
                CAST(NULL AS STRUCT(k INT, c VARCHAR, u VARCHAR, p INT, s INT)) AS last, CAST(0 AS DOUBLE) AS last_top, 0 AS blank, '' AS pending, 0 AS seg FROM w
            UNION ALL
            SELECT doc_id, n, page, line, CASE WHEN pending <> '' AND (length(said) < 3 OR regexp_matches(said, '^[a-z]')) THEN trim(pending || ' ' || said) ELSE said END, n_figures, shown, now, carry, CASE WHEN shown THEN now ELSE last END, CASE WHEN shown THEN top ELSE last_top END, run,
                CASE WHEN n_cols IS NOT NULL OR n_figures > 0 OR run > 6 THEN '' ELSE trim(pending || ' ' || said) END, seg
            FROM (
                SELECT *, n_cols IS NULL AND n_figures > 0 AND coalesce(n_figures <= now.k, FALSE) AS shown FROM (
                    SELECT * EXCLUDE (seg, blank), seg + CASE WHEN n_cols IS NOT NULL THEN 1 ELSE 0 END AS seg, CASE WHEN n_cols IS NOT NULL OR n_figures > 0 THEN 0 ELSE blank + 1 END AS run,
                        CASE WHEN n_cols IS NOT NULL THEN CASE WHEN coalesce(carry.c = columns, FALSE) AND place <= 8 THEN {{'k': n_cols, 'c': columns, 'u': coalesce(unit, carry.u), 'p': carry.p, 's': carry.s}} ELSE {{'k': n_cols, 'c': columns, 'u': unit, 'p': page, 's': CAST(seg + 1 AS INT)}} END
                             WHEN n_figures = 0 AND blank + 1 > 6 THEN NULL ELSE cur END AS now
                    FROM (
                        SELECT w.doc_id, w.n, w.page, w.line, w.top, w.said, w.n_figures, w.n_cols, w.columns, w.unit, w.place, CASE WHEN w.page = r.page THEN r.cur WHEN w.page = r.page + 1 AND r.last_top > 0.7 THEN r.last END AS cur,
                            CASE WHEN w.page = r.page THEN r.carry WHEN w.page = r.page + 1 AND r.last_top > 0.7 THEN r.last END AS carry, CASE WHEN w.page = r.page THEN r.last END AS last, CASE WHEN w.page = r.page THEN r.last_top ELSE 0 END AS last_top,
                            CASE WHEN w.page = r.page THEN r.blank ELSE 0 END AS blank, CASE WHEN w.page = r.page THEN r.pending ELSE '' END AS pending, CASE WHEN w.page = r.page THEN r.seg ELSE 0 END AS seg
                        FROM r JOIN w ON w.doc_id = r.doc_id AND w.n = r.n + 1) a) b) c
        )
        SELECT doc_id, page, line, label, n_figures, cur.k AS n_cols, cur.u AS unit, cur.p AS table_page, cur.s AS table_segment FROM r WHERE shown
    """,
    "lent_context": f"""
        WITH l AS (SELECT *, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS place FROM ({CONTEXT}) x),
        m AS (SELECT *, CASE WHEN t LIKE '%lakhs%' THEN 'INR_LAKH' WHEN t LIKE '%million%' THEN 'INR_MILLION' END AS u, lower(t) LIKE '%consolidated%' AS c, lower(t) LIKE '%standalone%' AS s FROM l),
        b AS (SELECT *, CASE WHEN c AND NOT s THEN 'consolidated' WHEN s AND NOT c THEN 'standalone' END AS b FROM m),
        h AS (SELECT doc_id, page, min(line) AS line FROM b WHERE is_header GROUP BY ALL),
        p AS (SELECT doc_id, page, arg_min(u, line) FILTER (WHERE u IS NOT NULL) AS heading, bool_or(c) AS c, bool_or(s) AS s FROM b WHERE place <= 12 GROUP BY ALL),
        a AS (SELECT h.doc_id, h.page, any_value(b.u) FILTER (WHERE b.line = h.line) AS own, arg_max(b.u, b.line) FILTER (WHERE b.u IS NOT NULL AND h.line - b.line BETWEEN 1 AND 10) AS caption, arg_max(b.b, b.line) FILTER (WHERE b.b IS NOT NULL AND h.line - b.line BETWEEN 1 AND 14) AS near,
              coalesce(bool_or(b.names_rules) FILTER (WHERE h.line - b.line BETWEEN 1 AND 40), FALSE) AS eligible, list(b.t ORDER BY b.line) FILTER (WHERE b.t <> '' AND h.line - b.line BETWEEN 1 AND 14) AS above FROM h JOIN b ON b.doc_id = h.doc_id AND b.page = h.page AND b.line <= h.line GROUP BY h.doc_id, h.page),
        x AS (SELECT a.*, p.heading, CASE WHEN p.c AND NOT p.s THEN 'consolidated' WHEN p.s AND NOT p.c THEN 'standalone' END AS of_head FROM a JOIN p ON p.doc_id = a.doc_id AND p.page = a.page)
        SELECT g.doc_id, g.page, coalesce(g.unit, own, caption, heading) AS unit, CASE WHEN g.unit IS NOT NULL OR own IS NOT NULL THEN 'header' WHEN caption IS NOT NULL THEN 'caption' WHEN heading IS NOT NULL THEN 'page_heading' END AS unit_source,
            coalesce(near, of_head) AS basis, CASE WHEN x.doc_id IS NOT NULL THEN substr(coalesce(array_to_string(above[-3:], ' / '), ''), 1, 300) END AS title, coalesce(eligible, FALSE) AS eligible
        FROM ({GRIDS}) g LEFT JOIN x ON x.doc_id = g.doc_id AND x.page = g.page
    """,
}
