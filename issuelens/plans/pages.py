"""Pages for readers: index, triage, differences and briefs of suppliers as filings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import reports
from .inputs import portable

Query = Callable[[SparkSession, str], DataFrame]

FILINGS = "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 6 = 0 THEN concat('A&B <', s_name, '>') WHEN s_suppkey % 6 = 1 THEN lower(s_name) ELSE s_name END AS issuer, CASE s_suppkey % 3 WHEN 0 THEN 'drhp' ELSE 'rhp' END AS doc_type, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'sme' ELSE 'mainboard' END AS platform, CASE WHEN s_suppkey % 5 > 0 THEN concat('2024-01-1', CAST(s_suppkey % 10 AS VARCHAR(2))) END AS filed, CAST(s_suppkey % 12 AS INT) AS decisive, 12 AS applicable FROM supplier"
ITEMS = "SELECT l_suppkey AS doc_id, CASE l_returnflag WHEN 'R' THEN 'flag' WHEN 'A' THEN 'conflict' ELSE CASE l_linenumber WHEN 1 THEN 'hidden_text' ELSE 'unchecked' END END AS kind, CAST(l_linenumber AS INT) AS rank, concat('order ', CAST(l_orderkey AS VARCHAR(20)), ' & line ', CAST(l_linenumber AS VARCHAR(3)), ' of ', CAST(l_partkey AS VARCHAR(20))) AS text, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey % 400 AS INT) END AS page FROM lineitem WHERE l_quantity > 47 AND l_suppkey % 7 > 0"
FIGURES = "SELECT doc_id, CAST(place AS INT) AS place, label, value, page FROM (SELECT l_suppkey AS doc_id, l_linenumber AS place, concat('<Line> ', CAST(l_linenumber AS VARCHAR(3))) AS label, CAST(CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS VARCHAR(20)) AS value, CAST(MIN(l_orderkey) AS INT) AS page FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY l_suppkey, l_linenumber) x"
CHANGES = """
    SELECT doc_id, key, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'same' ELSE 'changed' END AS kind, CAST(old AS VARCHAR(20)) AS old, CAST(new AS VARCHAR(20)) AS new, CASE WHEN old <> new AND old % 4 > 0 THEN (new - old) / CAST(10 AS DOUBLE) END AS pct
    FROM (SELECT l_suppkey AS doc_id, concat('orders.', CAST(l_orderkey % 30 AS VARCHAR(3))) AS key, CAST(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS BIGINT) END) AS BIGINT) AS old, CAST(SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS BIGINT) END) AS BIGINT) AS new FROM lineitem GROUP BY l_suppkey, l_orderkey % 30) x
"""


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severities = portable(spark, sf_dir, ITEMS).where("kind = 'flag'").groupBy("doc_id").agg(F.collect_list(F.when(F.col("rank") < 3, "high").otherwise("low")).alias("severities"))
    return portable(spark, sf_dir, FILINGS).join(severities, "doc_id", "left").withColumn("severities", F.coalesce("severities", F.array().cast("array<string>")))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.index_pages(_filings(spark, sf_dir), 20)


def triage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.triage_pages(_filings(spark, sf_dir), portable(spark, sf_dir, ITEMS), 20)


def difference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.difference_pages(portable(spark, sf_dir, CHANGES))


def brief_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.brief_pages(_filings(spark, sf_dir), portable(spark, sf_dir, FIGURES), portable(spark, sf_dir, ITEMS))


QUERIES: dict[str, Query] = {f.__name__: f for f in (index_pages, triage_pages, difference_pages, brief_pages)}


def _safe(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _cells(*cells: str) -> str:
    return "'<tr>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"


def _whole(title: str, *body: str) -> str:
    return f"'<!doctype html><html><head><meta charset=''utf-8''><title>' || {title} || '</title></head><body><h1>' || {title} || '</h1>' || " + " || ".join(body) + " || '</body></html>'"


def _heads(*names: str) -> str:
    return "'<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>'"


_LINK = f"'<a href=\"' || f.doc_id || '.html\">' || {_safe('f.issuer')} || '</a>'"
_AT = "CASE WHEN page IS NOT NULL THEN ' <a href=''#page=' || page || '''>open p.' || page || '</a>' ELSE '' END"
ORACLE: dict[str, str] = {
    "index_pages": f"""
        WITH s AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT CASE WHEN rank < 3 THEN 'high' ELSE 'low' END, ', ' ORDER BY CASE WHEN rank < 3 THEN 'high' ELSE 'low' END) AS said FROM ({ITEMS}) i WHERE kind = 'flag' GROUP BY doc_id),
        f AS (SELECT *, upper(left(issuer, 1)) AS letter, row_number() OVER (PARTITION BY upper(left(issuer, 1)) ORDER BY lower(issuer), doc_id) AS place FROM ({FILINGS}) x),
        r AS (SELECT letter, place, {_cells(_LINK, "doc_type", "coalesce(platform, '–')", "coalesce(filed, '–')", "coalesce(s.n, 0) || ' (' || coalesce(s.said, 'none') || ')'", "decisive || ' of ' || applicable")} AS row FROM f LEFT JOIN s ON s.doc_id = f.doc_id)
        SELECT letter, CAST((place - 1) // 20 AS INT) AS page_no, {_whole("'Offer document reviews'", _heads('Issuer', 'Document', 'Platform', 'Filed', 'Flags', 'Rules checked'), "string_agg(row, '' ORDER BY place)", "'</table>'")} AS html FROM r GROUP BY ALL
    """,
    "triage_pages": f"""
        WITH c AS (SELECT doc_id, min(rank) AS top, count(*) AS n, count(*) FILTER (WHERE kind = 'flag') AS flag, count(*) FILTER (WHERE kind = 'conflict') AS conflict, count(*) FILTER (WHERE kind = 'unchecked') AS unchecked, count(*) FILTER (WHERE kind = 'hidden_text') AS hidden FROM ({ITEMS}) i GROUP BY doc_id),
        f AS (SELECT x.*, coalesce(c.top, 9) AS top, coalesce(n, 0) AS n, coalesce(flag, 0) AS flag, coalesce(conflict, 0) AS conflict, coalesce(unchecked, 0) AS unchecked, coalesce(hidden, 0) AS hidden FROM ({FILINGS}) x LEFT JOIN c ON c.doc_id = x.doc_id),
        r AS (SELECT top, row_number() OVER (PARTITION BY top ORDER BY n DESC, lower(issuer), doc_id) AS place, {_cells(_LINK, "coalesce(filed, '–')", "n", "flag", "conflict", "unchecked", "CASE WHEN hidden > 0 THEN 'yes' ELSE '' END", "decisive || ' of ' || applicable")} AS row FROM f)
        SELECT CAST(top AS INT) AS top, CAST((place - 1) // 20 AS INT) AS page_no, {_whole("'Triage: what to open first'", _heads('Issuer', 'Filed', 'To read', 'Flags', 'Withheld', 'Unchecked', 'Hidden text', 'Rules checked'), "string_agg(row, '' ORDER BY place)", "'</table>'")} AS html FROM r GROUP BY top, (place - 1) // 20
    """,
    "difference_pages": f"""
        WITH r AS (SELECT doc_id, key, kind <> 'same' AS moved, {_cells("CASE WHEN kind <> 'same' THEN '<b>' || key || '</b>' ELSE key END", "coalesce(old, '–')", "coalesce(new, '–')", "CASE kind WHEN 'same' THEN 'unchanged' WHEN 'added' THEN 'only in the newer version' WHEN 'removed' THEN 'only in the older version' ELSE coalesce('changed ' || format('{:+.1f}%', pct), 'changed') END")} AS row FROM ({CHANGES}) c)
        SELECT doc_id, {_whole("doc_id || ': what changed'", "'<p>' || count(*) FILTER (WHERE moved) || ' of ' || count(*) || ' comparable figures moved.</p>'", _heads('', 'Older', 'Newer', ''), "string_agg(row, '' ORDER BY NOT moved, key)", "'</table>'")} AS html FROM r GROUP BY doc_id
    """,
    "brief_pages": f"""
        WITH i AS (SELECT doc_id, string_agg('<li><b>' || replace(kind, '_', ' ') || '</b> ' || {_safe('text')} || {_AT} || '</li>', '' ORDER BY rank, text) AS html FROM ({ITEMS}) x GROUP BY doc_id), g AS (SELECT doc_id, string_agg({_cells(_safe('label'), f"value || {_AT}")}, '' ORDER BY place) AS html FROM ({FIGURES}) x GROUP BY doc_id)
        SELECT f.doc_id, {_whole(_safe('f.issuer'), "'<h2>Read first</h2>'", "coalesce('<ol>' || i.html || '</ol>', '<p>Nothing flagged and nothing withheld; that clears nothing that could not be checked.</p>')", "'<h2>The issue</h2>'", "coalesce('<table>' || g.html || '</table>', '<p>No figure could be read.</p>')", "'<p>' || decisive || ' of ' || applicable || ' applicable rules could be evaluated.</p>'")} AS html
        FROM ({FILINGS}) f LEFT JOIN i ON i.doc_id = f.doc_id LEFT JOIN g ON g.doc_id = f.doc_id
    """,
}
