"""Reports as text, JSON and HTML, made as columns at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def json_reports(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, report: the outcome and its rule results as one JSON document."""
    rows = results.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rule_id", "category", "verdict", "review"))).alias("rules"))
    return outcomes.join(rows, "case_id").select("case_id", F.to_json(F.struct("case_id", "outcome", "passed_pct", "rules"), {"ignoreNullFields": "false"}).alias("report"))


def text_reports(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, report: a headline and a line for each rule."""
    line = F.format_string("%-32s %s%s", F.col("rule_id"), F.col("verdict"), F.when(F.col("review"), " (review)").otherwise(""))
    rows = results.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("rows"))
    head = F.format_string("Case %s: %s, %.2f%% passed", F.col("case_id").cast("string"), F.col("outcome"), F.col("passed_pct"))
    return outcomes.join(rows, "case_id").select("case_id", F.concat_ws("\n", head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("report"))


def html_reports(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, report: a heading and a table; text from documents is escaped."""
    cells = F.concat(F.lit("<tr><td>"), escaped(F.col("rule_id")), F.lit("</td><td>"), escaped(F.col("verdict")), F.lit("</td></tr>"))
    rows = results.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", cells.alias("row")))).alias("rows"))
    body = F.concat(F.lit("<h1>"), escaped(F.concat_ws(" ", F.col("case_id").cast("string"), "outcome")), F.lit("</h1><table>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), F.lit("</table>"))
    return outcomes.join(rows, "case_id").select("case_id", body.alias("report"))


def _tag(name: str, *inside: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inside, F.lit(f"</{name.split()[0]}>"))


def _text(c: Column | str) -> Column:
    """A value as text, a dash for null, escaped."""
    return escaped(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("–")))


def _row(*cells: Column) -> Column:
    return _tag("tr", *[_tag("td", c) for c in cells])


def _page(title: Column, *body: Column) -> Column:
    return F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), title, F.lit("</title></head><body>"), _tag("h1", title), *body, F.lit("</body></html>"))


def _table(heads: list[str], rows: Column) -> Column:
    return F.concat(F.lit("<table><tr>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>"), rows, F.lit("</table>"))


def _gathered(rows: DataFrame, keys: list[str], order: list[str], row: Column) -> DataFrame:
    """keys and html: the rows of each key in order. A key has as many rows as a page."""
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("row")))), lambda r: r["row"]), "")
    return rows.groupBy(*keys).agg(html.alias("html"))


def _linked(doc: Column, text: Column) -> Column:
    return F.concat(F.lit('<a href="'), escaped(doc.cast("string")), F.lit('.html">'), text, F.lit("</a>"))


def index_pages(filings: DataFrame, per_page: int = 100) -> DataFrame:
    """letter, page_no, html: all filings by issuer, so many on a page, pages by the issuer's first letter (S23). filings: doc_id, issuer, doc_type, platform, filed, severities (array), decisive, applicable."""
    by = Window.partitionBy("letter").orderBy(F.lower("issuer"), "doc_id")
    placed = filings.withColumn("letter", F.upper(F.left("issuer", F.lit(1)))).withColumn("n", F.row_number().over(by)).withColumn("page_no", F.floor((F.col("n") - 1) / per_page).cast("int"))
    found = F.when(F.size("severities") == 0, "none").otherwise(F.array_join(F.array_sort(F.array_distinct("severities")), ", "))
    flags = F.concat(F.size("severities").cast("string"), F.lit(" ("), escaped(found), F.lit(")"))
    row = _row(_linked(F.col("doc_id"), _text("issuer")), _text("doc_type"), _text("platform"), _text("filed"), flags, F.format_string("%d of %d", "decisive", "applicable"))
    pages = _gathered(placed, ["letter", "page_no"], ["n"], row)
    return pages.select("letter", "page_no", _page(F.lit("Offer document reviews"), _table(["Issuer", "Document", "Platform", "Filed", "Flags", "Rules checked"], F.col("html"))).alias("html"))


def triage_pages(filings: DataFrame, items: DataFrame, per_page: int = 100) -> DataFrame:
    """top, page_no, html: filings by the most serious item to read (9: none), then by how many there are (S23). items: doc_id, kind ('flag', 'conflict', 'unchecked', 'hidden_text', ...), rank."""
    counted = items.groupBy("doc_id").agg(F.min("rank").alias("top"), F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("flag", "conflict", "unchecked", "hidden_text")])
    met = filings.join(counted, "doc_id", "left").fillna(0, ["n", "flag", "conflict", "unchecked", "hidden_text"]).withColumn("top", F.coalesce("top", F.lit(9)))
    by = Window.partitionBy("top").orderBy(F.col("n").desc(), F.lower("issuer"), "doc_id")
    placed = met.withColumn("place", F.row_number().over(by)).withColumn("page_no", F.floor((F.col("place") - 1) / per_page).cast("int"))
    row = _row(_linked(F.col("doc_id"), _text("issuer")), _text("filed"), *[F.col(c).cast("string") for c in ("n", "flag", "conflict", "unchecked")], F.when(F.col("hidden_text") > 0, "yes").otherwise(""), F.format_string("%d of %d", "decisive", "applicable"))
    pages = _gathered(placed, ["top", "page_no"], ["place"], row)
    return pages.select("top", "page_no", _page(F.lit("Triage: what to open first"), _table(["Issuer", "Filed", "To read", "Flags", "Withheld", "Unchecked", "Hidden text", "Rules checked"], F.col("html"))).alias("html"))


def difference_pages(changes: DataFrame) -> DataFrame:
    """doc_id, html: the figures of two versions side by side, those that moved first (S23). changes: doc_id, key, kind ('same', 'changed', 'added', 'removed'), old, new (as text), pct."""
    moved = F.col("kind") != "same"
    what = F.when(~moved, "unchanged").when(F.col("kind") == "added", "only in the newer version").when(F.col("kind") == "removed", "only in the older version").when(F.col("pct").isNotNull(), F.format_string("changed %+.1f%%", "pct")).otherwise("changed")
    name = F.when(moved, _tag("b", _text("key"))).otherwise(_text("key"))
    told = changes.withColumn("held", (~moved).cast("int"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("held", "key", _row(name, _text("old"), _text("new"), what).alias("row")))), lambda r: r["row"]), "")
    pages = told.groupBy("doc_id").agg(html.alias("html"), F.count_if(moved).alias("moved"), F.count("*").alias("n"))
    said = F.format_string("<p>%d of %d comparable figures moved.</p>", "moved", "n")
    return pages.select("doc_id", _page(F.concat(_text("doc_id"), F.lit(": what changed")), said, _table(["", "Older", "Newer", ""], F.col("html"))).alias("html"))


def brief_pages(filings: DataFrame, figures: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, html: what to read first, the issue and the newest figures, each with its page (S23). figures: doc_id, place, label, value (as text), page; items: doc_id, rank, kind, text, page."""
    at = F.when(F.col("page").isNotNull(), F.format_string(" <a href='#page=%d'>open p.%d</a>", "page", "page")).otherwise("")
    entry = _tag("li", F.lit("<b>"), escaped(F.replace(F.col("kind"), F.lit("_"), F.lit(" "))), F.lit("</b> "), _text("text"), at)
    first = _gathered(items, ["doc_id"], ["rank", "text"], entry).withColumnRenamed("html", "first")
    rows = _gathered(figures, ["doc_id"], ["place"], _row(_text("label"), F.concat(_text("value"), at))).withColumnRenamed("html", "rows")
    met = filings.join(first, "doc_id", "left").join(rows, "doc_id", "left")
    todo = F.coalesce(_tag("ol", F.col("first")), F.lit("<p>Nothing flagged and nothing withheld; that clears nothing that could not be checked.</p>"))
    issue = F.coalesce(_tag("table", F.col("rows")), F.lit("<p>No figure could be read.</p>"))
    checked = F.format_string("<p>%d of %d applicable rules could be evaluated.</p>", "decisive", "applicable")
    return met.select("doc_id", _page(_text("issuer"), F.lit("<h2>Read first</h2>"), todo, F.lit("<h2>The issue</h2>"), issue, checked).alias("html"))


def draft_labels(predictions: DataFrame) -> DataFrame:
    """Predictions as labels to be checked by a person."""
    return predictions.select("doc_id", "key", F.lit("present").alias("status"), "value", F.array("page").alias("pages"), F.lit("draft").alias("note"))


def write_text(reports: DataFrame, path: str) -> None:
    """One folder for each case, so that a report is found by path."""
    reports.write.mode("errorifexists").partitionBy("case_id").text(path)
