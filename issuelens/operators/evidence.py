"""Evidence: paths, provenance, verification against pages, hidden pages, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEARLY = r"^financials\.fiscal_years\[([^\]]+)\]\.([a-z_]+)$"


def path_parts(path: Column) -> Column:
    """struct of year label and field of a yearly path; null parts for a scalar one."""
    return F.struct(F.nullif(F.regexp_extract(path, YEARLY, 1), F.lit("")).alias("year"), F.coalesce(F.nullif(F.regexp_extract(path, YEARLY, 2), F.lit("")), path).alias("field"))


def paths(cases: DataFrame, years: DataFrame, scalars: list[str], fields: list[str]) -> DataFrame:
    """Every path that can be addressed: scalars for each case, fields for each of its years."""
    one = cases.select("case_id", F.explode(F.array(*[F.lit(s) for s in scalars])).alias("path"))
    many = years.select("case_id", F.explode(F.transform(F.array(*[F.lit(f) for f in fields]), lambda f: F.concat(F.lit("financials.fiscal_years["), F.col("year_label"), F.lit("]."), f))).alias("path"))
    return one.unionByName(many)


def updated(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """facts with changes by case_id and path; a null for a year that isn't there changes nothing."""
    c = changes.select("case_id", "path", F.col("value").alias("new"), F.lit(True).alias("touched"))
    both = facts.join(c, ["case_id", "path"], "full_outer")
    out = both.select("case_id", "path", F.when(F.col("touched"), F.col("new")).otherwise(F.col("value")).alias("value"), F.col("value").isNull().alias("was_null"))
    return out.where(~(F.col("value").isNull() & F.col("was_null"))).drop("was_null")


def review_reason(status: Column, confidence: Column) -> Column:
    parts = F.array_compact(F.array(F.when(status == "conflicting_candidates", F.lit("candidates conflict")), F.when(status == "extracted_needs_verification", F.lit("needs verification")), F.when(confidence == "low", F.lit("low confidence"))))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; "))


def kind(method: Column, page: Column) -> Column:
    return F.when(method.isin("manual", "human_corrected"), "human").when(method == "calculated", "calculated").when(page.isNotNull(), "document").otherwise("declared")


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def verified(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts with in_span, in_table and on_page: the raw figure is in its span, its page among the table's, and its characters (blanks aside) on the page.

    Facts meet page text by (doc_id, page); a page no fact cites is never read twice.
    """
    text = pages.select("doc_id", "page", squashed(F.col("text")).alias("page_text"))
    met = facts.join(text, ["doc_id", "page"], "left")
    return met.select(*facts.columns, F.contains("span", "raw").alias("in_span"), F.array_contains("table_pages", F.col("page")).alias("in_table"), F.coalesce(F.contains("page_text", squashed(F.col("raw"))), F.lit(False)).alias("on_page"))


def labels_verified(labels: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, key, found: the raw text is on any of the pages a label lists."""
    rows = labels.select("doc_id", "key", "raw", F.explode_outer("pages").alias("page")).join(pages.select("doc_id", "page", "text"), ["doc_id", "page"], "left")
    return rows.groupBy("doc_id", "key").agg(F.coalesce(F.bool_or(F.contains(squashed(F.col("text")), squashed(F.col("raw")))), F.lit(False)).alias("found"))


def visible(facts: DataFrame, hidden: DataFrame) -> DataFrame:
    """facts with at least one citation on a page that isn't hidden. facts: doc_id, citations (pages); hidden: doc_id, page."""
    gone = hidden.groupBy("doc_id").agg(F.collect_set("page").alias("hidden"))
    met = facts.join(gone, "doc_id", "left")
    return met.where(F.col("hidden").isNull() | ~F.forall("citations", lambda p: F.array_contains("hidden", p))).select(*facts.columns)


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with keys in order and nulls written."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def page_tagged(pages: DataFrame) -> DataFrame:
    """doc_id, text: pages in order, each under its tag."""
    part = F.concat(F.lit("[PDF_PAGE_"), F.col("page").cast("string"), F.lit("]\n"), F.col("text"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))), lambda p: p["part"]), "\n").alias("text"))
