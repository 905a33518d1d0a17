"""Summaries of runs, documents and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rules of Regulation 6(1), whose failure leaves the other route open; kinds of a difference in the order they are shown.
REG_6_1 = ("NTA_3CR", "MONETARY_ASSETS_50PCT", "AVG_OPERATING_PROFIT_15CR", "NET_WORTH_1CR", "ICDR_REG6_1D_NAME_CHANGE")
SHOWN_FIRST = ("moved", "same", "added", "removed")


def _share(part: Column, of: Column, places: int = 4) -> Column:
    return F.round(part / F.nullif(of.cast("double"), F.lit(0.0)), places)


def statement_basis(chosen: DataFrame) -> DataFrame:
    """doc_id, statement_basis: what most chosen values are of, consolidated on a tie; unknown if none says (A08). chosen: doc_id, basis."""
    n = lambda basis: F.count_if(F.col("basis") == basis)
    both = chosen.groupBy("doc_id").agg(n("consolidated").alias("c"), n("standalone").alias("s"))
    return both.select("doc_id", F.when((F.col("c") >= F.col("s")) & (F.col("c") > 0), "consolidated").when(F.col("s") > 0, "standalone").otherwise("unknown").alias("statement_basis"))


def run_metrics(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """doc_id and counts of its pages by method and of its fields by status (A09). pages: doc_id, page, method, readable, warnings; outcomes: doc_id, status."""
    n = lambda c: F.count_if(c)
    read = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), n(F.col("method") == "native").alias("native_pages"), n(F.col("method") == "ocr").alias("ocr_pages"), n(~F.col("readable")).alias("unreadable_pages"))
    status = {"fields_high": "extracted_high_confidence", "fields_needs_verification": "extracted_needs_verification", "fields_conflicting": "conflicting_candidates", "fields_not_found": "not_found"}
    fields = outcomes.groupBy("doc_id").agg(*[n(F.col("status") == s).alias(k) for k, s in status.items()])
    return read.join(fields, "doc_id", "left").fillna(0, list(status))


def run_warnings(pages: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, warnings: unreadable pages first (how many, and the first of them), then each warning of its pages once, in order, but those on skew."""
    said = pages.select("doc_id", "page", "readable", F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: ~F.contains(w, F.lit("deskew"))).alias("warnings"))
    told = said.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(~F.col("readable"), F.col("page")))).alias("bad"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("warnings")))).alias("warnings"))
    first = F.concat(F.size("bad").cast("string"), F.lit(" page(s) could not be read: ["), F.array_join(F.slice("bad", 1, most).cast("array<string>"), ", "), F.lit("]"))
    return told.select("doc_id", F.when(F.size("bad") > 0, F.concat(F.array(first), "warnings")).otherwise(F.col("warnings")).alias("warnings"))


def benchmark(rows: DataFrame) -> DataFrame:
    """split, field, and counts and rates of outcomes: over all, by split, by field (null: over all) (A23, J07). rows: doc_id, split, field, expected (any type, null: none), outcome, high, status."""
    expected = F.col("expected").isNotNull()
    n = lambda c: F.count_if(expected & c)
    wrong = F.col("outcome").isin("wrong", "wrong_page")
    counts = [
        F.countDistinct("doc_id").alias("documents"), F.count_if(expected).alias("scored"), n(F.col("outcome") == "correct").alias("correct"), n(wrong).alias("wrong"), n(F.col("outcome") == "missing").alias("missing"),
        n(F.col("status").isin("extracted_needs_verification", "conflicting_candidates")).alias("flagged"), n(wrong & F.col("high")).alias("false_high"), F.count_if(~expected).alias("abstention_cases"),
        F.count_if(~expected & (F.col("outcome") == "correct_abstention")).alias("correct_abstentions"),
    ]
    out = rows.groupingSets([[F.col("split")], [F.col("field")], []], "split", "field").agg(*counts)
    c = F.col
    return out.withColumns({"precision": _share(c("correct"), c("correct") + c("wrong")), "recall": _share(c("correct"), c("scored")), "missing_rate": _share(c("missing"), c("scored")), "false_high_rate": _share(c("false_high"), c("scored"))})


def parse_statistics(pages: DataFrame, tables: DataFrame, least: int = 25) -> DataFrame:
    """doc_id and what its parse holds (A24). pages: doc_id, page, alnum, needs_ocr, error, blocks, printed_page; tables: doc_id, unit, stitched_from, transposed."""
    n = lambda c: F.count_if(c)
    read = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), n(F.col("alnum") < least).alias("pages_no_text_layer"), n(F.col("needs_ocr")).alias("pages_needs_ocr"), n(F.col("error").isNotNull()).alias("pages_with_errors"),
        F.sum("blocks").alias("blocks"), n(F.col("printed_page").isNotNull()).alias("pages_with_printed_number"),
    )
    held = tables.groupBy("doc_id").agg(F.count("*").alias("logical_tables"), n(F.col("stitched_from") > 1).alias("multi_page_tables"), n(F.col("transposed")).alias("transposed_suspect_tables"), n(F.col("unit").isNotNull()).alias("tables_with_unit"))
    both = read.join(held, "doc_id", "left").fillna(0, ["logical_tables", "multi_page_tables", "transposed_suspect_tables", "tables_with_unit"])
    percent = lambda a, b: F.round(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1)), 1)
    return both.withColumns({"pct_needs_ocr": percent("pages_needs_ocr", "n_pages"), "pct_tables_with_unit": percent("tables_with_unit", "logical_tables")})


def analysis_summary(values: DataFrame, footed: DataFrame, agreed: DataFrame, audited: DataFrame) -> DataFrame:
    """doc_id and what its analysis found (A25). values: doc_id, verified, period, unit; footed: doc_id, ok; agreed: doc_id, total, supporters; audited: doc_id, status."""
    n = lambda c: F.count_if(c)
    parts = [
        values.groupBy("doc_id").agg(F.count("*").alias("values_total"), n(F.col("verified")).alias("values_verified"), n(F.col("period").isNull()).alias("values_without_period"), n(F.col("unit").isNull()).alias("values_without_unit")),
        footed.groupBy("doc_id").agg(F.count("*").alias("footing_checked"), n(F.col("ok")).alias("footing_passed")),
        agreed.groupBy("doc_id").agg(F.count("*").alias("consensus_groups"), n(F.col("total") > 1).alias("consensus_multi_source"), n((F.col("total") > 1) & (F.col("supporters") == F.col("total"))).alias("consensus_unanimous_multi")),
        audited.groupBy("doc_id").agg(n(F.col("status") == "flagged").alias("flags"), n(F.col("status").isin("flagged", "clear")).alias("rules_decisive"), n(~F.col("status").isin("other_platform", "not_in_force", "not_applicable")).alias("rules_applicable")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "doc_id", "full")
    return out.fillna(0)


def unresolved(results: DataFrame) -> DataFrame:
    """case_id, issues: of each rule without a verdict what is missing, of each to be reviewed why, in the rules' order (A32). results: case_id, ord, rule_id, verdict, missing, review, reasons."""
    listed = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise("see rule")
    said = F.when(F.col("verdict") == "inconclusive", F.concat("rule_id", F.lit(": missing evidence — "), listed("missing", ", "))).when(F.col("review"), F.concat("rule_id", F.lit(": review required — "), listed("reasons", "; ")))
    told = results.withColumn("said", said).where("said is not null")
    return told.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "said"))), lambda x: x["said"]).alias("issues"))


def observations(results: DataFrame, years: DataFrame) -> DataFrame:
    """case_id, kind, rules: remarks that block nothing (A32): failed conditions of Regulation 6(1), advisory rules that failed, revenue lower than two years before. results: case_id, ord, rule_id, verdict, mandatory; years: case_id, fy, revenue, reliable."""
    failed = results.where("verdict = 'fail'")
    rules = lambda rows, kind: rows.groupBy("case_id").agg(F.lit(kind).alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rule_id"))), lambda x: x["rule_id"]), ", ").alias("rules"))
    last = years.groupBy("case_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("fy", "revenue", "reliable")))), 1, 3).alias("last")).where(F.size("last") == 3)
    sure = F.forall("last", lambda y: F.coalesce(y["reliable"], F.lit(False)) & y["revenue"].isNotNull())
    fell = last.where(sure & (F.get("last", F.lit(0))["revenue"] < F.get("last", F.lit(2))["revenue"])).select("case_id", F.lit("revenue_declined").alias("kind"), F.lit("").alias("rules"))
    open_ = failed.where(F.col("mandatory") & F.col("rule_id").isin(*REG_6_1))
    return rules(open_, "reg6_1_failed").unionByName(rules(failed.where("not mandatory"), "advisory_flagged")).unionByName(fell)


def timings(rows: DataFrame) -> DataFrame:
    """name, n, mean, median, slowest (A35). rows: name, seconds."""
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.max("seconds").alias("slowest"))


def shown(differences: DataFrame) -> DataFrame:
    """differences with place: moved figures first, then those that held, then those on one side (A41). differences: doc_id, key, kind."""
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(SHOWN_FIRST)])
    return differences.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(order, "key")))


def one_sided(differences: DataFrame) -> DataFrame:
    """doc_id, kind, concept, periods of figures that only one side has, as one entry each (A41). differences: doc_id, key (…concept.period), kind."""
    concept, period = F.regexp_extract("key", r"^(.*)\.[^.]*$", 1), F.substring_index("key", ".", -1)
    return differences.where("kind in ('added', 'removed')").groupBy("doc_id", "kind", concept.alias("concept")).agg(F.array_join(F.array_sort(F.collect_set(period)), ", ").alias("periods"))
