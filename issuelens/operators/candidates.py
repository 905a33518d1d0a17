"""Candidates for a field, their clusters and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CRITICAL = ["net_tangible_assets", "monetary_assets", "operating_profit", "net_worth"]
MARGIN = 0.15


def score(label: Column, unit: Column, period: Column, section: Column, basis: Column, quality: Column) -> Column:
    """Weighted sum of components in 0 to 1, to four places."""
    return F.round(0.35 * label + 0.20 * unit + 0.15 * period + 0.10 * section + 0.10 * basis + 0.10 * quality, 4)


def clustered(candidates: DataFrame) -> DataFrame:
    """doc_id, field, clusters: from the best score down, a candidate joins the first cluster whose head lies within the tolerances.

    candidates: doc_id, field, value, tol, score, source. A field of a document has a bounded number of candidates.
    """
    element = "struct<neg:double,ord:long,value:double,tol:double,source:string>"
    order = F.struct((-F.col("score")).alias("neg"), F.col("ord").cast("long").alias("ord"), F.col("value").cast("double").alias("value"), F.col("tol").cast("double").alias("tol"), F.col("source").cast("string").alias("source"))
    rows = candidates.groupBy("doc_id", "field").agg(F.array_sort(F.collect_list(order)).alias("rows"))
    empty = F.array().cast(f"array<struct<head:double,tol:double,top:double,members:array<{element}>>>")

    def add(acc: Column, r: Column) -> Column:
        near = lambda k: F.abs(k["head"] - r["value"]) <= F.greatest(k["tol"], r["tol"]) + 1e-6
        at = F.array_position(F.transform(acc, near), F.lit(True))
        grown = F.transform(acc, lambda k, i: F.when(i + 1 == at, F.struct(k["head"].alias("head"), k["tol"].alias("tol"), k["top"].alias("top"), F.concat(k["members"], F.array(r)).alias("members"))).otherwise(k))
        fresh = F.struct(r["value"].alias("head"), r["tol"].alias("tol"), (-r["neg"]).alias("top"), F.array(r).alias("members"))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(fresh)))

    return rows.select("doc_id", "field", F.aggregate("rows", empty, add).alias("clusters"))


def decide(candidates: DataFrame) -> DataFrame:
    """doc_id, field, value, score, sources, rivals, status: the best cluster, conflicting if another comes within MARGIN of it.

    A cluster scores its best candidate plus 0.05 for each further source, 0.1 at most.
    """
    sources = lambda k: F.size(F.array_distinct(F.transform(k["members"], lambda m: m["source"])))
    total = lambda k: k["top"] + F.least(F.lit(0.1), 0.05 * (sources(k) - 1))
    scored = clustered(candidates).withColumn("k", F.transform("clusters", lambda k, i: F.struct(total(k).alias("score"), (-i).alias("first"), sources(k).alias("sources"), k["head"].alias("value"))))
    best = F.array_max("k")
    rivals = F.size(F.filter("k", lambda k: k["score"] >= best["score"] - MARGIN - 1e-9)) - 1
    need = F.when(F.col("field").isin(CRITICAL), 0.78).otherwise(0.72)
    status = F.when(rivals > 0, "conflicting_candidates").when((best["score"] >= need) & (best["sources"] >= 2), "extracted_high_confidence").otherwise("extracted_needs_verification")
    return scored.select("doc_id", "field", best["value"].alias("value"), F.round(best["score"], 4).alias("score"), best["sources"].cast("long").alias("sources"), rivals.cast("long").alias("rivals"), status.alias("status"))


def cross_checked(decisions: DataFrame) -> DataFrame:
    """Downgrades within a period: assets above 1.001 times all assets, negative money or revenue. decisions: doc_id, period, field, value, status."""
    by = Window.partitionBy("doc_id", "period")
    all_ = F.max(F.when(F.col("field") == "total_assets", F.col("value"))).over(by)
    over = F.col("field").isin("net_tangible_assets", "monetary_assets") & (F.col("value") * 1000 > all_ * 1001)
    below = F.col("field").isin("monetary_assets", "revenue") & (F.col("value") < 0)
    doubt = F.coalesce(over | below, F.lit(False))
    return decisions.withColumn("checked", F.when(doubt & (F.col("status") == "extracted_high_confidence"), "extracted_needs_verification").otherwise(F.col("status")))


def top_candidates(candidates: DataFrame, k: int = 8) -> DataFrame:
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "field").orderBy(F.col("score").desc(), "ord"))).where(F.col("rank") <= k)


def confidence(of: Column) -> Column:
    return F.when(of >= 0.72, "high").when(of >= 0.5, "medium").otherwise("low")
