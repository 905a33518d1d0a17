"""Differences between versions, and accuracy against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import family


def changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, old, new, kind (same, moved, added, removed, period_only) and pct. old, new: keys, value, step; one-sided yearly figures are period_only."""
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("value").alias("old"), F.col("step").alias("o_step"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col("value").alias("new"), F.col("step").alias("n_step"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys]
    both = o.join(n, on, "full_outer")
    key = [F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys]
    same = F.abs(F.col("new") - F.col("old")) <= F.greatest("o_step", "n_step")
    one_sided = F.col("old").isNull() | F.col("new").isNull()
    yearly = F.coalesce(F.coalesce(f"o_{keys[-1]}", f"n_{keys[-1]}").cast("string").startswith("financials."), F.lit(False))
    kind = F.when(one_sided & yearly, "period_only").when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same, "same").otherwise("moved")
    pct = F.when(F.col("old") != 0, (F.col("new") - F.col("old")) / F.abs(F.col("old")) * 100)
    return both.select(*key, "old", "new", kind.alias("kind"), pct.alias("pct"))


def status_changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """added, removed or kept, for rows of keys on either side."""
    o, n = old.select(*keys).distinct().withColumn("in_old", F.lit(True)), new.select(*keys).distinct().withColumn("in_new", F.lit(True))
    both = o.join(n, list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("kept").alias("kind"))


def scored(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """labels with verdict and citation: correct, wrong, abstained, hallucinated or absent. Of predictions with the same key, the last (by seq) counts."""
    last = predictions.groupBy("doc_id", "key").agg(F.max_by(F.struct("value", "step", "page"), "seq").alias("p"))
    met = labels.join(last, ["doc_id", "key"], "left")
    near = F.abs(F.col("p.value") - F.col("value")) <= F.greatest("step", "p.step")
    verdict = F.when(F.col("status") == "present", F.when(F.col("p").isNull(), "abstained").when(near, "correct").otherwise("wrong")).otherwise(F.when(F.col("p").isNull(), "absent").otherwise("hallucinated"))
    return met.select("doc_id", "key", "status", verdict.alias("verdict"), (F.coalesce(near, F.lit(False)) & F.array_contains("pages", F.col("p.page"))).alias("cited"))


def report(judged: DataFrame, by: Column | None = None) -> DataFrame:
    """Counts and ratios for everything and for each family of keys (null: all); ratios are null over nothing."""
    rows = judged.withColumn("part", family(F.col("key")) if by is None else by)
    n = lambda v: F.count_if(F.col("verdict") == v)
    answered = n("correct") + n("wrong")
    out = rows.groupingSets([["part"], []], "part").agg(
        F.grouping("part").alias("is_total"), n("correct").alias("n_correct"), n("wrong").alias("n_wrong"), n("abstained").alias("n_abstained"), n("hallucinated").alias("n_hallucinated"), F.count_if("cited").alias("n_cited"),
        F.try_divide(n("correct"), answered).alias("precision"), F.try_divide(n("correct"), answered + n("abstained")).alias("recall"),
    )
    return out


def stale_labels(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Label files whose document has changed since: same doc_id, another hash."""
    m = manifest.select("doc_id", F.col("sha256").alias("current"))
    return labels.join(m, "doc_id").where(F.col("sha256") != F.col("current")).select("doc_id", "sha256", "current")
