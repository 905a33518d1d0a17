"""What to read first, and which filing (2.6, W07, W24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"high": 0, "medium": 1, "low": 2, "info": 3}
KIND = {"hidden": 0, "flag": 1, "conflict": 2, "unchecked": 3}


def _coded(column: Column, codes: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, n in codes.items():
        out = F.when(column == name, n).otherwise(out)
    return out


def read_first(items: DataFrame, k: int | None = None) -> DataFrame:
    """Items of each document by severity, kind, page and key. items: doc_id, kind, severity, page, key."""
    weight = F.when(F.col("kind") == "hidden", 0).when(F.col("kind") == "flag", _coded(F.col("severity"), SEVERITY, 3)).when(F.col("kind") == "conflict", F.when(F.col("severity") == "older", 5).otherwise(3)).otherwise(4)
    by = Window.partitionBy("doc_id").orderBy(weight, _coded(F.col("kind"), KIND, 9), "page", "key")
    out = items.withColumn("rank", F.row_number().over(by))
    return out.where(F.col("rank") <= k) if k else out


def triage(items: DataFrame) -> DataFrame:
    """Documents by their worst item, then by how many they have, then by name."""
    worst = items.where(F.col("kind") == "flag").groupBy("doc_id").agg(F.min(_coded(F.col("severity"), SEVERITY, 3)).alias("worst"), F.count("*").alias("n"))
    return worst.orderBy("worst", F.col("n").desc(), "doc_id")


def newest_growth(series: DataFrame) -> DataFrame:
    """Growth of the newest year over the one before, percent to one place (half up), if both are positive. series: doc_id, concept, fy, value."""
    by = Window.partitionBy("doc_id", "concept").orderBy(F.col("fy").desc())
    rows = series.withColumns({"back": F.row_number().over(by), "before": F.lead("value").over(by), "fy_before": F.lead("fy").over(by)}).where("back = 1")
    growth = F.when((F.col("value") > 0) & (F.col("before") > 0) & (F.col("fy") - F.col("fy_before") == 1), F.round((F.col("value") - F.col("before")).cast("double") / F.col("before").cast("double") * 100, 1))
    return rows.select("doc_id", "concept", "fy", growth.alias("growth_pct"))


def withheld_years(withheld: DataFrame) -> DataFrame:
    """listed: the newest two years of each document; older ones are only counted. withheld: doc_id, concept, fy."""
    newest = F.max("fy").over(Window.partitionBy("doc_id"))
    return withheld.withColumn("listed", F.col("fy") > newest - 2).groupBy("doc_id").agg(F.count_if("listed").alias("n_listed"), F.count_if(~F.col("listed")).alias("n_older"))


def chronological(end: Column, label: Column) -> list[Column]:
    """Sort keys: stored end, else 31 March of the year the label names, undated last; then the label."""
    implied = F.try_to_date(F.concat(F.regexp_extract(label, r"(\d{4})", 1), F.lit("-03-31")), "yyyy-MM-dd")
    return [F.coalesce(end, implied).asc_nulls_last(), label.asc()]


def version_key(version: Column) -> Column:
    """Versions such as 2.10.0 as arrays of numbers, which sort in order."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
