"""Footing, consensus over readings, and the facts that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Identities (name, kind of statement, total, signed parts), and concepts that measure size or anchor a column.
IDENTITIES = [
    ("total_income", "income", "total_income", [(1, "revenue_from_operations"), (1, "other_income")]),
    ("profit_after_tax", "flow", "profit_after_tax", [(1, "profit_before_tax"), (-1, "tax_expense")]),
    ("total_assets", "stock", "total_assets", [(1, "total_equity_and_liabilities")]),
]
SIZE_CONCEPTS = ["revenue_from_operations", "total_income", "total_expenses", "total_assets", "total_equity_and_liabilities"]
ANCHORS = ["revenue_from_operations", "total_income", "profit_before_tax", "profit_after_tax"]
OTHER_ENTITY = r"(?i)excluding|\bex[- ]|\bexcl\b|standalone|stand-alone|subsidiar|segment|pro[- ]?forma|previous\s+gaap|indian\s+gaap"


def statement_kind(instant: Column, months: Column, end: Column) -> Column:
    """stock, flow or income: what an identity may be tested on."""
    return F.when(instant & (F.date_format(end, "MM-dd") == "03-31"), "stock or income").when(instant, "stock").otherwise("flow or income")


def footing(values: DataFrame, identities: list = IDENTITIES) -> DataFrame:
    """table_id, period, identity, ok: identities whose concepts all occur exactly once, in one unit; the tolerance is the printed step times the parts and one.

    values: table_id, period, concept, value, unit, step. One grouping serves all identities.
    """
    names = sorted({c for _, _, total, parts in identities for c in [total, *[p for _, p in parts]]})
    is_ = lambda c: F.col("concept") == c
    held = values.where(F.col("concept").isin(names)).groupBy("table_id", "period").agg(
        *[F.count_if(is_(c)).alias(f"n_{c}") for c in names], *[F.max(F.when(is_(c), F.col("value"))).alias(f"v_{c}") for c in names],
        *[F.max(F.when(is_(c), F.col("unit"))).alias(f"u_{c}") for c in names], *[F.max(F.when(is_(c), F.col("step"))).alias(f"s_{c}") for c in names],
    )
    tests = []
    for name, _, total, parts in identities:
        all_ = [total, *[p for _, p in parts]]
        once, one_unit = F.lit(True), F.lit(True)
        for x in all_:
            once, one_unit = once & (F.col(f"n_{x}") == 1), one_unit & F.col(f"u_{x}").eqNullSafe(F.col(f"u_{total}"))
        sum_ = sum((F.col(f"v_{p}") * F.lit(sign) for sign, p in parts), F.lit(0))
        slack = F.greatest(*[F.col(f"s_{x}") for x in all_], F.lit(0.0)) * (len(parts) + 1)
        off = F.abs(F.col(f"v_{total}") - sum_)
        tests.append(F.when(once & one_unit, F.struct(F.lit(name).alias("identity"), (off.cast("double") <= slack).alias("ok"))))
    return held.select("table_id", "period", F.explode(F.array_compact(F.array(*tests))).alias("t")).select("table_id", "period", "t.identity", "t.ok")


def trusted_columns(footed: DataFrame) -> DataFrame:
    """Columns where some identity was tested and none failed."""
    return footed.groupBy("table_id", "period").agg(F.bool_and("ok").alias("ok")).where("ok").select("table_id", "period")


def without_ambiguous(values: DataFrame) -> DataFrame:
    """Readings whose table shows one value only for their concept and period."""
    keys = ["doc_id", "table_id", "concept", "period"]
    one = values.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where(F.col("lo") == F.col("hi")).select(*keys)
    return values.join(one, keys, "left_semi")


def clusters(readings: Column) -> Column:
    """Readings (array of struct with value first, then step) gathered from the least value up: one joins the last cluster if it lies within a step of its head.

    A fold, since closeness to a head isn't transitive: array of struct(head, step, members).
    """
    element = "struct<value:double,step:double,weight:double,confidence:double>"
    empty = F.array().cast(f"array<struct<head:double,step:double,members:array<{element}>>>")

    def add(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = last.isNotNull() & (r["value"] - last["head"] <= F.greatest(last["step"], r["step"]))
        grown = F.struct(last["head"].alias("head"), F.greatest(last["step"], r["step"]).alias("step"), F.concat(last["members"], F.array(r)).alias("members"))
        fresh = F.struct(r["value"].alias("head"), r["step"].alias("step"), F.array(r).alias("members"))
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(F.array_sort(readings.cast(f"array<{element}>")), empty, add)


def weigh(readings: DataFrame) -> DataFrame:
    """weight: 2 in the first quarter of the pages, else 1; 0 for another entity's column, unless every reading of the figure is such."""
    keys = Window.partitionBy("doc_id", "concept", "period")
    other = F.coalesce(F.col("header"), F.lit("")).rlike(OTHER_ENTITY)
    alone = F.bool_and(other).over(keys)
    front = F.when(F.col("n_pages").isNotNull() & (F.col("page") * 4 <= F.col("n_pages")), 2.0).otherwise(1.0)
    return readings.withColumn("weight", F.when(F.col("n_pages").isNotNull() & other & ~alone, 0.0).otherwise(front))


def consensus(readings: DataFrame) -> DataFrame:
    """doc_id, concept, period, value, total, supporters, strength, rival, largest. readings: doc_id, concept, period, value, step, weight, confidence, trusted.

    Equal readings are summed before they gather, so a group holds as many rows as it has different values, not readings.
    Of equally strong clusters that of more confidence a reading wins, then the lower one; confidence is added as decimals,
    since sums of doubles depend on their order and part clusters that tie. If some readings are of trusted columns, only those compete; the others back the cluster they agree with.
    """
    keys = ["doc_id", "concept", "period"]
    same = readings.groupBy(*keys, "value", "step", "trusted").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(F.col("confidence").cast("decimal(18,12)")).alias("confidence"))
    gathered = same.groupBy(*keys).agg(
        F.bool_or("trusted").alias("any_trusted"),
        F.collect_list(F.struct(F.col("value").cast("double").alias("value"), F.col("step").cast("double").alias("step"), F.col("weight").cast("double").alias("weight"), F.col("confidence").alias("confidence"), F.col("n").alias("n"), F.col("trusted").alias("trusted"))).alias("all"),
    )
    competing = F.filter("all", lambda r: r["trusted"] | ~F.col("any_trusted"))
    plain = F.transform(competing, lambda r: F.struct(r["value"], r["step"], r["weight"], r["confidence"]))
    made = gathered.withColumn("made", clusters(plain))

    def near(k: Column) -> Column:
        """Members of the cluster, and readings that don't compete but agree with its head."""
        own = lambda r: F.exists(k["members"], lambda m: (m["value"] == r["value"]) & (m["step"] == r["step"]))
        agrees = lambda r: F.abs(r["value"] - k["head"]) <= F.greatest(r["step"], k["step"])
        return F.filter("all", lambda r: F.when(r["trusted"] | ~F.col("any_trusted"), own(r)).otherwise(agrees(r)))

    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda a, r: a + r[f].cast("double"))
    sure = lambda rows: F.aggregate(rows, F.lit(0).cast("decimal(38,12)"), lambda a, r: (a + r["confidence"]).cast("decimal(38,12)")) / total(rows, "n").cast("decimal(20,0)")

    def scored(k: Column) -> Column:
        backers = near(k)
        mode = F.array_max(F.transform(backers, lambda r: F.struct(r["n"].alias("n"), (-r["step"]).alias("fine"), (r["confidence"] / r["n"].cast("decimal(20,0)")).alias("confidence"), r["value"].alias("value"))))
        return F.struct(total(backers, "weight").alias("strength"), sure(backers).alias("confidence"), (-k["head"]).alias("order"), total(backers, "n").cast("long").alias("supporters"), mode["value"].alias("value"), k["head"].alias("head"))

    ranked = made.withColumn("ranked", F.reverse(F.array_sort(F.transform("made", scored))))
    best, second = F.element_at("ranked", 1), F.try_element_at(F.col("ranked"), F.lit(2))
    rival = F.coalesce(second["strength"], F.lit(0.0))
    return ranked.select(*keys, best["value"].alias("value"), F.aggregate("all", F.lit(0).cast("long"), lambda a, r: a + r["n"]).alias("total"), best["supporters"].alias("supporters"), best["strength"].alias("strength"), rival.alias("rival"), (best["head"] >= F.array_max(F.transform("ranked", lambda k: k["head"]))).alias("largest"))


def keep() -> Column:
    """A lone reading; or two and twice the rival; or the largest of a size concept, with two and a lead."""
    double = (F.col("supporters") >= 2) & (F.col("strength") >= 2 * F.col("rival"))
    lead = F.col("concept").isin(SIZE_CONCEPTS) & F.col("largest") & (F.col("supporters") >= 2) & (F.col("strength") > F.col("rival"))
    return (F.col("total") == 1) | double | lead


def quarantined(readings: DataFrame, agreed: DataFrame) -> DataFrame:
    """Columns (doc_id, table_id, period) with anchors to compare with a decisive consensus, none of which agrees."""
    decisive = agreed.where(F.col("concept").isin(ANCHORS) & (F.col("supporters") >= 2) & (F.col("strength") >= 2 * F.col("rival"))).select("doc_id", "concept", "period", F.col("value").alias("agreed"))
    met = readings.join(decisive, ["doc_id", "concept", "period"])
    return met.groupBy("doc_id", "table_id", "period").agg(F.bool_or(F.abs(F.col("value").cast("double") - F.col("agreed")) <= F.col("step").cast("double")).alias("some")).where("not some").select("doc_id", "table_id", "period")


def facts(readings: DataFrame) -> DataFrame:
    """Two passes, no more: consensus, then again without the columns it has quarantined; what keep() lets stand."""
    first = consensus(readings)
    again = consensus(readings.join(quarantined(readings, first), ["doc_id", "table_id", "period"], "left_anti"))
    return again.where(keep()).select("doc_id", F.concat(F.lit("financials."), "concept", F.lit("."), "period").alias("key"), "value", "supporters")


def matrix(kept: DataFrame, years: list[str]) -> DataFrame:
    """A row for each document and concept, a column for each year. kept: doc_id, concept, period, value."""
    return kept.groupBy("doc_id", "concept").pivot("period", years).agg(F.first("value"))


def withheld(agreed: DataFrame) -> DataFrame:
    """Figures of fiscal years that were read but not kept."""
    return agreed.where(F.col("period").startswith("FY") & ~keep()).select("doc_id", "concept", "period", "total", "supporters")


def filing_index(flags: DataFrame) -> DataFrame:
    """doc_id, flag count, distinct severities (sorted), rules decided and applicable."""
    decided = F.col("status").isin("flagged", "clear")
    return flags.groupBy("doc_id").agg(
        F.count_if(F.col("status") == "flagged").alias("n_flags"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "flagged", F.col("severity")))), ",").alias("severities"),
        F.count_if(decided).alias("n_decided"), F.count_if(decided | (F.col("status") == "missing_inputs")).alias("n_applicable"),
    )
