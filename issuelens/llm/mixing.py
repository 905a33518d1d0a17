"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words (shares by weight, held to a multiple of the source's words). A source whose target
is r times its words takes floor(r) certain copies of every document; the words still wanted are a Pareto order sample of
its documents. Their inclusion probabilities are proportional to size / (size + HALF_WORDS), held to 1, and calibrated so
that the words they are expected to bring are the words wanted (documents held to 1 are certain). Documents are ranked by
their random odds u/(1-u) over their inclusion odds p/(1-p) and taken in that order until the words wanted are reached, so
the sample has a fixed size in words.

The cut is found from sums by (source, slice of the rank), first coarse slices, then fine ones inside the coarse slice
that holds it, then documents inside the fine one, so no task ever holds a source. Rows that repeat one document share a
rank and are summed before they are ordered; where the cut falls among them, they are numbered part by part and as many
are taken as bring the words nearest to those wanted. Only a table with one row for each source meets the documents.

Defined cases: null text counts 0 words and is never sampled; null source is a source of its own, last in order; an
empty table gives an empty result; rows that share a doc_id, or have none, are told apart by their text; columns of the
input with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, text_or_empty, written

#: Slices of the logarithm of the rank, for one unit of it; the logarithm spans about 100 units.
COARSE, SLICES = 32, 4096
#: Words at which a document reaches half the full inclusion probability.
HALF_WORDS = 64
#: The order of the sample; rows equal in all of these repeat one document.
KEY = ("rank", "doc_id", "size", "text_hash")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from rows of source and size. The weights repeat over the sources in order of code point, null last.

    A level l gives every source min(cap * size, weight * l); sources are met in the order in which they reach their
    cap, and the level is that of the first that stays below.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    ranked = by_source.withColumn("weight", pick).withColumn("limit", F.col("source_size") * F.lit(cap))
    everything = Window.partitionBy()
    reach = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(everything) * F.lit(share)
    before = F.coalesce(F.sum("limit").over(reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(reach.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (total - before) / left)
    open_level = F.max(F.when(F.col("limit") / F.col("weight") > F.col("level"), F.col("level"))).over(everything)
    return levels.withColumn("at", open_level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("weight") * F.col("at"))).alias("target"))


def _uniform(seed: int, *columns: str) -> Column:
    """In (0, 1), the same for the same columns in every run."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def odds_scale(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """scale_source, scale: of each source, the factor c for which documents of odds min(1, c * tilt) bring the words wanted.

    A source's documents count by size, largest first: at each size, c is what is left of the words wanted without the
    larger ones over the tilted words of the others; the first c that holds no smaller one to 1 is the factor.
    """
    met = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    met = met.join(plan.where("want > 0").select(F.col("source").alias("of"), "want"), F.col("source").eqNullSafe(F.col("of")))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    certain = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tilted = F.sum(F.col("size") * F.col("n") * _tilt()).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = met.withColumn("scale", (F.col("want") - certain) / tilted).where(F.col("scale") * _tilt() <= 1)
    return tried.groupBy(F.col("source").alias("scale_source")).agg(F.max_by("scale", "size").alias("scale"))


def _tilt() -> Column:
    return F.col("size") / (F.col("size") + HALF_WORDS)


def _cut(rows: DataFrame, per: int) -> DataFrame:
    """cut_source, cut_slice, left_over: of each source, the slice in which its words reach what is wanted, and what is wanted of it."""
    by_slice = rows.groupBy("source", F.floor(F.col("rank") * per).alias("at"), "want").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    reached = by_slice.withColumn("upto", upto).where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("words") < F.col("want")))
    return reached.select(F.col("source").alias("cut_source"), F.col("at").alias("cut_slice"), (F.col("want") - F.col("upto") + F.col("words")).alias("left_over"))


def _inside(rows: DataFrame, cut: DataFrame, per: int) -> DataFrame:
    """The rows of the slices of cut, wanted being what is left over for the slice."""
    met = rows.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.floor(F.col("rank") * per) == F.col("cut_slice")))
    return met.select("source", *KEY, F.col("left_over").alias("want"))


def _last_taken(inner: DataFrame, cut: DataFrame) -> DataFrame:
    """cut with last (the last key that is taken whole) and split, split_rows (a key of which only so many rows are taken)."""
    edge = _inside(inner, cut, SLICES).groupBy("source", *KEY, "want").agg(F.count("*").alias("n"))
    words = F.col("size") * F.col("n")
    edge = edge.withColumn("before", F.sum(words).over(Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0)) - words)
    edge = edge.withColumn("take", F.least(F.col("n"), F.round((F.col("want") - F.col("before")) / F.col("size")).cast("long"))).where("take > 0")
    key = F.struct(*KEY)
    last = edge.groupBy(F.col("source").alias("last_source")).agg(
        F.max(F.when(F.col("take") == F.col("n"), key)).alias("last"), F.max(F.when(F.col("take") < F.col("n"), F.struct(key.alias("key"), F.col("take").alias("rows")))).alias("split")
    )
    return cut.join(last, F.col("cut_source").eqNullSafe(F.col("last_source")), "left").select("cut_source", "cut_slice", "last", "split")


def _numbered(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Of the rows of split keys, the first split.rows of each source are sampled. Numbered part by part, so that a document repeated any number of times is never in one task."""
    held = written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)))
    parts = held.groupBy("source", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("part_source"), F.col("part").alias("of_part"), before.alias("rows_before"))
    met = held.join(parts, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("part") == F.col("of_part")))
    place = F.col("rows_before") + F.row_number().over(Window.partitionBy("source", "part").orderBy("row"))
    return met.withColumn("sampled", place <= F.col("split.rows")).select(*kept, "size", "source_size", "target", "whole", "sampled")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target, copies and taken. Needs doc_id, text and source."""
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    text_hash = F.xxhash64(text_or_empty()).alias("text_hash")
    sizes = written(docs.select("doc_id", "source", n_words().alias("size"), text_hash))
    goals = written(targets(sizes, weights, share, cap))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    plan = goals.withColumn("whole", whole).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = written(plan.join(odds_scale(sizes, plan), F.col("source").eqNullSafe(F.col("scale_source")), "left").drop("scale_source"))

    def ranked(rows: DataFrame) -> DataFrame:
        u = _uniform(seed, "doc_id", "size", "text_hash")
        p = F.least(F.greatest(F.col("scale") * _tilt(), F.lit(1e-12)), F.lit(1 - 1e-12))
        rows = rows.withColumn("rank", F.when((F.col("size") > 0) & (F.col("want") > 0), F.log(u / (1 - u)) - F.log(p / (1 - p))))
        return rows.withColumn("slice", F.floor(F.col("rank") * SLICES))

    def with_plan(rows: DataFrame, extra: DataFrame) -> DataFrame:
        return rows.join(extra.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")

    sampled = ranked(with_plan(sizes, plan)).where(F.col("rank").isNotNull())
    inner = _inside(sampled, _cut(sampled, COARSE), COARSE)
    cuts = _last_taken(inner, _cut(inner, SLICES))
    plan = written(plan.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source"))

    key = F.struct(*KEY)
    out = ranked(with_plan(docs.select(*[F.col(c).alias(f"in_{c}") for c in kept], "doc_id", "source", n_words().alias("size"), text_hash), plan))
    results = [*[f"in_{c}" for c in kept], "size", "source_size", "target", "whole"]
    upto = F.col("cut_slice").isNull() | (F.col("slice") < F.col("cut_slice")) | ((F.col("slice") == F.col("cut_slice")) & (key <= F.col("last")))
    split = F.coalesce(key.eqNullSafe(F.col("split.key")), F.lit(False))
    chosen = out.where(~split).withColumn("sampled", F.col("rank").isNotNull() & F.coalesce(upto, F.lit(False))).select(*results, "sampled")
    if plan.where("split is not null").limit(1).count():
        chosen = chosen.unionByName(_numbered(out.where(split), [f"in_{c}" for c in kept]))
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.col("sampled").cast("long")
    chosen = chosen.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return chosen.select(*[F.col(f"in_{c}").alias(c) for c in kept], "size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents taken, once for each copy, with the columns of docs."""
    copies = mix(docs.select("doc_id", "text", "source", *[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns]), **options)
    return copies.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"`in_{c}`").alias(c) for c in docs.columns])
