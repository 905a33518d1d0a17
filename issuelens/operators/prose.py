"""Amounts that offer documents name for the issue, by the words around them and by columns of cover tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import sentences
from ..functions.numbers import to_rupees
from ..functions.wording import words_of
from .documents import FRESH, MONEY, SALE

# Roles of amounts; a raise that isn't the offer's; how far from its amount a role may stand.
ROLES = ("fresh", "ofs", "total")
PLACEMENT = " (?:pre ipo|preipo|private placement)(?= )"
REACH = 1200
OFFER = {"offer", "issue", "public issue"}
UNITS = {"million": "million", "mn": "million", "lakh": "lakh", "lac": "lakh", "crore": "crore", "cr": "crore"}
_NONE = " (?:nil|na|n a)(?= )"


def _value(money: Column) -> Column:
    """Rupees of an amount in words, as printed with a currency and a unit."""
    money = F.concat(money, F.lit(" "))
    number = F.regexp_replace(F.regexp_extract(money, MONEY, 1), ",", "").try_cast("decimal(20,6)")
    word = F.regexp_replace(F.regexp_extract(money, MONEY, 2), "s$", "")
    return to_rupees(number, F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), word)).cast("double")


def _role_before(lead: Column) -> Column:
    """The role that the words before an amount give it: the one named last, if no placement is named after it and it isn't just a defined term."""
    after = lambda phrase: F.substring_index(lead, f" {phrase} ", -1)
    named = lambda phrase, other: (
        F.contains(after(other), F.lit(f" {phrase} ")) & ~F.substring_index(after(other), f" {phrase} ", 1).rlike(r'["(]\s*$') & ~F.concat(F.lit(" "), after(phrase)).rlike(PLACEMENT)
    )
    spaced = F.concat(F.lit(" "), lead)
    own = lambda phrase, other: F.when(F.contains(spaced, F.lit(f" {phrase} ")) & named(phrase, other), F.lit("fresh" if phrase == FRESH else "ofs"))
    return F.coalesce(own(FRESH, SALE), own(SALE, FRESH))


def _roles_defined(term: Column) -> Column:
    """Roles that a defined term in brackets gives the amount before it: ("Issue" or "Fresh Issue") is both."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(term, '"', " "), r"\s+", " ")), "^the ", "")
    total = bare.isin(*sorted(OFFER)) | (bare.rlike("^(?:offer|issue) ") & F.contains(F.concat(F.lit(" "), bare, F.lit(" ")), F.lit(" or ")))
    return F.array_compact(F.array(F.when(total, F.lit("total")), F.when(F.contains(bare, F.lit(FRESH)), F.lit("fresh")), F.when(bare == SALE, F.lit("ofs"))))


def issue_mentions(pages: DataFrame) -> DataFrame:
    """doc_id, page, place, key, value (rupees): what prose states of the fresh issue, the offer for sale and the total.

    A sentence is cut before each "aggregat…". The amount at the head of a piece belongs to the role that the piece before
    it names last, to the terms in the brackets behind it, and is the total if "comprising a fresh issue" follows. A row
    "Fresh Issue <amount> <amount or nil> <amount>" gives all three.
    """
    rows = pages.select("doc_id", "page", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("words", words_of(F.col("sentence")))
    rows = rows.where(F.col("words").rlike(MONEY))
    pieces = F.split("words", r"(?= aggregat)")
    heads = rows.select("doc_id", "page", "sentence_no", F.posexplode(F.transform(pieces, lambda p, i: F.struct(p.alias("piece"), F.get(pieces, i - 1).alias("lead")))).alias("piece_no", "x")).where("x.lead is not null")
    money = F.regexp_extract(F.concat(F.col("x.piece"), F.lit(" ")), rf"^ aggregat[a-z]*(?: up)?(?: to)?({MONEY})", 1)
    behind = F.regexp_extract(F.concat(F.col("x.piece"), F.lit(" ")), rf"^ aggregat[a-z]*(?: up)?(?: to)?{MONEY}(.*)$", 3)
    lead = F.concat(F.lit(" "), F.substring(F.col("x.lead"), -REACH, REACH), F.lit(" "))
    total = F.when(behind.rlike(r"^(?: \([^)]{1,40}\))? comprising (?:of )?(?:a )?fresh issue "), F.array(F.lit("total")))
    keys = F.array_distinct(F.array_compact(F.flatten(F.array(F.array(_role_before(lead)), _roles_defined(F.regexp_extract(behind, r"^ \(([^)]{1,80})\)", 1)), F.coalesce(total, F.array().cast("array<string>"))))))
    stated = heads.select("doc_id", "page", (F.col("sentence_no") * 1000 + F.col("piece_no")).cast("long").alias("place"), F.explode(keys).alias("key"), _value(money).alias("value"))
    form = rf" fresh issue({MONEY})(?:{_NONE}|({MONEY}))({MONEY})"
    by_row = [F.struct(F.lit(k).alias("key"), _value(F.regexp_extract("words", form, g)).alias("value")) for k, g in zip(ROLES, (1, 4, 7))]
    in_row = rows.where(F.col("words").rlike(form)).select("doc_id", "page", (F.col("sentence_no") * 1000).cast("long").alias("place"), F.explode(F.array(*by_row)).alias("m")).select("doc_id", "page", "place", "m.*")
    return stated.unionByName(in_row).where("value is not null")


def cover_amounts(rows: DataFrame) -> DataFrame:
    """doc_id, table_id, key, value (rupees) of cover tables read by column (F17). rows: doc_id, table_id, row_no, cells.

    The row whose first cell names both kinds of offer holds three cells with "aggregat…": fresh, offer for sale, total, if
    the five rows above, read column by column, name them in that order.
    """
    above = Window.partitionBy("doc_id", "table_id").orderBy("row_no").rowsBetween(-5, -1)
    held = rows.withColumn("above", F.collect_list("cells").over(above)).where(F.lower(F.get("cells", F.lit(0))).contains(FRESH) & F.lower(F.get("cells", F.lit(0))).contains(SALE))
    width = F.array_max(F.transform("above", F.size))
    column = lambda j: F.array_join(F.filter(F.transform("above", lambda r: F.get(r, j)), lambda c: F.coalesce(c, F.lit("")) != ""), " ")
    head = words_of(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), column), " "))
    slots = F.slice(F.filter(F.slice("cells", 2, 1000), lambda c: F.lower(c).contains("aggregat")), 1, 3)
    found = held.where(head.rlike(" fresh .* offer for sale .* total ")).select("doc_id", "table_id", slots.alias("slots")).where(F.size("slots") == 3)
    by_slot = [F.struct(F.lit(k).alias("key"), _value(words_of(F.get("slots", F.lit(i)))).alias("value")) for i, k in enumerate(ROLES)]
    return found.select("doc_id", "table_id", F.explode(F.array(*by_slot)).alias("m")).select("doc_id", "table_id", "m.*").where("value is not null")


def with_total(facts: DataFrame, no_sale: DataFrame | None = None) -> DataFrame:
    """facts (doc_id, key, value) and a derived total where none is stated: fresh and offer for sale, or fresh alone for the documents of no_sale (doc_id)."""
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
    sides = facts.groupBy("doc_id").agg(*map(of, ROLES)).where("total is null and fresh is not null")
    if no_sale is not None:
        sides = sides.join(no_sale.select("doc_id", F.lit(0.0).alias("none")).distinct(), "doc_id", "left").withColumn("ofs", F.coalesce("ofs", "none"))
    derived = sides.where("ofs is not null").select("doc_id", F.lit("total").alias("key"), (F.col("fresh") + F.col("ofs")).alias("value"), F.lit("derived").alias("method"))
    return facts.withColumn("method", F.lit("stated")).select("doc_id", "key", "value", "method").unionByName(derived)
