"""Declared monetary units.

Both dialects look at the words of a caption: a unit's name declares it if a currency or "in" stands before it, and doesn't
if a number does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import let

# Names of units, and of the currency.
NAMES = {"thousand": "thousand", "lakh": "lakh", "lac": "lakh", "million": "million", "crore": "crore", "billion": "billion"}
SHORT = {"mn": "million", "cr": "crore", "bn": "billion"}
CURRENCY = ("₹", "rs", "inr", "rupees")
SPOKEN_OF = ("in", "amount", "amounts", "figure", "figures")
#: Scans take the first letter of lakh for others that look like it.
SCANNED = {c + "akh" + s: "lakh" for c in "ti1" for s in ("", "s")}
WORDS = {name + s: unit for name, unit in NAMES.items() for s in ("", "s")} | SHORT
WORDS_B = WORDS | {"mm": "million", "000": "thousand", "000s": "thousand"}


def _tokens(text: Column) -> Column:
    """Words, numbers and marks in lower case, without points and apostrophes."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[lti1]akhs?(?![a-z])|000s?(?!\w)|[a-z]+|\d+|[^a-z\d\s]"), F.lit(0))
    return F.filter(parts, lambda w: ~w.isin(".", "'"))


def _named(word: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word)


def unit_a(text: Column) -> Column:
    """The one unit a caption declares; null if none or several. Amounts in prose declare nothing."""
    return let(F.struct(_tokens(text).alias("words"), F.trim(text).rlike(r"^\([^()]{1,24}\)$").alias("caption")), _unit_a)


def _unit_a(p: Column) -> Column:
    words = p["words"]

    def declared(word: Column, i: Column) -> Column:
        before, second = F.get(words, i - 1), F.get(words, i - 2)
        money = before.isin(*CURRENCY)
        thousands = F.when((word == "000") & (money | ((before == "in") & second.isin(*CURRENCY))) | word.startswith("thousand") & (money | (before == "in")), F.lit("thousand"))
        others = F.when(~F.coalesce(before.rlike(r"^\d"), F.lit(False)), _named(word, {k: v for k, v in WORDS.items() if v != "thousand"} | SCANNED))
        return F.coalesce(thousands, others)

    units = F.array_distinct(F.array_compact(F.transform(words, declared)))
    allowed = p["caption"] | F.arrays_overlap(words, F.array(*[F.lit(w) for w in (*CURRENCY, *SPOKEN_OF)]))
    plain = F.exists(F.transform(words, lambda w, i: (w == "(") & F.get(words, i + 1).isin(*CURRENCY[:3]) & (F.get(words, i + 2) == ")")), lambda x: F.coalesce(x, F.lit(False)))
    return F.when(allowed & (F.size(units) == 1), F.concat(F.lit("INR_"), F.upper(F.get(units, F.lit(0))))).when(allowed & (F.size(units) == 0) & plain, F.lit("INR"))


def unit_b(text: Column) -> Column:
    """struct of unit and matched text of the earliest declaration; null if none."""
    return let(F.struct(_tokens(text).alias("words"), text.alias("text")), _unit_b)


def _unit_b(p: Column) -> Column:
    words, money = p["words"], (*CURRENCY, "`")

    def declared(word: Column, i: Column) -> Column:
        before, second = F.get(words, i - 1), F.get(words, i - 2)
        start = F.when((before == "in") & second.isin(*money) | before.isin(*money) & (second == "in"), i - 2).when((before == "in") | before.isin(*money), i - 1)
        return F.when(start.isNotNull() & _named(word, WORDS_B).isNotNull(), F.struct(start.alias("start"), i.alias("end")))

    def shown(at: Column) -> Column:
        said = F.slice(words, at["start"] + 1, at["end"] - at["start"] + 1)
        form = F.concat(F.lit("(?i)"), F.array_join(F.transform(said, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"[\s.']*"))
        return F.when(at.isNotNull(), F.struct(_named(F.get(words, at["end"]), WORDS_B).alias("unit"), F.regexp_substr(p["text"], form).alias("text")))

    return let(F.array_min(F.array_compact(F.transform(words, declared))), shown)
