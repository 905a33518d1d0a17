"""Numbers as printed in offer documents, read as decimals of scale 6."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import let

AMOUNT = "decimal(20,6)"

# Multipliers of units, and the marks that stand for no value.
CRORE_PER = {"INR": "0.0000001", "INR_THOUSAND": "0.0001", "INR_LAKH": "0.01", "INR_MILLION": "0.1", "INR_CRORE": "1", "INR_BILLION": "100"}
RUPEES_PER = {"rupees": 1, "thousand": 10**3, "lakh": 10**5, "million": 10**6, "crore": 10**7, "billion": 10**9}
NULL_MARKS_A = ["-", "--", "na", "n.a.", "n.a", "n/a", "nil", "none", "[●]", "[•]", "●", "•", "*"]
MISSING_B = ["", "na", "n.a.", "n.a", "n/a", "nm", "n.m.", "-", "–", "—", "‒"]
DASHES = "‐‑‒–—−"


def _replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


_CUT = "\x01"
#: An amount in one look: bracket, sign, currency, sign, digits in groups, fraction; then a minus, or a mark of a note and a percent sign, and a bracket; or a note in brackets.
_PARTS_A = (
    r"^(\(?)\s*(-?)\s*(?:(?:₹|[Rr][Ss]\.?|[Ii][Nn][Rr]|`)\s*)?(-?)\s*([\d,](?:[\d,\s]*[\d,])?)(\s*\.\s*\d[\d\s]*)?"
    r"(?:\s*(-)\s*(\)?)|\s*(?:\*{1,3}|#{1,2}|\^|[¹²³⁴⁵⁶⁷⁸⁹⁰]+)?\s*%?\s*(\)?)|\s*\(([^()]{1,4})\))$"
)
#: The same for dialect b: bracket, currency, sign, digits in groups, fraction, bracket, percent sign, marks of notes.
_PARTS_B = r"^(\(?)\s*(?:(?:₹|`|[Rr][Ss]\.?|[Ii][Nn][Rr])\s*)?([-−–—]?)\s*([\d,]*)(\.\d+)?\s*(\)?)\s*(%?)\s*[*#^†‡]*$"


def _parts(t: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that fits the whole text, each "" if it is left out; else an array of another size. Texts without a digit, which have no value, aren't looked at."""
    return F.when(t.rlike(r"\d"), F.split(_replace(t, pattern, _CUT.join(f"${i}" for i in range(1, n + 1))), _CUT)).otherwise(F.array(t))


def parse_a(text: Column) -> Column:
    """Dialect a: struct of value, is_null_mark, is_percent, negative_by (parentheses, minus or trailing minus), grouping and warning.

    Groups of digits must be Indian or international; both readings count as international. A leading point is no number. A
    note of one or two digits, a letter or a small Roman numeral may follow in brackets.
    """
    plain = F.trim(F.translate(text, DASHES, "-" * len(DASHES)))
    return let(plain, lambda t: let(F.struct(t.alias("t"), _parts(t, _PARTS_A, 9).alias("p")), lambda x: _valued_a(x)))


#: Most amounts: digits in a row or in groups, a fraction, brackets around; read without taking the text apart.
_PLAIN_A, _PLAIN_B = (rf"^\(?(?:\d+|\d{{1,3}}(?:,{group})+)(?:\.\d+)?\)?$" for group in (r"\d{3}", r"\d{2,3}"))


def _is_plain(t: Column, pattern: str) -> Column:
    return t.rlike(pattern) & (t.startswith("(") == t.endswith(")"))


def _plain_value(t: Column) -> Column:
    size = F.translate(t, ",()", "").try_cast(AMOUNT)
    return F.when(t.startswith("("), -size).otherwise(size).cast(AMOUNT)


def _is_null_mark(t: Column) -> Column:
    return F.lower(t).isin(NULL_MARKS_A) | F.btrim(F.lower(t), F.lit(" .\t")).isin(NULL_MARKS_A)


def value_a(text: Column) -> Column:
    """Of what parse_a tells, value and is_null_mark alone; fields of a struct made in a lambda are all computed, asked for or not."""
    told = lambda value, mark: F.struct(value.cast(AMOUNT).alias("value"), mark.alias("is_null_mark"))
    in_parts = lambda t: let(F.struct(t.alias("t"), _parts(t, _PARTS_A, 9).alias("p")), lambda x: _valued_a(x, ("value", "is_null_mark")))
    read = lambda t: F.when(~t.rlike(r"\d"), told(F.lit(None), _is_null_mark(t))).when(_is_plain(t, _PLAIN_A), told(_plain_value(t), F.lit(False))).otherwise(in_parts(t))
    return let(F.trim(F.translate(text, DASHES, "-" * len(DASHES))), read)


def _valued_a(x: Column, told: tuple[str, ...] = ("value", "is_null_mark", "is_percent", "negative_by", "grouping", "warning")) -> Column:
    t, fits = x["t"], F.size(x["p"]) == 9
    part = lambda i: F.get(x["p"], F.lit(i - 1))
    whole, note = part(4), part(9)
    no_note = F.when(note == "", False).otherwise(~((F.translate(note, "0123456789", "") == "") & (F.length(note) <= 2) | (F.length(note) == 1) & note.between("a", "z") | (F.translate(note, "ivx", "") == "")) | t.startswith("("))
    null_mark = _is_null_mark(t)
    opened, closed = t.startswith("("), t.endswith(")") & F.when(fits, note == "").otherwise(True)
    wrapped, trailing, minus = opened & closed, fits & (part(6) != ""), fits & ((part(2) != "") | (part(3) != ""))
    # Groups by three digits; or, as the Indian way has it, the last by three and those before by two.
    grouping = F.when(~whole.contains(","), "none").otherwise(F.when(whole.rlike(r"^\d{1,3}(?:,\d{3})+$"), "international").when(whole.rlike(r"^\d{1,2}(?:,\d{2})*,\d{3}$"), "indian"))
    grouped = fits & ~no_note & grouping.isNotNull()
    size = F.translate(F.concat(whole, part(5)), ", \t\n", "").try_cast(AMOUNT)
    value = F.when(~null_mark & grouped, F.when(wrapped | minus | trailing, -size).otherwise(size))
    by = F.when(wrapped, "parentheses").when(trailing, "trailing minus").when(minus | t.startswith("-"), "minus")
    warning = F.when(opened != closed, "unbalanced parenthesis").when(wrapped & (minus | trailing), "multiple negative markers").when(~null_mark & fits & grouping.isNull(), "malformed digit grouping")
    percent = t.endswith("%") | t.endswith("%)")
    fields = {"value": value.cast(AMOUNT), "is_null_mark": null_mark, "is_percent": percent, "negative_by": by, "grouping": F.when(fits, grouping), "warning": warning}
    return F.struct(*[fields[name].alias(name) for name in told])


def parse_b(text: Column, allow_percent: bool = False) -> Column:
    """Dialect b: nil is zero, dashes and NA are no value, percentages are refused unless allowed, .5 is a number. Digits stand in one group, or in groups of which the first has one to three and the others two or three."""
    in_parts = lambda t: let(F.struct(F.lower(t).alias("low"), _parts(t, _PARTS_B, 6).alias("p")), lambda x: _valued_b(x, allow_percent))
    nil = lambda t: F.when(F.lower(t) == "nil", F.lit(0).cast(AMOUNT))
    return let(F.trim(F.translate(text, "\u00a0", " ")), lambda t: F.when(~t.rlike(r"\d"), nil(t)).when(_is_plain(t, _PLAIN_B), _plain_value(t)).otherwise(in_parts(t)))


def _valued_b(x: Column, allow_percent: bool) -> Column:
    part = lambda i: F.get(x["p"], F.lit(i - 1))
    whole, fraction, groups = part(3), part(4), F.split(part(3), ",")
    in_groups = F.length(F.get(groups, F.lit(0))).between(1, 3) & F.forall(F.slice(groups, 2, F.size(groups)), lambda g: F.length(g).between(2, 3))
    fits = (F.size(x["p"]) == 6) & ((part(1) == "") == (part(5) == "")) & F.when(whole.contains(","), in_groups).otherwise((whole != "") | (fraction != ""))
    size = F.translate(F.concat(whole, fraction), ",", "").try_cast(AMOUNT)
    value = F.when((part(1) != "") | (part(2) != ""), -size).otherwise(size)
    allowed = F.lit(True) if allow_percent else part(6) == ""
    return F.when(x["low"] == "nil", F.lit(0).cast(AMOUNT)).when(~x["low"].isin(MISSING_B) & fits & allowed, value).cast(AMOUNT)


def _by_unit(unit: Column, table: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, factor in table.items():
        out = F.when(unit == name, F.lit(str(factor)).cast(kind)).otherwise(out)
    return out


def to_crore(value: Column, unit: Column) -> Column:
    """Exact for values of scale 6; null for an unknown unit."""
    return value.cast(AMOUNT) * _by_unit(unit, CRORE_PER, "decimal(10,7)")


def to_rupees(value: Column, unit: Column) -> Column:
    return (value.cast(AMOUNT) * _by_unit(unit, RUPEES_PER, "decimal(11,0)")).cast("decimal(32,6)")


def printed_places(raw: Column) -> Column:
    """Digits after the point as printed."""
    return F.length(F.regexp_extract(raw, r"\.(\d+)", 1))


def step(raw: Column, factor: Column) -> Column:
    """What one unit of the last printed digit is worth."""
    return F.pow(F.lit(10.0), -printed_places(raw)) * factor.cast("double")


def half_unit(raw: Column, factor: Column) -> Column:
    """Half a printed unit: the tolerance of dialect a."""
    return step(raw, factor) / 2


def indian(value: Column) -> Column:
    """Digits grouped the Indian way (1,23,45,678), rounded half up to whole numbers."""
    whole = F.round(value, 0).cast("decimal(38,0)")
    head = F.regexp_replace(F.abs(whole).cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")
    return F.when(whole < 0, F.concat(F.lit("-"), head)).otherwise(head)


def crore_text(value: Column) -> Column:
    """Two decimals, half even, thousands grouped."""
    return F.concat(F.lit("₹"), F.format_number(F.bround(value.cast("decimal(38,6)"), 2), 2), F.lit(" Cr"))


def percent_text(value: Column) -> Column:
    return F.concat(F.format_number(F.bround(value.cast("decimal(38,6)"), 2), 2), F.lit("%"))
