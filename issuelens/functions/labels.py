"""Row labels of statements.

Labels are compared word by word: dialect a looks for phrases in a label's words, dialect b looks a label's head up among the
wordings of each concept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .periods import let

# Fixed values (dialect a): field, phrase, where it stands (first, whole, or inside a label) and strength.
PHRASES = [
    ("net_tangible_assets", "net tangible assets", "first", 1.0),
    ("net_tangible_assets", "net tangible assets", "inside", 0.9),
    ("monetary_assets", "monetary assets", "first", 1.0),
    ("monetary_assets", "monetary assets", "inside", 0.9),
    ("operating_profit", "operating profit", "first", 1.0),
    ("operating_profit", "operating profit", "inside", 0.85),
    ("net_worth", "net worth", "first", 1.0),
    ("net_worth", "net worth", "inside", 0.9),
    ("net_worth", "total equity", "whole", 0.7),
    ("net_worth", "shareholders funds", "whole", 0.7),
    ("net_worth", "total equity attributable to equity holders", "first", 0.65),
    ("net_worth", "total equity attributable to owners", "first", 0.65),
    ("revenue", "revenue from operations", "first", 1.0),
    ("revenue", "revenue from operations", "inside", 0.85),
    ("pat", "profit after tax", "first", 1.0),
    ("pat", "net profit after tax", "first", 0.9),
    ("pat", "profit loss after tax", "first", 0.95),
    ("pat", "profit for the year", "first", 0.95),
    ("pat", "profit for the period", "first", 0.95),
    ("pat", "profit loss for the year", "first", 0.95),
    ("pat", "profit loss for the period", "first", 0.95),
    ("total_assets", "total assets", "whole", 1.0),
    ("total_liabilities", "total liabilities", "whole", 1.0),
    ("paid_up_capital", "equity share capital", "whole", 1.0),
    ("paid_up_capital", "share capital", "whole", 0.85),
    ("reserves_and_surplus", "other equity", "whole", 0.9),
    ("reserves_and_surplus", "reserves and surplus", "whole", 1.0),
    ("ebitda", "ebitda", "whole", 1.0),
    ("ebitda", "earnings before interest tax", "first", 0.8),
]
#: Words that may stand before a phrase that has to come first or alone.
BEFORE = {"operating_profit": ("restated", "pre tax", "pretax"), "paid_up_capital": ("paid up",), "net_worth": ("restated", "total")} | {f: ("restated",) for f in ("net_tangible_assets", "monetary_assets", "revenue", "pat", "ebitda")}
#: Phrases that rule a field out, and those that rule all out.
RULED_OUT = {
    "net_tangible_assets": ("monetary assets",),
    "monetary_assets": ("net tangible assets",),
    "operating_profit": ("profit before tax", "ebit", "ebitda", "pbt", "after tax", "average", "working capital", "margin"),
    "net_worth": ("return", "ronw", "non controlling", "nci", "tangible", "per share"),
    "revenue": ("other income", "total income"),
    "pat": ("non controlling", "other comprehensive", "attributable to non", "discontinued", "before", "nci", "oci"),
    "reserves_and_surplus": ("non controlling",),
}
NEVER = ("margin", "ratio", "growth", "return on", "per share", "per equity share", "%", "percentage", "cagr", "days", "times", "average", "avg", "number of", "basic", "diluted", "eps", "as per audited", "as per the audited")

# Fixed values (dialect b): what a label must not say, and what heads of labels, as _head_b leaves them, are called.
REJECTED = ("%", "percent", "per cent", "growth", "margin", "ratio", "per share", "days", "attributable", "comprehensive", "as a", "turnover", "cagr", "including oci", "incl oci", "after oci", "net of oci")
CONCEPTS = {
    "revenue from operations": "revenue_from_operations",
    "total revenue from operations": "revenue_from_operations",
    "other income": "other_income",
    "total income": "total_income",
    "total revenue": "total_income",
    "total expenses": "total_expenses",
    "total expenditure": "total_expenses",
    "profit before tax": "profit_before_tax",
    "profit before taxation": "profit_before_tax",
    "tax expense": "tax_expense",
    "tax expenses": "tax_expense",
    "profit for": "profit_after_tax",
    "profit for the year": "profit_after_tax",
    "profit after tax": "profit_after_tax",
    "profit after adjustments": "profit_after_tax",
    "adjusted ebitda": "adjusted_ebitda",
    "ebitda": "ebitda",
    "total assets": "total_assets",
    "total equity and liabilities": "total_equity_and_liabilities",
    "total liabilities and equity": "total_equity_and_liabilities",
    "total equity": "total_equity",
    "net worth": "net_worth",
    "total borrowings": "total_borrowings",
    "borrowings": "borrowings",
    "long term borrowings": "borrowings",
    "short term borrowings": "borrowings",
    "debt securities": "borrowings",
    "trade receivables": "trade_receivables",
    "inventory": "inventories",
    "inventories": "inventories",
}
#: Labels that begin with cash and end with one of these activities.
CASH = {"operating": "cash_from_operations", "investing": "cash_from_investing", "financing": "cash_from_financing"}
LABEL_WORDS = ["total", "revenue", "other", "income", "profit", "loss", "tax", "trade", "net", "cash", "finance", "employee", "depreciation", "borrowings", "current", "equity", "liabilities", "expenses", "interest"]


def _head_b(words: Column) -> Column:
    """The words of a label's head without what only qualifies them: profit and loss are one, a period is a year, and restated, net, income, or what remains before unusual items says nothing more of a profit or tax."""
    one = F.regexp_replace(F.regexp_replace(words, r"\bloss\b", "profit"), r"\b(?:year )?period\b", "year")
    profit = F.regexp_replace(one, r"^(?:restated )?(?:net )?(?=profit )", "")
    profit = F.when(profit.startswith("profit for the year "), F.regexp_replace(profit, r"(?: from continuing)?(?: operations)?$| net of tax$", "")).otherwise(profit)
    profit = F.regexp_replace(profit, r"^(profit after tax) but before extra ?ordinary items$", "$1")
    return F.when(profit.endswith("tax expense") | profit.endswith("tax expenses"), F.regexp_replace(profit, r"^(?:total |net )?(?:income )?(?=tax )", "")).otherwise(profit)


def _says(words: Column, phrases: tuple[str, ...]) -> Column:
    """Whether words, with a blank around each, hold one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(words, F.lit(f" {p} "))
    return out


def normal_a(text: Column) -> Column:
    """The words of a label, a blank around each: no captions of units, no footnote marks, "as restated" as restated."""
    low = F.translate(F.lower(text), "’‘", "''")
    # What stands in brackets goes if it is a short mark, or a currency or unit.
    low = F.regexp_replace(low, r"\(\s*(?:\w{1,3}|(?:₹|rs\.?|inr|in|lakhs?|millions?|crores?|thousands?|\s)+)\s*\)", " ")
    words = F.regexp_extract_all(F.regexp_replace(low, r"(?<=[a-z])\d{1,2}\b|'s?\b", " "), F.lit(r"[a-z0-9]+|[%&]"), F.lit(0))
    joined = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.when(w == "&", F.lit("and")).when(w == "shareholder", F.lit("shareholders")).when(w == "fund", F.lit("funds")).otherwise(w)), " "), F.lit(" "))
    return F.replace(F.replace(joined, F.lit(" as restated "), F.lit(" restated ")), F.lit(" attributable to the "), F.lit(" attributable to "))


def match_a(text: Column) -> Column:
    """struct of field and strength of the strongest phrase, the first field on ties; null if none may stand."""
    return let(F.struct(normal_a(text).alias("words"), F.contains(F.lower(text), F.lit("(audited)")).alias("audited")), _match_a)


def _match_a(p: Column) -> Column:
    words, hits = p["words"], []
    for k, field in enumerate(dict.fromkeys(f for f, *_ in PHRASES)):
        bare = words
        for lead in BEFORE.get(field, ()):
            bare = F.when(bare.startswith(f" {lead} "), F.substring(bare, len(lead) + 2, 200)).otherwise(bare)
        strength = F.lit(0.0)
        for of, phrase, where, value in PHRASES:
            if of == field:
                ok = [F.contains(words, F.lit(f" {phrase} "))] if where == "inside" else [x.startswith(f" {phrase} ") if where == "first" else x == f" {phrase} " for x in (words, bare)]
                strength = F.greatest(strength, F.when(ok[0] | ok[-1], value).otherwise(0.0))
        said = F.replace(words, F.lit(" operating profit before tax "), F.lit(" ")) if field == "operating_profit" else words
        hits.append(F.when((strength > 0) & ~_says(said, RULED_OUT.get(field, ())), F.struct(strength.alias("strength"), F.lit(-k).alias("place"), F.lit(field).alias("field"))))
    best = F.array_max(F.array_compact(F.array(*hits)))
    stands = (F.length(words) <= 162) & ~_says(words, NEVER) & ~p["audited"]
    return let(best, lambda b: F.when(stands & b.isNotNull(), F.struct(b["field"].alias("field"), b["strength"].alias("strength"))))


def rejoined(text: Column) -> Column:
    """Capitals printed apart from their word ("t otal") joined where that gives a label word."""

    def joined(words: Column) -> Column:
        whole = lambda i: F.concat(F.get(words, i), F.get(words, i + 1))
        apart = lambda i: F.coalesce((F.length(F.get(words, i)) == 1) & whole(i).isin(LABEL_WORDS), F.lit(False))
        return F.array_join(F.filter(F.transform(words, lambda w, i: F.when(apart(i), whole(i)).when(~F.coalesce(apart(i - 1), F.lit(False)) | (i == 0), w)), lambda w: w.isNotNull()), " ")

    return let(F.split(text, " "), joined)


def normal_b(text: Column) -> Column:
    """Lower case without leading numerals and marks of a list, trailing notes or colons."""
    low = F.trim(F.regexp_replace(F.lower(F.translate(text, "’‘", "''")), r"\s+", " "))
    numbered = F.regexp_replace(low, r"^(?:\(?(?:\d\d?|[a-z]|[ivx]+)[.)] ?)+", "")
    return rejoined(F.trim(F.regexp_replace(numbered, r" ?(?:\(refer note[^)]*\)|[*#^:]+$)", "")))


def concept_b(text: Column) -> Column:
    """The concept that the head of a label words, with nothing but brackets and sums of letters behind; null for ratios and the like."""
    return let(normal_b(text), _concept_b)


def _concept_b(label: Column) -> Column:
    # "profit/(loss)", "(loss)/profit" and "expense/(credit)" are one head; a slash between two words is a blank.
    plain = F.regexp_replace(label, r" ?/ ?\(?(?:loss|profit|credit|charge|benefit)\)?(?![a-z])|^((?:restated )?(?:net )?)\(?loss\)? ?/ ?(?=profit)", "$1")
    at = F.regexp_instr(plain, F.lit(r"[(=]"))
    head = F.when(at > 0, F.substring(plain, F.lit(1), at - 1)).otherwise(plain)
    behind = F.when(at > 0, F.regexp_replace(F.substr(plain, at), r"\([^)]*\)?|= ?[a-z0-9+-]*", "")).otherwise("")
    words = F.array_join(F.regexp_extract_all(head, F.lit(r"[a-z']+|\d+|[%&]"), F.lit(0)), " ")
    table = F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair])
    cash = F.coalesce(*[F.when(words.rlike(rf"^(?:net )?cash\b.*\b{activity} activit(?:y|ies)$"), F.lit(c)) for activity, c in CASH.items()])
    everything = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(label, F.lit(r"[a-z]+|%"), F.lit(0)), " "), F.lit(" "))
    return F.when((F.trim(behind) == "") & ~_says(everything, REJECTED), F.coalesce(F.try_element_at(table, _head_b(words)), cash))


def skipped_column(header: Column) -> Column:
    """Columns that hold no amounts: percentages, notes, serial numbers."""
    return F.lower(header).rlike(r"%|\bnotes?\b|\bsr\.?\s*no\b|\bs\.?\s*no\b|\bparticulars\b")


def note_columns(cells: DataFrame) -> DataFrame:
    """table_no, col: columns that hold references to notes, whole numbers from 1 to 99 and nothing else (P15). cells: table_no, col, text."""
    return cells.groupBy("table_no", "col").agg(F.bool_and(F.trim("text").rlike(r"^[1-9]\d?$")).alias("notes")).where("notes").select("table_no", "col")


def family(key: Column) -> Column:
    """financials.<concept>.<period> belongs to its concept; any other key to its first part."""
    parts = F.split(key, r"\.")
    return F.when(parts[0] == "financials", F.concat_ws(".", parts[0], parts[1])).otherwise(parts[0])


def sentences(text: Column) -> Column:
    """The sentences of a text, blanks as one each; single blanks are left alone, not put in anew."""
    flat = F.trim(F.regexp_replace(text, r"[\t-\r]\s*| \s+", " "))
    return F.filter(F.split(flat, r" (?<=[.;] )(?=[A-Z(])"), lambda s: s != "")


def printed_page(text: Column) -> Column:
    """The page number printed on a line of its own, first or last."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(\d{1,4})\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^\s*(\d{1,4})\b", 1), F.lit(""))).cast("int")
