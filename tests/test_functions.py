"""Boundaries of the scalar dialects."""

import datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelens.functions import labels, numbers, periods, units


def applied(spark, values, fn):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in frame.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


NUMBERS_A = {
    "1,234.50": "1234.5", "12,34,567.89": "1234567.89", "(1,234)": "-1234", "–5": "-5", "5-": "-5", "₹ 12": "12", "Rs. -7": "-7", "12%": "12", "nil": None, "-": None, "N.A.": None,
    ".5": None, "1,23,4": None, "12,345 (1)": "12345", "5*": "5", "abc": None, "": None, "1 234": "1234", "12,34": None,
}
NUMBERS_B = {"1,23,456.78": "123456.78", "(1,234)": "-1234", "Nil": "0", "-": None, "NA": None, "12%": None, ".5": "0.5", "₹ 12.5": "12.5", "−3": "-3", "7#": "7", "x": None, "1,2": None}


def test_dialect_a_numbers(spark):
    got = [x.value for x in applied(spark, list(NUMBERS_A), numbers.parse_a)]
    assert got == [None if v is None else Decimal(v) for v in NUMBERS_A.values()]
    odd = applied(spark, ["(12", "(-3)", "1,23,4"], numbers.parse_a)
    assert [x.warning for x in odd] == ["unbalanced parenthesis", "multiple negative markers", "malformed digit grouping"]


def test_dialect_b_numbers(spark):
    assert applied(spark, list(NUMBERS_B), numbers.parse_b) == [None if v is None else Decimal(v) for v in NUMBERS_B.values()]
    assert applied(spark, ["12%"], lambda c: numbers.parse_b(c, allow_percent=True)) == [Decimal(12)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**12), min_size=30, max_size=30))
def test_both_groupings_round_trip(spark, values):
    western = [f"{v:,}" for v in values]
    assert [x.value for x in applied(spark, western, numbers.parse_a)] == values
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v bigint")
    indian = [r.t for r in frame.select("i", numbers.indian(F.col("v")).alias("t")).orderBy("i").collect()]
    assert [x.value for x in applied(spark, indian, numbers.parse_a)] == values


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=20), min_size=20, max_size=20))
def test_parsers_never_raise(spark, values):
    for fn in (numbers.parse_a, numbers.parse_b, periods.period_a, periods.period_b, units.unit_a, units.unit_b, labels.match_a, labels.concept_b):
        assert len(applied(spark, values, fn)) == 20


def test_units(spark):
    captions = ["(₹ in lakhs)", "in ₹ million", "₹ 30 million", "Rs. in crore and lakhs", "(₹)", "", None, "(₹ in '000)", "Amount in 1akhs"]
    assert applied(spark, captions, units.unit_a) == ["INR_LAKH", "INR_MILLION", None, None, "INR", None, None, "INR_THOUSAND", "INR_LAKH"]
    assert [x and x.unit for x in applied(spark, captions, units.unit_b)] == ["lakh", "million", None, "crore", None, None, None, "thousand", None]


UNITS_A = {
    "(₹ in lakhs)": "INR_LAKH", "(Rs. in Lacs)": "INR_LAKH", "₹ in million": "INR_MILLION", "(₹ in crores)": "INR_CRORE", "(Amount in INR Mn)": "INR_MILLION", "figures in ₹ billion": "INR_BILLION",
    "(₹ in takhs)": "INR_LAKH", "(₹ in iakhs)": "INR_LAKH", "(in ₹ thousands)": "INR_THOUSAND", "Rs. '000": "INR_THOUSAND", "(lakhs)": "INR_LAKH", "a total of ₹ 30 million": None, "10 lakhs in all": None,
    "₹1,000,000 crore": None, "revenue of lakhs": None, "in lakhs and in million": None, "(Rs.)": "INR", "₹": None, "thousands of rupees": None, "lakhs in rupees": "INR_LAKH",
}
UNITS_B = {
    "(₹ in lakhs)": ("lakh", "₹ in lakhs"), "amounts in Rs. crore, in million": ("crore", "in Rs. crore"), "INR Mn": ("million", "INR Mn"), "₹ mm": ("million", "₹ mm"), "(₹ '000s)": ("thousand", "₹ '000s"),
    "` in lacs": ("lakh", "` in lacs"), "30 million": None, "in all lakhs": None, "Margin lakhs": None, "Rs. 5 crore": None, "in Crores": ("crore", "in Crores"),
}


def test_unit_boundaries(spark):
    assert dict(zip(UNITS_A, applied(spark, list(UNITS_A), units.unit_a))) == UNITS_A
    assert {k: x and (x.unit, x.text) for k, x in zip(UNITS_B, applied(spark, list(UNITS_B), units.unit_b))} == UNITS_B


PERIODS_A = {
    "March 31, 2023": ("FY2023", 12), "31 March 2023": ("FY2023", 12), "31st March, 2023": ("FY2023", 12), "31-03-2023": ("FY2023", 12), "FY23": ("FY2023", 12), "FY 2022-23": ("FY2023", 12), "Financial Year 2024": ("FY2024", 12),
    "Fiscal 2023": ("FY2023", 12), "for the three months ended June 30, 2023": ("P2023-06-30-3M", 3), "six months period ended 30 September 2023": ("P2023-09-30-6M", 6), "9 months ended December 31, 2023": ("P2023-12-31-9M", 9),
    "six months ended": None, "Year ended December 31, 2023": ("YE2023-12", 12), "31 June 2023": None, "31-Mar-24": ("FY2024", 12), "'2022-23": ("FY2023", 12), "2022–23": ("FY2023", 12), "1,234.50": None, "Note 12": None, "": None,
}
PERIODS_B = {
    "As at March 31, 2025": "AT-2025-03-31", "as on 31st March, 2025": "AT-2025-03-31", "year ended 31-Mar-25": "FY2025", "For the nine months ended December 31, 2024": "9M-2024-12-31", "half-year ended September 30, 2024": "6M-2024-09-30",
    "Fiscal 2025": "FY2025", "FY2024-25": "FY2025", "F.Y. 2024-25": "FY2025", "FY 1999-00": "FY2000", "Fiscal 2025-24": "FY2025", "31.12.2024": "?-2024-12-31", "31-Mar-69": "?-2069-03-31", "31-Mar-70": "?-1970-03-31",
    "year ended March 31, 2024 and 2023": "FY2024", "February 30, 2024": None, "as at": None, "12 months ended 30 June 2024": "12M-2024-06-30", "quarter ended 30/06/2024": "3M-2024-06-30",
}


def test_period_boundaries(spark):
    assert {k: x and (x.label, x.months) for k, x in zip(PERIODS_A, applied(spark, list(PERIODS_A), periods.period_a))} == PERIODS_A
    assert dict(zip(PERIODS_B, applied(spark, list(PERIODS_B), lambda c: periods.period_key(periods.period_b(c))))) == PERIODS_B


def test_periods(spark):
    texts = ["As at March 31, 2024", "31-Dec-23", "31.3.2022", "FY 2021-22", "Fiscal 2024", "six months ended September 30, 2023", "nine months ended", "FY 2021-23", "particulars", "x" * 161, "Fiscal 1899", "30 February 2024"]
    got = [(x.label, x.months) if x else None for x in applied(spark, texts, periods.period_a)]
    assert got == [("FY2024", 12), ("YE2023-12", 12), ("FY2022", 12), ("FY2022", 12), ("FY2024", 12), ("P2023-09-30-6M", 6), None, None, None, None, None, None]
    b = applied(spark, ["As at March 31, 2024", "FY 2022-21", "FY 1999-00", "quarter ended 30 June 2023", "31 March 2023", "year 31.3.99 31.3.1999"], lambda c: F.struct(periods.period_key(periods.period_b(c)).alias("k"), periods.fiscal_key(periods.period_b(c)).alias("f")))
    assert [(x.k, x.f) for x in b] == [("AT-2024-03-31", "FY2024"), ("FY2022", "FY2022"), ("FY2000", "FY2000"), ("3M-2023-06-30", "3M-2023-06-30"), ("?-2023-03-31", "FY2023"), ("FY1999", "FY1999")]


def test_labels(spark):
    said = ["Restated Net Worth (₹ in lakhs)", "Return on net worth", "Net tangible assets1", "Profit after tax margin", "Average operating profit", "Total equity", "Other equity"]
    assert [x and x.field for x in applied(spark, said, labels.match_a)] == ["net_worth", None, "net_tangible_assets", None, None, "net_worth", "reserves_and_surplus"]
    heads = ["I. Revenue from operations", "Profit/(Loss) before tax (A-B)", "T otal assets", "Earnings per share", "Net cash generated from operating activities", "EBITDA margin", "Total expenses (IV)"]
    assert applied(spark, heads, labels.concept_b) == ["revenue_from_operations", "profit_before_tax", "total_assets", None, "cash_from_operations", None, "total_expenses"]


LABELS_A = {
    "Restated Net Tangible Assets (A)": "net_tangible_assets", "Monetary assets as a % of net tangible assets": None, "Monetary Assets, as restated (₹ in lakhs)": "monetary_assets", "Pre-tax operating profit": "operating_profit",
    "Restated pre-tax operating profit": "operating_profit", "Operating profit before tax": "operating_profit", "Average pre-tax operating profit": None, "Operating profit (EBITDA)": None, "Net Worth as restated": "net_worth",
    "Return on Net Worth (%)": None, "Net worth per share": None, "Total shareholders' funds": "net_worth", "Total equity attributable to the owners of the company": "net_worth", "Revenue from Operations1": "revenue",
    "Total Revenue from Operations": "revenue", "Restated profit/(loss) for the year": "pat", "Net profit after tax": "pat", "Profit after tax margin": None, "Profit before tax": None, "Profit for the year from discontinued operations": None,
    "Total Assets": "total_assets", "Net total assets": None, "Equity share capital": "paid_up_capital", "Paid-up share capital": "paid_up_capital", "Reserves & surplus": "reserves_and_surplus", "EBITDA": "ebitda", "Net worth (audited)": None,
    "Number of shareholders' funds": None, "": None,
}
LABELS_B = {
    "I. Revenue from operations": "revenue_from_operations", "(a) Other income (net)": "other_income", "Total income (I+II)": "total_income", "III) Total income = (I+II)": "total_income", "Profit / (Loss) before tax (V-VI)": "profit_before_tax",
    "Restated (loss)/profit before tax": "profit_before_tax", "Total tax expense/(credit)": "tax_expense", "Income tax expenses": "tax_expense", "Profit for the year (A)": "profit_after_tax", "Restated profit for the year/period": "profit_after_tax",
    "Profit for the year attributable to owners": None, "Profit after tax but before extra-ordinary items": "profit_after_tax", "Total comprehensive income": None, "Profit for the year including OCI": None, "T otal assets": "total_assets",
    "Total Equity and Liabilities": "total_equity_and_liabilities", "Long-term borrowings": "borrowings", "N et cash generated from operating activities": "cash_from_operations", "Net cash used in investing activities (B)": "cash_from_investing",
    "Trade receivables turnover": None, "Inventories*": "inventories", "EBITDA Margin": None, "Total income of the group": None, "Trade receivables (refer note 12)": "trade_receivables", "Adjusted EBITDA": "adjusted_ebitda",
}


def test_label_boundaries(spark):
    assert {k: x and x.field for k, x in zip(LABELS_A, applied(spark, list(LABELS_A), labels.match_a))} == LABELS_A
    assert dict(zip(LABELS_B, applied(spark, list(LABELS_B), labels.concept_b))) == LABELS_B


@pytest.mark.parametrize("y, m, d, want", [(2024, 2, 29, datetime.date(2024, 2, 29)), (2023, 2, 29, None), (2023, 13, 1, None)])
def test_safe_date(spark, y, m, d, want):
    assert spark.range(1).select(periods.safe_date(F.lit(y), F.lit(m), F.lit(d)).alias("d")).first().d == want
