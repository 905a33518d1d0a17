"""Boundaries of the tables of a page: grids, fused cells, choice, slots, and the scan over page breaks against a fold line by line."""

import random

import pytest

from issuelens.operators import tables
from issuelens.plans import grids

SF = "/root/testdata/sf0.001"


def grid(spark, rows, page=1):
    return spark.createDataFrame([(1, page, 1, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)], "doc_id long, page int, table_no int, row int, col int, text string")


def test_header_is_the_first_of_four_rows_with_two_different_periods(spark):
    body = [["Revenue", "5", "1,200", "(300)"], ["", "", "7", "8"], ["Net\nworth", None, "-", "n.m."], ["12", "", "1", "2"], ["Ratio", "", "", ""]]
    rows = [["Rs. in lakhs", None, "", ""], ["Particulars", "Note", "Fiscal\n2023", "March 31, 2022"], *body]
    got = {(r.row, r.label, r.period, None if r.value is None else float(r.value), r.is_null_mark, r.unit) for r in tables.ruled(grid(spark, rows)).collect()}
    assert got == {(2, "Revenue", "FY2023", 1200.0, False, "INR_LAKH"), (2, "Revenue", "FY2022", -300.0, False, "INR_LAKH"), (4, "Net worth", "FY2023", None, True, "INR_LAKH")}
    same = [["x", "n", "Fiscal 2023", "Fiscal 2023"], *body]
    assert tables.ruled(grid(spark, same)).count() == 0
    assert tables.ruled(grid(spark, [["a", "", "", ""]] * 4 + rows[1:])).count() == 0  # the fifth row is no header
    assert {r.row for r in tables.ruled(grid(spark, [["a", "", "", ""]] * 3 + rows[1:])).collect()} == {4, 6}
    assert tables.ruled(grid(spark, [["", "", "", ""]])).count() == 0


def test_header_rows_end_at_the_first_amount(spark):
    rows = [["", "Fiscal 2023", ""], ["Particulars", "Amount", "2022"], ["Revenue", "1,000", "900"], ["Tax", "", "3.5"]]
    got = {r.col: (r.n_header, r.header) for r in tables.header_info(grid(spark, rows)).collect()}
    assert got == {0: (2, "Particulars"), 1: (2, "Fiscal 2023 Amount"), 2: (2, "2022")}
    assert tables.header_info(grid(spark, rows[2:])).count() == 0 and tables.header_info(grid(spark, rows[:2])).count() == 0


def test_periods_down_the_side_are_turned(spark):
    rows = [["Year", "Revenue", "Tax"], ["Fiscal 2023", "1", "2"], ["", "", ""], ["Fiscal 2022", "3", ""]]
    got = sorted((r.row, r.col, r.text) for r in tables.turned(grid(spark, rows)).where("text <> ''").collect())
    assert got == [(0, 0, "Year"), (0, 1, "Fiscal 2023"), (0, 2, "Fiscal 2022"), (1, 0, "Revenue"), (1, 1, "1"), (1, 2, "3"), (2, 0, "Tax"), (2, 1, "2")]
    assert not any(r.turned for r in tables.turned(grid(spark, [["", "Fiscal 2023", "Fiscal 2022"], ["a", "1", "2"], ["b", "3", "4"]])).collect())
    assert not any(r.turned for r in tables.turned(grid(spark, [r[:2] for r in rows])).collect())


@pytest.mark.parametrize(("texts", "is_fused"), [(["1,234 567 8.5"], True), (["1,234 567"], False), (["1,234 567", "2.5 300"], True), (["2022 2023 2024"], False), (["12 7 5"], False), ([None, ""], False), (["nil nil nil"], True)])
def test_fused_cells(spark, texts, is_fused):
    assert tables.fused(grid(spark, [[t] for t in texts])).count() == int(is_fused)


def test_words_go_to_the_interval_that_holds_most_of_them(spark):
    cells = spark.createDataFrame([(1, 1, 1, 0, 0, 0.0, 100.0, 0.0, 300.0, "a b"), (1, 1, 1, 0, 1, 100.0, 200.0, 0.0, 300.0, "1,000 2,000 3,000")], "doc_id long, page int, table_no int, row int, col int, x0 double, x1 double, y0 double, y1 double, text string")
    words = [(1, 1, i, x0, x1, y, y + 10.0, t) for i, (x0, x1, y, t) in enumerate([(5, 20, 100, "Total"), (90, 112, 101, "1,000"), (25, 40, 103, "assets"), (90, 110, 130, "left"), (150, 160, 290, "3,000"), (150, 160, 296, "below"), (210, 230, 100, "beside")])]
    got = sorted((r.row, r.col, r.text) for r in tables.recut(cells, spark.createDataFrame([tuple(float(v) if isinstance(v, int) and k > 2 else v for k, v in enumerate(w)) for w in words], "doc_id long, page int, no long, x0 double, x1 double, y0 double, y1 double, text string")).collect())
    assert got == [(1, 0, "Total assets"), (1, 1, "1,000"), (2, 0, "left"), (3, 1, "3,000")]


def test_choice_among_tables(spark):
    t = lambda page, no, strategy, y0, y1, n_rows=9, n=5, density=0.9, labelless=False, x0=0.0, x1=100.0: (1, page, no, strategy, x0, x1, float(y0), float(y1), n_rows, n, density, labelless)
    rows = [
        t(1, 1, "statement", 200, 300), t(1, 2, "lines", 150, 180, 3, 0), t(1, 3, "lines", 100, 160, 3, 0), t(1, 4, "lines", 195, 215, 3, 0), t(1, 5, "lines", 230, 260, labelless=True), t(1, 6, "lines", 230, 260),
        t(1, 7, "lines", 290, 320, labelless=True), t(1, 8, "lines", 150, 180, 3, 0, x0=100.0, x1=200.0), t(1, 9, "text", 400, 500), t(2, 1, "text", 0, 50), t(2, 2, "text", 60, 90, density=0.1), t(3, 1, "statement", 10, 60), t(3, 2, "text", 50, 70), t(3, 3, "text", 40, 60),
        t(4, 1, "statement", 10, 60), t(4, 2, "lines", 20, 50, labelless=True), t(4, 3, "text", 100, 150), t(5, 1, "lines", 90, 98, 7, 0), t(5, 2, "statement", 99, 190),
    ]
    got = {(r.page, r.table_no): r.reason for r in tables.preferred(spark.createDataFrame(rows, "doc_id long, page int, table_no int, strategy string, x0 double, x1 double, y0 double, y1 double, n_rows int, n_amounts int, density double, labelless boolean")).collect()}
    gone = {k: v for k, v in got.items() if v}
    assert gone == {(1, 2): "band of a statement", (1, 4): "band of a statement", (1, 5): "box without labels", (1, 9): "ruled page", (2, 2): "prose", (3, 3): "covered", (4, 2): "box without labels"} and len(got) == len(rows)


def test_values_fill_slots(spark):
    columns = spark.createDataFrame([(1, 1, 3, [100.0, 200.0, 300.0]), (1, 2, 3, [100.0, 200.0])], "doc_id long, table_no int, n_cols int, anchors array<double>")
    rows = {1: [104.0, 296.0], 2: [190.0, 210.0], 3: [150.0], 4: [1.0, 2.0, 3.0, 4.0], 5: [99.0, 101.0, 102.0]}
    values = [(1, 1, r, i, x) for r, xs in rows.items() for i, x in enumerate(xs)] + [(1, 2, 1, 0, 200.0), (1, 2, 1, 1, 100.0)]
    got = sorted(tuple(r) for r in tables.placed_values(spark.createDataFrame(values, "doc_id long, table_no int, row long, no int, x1 double"), columns).collect())
    assert got == [(1, 1, 1, 0, 0), (1, 1, 1, 1, 2), (1, 1, 2, 0, 1), (1, 1, 2, 1, 2), (1, 1, 3, 0, 0), (1, 1, 5, 0, 0), (1, 1, 5, 1, 1), (1, 1, 5, 2, 2), (1, 2, 1, 0, 1), (1, 2, 1, 1, 0)]


def test_lines_on_the_columns_count_as_rows(spark):
    columns = spark.createDataFrame([(1, 1, [100.0, 200.0])], "doc_id long, table_no int, anchors array<double>")
    lines = {1: [("Cash", 20), ("5", 112)], 2: [("Cash", 20), ("5", 116)], 3: [("5", 100), ("Cash", 150)], 4: [("As", 10), ("2022", 100), ("2023", 200)], 5: [("7", 90), ("2023", 200)], 6: [("x", 100), ("7", 150), ("8", 200)]}
    tokens = [(1, 1, n, i, float(x), t, t[0].isdigit(), False) for n, ts in lines.items() for i, (t, x) in enumerate(ts)] + [(1, 1, 7, 0, 100.0, "5", True, True)]
    got = sorted((r.line, r.n) for r in tables.promoted_rows(spark.createDataFrame(tokens, "doc_id long, table_no int, line long, no int, x1 double, text string, is_value boolean, is_row boolean"), columns).collect())
    assert got == [(1, 1), (5, 2)]


def folded(lines, most_blank=6, low=0.7, most_above=8):
    """The scan line by line: state goes from line to line and, by the last table of a page, from page to page."""
    out, docs = [], {}
    for x in lines:
        docs.setdefault(x[0], {}).setdefault(x[1], []).append(x)
    for doc, pages in docs.items():
        carry, before = None, None
        for page in sorted(pages):
            if before != page - 1:
                carry = None
            now, blank, waiting, last, bottom, segment = carry, 0, "", None, 0.0, 0
            for place, (_, _, line, top, label, n, cols, heading, unit) in enumerate(sorted(pages[page], key=lambda x: x[2]), 1):
                label = " ".join((label or "").split())
                if cols is not None:
                    segment += 1
                    goes_on = carry is not None and carry[1] == heading and place <= most_above
                    now = (cols, heading, unit or carry[2], carry[3]) if goes_on else (cols, heading, unit, (page, segment))
                    blank, waiting = 0, ""
                elif n == 0:
                    blank += 1
                    waiting = f"{waiting} {label}".strip()
                    if blank > most_blank:
                        now, waiting = None, ""
                else:
                    if now is not None and n <= now[0]:
                        said = f"{waiting} {label}".strip() if waiting and (len(label) < 3 or label[0].islower()) else label
                        out.append((doc, page, line, said, n, now[0], now[2], *now[3]))
                        last, bottom = now, top
                    blank, waiting = 0, ""
            carry, before = (last if last is not None and bottom > low else None), page
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_a_fold_over_hundreds_of_pages(spark, seed):
    rng, lines = random.Random(seed), []
    for doc in range(3):
        few = rng.choice([0.2, 0.4, 0.7])
        for page in range(1, 301):
            if rng.random() < 0.03:
                continue
            height = rng.randrange(1, 12)
            for line in range(1, height + 1):
                head = rng.random() < 0.06
                n = 0 if head or rng.random() < few else rng.randrange(1, 4)
                lines.append((doc, page, line, line / height if rng.random() < 0.8 else 0.3, rng.choice(["Total  assets", "of which", "", None, "PL", "Revenue"]), n, rng.choice([2, 3]) if head else None, rng.choice(["a", "b"]) if head else None, rng.choice(["lakh", None, "crore"]) if head else None))
    frame = spark.createDataFrame(lines, "doc_id long, page int, line int, top double, label string, n_figures int, n_cols int, columns string, unit string").repartition(7)
    got = sorted(map(str, (tuple(r) for r in tables.scan(frame).collect())))
    want = folded(lines)
    assert got == sorted(map(str, want)) and any(page > table_page + 2 for _, page, *_, table_page, _ in want)


def test_scan_of_given_lines_goes_over_page_breaks(spark):
    got = grids.statement_scan(spark, SF).collect()
    assert sum(r.table_page < r.page for r in got) > 20 and {r.unit for r in got} == {"lakh", "crore", None}
    assert {r.reason for r in grids.preferred_tables(spark, SF).collect()} == {None, "prose", "ruled page", "covered", "band of a statement", "box without labels"}
    assert {r.turned for r in grids.transposed_cells(spark, SF).collect()} == {True, False}


def test_empty_tables(spark):
    none = grid(spark, [["x"]]).limit(0)
    assert [f(none).count() for f in (tables.ruled, tables.header_info, tables.turned, tables.fused, tables.facts)] == [0] * 5
