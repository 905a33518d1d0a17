"""Faults that a reviewer found on larger tables, each in a small case."""

import random
import re

from pyspark.sql import functions as F

from issuelens.functions import labels, numbers
from issuelens.operators import consensus, documents, headers, layout, tables
from issuelens.sources import store


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_equal_strength_and_confidence_goes_to_the_lower_cluster(spark):
    """Seven readings of 0.9 add up to another mean as doubles when they come in parts."""
    rows = [("d", k, "c", "FY2026", 10.0, 1.0 if k < 6 else 0.5, 1.0, 0.9, False) for k in range(7)] + [("d", k, "c", "FY2026", 20.0, 1.0, 1.0, 0.9, False) for k in range(7)]
    frame = spark.createDataFrame(rows, "doc_id string, table_id int, concept string, period string, value double, step double, weight double, confidence double, trusted boolean").coalesce(1)
    (got,) = consensus.consensus(frame).collect()
    assert (got.value, got.supporters, got.strength, got.rival) == (10.0, 7, 7.0, 7.0)


def test_facts_of_a_table_read_its_cells_once(spark):
    rows = [("Revenue", "1,234 5.5"), ("Tax  paid", "2020"), (None, "nil"), ("12", "( 1,200 )"), (" ", "")]
    cells = spark.createDataFrame([(1, 1, 1, r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)], "doc_id long, page int, table_no int, row int, col int, text string")
    got = tables.facts(cells)
    (r,) = got.collect()
    assert (r.n_rows, r.n_cols, r.n_amounts, r.labelless) == (4, 2, 3 + 1, False) and abs(r.density - 4 / 7) < 1e-12
    assert "Join" not in plan(got) and "Generate" not in plan(got)


def test_pages_are_streamed_and_lines_go_on_over_batches(spark):
    """No call of Python for each page; batches of three words cut pages and lines anywhere."""
    rnd = random.Random(7)
    words = [(d, p, k, float(rnd.randrange(60)), float(rnd.randrange(90))) for d in (1, 2) for p in (1, 2, 3) for k in range(25)]
    frame = spark.createDataFrame(words, "doc_id int, page int, word_no int, top double, x0 double").withColumns({"bottom": F.col("top") + 6 + F.col("word_no") % 3, "x1": F.col("x0") + 4, "text": F.lit("w")})
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert "FlatMapGroups" not in plan(layout.lines(frame)) + plan(headers.lines_by_head(frame))
        got, heads = ({(r.doc_id, r.page, r.word_no): r.line for r in f(frame).collect()} for f in (layout.lines, headers.lines_by_head))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for d, p in {(w[0], w[1]) for w in words}:
        page = sorted(((t + t + 6 + k % 3) / 2, x, k, t) for a, b, k, t, x in words if (a, b) == (d, p))
        tall, line, mean, n = sorted(6 + k % 3 for _, _, k, _ in page)[12] / 2, 0, None, 0
        for mid, _, k, _ in page:
            if mean is None or abs(mid - mean) > tall:
                line, mean, n = line + 1, mid, 1
            else:
                n += 1
                mean += (mid - mean) / n
            assert got[d, p, k] == line
        line, head = 0, None
        for t, _, k in sorted((t, x, k) for _, x, k, t in page):
            if head is None or abs(t - head) > 3:
                line, head = line + 1, t
            assert heads[d, p, k] == line


def test_donors_come_by_windows_and_not_by_a_join(spark):
    rnd = random.Random(3)
    rows = [(d, k, k // 3, rnd.choice([None, None, "lakh", "crore"]), rnd.choice([1, 1, 2, None])) for d in (1, 2) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id int, table_no int, page int, unit string, dates int")
    got = layout.unit_donors(frame)
    want = set()
    for d, k, p, u, s in rows:
        near = [(n, v) for e, n, q, v, t in rows if e == d and v and s and t == s and abs(q - p) <= 2]
        side = {v for n, v in near if n < k} or {v for n, v in near if n > k}
        if u is None and len(side) == 1:
            want.add((d, k, *side))
    assert {tuple(r) for r in got.collect()} == want and "Join" not in plan(got)


def test_a_wording_that_repeats_is_searched_once(spark):
    cells = [(k, "Year ended March 31, 2022 and 2021" if k % 2 else "Fiscal 2020") for k in range(40)]
    words = spark.createDataFrame(cells, "k int, said string").select("k", F.posexplode(F.split("said", " ")).alias("word_no", "text"))
    got = headers.period_windows(words, ["k"])
    assert {(r.k, r.label) for r in got.select("k", "label").collect()} == {(k, "FY2022" if k % 2 else "FY2020") for k in range(40)}
    assert "HashAggregate(keys=[words" in plan(got)


def test_small_files_are_written_by_all_tasks_and_read_without_a_split_each(spark, tmp_path):
    rows = spark.range(3000).coalesce(1).select(F.concat("id", F.lit(".json")).alias("name"), F.concat(F.lit('{"doc_id": '), (F.col("id") % 7).cast("string"), F.lit(',\n "key": "k"}')).cast("binary").alias("content"))
    store.put(rows, str(tmp_path / "s"), by_name=True)
    assert len(list((tmp_path / "s" / "jobs").glob("*/*"))) > 1
    (tmp_path / "s" / "more" / "deep").mkdir(parents=True)
    (tmp_path / "s" / "more" / "deep" / "x.json").write_text('[{"doc_id": 6, "key": "a"}, {"doc_id": 7, "key": "b"}]')
    (tmp_path / "s" / "more" / "_x.json").write_text('{"doc_id": 99}')
    got = store.label_folder(spark, str(tmp_path / "s"), "doc_id long, key string")
    assert "FileScan" not in plan(got)
    assert {tuple(r) for r in got.select("doc_id", "key", "file_name").collect()} == {(d, "k", max(f"{k}.json" for k in range(3000) if k % 7 == d)) for d in range(6)} | {(6, "a", "x.json"), (7, "b", "x.json")}


def test_a_table_is_turned_in_one_shuffle(spark):
    cells = spark.createDataFrame([(1, 1, 1, r, c, ["", "Revenue", "Tax"][c] if r == 0 else f"Fiscal {2019 + r}" if c == 0 else str(r * c)) for r in range(4) for c in range(3)], "doc_id long, page int, table_no int, row int, col int, text string")
    got = tables.turned(cells)
    assert plan(got).count("Exchange") == 1 and plan(got).count("Sort ") == 1
    assert {(r.row, r.col): r.text for r in got.collect()}[0, 3] == "Fiscal 2022"


def test_a_grid_reads_of_its_amounts_only_what_it_shows(spark):
    cells = spark.createDataFrame([(1, 1, 1, r, c, t) for r, row in enumerate([["Item", "Fiscal 2023", "Fiscal 2022"], ["Tax", "(1,200)", "nil"], ["", "5", "6"]]) for c, t in enumerate(row)], "doc_id long, page int, table_no int, row int, col int, text string")
    got = tables.ruled(cells)
    assert "negative_by" not in plan(got) and "malformed" not in plan(got)
    assert {(r.row, r.label, r.period, None if r.value is None else float(r.value), r.is_null_mark) for r in got.collect()} == {(1, "Tax", "FY2023", -1200.0, False), (1, "Tax", "FY2022", None, True)}


def test_plain_amounts_read_as_the_others(spark):
    texts = ["5", "1,234", "(1,234.50)", "( 1,234 )", "1,23,456", "12,34", "1234,5", ",5", "(5", "5)", "0.1234567", "1.", ".5", "nil", " NIL ", "-", "n.a. ", "–", "12 %", "1,234*", "-7", " 9", "99999999999999999", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", numbers.parse_a(F.col("t")).alias("whole"), numbers.value_a(F.col("t")).alias("a"), numbers.parse_b(F.col("t")).alias("b"))
    rows = frame.select("t", "whole", "a", F.col("b").cast("double").alias("b")).collect()
    assert all((r.a.value, r.a.is_null_mark) == (r.whole.value, r.whole.is_null_mark) for r in rows)
    assert {r.t: r.b for r in rows} == dict(zip(texts, [5, 1234, -1234.5, -1234, 123456, 1234, None, None, None, None, 0.123457, None, 0.5, 0, 0, None, None, None, None, 1234, -7, 9, None, None, None]))


def test_a_scan_sorts_lines_twice_at_most(spark):
    lines = spark.createDataFrame([(1, 1, k, k / 9, f"row {k}", 0 if k in (1, 4) else 1, 2 if k == 1 else None, "h" if k == 1 else None, None) for k in range(1, 9)], "doc_id int, page int, line int, top double, label string, n_figures int, n_cols int, columns string, unit string")
    of_page = tables._scanned(lines.withColumns({"segment": F.lit(1) + F.col("doc_id"), "k": F.lit(2)}), 6)
    assert plan(of_page).count("Sort ") == 2
    assert [(r.line, r.label) for r in tables.scan(lines).orderBy("line").collect()] == [(k, f"row 4 row {k}" if k == 5 else f"row {k}") for k in (2, 3, 5, 6, 7, 8)]


def test_words_are_taken_once_and_from_sentences_with_a_cue_alone(spark):
    said = ["Our Directors are NOT PROHIBITED from dealing in securities", "Roads are blocked in for a period of 18 months, promoters say", "He is not unwilful. None is a wilful\tdefaulter", "None of 175% is locked; nothing", "“Promoter” shares are locked-in for a period of 3 years"]
    pages = spark.createDataFrame([(k, 1, f"Prose; of it. {x}. More") for k, x in enumerate(said)], "doc_id int, page int, text string")
    got = documents.narrative(pages)
    filters = [line for line in plan(got).splitlines() if re.match(r"[\s:+|*()\d-]*Filter ", line) and "regexp_extract_all" in line]
    assert len(filters) == 1 and filters[0].count("regexp_extract_all") == 1 and filters[0].index("Contains(lower(sentence") < filters[0].index("regexp_extract_all")
    assert {(r.doc_id, r.fact.split(".")[1], r.value) for r in got.collect()} == {(0, "debarred_by_sebi", "false"), (2, "wilful_defaulter_or_fraudulent_borrower", "false"), (4, "lock_in_months", "36")}


def test_every_fact_of_sentences_has_its_cue(spark):
    """The facts of any mix of words are those that would be found if no cue were asked for."""
    assert list(documents.CUES) == list(documents._declared(F.array()))
    rnd = random.Random(11)
    parts = "none neither are not debarred prohibited securities which company promoter director wilful defaulter fugitive economic offender not_less_than_75% net_offer allotted promoter locked_in period_of_18_months is".split()
    frame = spark.createDataFrame([(k, 1, " ".join(rnd.choices(parts, k=14)).replace("_", " ")) for k in range(400)], "doc_id int, page int, text string")
    plain = documents._declared(documents.claims.word_list(F.col("text")))
    want = frame.select("doc_id", *[v.alias(k.replace(".", "_")) for k, v in plain.items()]).collect()
    want = {(r.doc_id, k, r[k.replace(".", "_")]) for r in want for k in plain if r[k.replace(".", "_")] is not None}
    assert len({k for _, k, _ in want}) >= 4
    assert {(r.doc_id, r.fact, r.value) for r in documents.narrative(frame).collect()} == want


def test_sentences_of_odd_blanks(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(" \t\n\x0b\f\r\u00a0..;(AbÉ1", k=rnd.randrange(30))) for _ in range(500)] + ["", " ", None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(labels.sentences(F.col("t")).alias("s")).collect()]
    flat = [None if t is None else re.sub(r"[ \t-\r]+", " ", t).strip(" ") for t in texts]
    assert got == [None if t is None else [s.strip(" ") for s in re.split(r"(?<=[.;]) +(?=[A-Z(])", t) if s.strip(" ")] for t in flat]
