"""Boundaries of the relational operators."""

from pyspark.sql import functions as F

from issuelens.operators import candidates, compare, consensus, documents, eligibility, evidence, flags, headers, layout, prose, ranking, workflow
from issuelens.streaming import events


def verdicts(spark, rule_id, schema, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_id int, {schema}").withColumn("route", F.lit("6(1)"))
    return [(r.o.verdict, r.o.review) for r in frame.select("case_id", eligibility.rule(rule_id).alias("o")).orderBy("case_id").collect()]


def test_public_offer_tiers(spark):
    rows = [(1600.0, 25.0), (1600.0, 24.99), (1600.01, 25.0), (4000.0, 10.0), (4000.0, 9.99), (50000.0, 10.0), (50000.01, 8.0), (100000.0, 7.99), (500000.0, 2.75), (500000.01, 3.0), (900000.0, 2.0), (900000.0, 1.0), (0.0, 50.0), (None, 10.0)]
    got = verdicts(spark, "PUBLIC_OFFER_MIN", "market_cap double, market_cap_ok boolean, public_pct double, public_pct_ok boolean", [(c, True, p, True) for c, p in rows])
    assert [v for v, _ in got] == ["pass", "fail", "pass", "pass", "fail", "pass", "pass", "fail", "pass", "fail" if 500000.01 * 0.03 < 15000 else "pass", "requires_human_review", "fail", "requires_human_review", "inconclusive"]
    assert [r for _, r in got][6:9] == [True, True, True]


def test_promoter_proviso_and_lock_in(spark):
    kind = "promoter_pct double, promoter_pct_ok boolean, other_contribution_pct double, other_contribution_pct_ok boolean, has_promoter boolean"
    rows = [(15.0, None), (9.5, None), (12.0, 8.0), (9.99, 15.0), (10.0, 12.0), (20.0, None)]
    assert verdicts(spark, "PROMOTER_CONTRIBUTION_20", kind, [(p, True, o, True, True) for p, o in rows]) == [("inconclusive", False), ("fail", False), ("pass", True), ("fail", False), ("pass", True), ("pass", False)]
    kind = "lock_in_months int, lock_in_months_ok boolean, is_capex boolean, has_promoter boolean"
    rows = [(18, False), (17, False), (36, True), (35, True), (17, None), (36, None), (20, None), (None, False)]
    assert [v for v, _ in verdicts(spark, "PROMOTER_LOCK_IN", kind, [(m, True, c, True) for m, c in rows])] == ["pass", "fail", "pass", "fail", "fail", "pass", "inconclusive", "inconclusive"]
    assert verdicts(spark, "PROMOTER_LOCK_IN", kind, [(1, True, None, False)])[0][0] == "not_applicable"


def yearly(spark, values):
    rows = [(i, f"20{20 + k}-03-31", m, v, ok) for i, years in enumerate(values) for k, (v, ok, m) in enumerate(years)]
    frame = spark.createDataFrame(rows, "case_id int, e string, months int, v double, net_tangible_assets_ok boolean").select("case_id", F.to_date("e").alias("period_end"), "months", F.col("v").cast("decimal(20,6)").alias("net_tangible_assets"), "net_tangible_assets_ok")
    out = eligibility.yearly(frame, ("net_tangible_assets",)).withColumn("route", F.lit("6(1)"))
    return [r.o.verdict for r in out.select("case_id", eligibility.rule("NTA_3CR").alias("o")).orderBy("case_id").collect()]


def test_net_tangible_assets_of_three_full_years(spark):
    y = lambda *vs: [(None if v is None else float(v), True, 12) for v in vs]
    cases = [y(3, 3, 3), y(2.99, 40, 40), y(40, 40, 2.999999), y(-5, 40, 40), y(40, 40), [*y(3, 3, 3), (1.0, True, 6)], y(3, None, 3), [(3.0, False, 12), *y(3, 3)], [(1.0, False, 12), *y(3, 3)], [(1.0, True, 12), (None, True, 12), (3.0, False, 12)]]
    assert yearly(spark, cases) == ["pass", "fail", "fail", "fail", "inconclusive", "pass", "inconclusive", "requires_human_review", "requires_human_review", "fail"]


def test_outcome_precedence(spark):
    rows = [(1, "6(1)", "mandatory", "fail"), (1, "6(1)", "mandatory", "inconclusive"), (2, "6(1)", "mandatory", "requires_human_review"), (2, "6(1)", "mandatory", "inconclusive"), (3, "6(1)", "mandatory", "inconclusive"), (3, "6(1)", "advisory", "fail"), (4, "6(1)", "mandatory", "pass"), (4, "6(1)", "mandatory", "pass"), (4, "6(1)", "mandatory", "fail_"), (5, "sme", "mandatory", "not_applicable")]
    frame = spark.createDataFrame(rows, "case_id int, route string, category string, verdict string").withColumn("review", F.lit(False))
    got = {r.case_id: (r.outcome, r.passed_pct) for r in eligibility.outcome(frame).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "screening_failure", 2: "awaiting_human_review", 3: "inconclusive", 4: "no_failure_identified", 5: "unsupported_scope"}
    assert got[4][1] == 66.67 and got[5][1] == 0


def test_cap_rules(spark):
    rows = [(25.0, 100.0), (25.01, 100.0), (22.5, 100.0), (22.4, 100.0), (1.0, 0.0), (None, 100.0)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t double, b double")
    lit = F.lit
    out = frame.select("i", flags.ratio_vs_cap(F.col("t"), F.col("b"), lit(0.25), lit(0.9), lit(None).cast("double"), lit("medium"), lit("high")).alias("o")).orderBy("i").collect()
    assert [(r.o.status, r.o.severity) for r in out] == [("flagged", "medium"), ("flagged", "high"), ("flagged", "medium"), ("clear", None), ("missing_inputs", None), ("missing_inputs", None)]


def test_series_rules(spark):
    rows = [("d", "l", 2020, 10), ("d", "r", 2020, 100), ("d", "l", 2021, 13), ("d", "r", 2021, 105), ("d", "l", 2023, 50), ("d", "r", 2023, 105)]
    series = spark.createDataFrame(rows, "doc_id string, concept string, fy int, value int")
    got = flags.growth_gap(series, "l", "r").collect()
    assert [(r.fy, round(r.gap_pp, 6), r.flagged) for r in got] == [(2021, 25.0, True)]
    assert flags.persistent_below(series, "l", "r").first().status == "flagged"


def test_footing_tolerance_and_uniqueness(spark):
    def column(t, total, a, b, unit="lakh", again=False):
        rows = [(t, "FY", "total_income", total, unit, 0.01), (t, "FY", "revenue_from_operations", a, unit, 0.01), (t, "FY", "other_income", b, unit, 0.01)]
        return rows + rows[1:2] * again

    rows = column(1, 100.03, 90.0, 10.0) + column(2, 100.04, 90.0, 10.0) + column(3, 100.0, 90.0, 10.0, again=True) + column(4, 1.0, 1.0, 0.0)[:2]
    values = spark.createDataFrame(rows, "table_id int, period string, concept string, value double, unit string, step double").withColumn("value", F.col("value").cast("decimal(20,6)"))
    got = {r.table_id: r.ok for r in consensus.footing(values).collect()}
    assert got == {1: True, 2: False} and [r.table_id for r in consensus.trusted_columns(consensus.footing(values)).collect()] == [1]


def kept(spark, counts, concept="profit_after_tax"):
    rows = [("d", k, concept, "FY2026", float(v), 1.0, 1.0, 0.9, False) for k, v in enumerate(v for v, n in counts for _ in range(n))]
    frame = spark.createDataFrame(rows, "doc_id string, table_id int, concept string, period string, value double, step double, weight double, confidence double, trusted boolean")
    return [r.value for r in consensus.consensus(frame).where(consensus.keep()).collect()]


def test_facts_are_kept_by_support(spark):
    assert kept(spark, [(100, 1), (250, 1)]) == [] and kept(spark, [(100, 2)]) == [100.0] and kept(spark, [(100, 1)]) == [100.0]
    assert kept(spark, [(100, 4), (55, 2), (7, 1)]) == [100.0] and kept(spark, [(100, 3), (55, 2), (7, 2)]) == []
    assert kept(spark, [(100, 3), (55, 2)], "total_assets") == [100.0] and kept(spark, [(55, 3), (100, 2)], "total_assets") == []
    # 101.8 is within a step of 100.9 but not of the head 100, so it stands alone.
    assert kept(spark, [(100.0, 1), (100.9, 1), (101.8, 1)]) in ([100.0], [100.9])


def test_quarantine_drops_columns_that_disagree(spark):
    rows = [("d", t, c, "FY2026", v, 1.0, 1.0, 0.9, False) for t, c, v in [(1, "total_income", 10.0), (2, "total_income", 10.0), (3, "total_income", 99.0), (3, "inventories", 5.0)]]
    frame = spark.createDataFrame(rows, "doc_id string, table_id int, concept string, period string, value double, step double, weight double, confidence double, trusted boolean")
    assert [r.table_id for r in consensus.quarantined(frame, consensus.consensus(frame)).collect()] == [3]
    assert sorted(r.key for r in consensus.facts(frame).collect()) == ["financials.total_income.FY2026"]


def test_candidates_cluster_by_score_and_conflict(spark):
    rows = [("d", "f", 100.0, 0.5, 0.80, 1, "a"), ("d", "f", 100.4, 0.5, 0.75, 2, "b"), ("d", "f", 150.0, 0.5, 0.72, 3, "c"), ("e", "f", 1.0, 0.1, 0.9, 1, "a"), ("e", "f", 5.0, 0.1, 0.5, 2, "b")]
    frame = spark.createDataFrame(rows, "doc_id string, field string, value double, tol double, score double, ord int, source string")
    got = {r.doc_id: (r.value, r.score, r.sources, r.rivals, r.status) for r in candidates.decide(frame).collect()}
    assert got == {"d": (100.0, 0.85, 2, 1, "conflicting_candidates"), "e": (1.0, 0.9, 1, 0, "extracted_needs_verification")}


def test_differences_and_accuracy(spark):
    kind = "key string, value double, step double"
    old = spark.createDataFrame([("a", 10.0, 1.0), ("b", 0.0, 0.1), ("financials.x.FY1", 1.0, 1.0)], kind)
    new = spark.createDataFrame([("a", 11.0, 0.1), ("b", 5.0, 0.1), ("c", 1.0, 1.0)], kind)
    assert {r.key: (r.kind, r.pct) for r in compare.changes(old, new).collect()} == {"a": ("same", 10.0), "b": ("moved", None), "c": ("added", None), "financials.x.FY1": ("period_only", None)}
    labels = spark.createDataFrame([("d", "k1", "present", 10.0, 1.0, [3]), ("d", "k2", "present", 10.0, 1.0, [3]), ("d", "k3", "absent", None, None, []), ("d", "k4", "present", 1.0, 1.0, [1]), ("d", "k5", "absent", None, None, [])], "doc_id string, key string, status string, value double, step double, pages array<int>")
    said = spark.createDataFrame([("d", "k1", 50.0, 0.1, 3, 1), ("d", "k1", 10.5, 0.1, 3, 2), ("d", "k2", 12.0, 0.1, 3, 1), ("d", "k3", 1.0, 0.1, 1, 1)], "doc_id string, key string, value double, step double, page int, seq int")
    judged = compare.scored(labels, said)
    assert {r.key: r.verdict for r in judged.collect()} == {"k1": "correct", "k2": "wrong", "k3": "hallucinated", "k4": "abstained", "k5": "absent"}
    total = compare.report(judged).where("is_total = 1").first()
    assert (total.n_correct, total.n_wrong, total.n_abstained, total.precision) == (1, 1, 1, 0.5)


def test_people_are_never_overruled(spark):
    outcomes = spark.createDataFrame([(1, "a", 5.0, "ok"), (1, "b", 5.0, "ok"), (1, "c", None, "conflicting_candidates"), (1, "d", 5.0, "ok")], "case_id int, field string, value double, status string")
    stored = spark.createDataFrame([(1, "a", 4.0, True), (1, "b", 4.0, False), (1, "d", 5.0, True)], "case_id int, field string, value double, human boolean")
    got = {r.field: (r.value, r.action, r.opens) for r in workflow.merged(outcomes, stored).collect()}
    assert got == {"a": (4.0, "kept", True), "b": (5.0, "replaced", False), "c": (None, "unchanged", True), "d": (5.0, "kept", False)}


def test_reviews_fold(spark):
    rows = [(1, 1, "open", 5.0), (1, 2, "request_more_evidence", None), (2, 1, "open", 5.0), (2, 2, "correct", 6.0), (3, 1, "open", 5.0), (3, 2, "reject", None), (4, 1, "open", 5.0), (4, 2, "confirm", None)]
    got = {r.item_id: (r.state, r.value, r.human) for r in workflow.review_state(spark.createDataFrame(rows, "item_id int, seq int, action string, value double")).collect()}
    assert got == {1: ("open", 5.0, False), 2: ("correct", 6.0, True), 3: ("reject", None, False), 4: ("confirm", 5.0, True)}


def test_layout_of_a_page(spark):
    words = [(1, 1, k, t, b, x0, x1, s) for k, (s, x0, x1, t, b) in enumerate([("Net", 0.0, 15.0, 10.0, 20.0), ("worth", 18.0, 43.0, 10.5, 20.5), ("100", 200.0, 215.0, 10.0, 20.0), ("next", 0.0, 20.0, 40.0, 50.0)])]
    frame = spark.createDataFrame(words, "doc_id int, page int, word_no int, top double, bottom double, x0 double, x1 double, text string")
    lined = layout.lines(frame)
    assert {r.text: r.line for r in lined.collect()} == {"Net": 1, "worth": 1, "100": 1, "next": 2}
    assert {r.text: r.cell for r in layout.cells(lined).collect()} == {"Net": 1, "worth": 1, "100": 2, "next": 1}
    numbers = spark.createDataFrame([(1, 1, 1, 101.0), (1, 1, 2, 160.0)], "doc_id int, page int, no int, x double")
    columns = spark.createDataFrame([(1, 1, 1, 100.0), (1, 1, 2, 200.0)], "doc_id int, page int, col int, at double")
    assert {r.no: r.col for r in layout.nearest_column(numbers, columns).collect()} == {1: 1, 2: 2}
    tables = spark.createDataFrame([(1, 1, 1, "x", "h"), (1, 3, 2, "x", None), (1, 5, 3, "x", None), (1, 8, 4, "x", None), (1, 8, 5, "y", None)], "doc_id int, page int, table_no int, anchors string, header string")
    assert {r.table_no: r.header for r in layout.inherited(tables, "header").collect()} == {1: "h", 2: "h", 3: "h", 4: None, 5: None}


def test_prose(spark):
    pages = spark.createDataFrame([("d", 2, "Intro text. Neither the company nor its directors is a wilful defaulter. More."), ("d", 5, "None of the promoters is a fugitive economic offender. The promoter shares are locked-in for a period of eighteen months.")], "doc_id string, page int, text string")
    got = {r.fact: (r.page, r.value) for r in documents.narrative(pages).collect()}
    assert got["declarations.wilful_defaulter_or_fraudulent_borrower"] == (2, "false") and got["declarations.fugitive_economic_offender"] == (5, "false") and got["promoter.lock_in_months"] == (5, "18")
    debt = spark.createDataFrame([(1, 3.0), (1, 4.0), (1, 7.0), (2, 3.0), (2, 5.0)], "doc_id int, value double")
    assert {r.doc_id: r.value for r in documents.debt_total(debt).collect()} == {1: 7.0, 2: 8.0}


def test_lock_in_is_read_beyond_the_snippet(spark):
    said = "The promoter shares " + "described in this chapter " * 20 + "are locked-in for a period of {} months."
    pages = spark.createDataFrame([(m, 1, said.format(m)) for m in ("eighteen", "36")], "doc_id string, page int, text string")
    got = {r.doc_id: (r.value, len(r.snippet)) for r in documents.narrative(pages).collect()}
    assert got == {"eighteen": ("18", 400), "36": ("36", 400)}


def test_evidence_and_ranks(spark):
    facts = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, [])], "doc_id int, citations array<int>")
    hidden = spark.createDataFrame([(1, 1), (2, 3)], "doc_id int, page int")
    assert sorted(r.doc_id for r in evidence.visible(facts, hidden).collect()) == [1, 3]
    items = spark.createDataFrame([(1, "unchecked", None, 1, "a"), (1, "flag", "low", 9, "b"), (1, "hidden", None, 5, "c"), (1, "flag", "high", 5, "d")], "doc_id int, kind string, severity string, page int, key string")
    assert [r.key for r in ranking.read_first(items).orderBy("rank").collect()] == ["c", "d", "b", "a"]
    versions = spark.createDataFrame([("2.10.0",), ("2.9.1",), ("1.0.0",)], "v string")
    assert [r.v for r in versions.orderBy(ranking.version_key(F.col("v")).desc()).collect()] == ["2.10.0", "2.9.1", "1.0.0"]


def test_streamed_limits_and_states(spark, tmp_path):
    rows = [(k, 1, f"2024-01-01 00:00:{s:02d}") for k, s in enumerate([0, 1, 2, 3, 59])]
    spark.createDataFrame(rows, "event_id long, user_id long, t string").select("event_id", "user_id", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "in"))

    def run(frame, name):
        query = frame.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).collect()

    assert {r.event_id: r.allowed for r in run(events.admitted(source, 2, 3), "limit")} == {0: True, 1: True, 2: False, 3: True, 4: True}
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("extracting", "complete", "extracted", "complete", "deleted")]), (F.col("event_id") + 1).cast("int"))
    got = run(events.document_states(source.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), wanted.alias("wanted"))), "states")
    assert [(r.state, r.accepted) for r in sorted(got, key=lambda r: r.seq)] == [("extracting", True), ("extracting", False), ("extracted", True), ("complete", True), ("deleted", True)]


def test_issue_amounts_by_the_words_around_them(spark):
    texts = {
        1: "The offer comprises a fresh issue of 10 shares aggregating up to ₹7,000 million and an offer for sale of 5 shares aggregating to Rs. 500 crore.",
        2: 'Initial public issue aggregating to Rs. 5,000.00 million (the "Issue" or "Fresh Issue").',
        3: "Offer aggregating up to ₹ 9,000 million comprising of a fresh issue of shares.",
        4: "Fresh Issue ₹1,301.04 Lakhs Nil ₹1,301.04 Lakhs",
        5: "A fresh issue of shares and a pre-IPO placement aggregating to ₹100 million.",
        6: 'Of the ("Fresh Issue") shares aggregating to ₹ 3 crore.',
        7: "Shares aggregating to ₹ 3 crore.",
        8: None,
    }
    pages = spark.createDataFrame([(i, 1, t) for i, t in texts.items()], "doc_id int, page int, text string")
    got = sorted((r.doc_id, r.key, r.value) for r in prose.issue_mentions(pages).collect())
    assert got == [(1, "fresh", 7e9), (1, "ofs", 5e9), (2, "fresh", 5e9), (2, "total", 5e9), (3, "total", 9e9), (4, "fresh", 130_104_000.0), (4, "total", 130_104_000.0)]
    total = prose.with_total(prose.issue_mentions(pages).select("doc_id", "key", "value")).where("method = 'derived'").collect()
    assert [(r.doc_id, r.key, r.value) for r in total] == [(1, "total", 1.2e10)]


def test_cover_tables_are_read_by_column(spark):
    head, row = ["Type", "Fresh Issue size", "Offer", "Total Offer size"], ["Fresh Issue and Offer for Sale", "aggregating to ₹ 5 crore", "aggregating to ₹ 2 crore", "aggregating up to ₹ 7 crore"]
    rows = [(1, 1, 1, head), (1, 1, 2, ["", "", "for Sale size", ""]), (1, 1, 3, row), (1, 2, 1, ["Type", "Total", "Offer for sale", "Fresh issue"]), (1, 2, 2, row), (1, 3, 1, head), (1, 3, 2, [*row[:2], "[●]", row[3]])]
    got = [(r.table_id, r.key, r.value) for r in prose.cover_amounts(spark.createDataFrame(rows, "doc_id int, table_id int, row_no int, cells array<string>")).collect()]
    assert got == [(1, "fresh", 5e7), (1, "ofs", 2e7), (1, "total", 7e7)]


def test_suggestions_and_monitoring_agency(spark):
    pages = [(1, 1, "We are eligible under Regulation 6(1) of the rules. A fresh issue is made."), (1, 7, "It is eligible under Regulation 6(2). The Book Building Process applies. An offer for sale follows."), (2, 1, "A fresh issue and an offer for sale."), (3, 9, "fresh issue")]
    frame = spark.createDataFrame(pages, "doc_id int, page int, text string")
    got = {(r.doc_id, r.suggestion): (r.value, r.page) for r in documents.suggestions(frame).collect()}
    assert got == {(1, "listing_route"): ("mainboard_reg6_2", 7), (1, "is_book_built"): ("true", 7), (1, "issue_type"): ("fresh", 1), (2, "issue_type"): ("mixed", 1)}
    said = [(1, "We have appointed XYZ as the monitoring agency."), (2, "Our company is not required to appoint a monitoring agency."), (3, "We have appointed X as monitoring agency. No monitoring agency is needed."), (4, "A monitoring agency has been appointed."), (5, None)]
    assert {r.doc_id: r.appointed for r in documents.monitoring_agency(spark.createDataFrame(said, "doc_id int, text string")).collect()} == {1: 1, 2: 0, 4: 1}


def test_header_band_stops_at_gaps_captions_and_data(spark):
    # line: top, bottom, data, caption, header
    spec = [(10, 20, False, False, True), (25, 35, False, True, False), (40, 50, False, False, True), (55, 65, False, False, False), (70, 80, True, False, False), (85, 95, True, False, False), (150, 160, False, False, True), (200, 210, False, False, True), (215, 225, True, False, False)]
    rows = [(1, 1, i + 1, float(a), float(b), d, c, h) for i, (a, b, d, c, h) in enumerate(spec)]
    got = headers.header_band(spark.createDataFrame(rows, "doc_id int, page int, line int, top double, bottom double, is_data boolean, is_caption boolean, is_header boolean")).collect()
    assert sorted((r.line, r.data_line) for r in got) == [(3, 5), (8, 9)]


def test_lines_join_the_first_word_of_a_line(spark):
    words = [(1, 1, i, t, float(i)) for i, t in enumerate([10.0, 12.0, 12.9, 14.0, 15.9, 30.0])]
    got = headers.lines_by_head(spark.createDataFrame(words, "doc_id int, page int, word_no int, top double, x0 double")).collect()
    assert [r.line for r in sorted(got, key=lambda r: r.word_no)] == [1, 1, 1, 2, 2, 3]


def test_period_windows_are_short_and_tight(spark):
    cells = {1: "Particulars March 31, 2025 March 31, 2024", 2: "nine months ended December 31, 2023 Fiscal 2023", 3: "Note 12 and 14", 4: "FY 2023 FY 2022 FY 2021"}
    words = [(c, i, w) for c, text in cells.items() for i, w in enumerate(text.split())]
    got = sorted(tuple(r) for r in headers.period_windows(spark.createDataFrame(words, "cell int, word_no int, text string"), ["cell"]).collect())
    assert got == [(1, 1, 3, "FY2025"), (1, 4, 6, "FY2024"), (2, 0, 5, "P2023-12-31-9M"), (2, 6, 7, "FY2023"), (4, 0, 1, "FY2023"), (4, 2, 3, "FY2022"), (4, 4, 5, "FY2021")]


def test_basis_lines_below_and_above(spark):
    words = [(2, 100.0, "(Consolidated)"), (3, 205.0, "Standalone"), (0, 205.0, "Consolidated"), (12, 100.0, "Standalone"), (11, 5.0, "Total"), (11, 9.0, "income")]
    columns = [(1, 1, 110.0), (1, 2, 190.0), (10, 1, 110.0)]
    got = headers.column_basis(spark.createDataFrame([(1, 1, *w) for w in words], "doc_id int, page int, line int, x double, text string"), spark.createDataFrame([(1, 1, *c) for c in columns], "doc_id int, page int, line int, col int, x double"))
    assert sorted((r.line, r.col, r.basis) for r in got.collect()) == [(1, 1, "consolidated"), (1, 2, "standalone")]


def test_series_rules_and_uncited_facts(spark):
    facts = [(1, f"financials.{c}.{p}", v, [1]) for c, p, v in [("cash_from_operations", "FY2022", 1.0), ("cash_from_operations", "FY2023", -1.0), ("cash_from_operations", "FY2024", 9.0), ("cash_from_operations", "9M-2024-12-31", 0.0), ("profit_after_tax", "FY2022", 2.0), ("profit_after_tax", "FY2023", 2.0), ("profit_after_tax", "FY2024", 2.0), ("trade_receivables", "FY2023", 10.0), ("trade_receivables", "FY2024", 15.0), ("revenue_from_operations", "FY2023", 100.0), ("revenue_from_operations", "FY2024", 110.0)]]
    facts += [(1, "objects.gcp_amount", 90.0, []), (1, "issue.fresh_issue_amount", 100.0, [1])]
    docs = spark.createDataFrame([(1, "mainboard", ["other"]), (2, "mainboard", ["lender"])], "doc_id int, platform string, sectors array<string>")
    out = flags.audit(docs, spark.createDataFrame(facts, "doc_id int, key string, value double, citations array<int>"), flags.catalogue(spark), F.lit("2025-06-30").cast("date"))
    got = {(r.doc_id, r.rule_id): r.status for r in out.collect()}
    assert len(got) == 24 and got[1, "FIN-CFO-BELOW-PAT"] == "flagged" and got[1, "FIN-RECEIVABLES-OUTGROW-REVENUE"] == "flagged"
    assert got[2, "FIN-CFO-BELOW-PAT"] == "not_applicable" and got[2, "FIN-RECEIVABLES-OUTGROW-REVENUE"] == "missing_inputs" and got[1, "OBJ-GCP-CAP-MAINBOARD"] == "missing_inputs"


def test_partial_layout_rules(spark, tmp_path):
    tables = [(1, 1, 1, "lakh", 1), (1, 2, 2, None, 1), (1, 3, 3, "crore", 1), (2, 1, 1, None, 1), (2, 2, 2, "crore", 1), (3, 1, 1, "lakh", 1), (3, 2, 1, "crore", 1), (3, 3, 2, None, 1)]
    got = {(r.doc_id, r.table_no): r.unit for r in layout.unit_donors(spark.createDataFrame(tables, "doc_id int, table_no int, page int, unit string, dates int")).collect()}
    assert got == {(1, 2): "lakh", (2, 1): "crore"}
    rows = [(1, 1, i, True, float(t), float(t + 10)) for i, t in enumerate([0, 12, 24, 100, 112, 124])]
    assert [r.n for r in layout.segments(spark.createDataFrame(rows, "doc_id int, page int, line int, is_data boolean, top double, bottom double")).collect()] == [3, 3]
    lines = [(1, i, "unit" if i == 2 else None) for i in range(40)]
    above = {r.line: r.caption_above for r in layout.carried_or_head(spark.createDataFrame(lines, "doc_id int, line int, caption string"), ["doc_id"], "line", "caption", 10).collect()}
    assert above[2] is None and above[12] == "unit" and above[30] == "unit"
    from issuelens.sources import files

    names = spark.createDataFrame([("a/b\\ré​sumé①.pdf",), ("x:y.pdf",)], "n string").select(files.safe_name(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["ré_sumé1.pdf", "x_y.pdf"]
    (tmp_path / "m.jsonl").write_text('{"doc_id": "a", "url": "1"}\n\n{"doc_id": "a", "url": "2"}\n{"doc_id": "b", "url": "3"}\n')
    assert {r.doc_id: r.url for r in files.last_entries(files.manifest(spark, str(tmp_path))).collect()} == {"a": "2", "b": "3"}
