"""Writes on versions, documents through crashes and retries, and the citations that flags carry."""

from pyspark.sql import functions as F

from issuelens.operators import flags, workflow


def test_of_two_writers_on_one_version_the_first_wins(spark):
    current = spark.createDataFrame([(1, 3, {"a": 1, "b": 2})], "case_id int, version long, fields map<string,int>")
    writes = [(1, 10, 3, False, {"b": 5, "c": 6}), (1, 11, 3, False, {"a": 9}), (1, 12, 4, True, {"z": 0}), (1, 13, 6, False, {"y": 1}), (1, 14, None, False, {"y": 1}), (2, 1, 0, False, {"a": 1}), (3, 1, 1, False, {"a": 1})]
    got = {(r.case_id, r.seq): (r.accepted, r.version, r.fields) for r in workflow.versioned(current, spark.createDataFrame(writes, "case_id int, seq int, base_version long, replaces boolean, fields map<string,int>").repartition(3)).collect()}
    assert got == {
        (1, 10): (True, 4, {"a": 1, "b": 5, "c": 6}), (1, 11): (False, 4, {"a": 1, "b": 5, "c": 6}), (1, 12): (True, 5, {"z": 0}), (1, 13): (False, 5, {"z": 0}), (1, 14): (False, 5, {"z": 0}),
        (2, 1): (True, 1, {"a": 1}), (3, 1): (False, 0, {}),
    }


def test_documents_through_a_crash(spark):
    told = {
        "done": ["start", "finish", "complete", "recover"], "crashed": ["start", "recover", "retry", "start", "finish"], "waiting": ["recover"], "gone": ["start", "finish", "delete_content", "retry"],
        "busy": ["start", "delete_content", "start", "fail"], "again": ["start", "fail", "retry", "retry", "complete"],
    }
    rows = [(d, i, a) for d, steps in told.items() for i, a in enumerate(steps)]
    got = {r.doc_id: (r.state, r.held, r.n_retries, r.n_recovered, r.n_refused) for r in workflow.replayed(spark.createDataFrame(rows, "doc_id string, seq int, action string").repartition(4)).collect()}
    assert got == {
        "done": ("complete", True, 0, 0, 0), "crashed": ("extracted", True, 1, 1, 0), "waiting": ("failed", True, 0, 1, 0), "gone": ("extracted", False, 0, 0, 1), "busy": ("failed", True, 0, 0, 2), "again": ("uploaded", True, 1, 0, 2),
    }


def test_flags_carry_the_citations_of_what_they_used(spark):
    cite = lambda *pages: [(p, "x") for p in pages]
    facts = [
        ("objects.gcp_amount", 30.0, cite(4, 5)), ("objects.unidentified_acquisition_amount", 10.0, cite(5, 6)), ("issue.fresh_issue_amount", 100.0, cite(6, 1)), ("objects.debt_repayment_amount", 90.0, []),
        *[(f"financials.cash_from_operations.FY{y}", 1.0, cite(y - 2000, 7)) for y in range(2019, 2024)], *[(f"financials.profit_after_tax.FY{y}", 2.0, cite(7, y - 2010)) for y in range(2019, 2024)],
    ]
    frame = spark.createDataFrame([("d", *f) for f in facts], "doc_id string, key string, value double, citations array<struct<page:int,span:string>>")
    docs = spark.createDataFrame([("d", "mainboard", [])], "doc_id string, platform string, sectors array<string>")
    got = {r.rule_id: [c.page for c in r.citations] for r in flags.cited_flags(docs, frame, flags.catalogue(spark), F.lit("2025-06-30").cast("date")).collect()}
    assert got == {"OBJ-GCP-CAP-MAINBOARD": [4, 5, 6, 1], "OBJ-GCP-UNIDENTIFIED-35-MAINBOARD": [4, 5, 6, 1], "FIN-CFO-BELOW-PAT": [21, 7, 11, 22, 12, 23, 13]}
