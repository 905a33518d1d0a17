"""What sentences claim: the reach of negations, whom a fact is about, and statements about the agency that monitors."""

import pytest
from pyspark.sql import functions as F

from issuelens.functions import claims
from issuelens.operators import documents

D = "declarations."
SAID = {
    "Our Company, its Promoters and Directors have not been debarred from accessing the capital markets by SEBI.": {D + "debarred_by_sebi": "false"},
    "Our Directors are not prohibited from dealing in securities.": {D + "debarred_by_sebi": "false"},
    "Our Directors have been debarred from dealing in securities.": {},
    "It is not clear whether our Directors were at any time debarred from dealing in securities.": {},
    "Our Company has not been debarred from bidding for tenders.": {},
    "None of our Promoters or Directors are promoters or directors of any other company which is debarred from accessing the capital market.": {D + "promoter_or_director_of_debarred_company": "false"},
    "Neither our Promoters nor Directors are directors of companies which have been debarred.": {D + "promoter_or_director_of_debarred_company": "false"},
    "Our Promoter is a director of a company which is debarred.": {},
    "Neither our Company nor any Promoter has been identified as a wilful defaulter or fraudulent borrower.": {D + "wilful_defaulter_or_fraudulent_borrower": "false"},
    "Our Company has not been declared a wilful defaulter.": {D + "wilful_defaulter_or_fraudulent_borrower": "false"},
    "Our Promoter is a wilful defaulter, not a bank.": {},
    "Not less than two wilful defaulters were named.": {},
    "None of our Directors is a Fugitive Economic Offender.": {D + "fugitive_economic_offender": "false"},
    "Whether or not he is a fugitive economic offender is unknown.": {},
    "Not less than 75% of the Net Offer shall be available for allocation to QIBs.": {"issue_details.qib_net_offer_allocation": "75"},
    "Not less than 75% of the Net Offer shall be allotted to QIBs.": {"issue_details.qib_net_offer_allocation": "75"},
    "Not more than 75% of the Net Offer shall be allotted to QIBs.": {},
    "The minimum Promoters' contribution is locked-in for a period of 18 months.": {"promoter.lock_in_months": "18"},
    "Promoter shares are locked in for a period of three years.": {"promoter.lock_in_months": "36"},
    "Other shares are locked in for a period of three years.": {},
    "Promoter shares are locked in for a period of one year.": {},
}
AGENCY = [
    ("In terms of Regulation 41, our Company has appointed India Ratings and Research Private Limited to monitor the utilisation of the Gross Proceeds.", 1),
    ("Our Company has not appointed any monitoring agency for this Issue.", 0),
    ("Our Company has appointed CARE Ratings as the Monitoring Agency for the Issue.", 1),
    ("CRISIL Ratings has been appointed as the monitoring agency in terms of Regulation 41.", 1),
    ("As the Issue size is below Rs 100 crores, no monitoring agency is required.", 0),
    ("The Company is not required to appoint a monitoring agency under the ICDR rules.", 0),
    ("The appointment of a monitoring agency is not applicable.", 0),
    ("A monitoring agency shall be appointed before the prospectus.", None),
    ("The Issue is being made through the book building process.", None),
    ("We have appointed auditors. The board will monitor progress.", None),
    (None, None),
]


def test_facts_of_sentences(spark):
    rows = [(i, 1, s) for i, s in enumerate(SAID)]
    found = {}
    for r in documents.narrative(spark.createDataFrame(rows, "doc_id int, page int, text string")).collect():
        found.setdefault(r.doc_id, {})[r.fact] = r.value
    assert {s: found.get(i, {}) for i, s in enumerate(SAID)} == SAID


def test_the_first_sentence_counts(spark):
    text = "The Promoter shares are locked-in for a period of eighteen months. The Promoter shares are locked-in for a period of three years."
    rows = [("a", 4, text), ("a", 2, "Other. Promoter shares are locked-in for a period of three years."), ("b", 1, None)]
    got = [(r.doc_id, r.page, r.value) for r in documents.narrative(spark.createDataFrame(rows, "doc_id string, page int, text string")).collect()]
    assert got == [("a", 2, "36")]


def test_monitoring_agency(spark):
    got = {r.doc_id: r.appointed for r in documents.monitoring_agency(spark.createDataFrame([(i, s) for i, (s, _) in enumerate(AGENCY)], "doc_id int, text string")).collect()}
    assert [got.get(i) for i in range(len(AGENCY))] == [a for _, a in AGENCY]


@pytest.mark.parametrize(("text", "phrases", "want"), [("a b a b c", ("a b",), [0, 2]), ("Debarring debars", ("debar*",), [0, 1]), ("a", ("a b",), []), ("", ("a",), []), (None, ("a",), []), ("b a", ("a", "b"), [1, 0])])
def test_places(spark, text, phrases, want):
    frame = spark.createDataFrame([(text,)], "t string").select(claims.places(claims.word_list(F.col("t")), *phrases).alias("p"))
    assert frame.first().p == want


def test_sectors_count_each_mention(spark):
    rows = [("x", 1, "NBFC nbfc NBFCs, a non-banking financial company."), ("x", 200, "nbfc"), ("y", 1, "RERA")]
    got = {(r.doc_id, r.sector): r.mentions for r in documents.sectors(spark.createDataFrame(rows, "doc_id string, page int, text string"), found={k: (p, 1) for k, (p, _) in documents.SECTORS.items()}).collect()}
    assert got == {("x", "lender"): 4, ("y", "real_estate"): 1}
