"""Each registered query of the reference's operators against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from issuelens.plans import registry

SF = "/root/testdata/sf0.001"
# One-rule queries are the rows of rules_long.
NAMES = [n for n in registry.ORACLE if not n.startswith("rule_r") or n == "rule_r03"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
            return f"{float(v):.9g}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["nearest_column_all", "band_assign_all", "outside_boxes_all"])
def test_geometry_reaches_every_page(spark, duck, name):
    pages = {p for (p,) in duck.sql("SELECT DISTINCT l_linenumber FROM lineitem").fetchall()}
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert set(got["page"]) == pages and (name != "band_assign_all" or len(got) == duck.sql("SELECT DISTINCT l_suppkey, l_linenumber, l_orderkey FROM lineitem").df().shape[0])


def test_whole_texts_are_searched(spark, duck, tmp_path):
    """Words after character 200 of a given text decide, and the SQL finds them too."""
    far = "word " * 100
    rows = [(5, far + "Draft Red Herring Prospectus and a fresh issue of Rs. 5 crore"), (11, far + "annual report"), (17, None), (23, far + "made pursuant to Regulation 6(2) of the rules, ₹ 7 million or INR 8 lakh")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {"doc_type_whole": {5: ("drhp",), 11: ("annual_report",), 17: (None,), 23: (None,)}, "issue_prose_whole": {5: ("mixed", None, 1), 11: ("fresh", None, 1), 17: ("offer_for_sale", None, 1), 23: (None, "6(2)", 2)}}
    for name, expected in want.items():
        for query in (name, name.removesuffix("_whole")):
            assert {r[0]: tuple(r[1:]) for r in registry.QUERIES[query](spark, str(tmp_path)).collect()} == expected
        assert {r[0]: r[1:] for r in con.sql(registry.ORACLE[name]).fetchall()} == expected


def test_registered_names_are_callable():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and all(map(callable, known.values()))


def test_entry_gives_rows(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[:2] == ["case_id", "outcome"] and out.count() == 10
