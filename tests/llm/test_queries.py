"""Every opN_ query through its registered function: columns, types, folds and rows, on a small folder of tables with nulls, repeats, an extra column, and on empty tables."""

import random
import zlib

import pytest

from issuelens.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, stats string"
WANT = {
    "op1_packing": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("bucket", "int"), ("bucket_len", "bigint"), ("batch", "bigint"), ("slot", "bigint")],
    "op2_license_scan": [("doc_id", "bigint"), ("license", "string"), ("coverage", "double"), ("licenses", "string")],
    "op3_secret_scan": [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("n_model", "bigint"), ("base_sha256", "string"), ("spans", "string")],
    "op4_mixing": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op5_repeats": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op6_lm_score": [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")],
    "op7_quality": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op8_exact_topk": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")],
    "op9_near_dedup": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op10_quality_rules": [
        ("doc_id", "bigint"), ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"), ("base_failed", "boolean"), ("kept", "boolean"),
    ],
}


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    at = tmp_path_factory.mktemp("sf")
    good = lambda: " ".join(rng.choice(["river", "meadow", "copper", "lantern", "of", "the"]) + rng.choice("abcdefgh") for _ in range(90))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "###", "a|b", "$$$"]) for _ in range(90))
    rows = [(i, good() if i % 4 else bad(), "en", f"s{i % 5}", 9, "clash") for i in range(200)]
    rows += [(300, None, None, None, None, None), (301, "", None, "s0", 0, None), rows[3], (None, "no id here", None, None, None, None), (None, "no id here", None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1 if i % 4 else 0, 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)], "clash") for i in range(120)] + [(None, [1.0], None), (150, None, None), (200, [float("nan")], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string").write.parquet(f"{at}/embeddings.parquet")
    return str(at), rows


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("none")
    for name, shape in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("embeddings", "vec_id long, embedding array<float>")):
        spark.createDataFrame([], shape).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", list(WANT))
def test_query_has_its_columns_and_rows(spark, tables, empty, name):
    at, rows = tables
    out = queries.QUERIES[name](spark, at)
    assert out.dtypes == WANT[name]
    got = out.collect()
    if name == "op8_exact_topk":
        assert sorted({r.query_id for r in got}) == [0, 50, 100] and len(got) == 15
    else:
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    if name == "op6_lm_score":
        assert all(r.held_out == (fold(r.doc_id) == 1) for r in got if r.doc_id is not None)
    if name == "op7_quality":
        assert all(r.held_out == (fold(r.doc_id) == 0) for r in got if r.doc_id is not None) and all(r.predicted == int(r.score >= 0.3) for r in got)
        held = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
        assert held and sum(held) / len(held) >= 0.95
    if name == "op10_quality_rules":
        assert all(not (r.kept and r.base_failed) for r in got) and all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert queries.QUERIES[name](spark, empty).count() == 0
