"""The corpus pipeline, stage by stage."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_rows_and_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
        if name != "packing":
            assert out.columns == columns
        if name in ("secrets",):
            assert out.count() == docs.count()
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]


def test_rejected_and_repeated_rows_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    grade = {r.doc_id: r.quality for r in labels.collect()}
    good = [i in left for i, q in grade.items() if q == 1]
    bad = [i in left for i, q in grade.items() if q == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / max(1, len(bad)) <= 0.2
    assert corpus_pipeline.drop_near_copies(spark, docs.unionByName(docs), SF).count() == corpus_pipeline.drop_near_copies(spark, docs, SF).count()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, in_text int"


def test_every_stage_takes_nulls_repeats_clashing_names_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"{text} number {i} " * 3, "en", "s", 9, "clash", 1) for i in range(6)] + [(None, text, None, None, None, None, None), (7, None, None, None, None, None, None), (8, "", "en", "s", 0, "x", 2), (3, f"{text} number 3 " * 3, "en", "s", 9, "clash", 1)]
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or name == "packing"
        found = out.collect()
        if name == "secrets":
            assert len(found) == len(rows) and sum(r.text is None for r in found) == 1 and {r["size"] for r in found} == {"clash", None, "x"}
        if name == "near_dedup":
            assert sum(r.doc_id is None for r in found) == 1 and len({r.doc_id for r in found}) == len(found)
        if name == "packing":
            assert len(found) == len(rows)
        assert stage(spark, none, SF).count() == 0


def test_the_whole_run_matches_its_stages(spark, tmp_path):
    """run() against the stages chained by hand over tables in memory, and what each must have done to its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= set(kept)
    sizes = {r.doc_id: r.n_tokens for r in out}
    from issuelens.llm import near, secrets

    shown = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    alone = {r.doc_id: r.text for r in near.one_of_each(shown).collect()}
    hidden = {r.doc_id: r.text for r in secrets.without_secrets(spark.createDataFrame(list(alone.items()), "doc_id long, text string")).collect()}
    assert set(sizes) <= set(hidden) and all(n == len((hidden[i] or "").encode().split()) for i, n in sizes.items())
    for r in out:
        assert r.n_tokens <= r.bucket_len
