"""The store of files: a job is seen whole or not at all; names, deletes, equal contents; folders of rules and labels."""

import os

import pytest
from pyspark.sql import functions as F

from issuelens.sources import store


def files(spark, rows):
    return spark.createDataFrame([(n, None if c is None else c.encode()) for n, c in rows], "name string, content binary").repartition(3)


def contents(spark, path):
    return {r.name: bytes(r.content).decode() for r in store.get(spark, path).collect()}


def test_put_get_exists_delete(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    store.put(files(spark, [("a.txt", "1"), ("b.txt", ""), ("c.txt", "1")]), at)
    assert contents(spark, at) == {"a.txt": "1", "b.txt": "", "c.txt": "1"}
    held = {r.sha256 for r in store.entries(spark, at).collect()}
    assert len(held) == 2 and sum(f in held for _, _, names in os.walk(tmp_path) for f in names) == 2  # equal contents once
    store.put(files(spark, [("a.txt", "2")]), at)
    store.delete(spark.createDataFrame([("b.txt",), ("none",)], "name string"), at)
    assert contents(spark, at) == {"a.txt": "2", "c.txt": "1"}
    asked = spark.createDataFrame([("a.txt",), ("b.txt",), ("z",)], "name string")
    assert {r.name: r.held for r in store.exists(asked, at).collect()} == {"a.txt": True, "b.txt": False, "z": False}
    assert {r.name for r in store.get(spark, at, asked).collect()} == {"a.txt"}
    assert not [x for x in os.listdir(tmp_path / "s" / "staging")]


@pytest.mark.parametrize("bad", ["../up", "", None, "a/b", ".hidden"])
def test_a_job_that_fails_leaves_nothing(spark, tmp_path, bad):
    at = f"file://{tmp_path}/s"
    store.put(files(spark, [("a.txt", "1")]), at)
    before = sorted(os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names)
    with pytest.raises(Exception, match="no name for a file"):
        store.put(files(spark, [(f"f{i}", "x" * i) for i in range(20)] + [(bad, "y")]), at)
    assert sorted(os.path.join(d, f) for d, _, names in os.walk(tmp_path) for f in names) == before and contents(spark, at) == {"a.txt": "1"}


def test_attempts_that_are_not_named_are_dropped(tmp_path):
    writer = store.StoreWriter(str(tmp_path), False)
    from pyspark.sql import Row

    kept, other = writer.write(iter([Row(name="a", content=b"1")])), writer.write(iter([Row(name="a", content=b"2")]))
    writer.commit([kept, None])
    (job,) = os.listdir(tmp_path / "jobs")
    assert os.listdir(tmp_path / "jobs" / job) == [kept.folder] and other.folder != kept.folder
    late = store.StoreWriter(str(tmp_path), False)
    late.write(iter([Row(name="b", content=b"3")]))
    late.abort([None])
    assert os.listdir(tmp_path / "staging") == [] and len(os.listdir(tmp_path / "jobs")) == 1
    store.StoreWriter(str(tmp_path), False).write(iter([Row(name="c", content=b"4")]))
    store.clear_staging(str(tmp_path))
    assert not (tmp_path / "staging").exists()


def test_rule_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.toml").write_text('id = "B"\nlimit = 2\n[more]\nx = 1\n')
    (tmp_path / "sub" / "a.toml").write_text('id = "A"\nkeys = ["k"]\nday = 2020-01-02\n')
    (tmp_path / "c.txt").write_text("no rule")
    got = store.rule_files(spark, str(tmp_path), "id string, limit int, keys array<string>, day string").orderBy("file_name").collect()
    assert [tuple(r) for r in got] == [("a.toml", "A", None, ["k"], "2020-01-02"), ("b.toml", "B", 2, None, None)]
    (tmp_path / "d.toml").write_text("id = ")
    with pytest.raises(Exception, match="d.toml"):
        store.rule_files(spark, str(tmp_path), "id string").collect()


def test_label_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"doc_id": "x",\n "key": "new"}')
    (tmp_path / "a.json").write_text('{"doc_id": "x", "key": "old"}')
    (tmp_path / "y.draft.json").write_text('{"doc_id": "y", "key": "draft"}')
    got = store.label_folder(spark, str(tmp_path), "doc_id string, key string")
    assert [tuple(r) for r in got.select("doc_id", "key", "file_name").collect()] == [("x", "new", "b.json")] and got.where(F.col("doc_id") == "y").count() == 0
