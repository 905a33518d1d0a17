"""Folders of files written and read by jobs, from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import store
from .inputs import portable

Query = Callable[[SparkSession, str], DataFrame]

#: Texts of documents under names that two of them share, put in two jobs; then some names are taken out.
FIRST = "SELECT concat('text-', CAST(doc_id - doc_id % 2 AS VARCHAR(20)), '.txt') AS name, coalesce(text, '') AS text FROM documents WHERE doc_id % 2 = 0"
SECOND = "SELECT concat('text-', CAST(doc_id - doc_id % 2 AS VARCHAR(20)), '.txt') AS name, coalesce(text, '') AS text FROM documents WHERE doc_id % 6 = 1"
GONE = "SELECT concat('text-', CAST(doc_id AS VARCHAR(20)), '.txt') AS name FROM documents WHERE doc_id % 5 = 0"
ASKED = "SELECT concat('text-', CAST(doc_id AS VARCHAR(20)), '.txt') AS name FROM documents"
RULES = "SELECT concat('rule-', CAST(s_suppkey AS VARCHAR(20)), CASE WHEN s_suppkey % 9 = 0 THEN '.txt' ELSE '.toml' END) AS name, concat('id = \"', s_name, '\"', chr(10), 'kind = \"', CASE WHEN s_suppkey % 2 = 0 THEN 'threshold' ELSE 'ratio' END, '\"', chr(10), 'limit = ', CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR(20)), chr(10), 'unused = [1, 2]', chr(10), CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('keys = [\"a\", \"', CAST(s_nationkey AS VARCHAR(20)), '\"]') END) AS text FROM supplier"
LABELS = "SELECT concat(CAST(c_custkey AS VARCHAR(20)), CASE WHEN c_custkey % 4 = 0 THEN '.draft.json' ELSE '.json' END) AS name, concat(chr(123), '\"doc_id\": ', CAST(c_custkey % 300 AS VARCHAR(20)), ',', chr(10), '\"key\": \"', c_mktsegment, '\"', chr(125)) AS text FROM customer"


def _put(spark: SparkSession, sf_dir: str, sql: str, at: str, by_name: bool = False) -> None:
    store.put(portable(spark, sf_dir, sql).select("name", F.col("text").cast("binary").alias("content")), at, by_name)


def _stored(spark: SparkSession, sf_dir: str) -> str:
    at = shared_folder(spark, "store")
    _put(spark, sf_dir, FIRST, at)
    _put(spark, sf_dir, SECOND, at)
    store.delete(portable(spark, sf_dir, GONE), at)
    return at


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as they come back from the store."""
    got = store.get(spark, _stored(spark, sf_dir))
    return got.select("name", "sha256", F.sha2("content", 256).alias("read_sha256"), F.octet_length("content").cast("long").alias("n_bytes"))


def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.exists(portable(spark, sf_dir, ASKED), _stored(spark, sf_dir))


def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "rules")
    _put(spark, sf_dir, RULES, at, by_name=True)
    return store.rule_files(spark, at, "id string, kind string, limit long, keys array<string>").select("file_name", "id", "kind", "limit", F.array_join("keys", ",").alias("keys"))


def label_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "labels")
    _put(spark, sf_dir, LABELS, at, by_name=True)
    return store.label_folder(spark, at, "doc_id long, key string")


QUERIES: dict[str, Query] = {f.__name__: f for f in (stored_files, stored_names, rule_files, label_folder)}
_HELD = f"WITH p AS (SELECT name, text, 1 AS job FROM ({FIRST}) a UNION ALL SELECT name, text, 2 FROM ({SECOND}) b), l AS (SELECT name, arg_max(text, job) AS text FROM p GROUP BY name), h AS (SELECT * FROM l WHERE name NOT IN (SELECT name FROM ({GONE}) g))"
ORACLE: dict[str, str] = {
    "stored_files": f"{_HELD} SELECT name, sha256(text) AS sha256, sha256(text) AS read_sha256, strlen(text) AS n_bytes FROM h",
    "stored_names": f"{_HELD} SELECT name, name IN (SELECT name FROM h) AS held FROM ({ASKED}) q",
    "rule_files": f"SELECT name AS file_name, regexp_extract(text, 'id = \"([^\"]*)\"', 1) AS id, regexp_extract(text, 'kind = \"([^\"]*)\"', 1) AS kind, CAST(regexp_extract(text, 'limit = (-?[0-9]+)', 1) AS BIGINT) AS limit, nullif(replace(replace(regexp_extract(text, 'keys = .([^]]*)', 1), '\"', ''), ' ', ''), '') AS keys FROM ({RULES}) r WHERE name LIKE '%.toml'",
    "label_folder": f"SELECT CAST(regexp_extract(text, '\"doc_id\": ([0-9]+)', 1) AS BIGINT) AS doc_id, arg_max(regexp_extract(text, '\"key\": \"([^\"]*)\"', 1), name) AS key, max(name) AS file_name FROM ({LABELS}) l WHERE name NOT LIKE '%.draft.json' GROUP BY 1",
}
