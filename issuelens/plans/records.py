"""Files, manifests, catalogues and reports over the given tables; event streams run to their end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import eligibility as e
from ..operators.workflow import TRANSITIONS
from ..sources import files, reports
from ..streaming import events as streams
from . import screening
from .inputs import portable
from .screening import cases

Query = Callable[[SparkSession, str], DataFrame]


def file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as contents of files, some with a signature, some encrypted or with scripts."""
    rows = portable(spark, sf_dir, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('%PDF-1.7 ', text) WHEN 2 THEN concat('%PDF-1.4 /Encrypt ', text) WHEN 3 THEN concat('%PDF-1.4 /JavaScript x ', text) ELSE text END AS t, concat('/up/../', CAST(doc_id AS VARCHAR(20)), ' a:b.pdf') AS path FROM documents")
    out = files.validated(rows.withColumn("content", F.col("t").cast("binary")), max_bytes=20_000)
    return out.select("doc_id", "sha256", "safe_name", "reason", F.array_join("warnings", ",").alias("warnings"))


def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.stored(portable(spark, sf_dir, "SELECT text FROM documents").select(F.sha2("text", 256).alias("sha256")))


def manifest_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.last_entries(portable(spark, sf_dir, "SELECT user_id AS doc_id, event_id AS seq, event_type AS platform, value AS size FROM events"))


def catalogue_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.repeated_ids(portable(spark, sf_dir, "SELECT p_name AS doc_id FROM part"))


def fetch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = portable(spark, sf_dir, "SELECT doc_id, source AS url, lang AS sha256 FROM documents")
    held = portable(spark, sf_dir, "SELECT doc_id, source AS url, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE lang END AS sha256 FROM documents WHERE doc_id % 4 <> 1")
    return files.to_fetch(wanted, held).select("doc_id")


def stale_caches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = portable(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return files.stale(docs, docs.select("sha256", (F.col("doc_id") % 3).alias("version")).distinct(), 2).select("doc_id")


def rule_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts cite brands as sources; the register holds some of them."""
    rules = portable(spark, sf_dir, "SELECT p_partkey AS rule_id, p_brand, p_type FROM part").select("rule_id", F.array("p_brand", "p_type").alias("source_ids"))
    known = portable(spark, sf_dir, "SELECT DISTINCT p_brand AS source_id FROM part WHERE p_size < 10")
    return files.unknown_sources(rules, known).groupBy("source_id").agg(F.count("*").alias("n"))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = e.evaluate(cases(spark, sf_dir))
    return reports.text_reports(e.outcome(results), results)


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = e.evaluate(cases(spark, sf_dir))
    return reports.json_reports(e.outcome(results), results)


def report_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = e.evaluate(cases(spark, sf_dir))
    return reports.html_reports(e.outcome(results), results)


def draft_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT doc_id, lang AS key, n_chars AS value, 1 AS page FROM documents")
    return reports.draft_labels(rows).select("doc_id", "key", "status", "value", F.element_at("pages", 1).alias("page"), "note")


def _streamed(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over the events to their end, into a table in the shared folder."""
    table = f"{sf_dir}/events.parquet"
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    at = f"{shared}/stream-{uuid.uuid4().hex}"
    # A file source takes folders and patterns; a pattern that begins with the table's name fits it whether it is a file or a folder.
    source = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{sf_dir}/events.parquet*")
    query = transform(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def stream_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First uploads by user and type, while the watermark holds them: as many as there are pairs, all events being in one span."""
    return _streamed(spark, sf_dir, lambda s: streams.unique_uploads(s.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("sha256"), F.col("ts").cast("timestamp").alias("ts")), "3650 days")).select("case_id", "sha256")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: streams.admitted(s.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), 3, 86_400))


def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("extracting", "extracted", "complete", "failed", "deleted")]), (F.col("event_id") % 5 + 1).cast("int"))
    return _streamed(spark, sf_dir, lambda s: streams.document_states(s.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), wanted.alias("wanted"))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (file_validation, content_store, manifest_last, catalogue_repeats, fetch_list, stale_caches, rule_sources, report_text, report_json, report_html, draft_labels, stream_unique, stream_rate_limit, stream_states)}
ORACLE: dict[str, str] = {
    "file_validation": "WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '%PDF-1.7 ' || text WHEN 2 THEN '%PDF-1.4 /Encrypt ' || text WHEN 3 THEN '%PDF-1.4 /JavaScript x ' || text ELSE text END AS t FROM documents) SELECT doc_id, sha256(t) AS sha256, doc_id || ' a_b.pdf' AS safe_name, CASE WHEN doc_id % 5 = 0 THEN 'empty' WHEN strlen(t) > 20000 THEN 'too_large' WHEN doc_id % 5 = 4 THEN 'not_a_pdf' WHEN doc_id % 5 = 2 THEN 'encrypted' END AS reason, CASE WHEN doc_id % 5 = 3 THEN 'javascript' ELSE '' END AS warnings FROM d",
    "content_store": "SELECT DISTINCT sha256(text) AS sha256, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) AS place FROM documents",
    "manifest_last": "SELECT user_id AS doc_id, arg_max(event_type, event_id) AS platform, arg_max(value, event_id) AS size FROM events GROUP BY user_id",
    "catalogue_repeats": "SELECT p_name AS doc_id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1",
    "fetch_list": "SELECT doc_id FROM documents WHERE doc_id % 4 = 1 OR doc_id % 3 = 0",
    "stale_caches": "WITH d AS (SELECT doc_id, sha256(text) AS s FROM documents) SELECT doc_id FROM d WHERE s NOT IN (SELECT s FROM d WHERE doc_id % 3 = 2)",
    "rule_sources": "WITH r AS (SELECT p_brand AS source_id FROM part UNION ALL SELECT p_type FROM part) SELECT source_id, count(*) AS n FROM r WHERE source_id NOT IN (SELECT p_brand FROM part WHERE p_size < 10) GROUP BY source_id",
    "draft_labels": "SELECT doc_id, lang AS key, 'present' AS status, n_chars AS value, CAST(1 AS INT) AS page, 'draft' AS note FROM documents",
    "stream_unique": "SELECT DISTINCT user_id AS case_id, event_type AS sha256 FROM events",
    "stream_rate_limit": """WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT event_id, user_id, n, [t] AS held, TRUE AS allowed FROM e WHERE n = 1
            UNION ALL SELECT event_id, user_id, n, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3 FROM (SELECT e.*, list_filter(r.held, lambda h: h > e.t - 86400) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) x)
        SELECT event_id, user_id, allowed FROM r""",
    "stream_states": f"""WITH RECURSIVE e AS (SELECT user_id AS doc_id, event_id AS seq, ['extracting', 'extracted', 'complete', 'failed', 'deleted'][event_id % 5 + 1] AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        t AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, bs in TRANSITIONS.items() for b in bs)}) v(was, becomes)),
        r AS (SELECT doc_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, 'uploaded' AS state, TRUE AS accepted FROM e WHERE n = 1
            UNION ALL SELECT e.doc_id, e.seq, e.n, CASE WHEN t.was IS NULL THEN r.state ELSE e.wanted END, t.was IS NOT NULL FROM r JOIN e ON e.doc_id = r.doc_id AND e.n = r.n + 1 LEFT JOIN t ON t.was = r.state AND t.becomes = e.wanted)
        SELECT doc_id, seq, state, accepted FROM r WHERE n > 0""",
}
# Reports, from the SQL of the screening queries.
_REPORTED = f"""
    WITH o AS ({screening.ORACLE['screening_outcome']}), l AS ({screening.ORACLE['rules_long']}),
    r AS (SELECT l.*, list_position([{', '.join(f"'{x[0]}'" for x in e.CATALOGUE)}], l.rule_id) AS ord FROM l)
"""
ORACLE["report_html"] = f"{_REPORTED} SELECT o.case_id, '<h1>' || o.case_id || ' ' || any_value(o.outcome) || '</h1><table>' || string_agg('<tr><td>' || rule_id || '</td><td>' || verdict || '</td></tr>', '' ORDER BY ord) || '</table>' AS report FROM o JOIN r ON o.case_id = r.case_id GROUP BY o.case_id"
ORACLE["report_text"] = f"{_REPORTED} SELECT o.case_id, format('Case {{}}: {{}}, {{:.2f}}% passed', o.case_id, any_value(o.outcome), any_value(o.passed_pct)) || chr(10) || string_agg(format('{{:<32}} {{}}{{}}', rule_id, verdict, CASE WHEN review THEN ' (review)' ELSE '' END), chr(10) ORDER BY ord) AS report FROM o JOIN r ON o.case_id = r.case_id GROUP BY o.case_id"
ORACLE["report_json"] = f"{_REPORTED} SELECT o.case_id, CAST(to_json({{'case_id': o.case_id, 'outcome': any_value(o.outcome), 'passed_pct': any_value(o.passed_pct), 'rules': list({{'ord': ord, 'rule_id': rule_id, 'category': category, 'verdict': verdict, 'review': review}} ORDER BY ord)}}) AS VARCHAR) AS report FROM o JOIN r ON o.case_id = r.case_id GROUP BY o.case_id"
