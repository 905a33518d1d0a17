"""Cases, versions, reviews and evidence over the given tables: users as cases, events as their log, documents as uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, evidence, ranking, workflow
from .inputs import portable

Query = Callable[[SparkSession, str], DataFrame]

EVENTS = "SELECT event_id, user_id, ts, event_type, value FROM events"
#: Review items of users: views open one, clicks confirm, purchases correct, errors reject, sign-ups ask for evidence.
REVIEWS = "SELECT user_id AS item_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'confirm' WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'reject' ELSE 'request_more_evidence' END AS action, value FROM events"
OUTCOMES = "SELECT o_custkey AS case_id, o_orderpriority AS field, CASE WHEN MIN(o_orderkey) % 7 = 0 THEN NULL ELSE MAX(o_totalprice) END AS value, CASE WHEN MIN(o_orderkey) % 5 = 0 THEN 'conflicting_candidates' ELSE 'extracted_high_confidence' END AS status FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey, o_orderpriority"
STORED = "SELECT o_custkey AS case_id, o_orderpriority AS field, MAX(o_totalprice) AS value, MIN(o_orderkey) % 3 = 0 AS human FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey, o_orderpriority"
UPLOADS = "SELECT doc_id, source AS case_id, text, doc_id % 3 <> 0 AS expired FROM documents"


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.latest(portable(spark, sf_dir, EVENTS), ("user_id",), ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.numbered(portable(spark, sf_dir, EVENTS), ("user_id",), ["ts", "event_id"]).select("user_id", "event_id", "version")


def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.hits_in_window(portable(spark, sf_dir, EVENTS), "user_id", "ts", 3600).select("event_id", "n")


def audit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the log: the report is a top-k."""
    return portable(spark, sf_dir, EVENTS).where("event_type = 'error'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "user_id").limit(200)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.grouped_counts(portable(spark, sf_dir, EVENTS), "event_type")


def case_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, open items and reports of each case in one pass over a union, not three joins."""
    docs = portable(spark, sf_dir, "SELECT o_custkey AS case_id, 'document' AS kind FROM orders UNION ALL SELECT o_custkey AS case_id, 'open_item' AS kind FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey AS case_id, 'report' AS kind FROM orders WHERE o_orderpriority = '1-URGENT'")
    return docs.groupBy("case_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("document", "open_item", "report")])


def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = case_counts(spark, sf_dir)
    return n.select("case_id", workflow.case_status(F.col("case_id") % 13 == 0, F.when(F.col("case_id") % 7 == 0, F.col("n_documents")).otherwise(0), F.col("n_open_items"), F.col("n_reports") > 0).alias("status"))


def as_of_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sign-up at or before each purchase: an as-of join by window, not a theta join."""
    from pyspark.sql import Window

    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return portable(spark, sf_dir, EVENTS).where("event_type in ('signup', 'purchase')").withColumn("signup_id", last).where("event_type = 'purchase'").select("event_id", "signup_id")


def review_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.review_state(portable(spark, sf_dir, REVIEWS))


def sign_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.sign_off(portable(spark, sf_dir, REVIEWS))


def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.merged(portable(spark, sf_dir, OUTCOMES), portable(spark, sf_dir, STORED))


def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = portable(spark, sf_dir, "SELECT event_id AS item_id, user_id AS doc_id, floor(value / 10) AS run_id, CASE WHEN event_type = 'view' THEN 'open' ELSE 'resolved' END AS status FROM events")
    return workflow.superseded(items, items).select("item_id", "status")


def idempotent_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content of a case; what a case holds already isn't stored again."""
    up = portable(spark, sf_dir, UPLOADS).select("case_id", F.sha2("text", 256).alias("sha256"), "doc_id")
    held = up.where("doc_id % 10 = 0").select("case_id", "sha256").distinct()
    return workflow.appended(held, up, ("case_id", "sha256")).select("case_id", "sha256")


def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.purgeable(portable(spark, sf_dir, UPLOADS).withColumn("sha256", F.sha2("text", 256)))


def delete_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = portable(spark, sf_dir, UPLOADS).select("doc_id", F.sha2("text", 256).alias("sha256"))
    return workflow.only_copy(docs, docs.where("doc_id % 4 = 1")).select("doc_id")


def complete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = portable(spark, sf_dir, "SELECT DISTINCT user_id AS doc_id FROM events")
    items = portable(spark, sf_dir, "SELECT user_id AS doc_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'open' ELSE 'resolved' END AS status FROM events")
    return workflow.complete(users, items)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = "CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'F' THEN 'extracted' ELSE 'failed' END"
    after = "CASE o_orderpriority WHEN '1-URGENT' THEN 'extracting' WHEN '2-HIGH' THEN 'complete' ELSE 'deleted' END"
    return portable(spark, sf_dir, f"SELECT o_orderkey, {states} AS a, {after} AS b FROM orders").select("o_orderkey", workflow.may_follow(F.col("a"), F.col("b")).alias("allowed"))


def case_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the cases whose name holds a text: the report is a page."""
    return workflow.found(portable(spark, sf_dir, "SELECT p_partkey AS case_id, p_name AS name FROM part"), "A", page=1, size=50)


def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT event_id, props, CAST(value AS VARCHAR(40)) AS v FROM events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.select("event_id", workflow.coerced(F.col("k"), "int").alias("as_int"), workflow.coerced(F.col("k"), "bool").alias("as_bool"), workflow.coerced(F.concat(F.lit("x"), F.col("k")), "int").alias("refused"))


def runs_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (orders) of documents (customers), narrow; the smaller side is broadcast if its measured size allows."""
    return portable(spark, sf_dir, "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders").join(portable(spark, sf_dir, "SELECT c_custkey, c_mktsegment FROM customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


def stale_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = portable(spark, sf_dir, "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE source END AS sha256 FROM documents")
    manifest = portable(spark, sf_dir, "SELECT doc_id, source AS sha256 FROM documents")
    return compare.stale_labels(labels, manifest)


FACTS = "SELECT d.doc_id, CAST(d.doc_id % 3 AS INT) AS page, substr(d.text, 10, 12) AS raw, substr(d.text, 5, 30) AS span, d.doc_id % 5 AS shift FROM documents d"


def evidence_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from texts against pages that hold the whole texts, some of them turned round."""
    facts = portable(spark, sf_dir, FACTS).withColumn("table_pages", F.array(F.lit(0), F.lit(1)))
    pages = portable(spark, sf_dir, "SELECT doc_id, CAST(doc_id % 3 AS INT) AS page, CASE WHEN doc_id % 5 = 0 THEN reverse(text) ELSE text END AS text FROM documents")
    return evidence.verified(facts, pages).select("doc_id", "in_span", "in_table", "on_page")


def labels_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = portable(spark, sf_dir, FACTS).select("doc_id", F.lit("k").alias("key"), "raw", F.array(F.lit(0), F.lit(1)).alias("pages"))
    pages = portable(spark, sf_dir, "SELECT doc_id, CAST(doc_id % 3 AS INT) AS page, text FROM documents")
    return evidence.labels_verified(labels, pages).select("doc_id", "found")


def hidden_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = portable(spark, sf_dir, "SELECT o_custkey AS doc_id, o_orderkey, CAST(o_orderkey % 5 AS INT) AS p FROM orders").withColumn("citations", F.array(F.col("p"), (F.col("p") + 1).cast("int")))
    hidden = portable(spark, sf_dir, "SELECT c_custkey AS doc_id, CAST(c_custkey % 5 AS INT) AS page FROM customer UNION ALL SELECT c_custkey AS doc_id, CAST((c_custkey + 1) % 5 AS INT) AS page FROM customer")
    return evidence.visible(facts, hidden).select("o_orderkey")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
    return rows.select("c_custkey", evidence.fingerprint({"segment": F.col("segment"), "name": F.col("c_name"), "nation": F.col("c_nationkey")}).alias("sha256"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.page_tagged(portable(spark, sf_dir, "SELECT conv_id AS doc_id, turn AS page, text FROM conversations")).select("doc_id", F.md5("text").alias("digest"))


def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = portable(spark, sf_dir, "SELECT s_suppkey AS case_id FROM supplier")
    years = portable(spark, sf_dir, "SELECT DISTINCT l_suppkey AS case_id, concat('FY', CAST(year(l_shipdate) AS VARCHAR(4))) AS year_label FROM lineitem")
    found = evidence.paths(cases, years, ["promoter.lock_in_months", "issue_details.issue_size"], ["net_worth", "revenue"])
    return found.select("case_id", "path", evidence.path_parts(F.col("path")).alias("p")).select("case_id", "path", "p.year", "p.field")


def path_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = portable(spark, sf_dir, "SELECT o_custkey AS case_id, o_orderpriority AS path, MAX(o_totalprice) AS value FROM orders GROUP BY o_custkey, o_orderpriority")
    changes = portable(spark, sf_dir, "SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE 'new.path' END AS path, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS value FROM customer")
    return evidence.updated(facts, changes)


def evidence_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = portable(spark, sf_dir, "SELECT event_id, CASE event_type WHEN 'click' THEN 'manual' WHEN 'error' THEN 'calculated' ELSE 'ocr' END AS method, CASE WHEN event_id % 2 = 0 THEN event_id END AS page, CASE WHEN event_id % 5 = 0 THEN 'conflicting_candidates' ELSE 'ok' END AS status, CASE WHEN event_id % 3 = 0 THEN 'low' ELSE 'high' END AS confidence FROM events")
    return rows.select("event_id", evidence.kind(F.col("method"), F.col("page")).alias("kind"), evidence.review_reason(F.col("status"), F.col("confidence")).alias("reason"))


def chronological_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = portable(spark, sf_dir, "SELECT o_custkey AS case_id, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS period_end, concat('FY', CAST(year(o_orderdate) AS VARCHAR(4)), '-', CAST(o_orderkey AS VARCHAR(20))) AS label FROM orders")
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("case_id").orderBy(*ranking.chronological(F.col("period_end"), F.col("label")))).alias("rank"))


_SHARED = "WITH d AS (SELECT *, sha256(text) AS sha256 FROM documents)"
_FACTS = f"f AS ({FACTS})"
#: Orders as writes on customers' cases: some on an older version, some on one that isn't there yet, some that replace the whole.
WRITES = """
    SELECT o_custkey AS case_id, o_orderkey AS seq, CAST(n + CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN -2 ELSE -1 END AS BIGINT) - CAST(floor(n / 4) AS BIGINT) AS base_version, o_orderkey % 5 = 0 AS replaces, substr(o_orderpriority, 1, 1) AS key1, o_orderstatus AS key2, CAST(floor(o_totalprice) AS BIGINT) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) x
"""
CURRENT = "SELECT c_custkey AS case_id, CAST(c_custkey % 2 AS BIGINT) AS version, CAST(floor(c_acctbal) AS BIGINT) AS value FROM customer WHERE c_custkey % 3 > 0"
#: Events as what happens to users' documents.
STEPS = "SELECT user_id AS doc_id, event_id AS seq, CASE event_id % 11 WHEN 0 THEN 'delete_content' WHEN 1 THEN 'fail' WHEN 2 THEN 'recover' WHEN 3 THEN 'retry' WHEN 4 THEN 'retry' WHEN 5 THEN 'complete' WHEN 6 THEN 'finish' WHEN 7 THEN 'finish' WHEN 8 THEN 'complete' ELSE 'start' END AS action FROM events"


def versioned_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = portable(spark, sf_dir, CURRENT).select("case_id", "version", F.create_map(F.lit("first"), F.col("value")).alias("fields"))
    writes = portable(spark, sf_dir, WRITES).select("case_id", "seq", "base_version", "replaces", F.when(F.col("key1") == F.col("key2"), F.create_map("key1", "value")).otherwise(F.create_map(F.col("key1"), F.col("value"), F.col("key2"), F.col("value") + 1)).alias("fields"))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return workflow.versioned(current, writes).select("case_id", "seq", "accepted", "version", said.alias("fields"))


def document_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.replayed(portable(spark, sf_dir, STEPS))


QUERIES: dict[str, Query] = {f.__name__: f for f in (versioned_writes, document_replay, latest_version, next_version, rate_limit_window, audit_history, status_counts, case_counts, case_status, as_of_signup, review_fold, sign_off, review_merge, supersede, idempotent_upload, purge, delete_content, complete_documents, transitions, case_search, coerced_values, runs_with_documents, stale_labels, evidence_verified, labels_verified, hidden_pages, fingerprint, page_text, field_paths, path_update, evidence_kind, chronological_rank)}
ORACLE: dict[str, str] = {
    "latest_version": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1",
    "next_version": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS version FROM events",
    "rate_limit_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS n FROM events",
    "audit_history": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200",
    "status_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "case_counts": "SELECT o_custkey AS case_id, count(*) AS n_documents, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open_items, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_reports FROM orders GROUP BY o_custkey",
    "case_status": "SELECT o_custkey AS case_id, CASE WHEN o_custkey % 13 = 0 THEN 'archived' WHEN o_custkey % 7 = 0 THEN 'processing' WHEN bool_or(o_orderstatus = 'O') THEN 'awaiting_review' WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'screened' ELSE 'ready' END AS status FROM orders GROUP BY o_custkey",
    "as_of_signup": "SELECT event_id, signup_id FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup_id FROM events WHERE event_type IN ('signup', 'purchase')) t WHERE event_type = 'purchase'",
    "review_fold": f"WITH r AS ({REVIEWS}), d AS (SELECT item_id, arg_max(action, seq) FILTER (WHERE action IN ('confirm', 'correct', 'reject')) AS a, arg_max(value, seq) FILTER (WHERE action = 'correct') AS cv, arg_max(value, seq) FILTER (WHERE action = 'open') AS ov, count(*) AS n_events FROM r GROUP BY item_id) SELECT item_id, coalesce(a, 'open') AS state, CASE WHEN a = 'correct' THEN cv WHEN a = 'reject' THEN NULL ELSE ov END AS value, coalesce(a IN ('confirm', 'correct'), FALSE) AS human, n_events FROM d",
    "sign_off": f"SELECT item_id, arg_min(action, seq) AS decision, min(seq) AS at FROM ({REVIEWS}) r WHERE action <> 'open' GROUP BY item_id",
    "review_merge": f"SELECT o.case_id, o.field, CASE WHEN o.value IS NULL OR coalesce(s.human, FALSE) THEN s.value ELSE o.value END AS value, CASE WHEN o.value IS NULL THEN 'unchanged' WHEN coalesce(s.human, FALSE) THEN 'kept' ELSE 'replaced' END AS action, o.status = 'conflicting_candidates' OR (coalesce(s.human, FALSE) AND coalesce(o.value <> s.value, FALSE)) AS opens FROM ({OUTCOMES}) o LEFT JOIN ({STORED}) s ON o.case_id = s.case_id AND o.field = s.field",
    "supersede": "SELECT event_id AS item_id, CASE WHEN event_type = 'view' AND floor(value / 10) < max(floor(value / 10)) OVER (PARTITION BY user_id) THEN 'superseded' WHEN event_type = 'view' THEN 'open' ELSE 'resolved' END AS status FROM events",
    "idempotent_upload": f"{_SHARED} SELECT DISTINCT source AS case_id, sha256 FROM d WHERE NOT EXISTS (SELECT 1 FROM d h WHERE h.doc_id % 10 = 0 AND h.source = d.source AND h.sha256 = d.sha256)",
    "purge": f"{_SHARED} SELECT sha256, count(*) AS n FROM d GROUP BY sha256 HAVING bool_and(doc_id % 3 <> 0)",
    "delete_content": f"{_SHARED} SELECT doc_id FROM d WHERE doc_id % 4 = 1 AND sha256 NOT IN (SELECT sha256 FROM d WHERE doc_id % 4 <> 1)",
    "complete_documents": "SELECT user_id AS doc_id FROM events GROUP BY user_id HAVING NOT bool_or(event_type = 'error' AND value > 50)",
    "transitions": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN o_orderpriority <> '2-HIGH' WHEN 'F' THEN TRUE ELSE o_orderpriority <> '2-HIGH' END AS allowed FROM orders",
    "case_search": "SELECT p_partkey AS case_id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_partkey LIMIT 50 OFFSET 50",
    "coerced_values": "SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS as_int, CAST(NULL AS BOOLEAN) AS as_bool, CAST(NULL AS BIGINT) AS refused FROM events",
    "runs_with_documents": "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "stale_labels": "SELECT doc_id, 'old' AS sha256, source AS current FROM documents WHERE doc_id % 4 = 0",
    "evidence_verified": f"WITH {_FACTS} SELECT f.doc_id, contains(f.span, f.raw) AS in_span, f.page IN (0, 1) AS in_table, contains(regexp_replace(CASE WHEN f.doc_id % 5 = 0 THEN reverse(d.text) ELSE d.text END, '\\s+', '', 'g'), regexp_replace(f.raw, '\\s+', '', 'g')) AS on_page FROM f JOIN documents d ON f.doc_id = d.doc_id",
    "labels_verified": f"WITH {_FACTS} SELECT doc_id, page IN (0, 1) AS found FROM f",
    "hidden_pages": "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderkey % 5 IN (c_custkey % 5, (c_custkey + 1) % 5) AND o_orderkey % 5 + 1 IN (c_custkey % 5, (c_custkey + 1) % 5))",
    "fingerprint": """SELECT c_custkey, sha256('{"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}') AS sha256 FROM customer""",
    "page_text": "SELECT conv_id AS doc_id, md5(string_agg('[PDF_PAGE_' || turn || ']' || chr(10) || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id",
    "field_paths": "SELECT s_suppkey AS case_id, path, CAST(NULL AS VARCHAR) AS year, path AS field FROM supplier, (VALUES ('promoter.lock_in_months'), ('issue_details.issue_size')) p(path) UNION ALL SELECT case_id, 'financials.fiscal_years[' || y || '].' || f, y, f FROM (SELECT DISTINCT l_suppkey AS case_id, 'FY' || year(l_shipdate) AS y FROM lineitem) t, (VALUES ('net_worth'), ('revenue')) p(f)",
    "path_update": "WITH f AS (SELECT o_custkey AS case_id, o_orderpriority AS path, MAX(o_totalprice) AS value FROM orders GROUP BY ALL), c AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE 'new.path' END AS path, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS new, TRUE AS touched FROM customer) SELECT coalesce(f.case_id, c.case_id) AS case_id, coalesce(f.path, c.path) AS path, CASE WHEN touched THEN new ELSE value END AS value FROM f FULL JOIN c ON f.case_id = c.case_id AND f.path = c.path WHERE NOT (value IS NULL AND new IS NULL)",
    "evidence_kind": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'human' WHEN event_type = 'error' THEN 'calculated' WHEN event_id % 2 = 0 THEN 'document' ELSE 'declared' END AS kind, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 'candidates conflict; low confidence' WHEN event_id % 5 = 0 THEN 'candidates conflict' WHEN event_id % 3 = 0 THEN 'low confidence' END AS reason FROM events",
    "chronological_rank": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN make_date(year(o_orderdate), 3, 31) ELSE CAST(o_orderdate AS DATE) END, 'FY' || year(o_orderdate) || '-' || o_orderkey) AS INT) AS rank FROM orders",
}

ORACLE["versioned_writes"] = f"""
    WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS n FROM ({WRITES}) x),
    r AS (SELECT DISTINCT w.case_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, FALSE AS accepted, coalesce(c.version, 0) AS version, CASE WHEN c.case_id IS NULL THEN CAST([] AS STRUCT(k VARCHAR, v BIGINT)[]) ELSE [{{'k': 'first', 'v': c.value}}] END AS fields FROM w LEFT JOIN ({CURRENT}) c ON c.case_id = w.case_id
        UNION ALL SELECT w.case_id, w.n, w.seq, w.base_version = r.version, CASE WHEN w.base_version = r.version THEN r.version + 1 ELSE r.version END,
            CASE WHEN w.base_version <> r.version THEN r.fields ELSE list_concat(CASE WHEN w.replaces THEN CAST([] AS STRUCT(k VARCHAR, v BIGINT)[]) ELSE list_filter(r.fields, lambda f: f.k NOT IN (w.key1, w.key2)) END, [{{'k': w.key1, 'v': w.value}}], CASE WHEN w.key1 = w.key2 THEN CAST([] AS STRUCT(k VARCHAR, v BIGINT)[]) ELSE [{{'k': w.key2, 'v': w.value + 1}}] END) END
        FROM r JOIN w ON w.case_id = r.case_id AND w.n = r.n + 1)
    SELECT case_id, seq, accepted, version, array_to_string(list_transform(list_sort(fields), lambda f: f.k || '=' || f.v), ',') AS fields FROM r WHERE n > 0
"""
_BUSY = "r.state IN ('uploaded', 'extracting')"
ORACLE["document_replay"] = f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM ({STEPS}) x),
    r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, 'uploaded' AS state, TRUE AS held, CAST(0 AS BIGINT) AS n_retries, CAST(0 AS BIGINT) AS n_recovered, CAST(0 AS BIGINT) AS n_refused FROM e
        UNION ALL SELECT e.doc_id, e.n, CASE WHEN action = 'start' AND r.state = 'uploaded' THEN 'extracting' WHEN action = 'finish' AND r.state = 'extracting' THEN 'extracted' WHEN action = 'complete' AND r.state = 'extracted' THEN 'complete' WHEN action IN ('fail', 'recover') AND {_BUSY} THEN 'failed'
                WHEN action = 'retry' AND NOT {_BUSY} AND r.held THEN 'uploaded' ELSE r.state END,
            r.held AND NOT (action = 'delete_content' AND NOT {_BUSY}), r.n_retries + CASE WHEN action = 'retry' AND NOT {_BUSY} AND r.held THEN 1 ELSE 0 END, r.n_recovered + CASE WHEN action = 'recover' AND {_BUSY} THEN 1 ELSE 0 END,
            r.n_refused + CASE WHEN (action = 'start' AND r.state <> 'uploaded') OR (action = 'finish' AND r.state <> 'extracting') OR (action = 'complete' AND r.state <> 'extracted') OR (action = 'fail' AND NOT {_BUSY}) OR (action = 'retry' AND ({_BUSY} OR NOT r.held)) OR (action = 'delete_content' AND {_BUSY}) THEN 1 ELSE 0 END
        FROM r JOIN e ON e.doc_id = r.doc_id AND e.n = r.n + 1)
    SELECT doc_id, state, held, n_retries, n_recovered, n_refused FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS last FROM r) t WHERE last = 1
"""
