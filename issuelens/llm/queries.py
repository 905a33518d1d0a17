"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, anomaly, jaccard, licenses, lm, mixing, near, packing, quality, repeats, secrets, topk, whiten
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.transform("licenses.found", lambda x: x["license"]), ",")
    return found.select("doc_id", "licenses.license", "licenses.coverage", names.alias("licenses"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = found.withColumn("said", secrets.digest(F.col("secrets.spans")))
    return said.select("doc_id", "secrets.n_assign", "secrets.n_access", "secrets.n_hex", "secrets.n_model", "said.base_sha256", "said.spans")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def _quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold() != 1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), _quality_labels(spark, sf_dir).where(fold() != 0))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable() & F.col("vec_id").isNotNull())
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), topk.whole().alias("terms"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = anomaly.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), _quality_labels(spark, sf_dir))
    return judged.select("doc_id", *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable()).select(F.col("vec_id").cast("long").alias("vec_id"), whiten.whole().alias("x"))
    fitted = whiten.fit(rows.select("x"))
    explained = [float(e * e / fitted.trace) for e in fitted.deviations] if fitted else []
    out = whiten.whitened(rows, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at")).alias("explained"), F.lit(fitted.identity_error if fitted else 0.0).alias("identity_error"),
    )


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_mixing": op4_mixing,
    "op5_repeats": op5_repeats,
    "op6_lm_score": op6_lm_score,
    "op7_quality": op7_quality,
    "op8_exact_topk": op8_exact_topk,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_ngram_join": op11_ngram_join,
    "op12_whitening": op12_whitening,
    "op13_token_align": op13_token_align,
}


def _linked_sql(shingle: int, percent: int, more: str = "") -> str:
    """Documents linked by the similarity of their word-shingle sets, by an inverted list of shingles; groups by closure."""
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower_ascii, '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS words
            FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {shingle} THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - {shingle - 2}), lambda i: array_to_string(words[i : i + {shingle - 1}], ' ')) END) AS s FROM w
        ), tokens AS (SELECT doc_id, hash(unnest(s)) AS t FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
        same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sets WHERE len(s) > 0),
        rare AS (SELECT t.* FROM tokens t JOIN same s ON t.doc_id = s.doc_id AND s.rep = s.doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM rare a JOIN rare b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)
            UNION ALL SELECT rep, doc_id FROM same WHERE rep <> doc_id
        ), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a AS node, b AS other FROM ways UNION SELECT r.node, w.b FROM reach r JOIN ways w ON w.a = r.other),
        lowest AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
        SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, CAST(least(s.doc_id, coalesce(m, s.doc_id)) AS BIGINT) AS component_id{more}
        FROM sizes s LEFT JOIN lowest ON node = s.doc_id
    """


ORACLE: dict[str, str] = {
    "op9_near_dedup": _linked_sql(5, 75, ", least(s.doc_id, coalesce(m, s.doc_id)) = s.doc_id AS kept"),
    "op11_ngram_join": _linked_sql(3, 90),
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, q.row AS query_row, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.row <> q.row
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
