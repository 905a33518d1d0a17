"""Document files and the records about them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "doc_id string, url string, issuer string, doc_type string, platform string, filing_date date, sha256 string, size_bytes bigint, fetched_at timestamp, local_path string, content_type string"


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def validated(files: DataFrame, max_bytes: int = 100 << 20, content: str = "content", name: str = "path") -> DataFrame:
    """files with sha256, reason (null: accepted) and warnings, judged on bytes alone; the structure of a file is for a decoder to judge."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    whole = F.decode(F.col(content), "ISO-8859-1")
    size = F.octet_length(content)
    reason = F.when(size == 0, "empty").when(size > max_bytes, "too_large").when(~F.contains(head, F.lit("%PDF-")), "not_a_pdf").when(F.contains(whole, F.lit("/Encrypt")), "encrypted")
    warnings = F.array_compact(F.array(F.when(whole.rlike(r"/(?:JavaScript|JS)\b"), F.lit("javascript")), F.when(F.contains(whole, F.lit("/EmbeddedFile")), F.lit("attachment"))))
    return files.select("*", F.sha2(F.col(content), 256).alias("sha256"), safe_name(F.col(name)).alias("safe_name"), reason.alias("reason"), warnings.alias("warnings"))


def safe_name(name: Column, most: int = 150) -> Column:
    """The last part of a path in its compatibility form (NFKC), letters and digits of any script and plain marks only, most characters at the most."""
    last = F.pandas_udf(_composed, "string")(F.regexp_extract(name, r"([^/\\]*)$", 1))
    return F.left(F.trim(F.regexp_replace(last, r"(?U)[^\w.()\[\] \-]", "_")), F.lit(most))


def _composed(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKC")


def stored(files: DataFrame) -> DataFrame:
    """One row for each content: where it lies in a store addressed by hash."""
    return files.dropDuplicates(["sha256"]).select("sha256", F.concat_ws("/", F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), F.col("sha256")).alias("place"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an append-only JSON-lines manifest, each with its place: file, and number of the line in it.

    A manifest file is read whole by one task and its lines numbered, so that the order doesn't depend on how files are split.
    """
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "json"))
    read = whole.where(F.trim("json") != "").select(F.from_json("json", MANIFEST).alias("entry"), F.struct("file", "line").alias("seq"))
    return read.select("entry.*", "seq")


def last_entries(entries: DataFrame, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The last entry of each document wins."""
    rest = [c for c in entries.columns if c not in (key, seq)]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("m")).select(key, *[F.col(f"m.{c}") for c in rest])


def to_fetch(catalogue: DataFrame, held: DataFrame) -> DataFrame:
    """Sources that aren't held under the same address and hash."""
    return catalogue.join(held.select("doc_id", "url", "sha256"), ["doc_id", "url", "sha256"], "left_anti")


def repeated_ids(catalogue: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that a catalogue gives more than once; it is refused unless this is empty."""
    return catalogue.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def toml_rows(spark: SparkSession, texts: list[str], schema: str) -> DataFrame:
    """A row for each text of a small catalogue of TOML files (one rule each)."""
    import tomllib

    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return spark.createDataFrame([tuple(t.get(n) for n in names) for t in map(tomllib.loads, texts)], schema)


def unknown_sources(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """source_ids that rules cite and the register lacks; a ruleset is refused unless this is empty. rules: rule_id, source_ids."""
    cited = rules.select("rule_id", F.explode("source_ids").alias("source_id"))
    return cited.join(sources.select("source_id"), "source_id", "left_anti")


def executable(rulesets: DataFrame) -> DataFrame:
    """Rulesets by version, newest first, without superseded ones."""
    return rulesets.where("status <> 'superseded'").orderBy(F.transform(F.split("version", r"\."), lambda x: x.cast("int")).desc())


def label_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Label files of a folder, drafts left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    return rows.where(~F.col("file_name").endswith(".draft.json"))


def stale(wanted: DataFrame, cached: DataFrame, version: int) -> DataFrame:
    """Documents to parse again: no cache of this hash by this version."""
    return wanted.join(cached.where(F.col("version") == version).select("sha256"), "sha256", "left_anti")
