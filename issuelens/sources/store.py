"""A store of files that Spark jobs write and read: put, get, exists and delete, each job seen whole or not at all.

    <path>/jobs/<time>-<job>/<part>/<name or hash>      contents
    <path>/jobs/<time>-<job>/<part>/entries.jsonl       name, sha256, size, deleted
    <path>/staging/<job>/<part>/...                     what a job that hasn't ended has written

Every task writes a folder of its own under staging. When all have ended, the driver drops folders of attempts that failed
or came twice and moves the job's folder in one step; a job that fails is removed. Nobody lists contents on the driver: it
hears one name from each task. Paths are those of any file system that pyarrow knows, and have to be shared by all machines.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ENTRY = "name string, sha256 string, size long, deleted boolean"
SAFE = re.compile(r"[\w][\w.() \[\]-]{0,149}")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else fs.FileSystem.from_uri(f"file://{path}") if not path.startswith("file:") else fs.FileSystem.from_uri(path.replace("file:", "file://", 1))


@dataclass
class Part(WriterCommitMessage):
    folder: str
    files: int


class StoreWriter(DataSourceWriter):
    """Rows of name, content (binary; null deletes the name). by_name keeps names of files, else contents lie under their hash."""

    def __init__(self, path: str, by_name: bool):
        self.path, self.by_name, self.job = path.rstrip("/"), by_name, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Part:
        store, root = _opened(self.path)
        part = uuid.uuid4().hex
        at, entries, held = f"{root}/staging/{self.job}/{part}", [], set()
        store.create_dir(at)
        try:
            for row in iterator:
                if row.name is None or not SAFE.fullmatch(row.name):
                    raise ValueError(f"no name for a file: {row.name!r}")
                digest = hashlib.sha256(row.content).hexdigest() if row.content is not None else None
                file = row.name if self.by_name else digest
                if digest is not None and file not in held:
                    with store.open_output_stream(f"{at}/{file}") as out:
                        out.write(bytes(row.content))
                    held.add(file)
                entries.append(json.dumps({"name": row.name, "sha256": digest, "size": None if digest is None else len(row.content), "deleted": digest is None}))
            with store.open_output_stream(f"{at}/entries.jsonl") as out:
                out.write("".join(f"{e}\n" for e in entries).encode())
        except BaseException:
            store.delete_dir(at)
            raise
        return Part(part, len(held))

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _opened(self.path)
        staged, good = f"{root}/staging/{self.job}", {m.folder for m in messages if m is not None}
        for found in store.get_file_info(fs.FileSelector(staged, allow_not_found=True)):
            if found.base_name not in good:
                store.delete_dir(found.path)
        if good:
            store.create_dir(f"{root}/jobs")
            store.move(staged, f"{root}/jobs/{time.time_ns():020d}-{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _opened(self.path)
        if store.get_file_info(f"{root}/staging/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/staging/{self.job}")


class Store(DataSource):
    @classmethod
    def name(cls) -> str:
        return "issuelens_store"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], self.options.get("by_name", "false") == "true")


def _write(rows: DataFrame, path: str, by_name: bool) -> None:
    rows.sparkSession.dataSource.register(Store)
    rows.write.format("issuelens_store").mode("append").option("path", path).option("by_name", str(by_name).lower()).save()


def put(files: DataFrame, path: str, by_name: bool = False) -> None:
    """Adds files (name, content binary) as one job; a name that is there gets the new content. Equal contents (or names) meet in a task, which keeps them once; a small table of many files goes to all tasks."""
    rows = files.select("name", "content")
    # As many parts as there are cores, whatever their bytes: a small file costs its creation.
    _write(rows.repartition(files.sparkSession.sparkContext.defaultParallelism, "name") if by_name else rows.repartition(F.sha2("content", 256)), path, by_name)


def delete(names: DataFrame, path: str) -> None:
    """Takes names (name) out as one job; those that aren't there don't matter."""
    _write(names.select("name", F.lit(None).cast("binary").alias("content")), path, False)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256, size, place of what the store holds: the last job that names a file wins, and within a job the greatest hash."""
    read = spark.read.schema(ENTRY).option("pathGlobFilter", "entries.jsonl").option("recursiveFileLookup", True).json(f"{path.rstrip('/')}/jobs")
    told = read.withColumns({"folder": F.regexp_extract(F.col("_metadata.file_path"), r"/jobs/([^/]+/[^/]+)/[^/]*$", 1), "job": F.regexp_extract(F.col("_metadata.file_path"), r"/jobs/([^/]+)/", 1)})
    last = told.groupBy("name").agg(F.max_by(F.struct("sha256", "size", "deleted", "folder"), F.struct("job", F.coalesce("sha256", F.lit("")))).alias("m")).where("not m.deleted")
    return last.select("name", "m.sha256", "m.size", F.concat_ws("/", F.lit("jobs"), "m.folder").alias("place"))


def exists(names: DataFrame, path: str) -> DataFrame:
    """names with held: does the store hold it?"""
    held = entries(names.sparkSession, path).select("name", F.lit(True).alias("held"))
    return names.join(held, "name", "left").withColumn("held", F.coalesce("held", F.lit(False)))


def get(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """name, sha256, content of all files of a store that keeps contents by hash, or of those named; read in tasks."""
    found = entries(spark, path)
    found = found if names is None else found.join(names.select("name").distinct(), "name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        for batch in batches:
            for name, digest, place in zip(*(batch.column(c).to_pylist() for c in ("name", "sha256", "place")), strict=True):
                with store.open_input_stream(f"{root.rstrip('/')}/{place}/{digest}") as f:
                    yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [digest], "content": pa.array([f.read()], pa.binary())})

    return found.select("name", "sha256", "place").mapInArrow(read, "name string, sha256 string, content binary")


def clear_staging(path: str) -> None:
    """Removes what jobs have left that were killed with their driver."""
    store, root = _opened(path)
    if store.get_file_info(f"{root}/staging").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/staging")


def _folders(spark: SparkSession, path: str) -> list[str]:
    """path and the folders under it, level by level; each is listed in a task, and the driver hears of folders alone."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = store.get_file_info(fs.FileSelector(folder))
                yield pa.RecordBatch.from_pydict({"folder": pa.array([f.path for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "._"], pa.string())})

    level = held = [_opened(path)[1]]
    while level:
        below = spark.createDataFrame([(f,) for f in level], "folder string").repartition(min(len(level), 200)).mapInArrow(within, "folder string")
        level = sorted(r.folder for r in below.collect())
        held = held + level
    return held


def _files(spark: SparkSession, path: str, ending: str, but: str = "") -> DataFrame:
    """file_name, content (binary) of the files under a folder that end so, hidden ones and those that end in but left out.

    Folders are listed and files read in tasks, hundreds of files a batch: a split for each few files, as file sources
    plan them, costs more than small files do.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(path)
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                found = (f for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File)
                yield pa.RecordBatch.from_pydict({"place": pa.array([f.path for f in found if f.base_name.endswith(ending) and f.base_name[0] not in "._" and not (but and f.base_name.endswith(but))], pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(path)
        for batch in batches:
            places = batch.column("place").to_pylist()
            for k in range(0, len(places), 256):
                contents = []
                for place in places[k : k + 256]:
                    with store.open_input_stream(place) as f:
                        contents.append(f.read())
                yield pa.RecordBatch.from_pydict({"file_name": [p.rsplit("/", 1)[-1] for p in places[k : k + 256]], "content": pa.array(contents, pa.binary())})

    held = _folders(spark, path)
    folders = spark.createDataFrame([(f,) for f in held], "folder string").repartition(min(len(held), 200))
    return folders.mapInArrow(names, "place string").repartition(4 * spark.sparkContext.defaultParallelism, "place").mapInArrow(read, "file_name string, content binary")


def rule_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file_name and the fields of schema of each TOML file under a folder, one rule a file; read and parsed in tasks. A file that is no TOML fails the read, with its name."""
    fields = spark.createDataFrame([], schema).schema
    wanted = {f.name for f in fields}

    def parse(batches):
        import tomllib

        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"], strict=True):
                try:
                    rule = tomllib.loads(bytes(content).decode())
                except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_pydict({"file_name": [name.rsplit("/", 1)[-1]], "json": [json.dumps({k: v for k, v in rule.items() if k in wanted}, default=str)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parse({c: b.column(c).to_pylist() for c in ("file_name", "content")} for b in batches)

    return _files(spark, path, ".toml").mapInArrow(run, "file_name string, json string").select("file_name", F.from_json("json", fields).alias("r")).select("file_name", "r.*")


def label_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file_name and the fields of schema of each JSON label file under a folder, in UTF-8, drafts left out; of files with one doc_id the last by name counts."""
    rows = F.explode_outer(F.from_json(F.col("content").cast("string"), f"array<struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in spark.createDataFrame([], schema).schema)}>>"))
    final = _files(spark, path, ".json", ".draft.json").select("file_name", rows.alias("r")).select("r.*", "file_name")
    rest = [c for c in final.columns if c != "doc_id"]
    return final.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "file_name").alias("m")).select("doc_id", *[f"m.{c}" for c in rest])
