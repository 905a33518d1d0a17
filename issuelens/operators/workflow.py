"""Cases, documents and reviews as folds over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a document and those that may follow.
TRANSITIONS = {
    "uploaded": ["extracting", "failed", "deleted"], "extracting": ["extracted", "failed"], "extracted": ["complete", "extracting", "deleted"],
    "failed": ["extracting", "deleted"], "complete": ["extracting", "deleted"], "deleted": [],
}


def numbered(versions: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """version: 1, 2, ... in the order given, for each key."""
    return versions.withColumn("version", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(rows: DataFrame, keys: tuple[str, ...], order: list[str]) -> DataFrame:
    """The last row of each key. One aggregate that combines on the map side, so a hot key costs nothing."""
    rest = [x for x in rows.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("last")).select(*keys, *[F.col(f"last.{x}") for x in rest])


def appended(current: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """New rows whose key isn't there yet, once each: idempotent uploads, and reports that are never overwritten."""
    return new.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")


def logged(log: DataFrame, entries: DataFrame, key: str, order: list[str]) -> DataFrame:
    """entries as they go behind a log: numbered within each key from where the log ends; nothing that is there changes (M09). log: key, seq."""
    last = log.groupBy(key).agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return entries.withColumn("place", place).join(last, key, "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("place")).drop("place", "last")


def rejected(new: DataFrame, current: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose id is taken, by a row that is there already or by an earlier new one: refused, not silently dropped."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    known = current.select(key, F.lit(True).alias("known")).distinct()
    return new.withColumn("place", place).join(known, key, "left").where("place > 1 or known").drop("place", "known")


def merged(outcomes: DataFrame, current: DataFrame) -> DataFrame:
    """What an extraction does to stored values: kept, replaced or unchanged, and whether a review item opens.

    outcomes: case_id, field, value, status; current: case_id, field, value, human. A person's value is never overwritten; it opens an item if the reading differs.
    """
    c = current.select("case_id", "field", F.col("value").alias("stored"), F.col("human").alias("human"))
    human = F.coalesce(F.col("human"), F.lit(False))
    differs = F.col("value").cast("string") != F.col("stored").cast("string")
    weak = F.coalesce(F.col("status").isin("extracted_needs_verification", "conflicting_candidates"), F.lit(False))
    action = F.when(F.col("value").isNull(), "unchanged").when(human, "kept").otherwise("replaced")
    opens = weak | (human & F.coalesce(differs, F.lit(False)))
    final = F.when((action == "replaced"), F.col("value")).otherwise(F.col("stored"))
    return outcomes.join(c, ["case_id", "field"], "left").select("case_id", "field", final.alias("value"), action.alias("action"), opens.alias("opens"))


def superseded(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Open items of older extraction runs become superseded. items: item_id, doc_id, run_id, status; runs: doc_id, run_id."""
    newest = runs.groupBy("doc_id").agg(F.max("run_id").alias("newest"))
    old = (F.col("status") == "open") & (F.col("run_id") < F.col("newest"))
    return items.join(newest, "doc_id", "left").withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).drop("newest")


def review_state(events: DataFrame) -> DataFrame:
    """item_id, state, value, human, n_events from events item_id, seq, action, value: confirm keeps the value, correct replaces it, reject clears it; asking for evidence leaves the item open."""
    closing = F.col("action").isin("confirm", "correct", "reject")
    decided = F.max_by(F.when(closing, F.struct("action", "value")), F.when(closing, F.col("seq")))
    opened = F.max_by(F.when(F.col("action") == "open", F.col("value")), F.when(F.col("action") == "open", F.col("seq")))
    folded = events.groupBy("item_id").agg(decided.alias("d"), opened.alias("first"), F.count("*").alias("n_events"))
    value = F.when(F.col("d.action") == "correct", F.col("d.value")).when(F.col("d.action") == "reject", None).otherwise(F.col("first"))
    return folded.select("item_id", F.coalesce(F.col("d.action"), F.lit("open")).alias("state"), value.alias("value"), F.coalesce(F.col("d.action").isin("confirm", "correct"), F.lit(False)).alias("human"), "n_events")


def sign_off(events: DataFrame) -> DataFrame:
    """The first decision of each review."""
    return events.where("action <> 'open'").groupBy("item_id").agg(F.min_by("action", "seq").alias("decision"), F.min("seq").alias("at"))


def case_status(archived: Column, busy: Column, open_items: Column, screened: Column) -> Column:
    return F.when(archived, "archived").when(busy > 0, "processing").when(open_items > 0, "awaiting_review").when(screened, "screened").otherwise("ready")


def purgeable(documents: DataFrame) -> DataFrame:
    """Contents (sha256) all of whose documents have expired."""
    return documents.groupBy("sha256").agg(F.bool_and("expired").alias("all"), F.count("*").alias("n")).where("all").select("sha256", "n")


def only_copy(documents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deleted documents whose content no other document shares. documents: doc_id, sha256."""
    others = documents.join(deleted.select("doc_id"), "doc_id", "left_anti").select("sha256").distinct()
    return deleted.join(others, "sha256", "left_anti")


def complete(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without an open item."""
    return documents.join(items.where("status = 'open'").select("doc_id"), "doc_id", "left_anti")


def grouped_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def may_follow(old: Column, new: Column) -> Column:
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(allowed, old), new), F.lit(False))


def found(cases: DataFrame, text: str, column: str = "name", page: int = 0, size: int = 20, order: str = "case_id") -> DataFrame:
    """Rows whose column holds text, whatever its case; % and _ are plain characters."""
    return cases.where(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(order).offset(page * size).limit(size)


def coerced(value: Column, kind: str) -> Column:
    """What a user typed as bool, int or decimal; null if it isn't that."""
    if kind == "bool":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    strict = value.rlike(r"^[+-]?\d+$") if kind == "int" else value.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$")
    return F.when(strict, value.try_cast("bigint" if kind == "int" else "decimal(20,6)"))


def hits_in_window(events: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """n: events of the key in the window that ends with each event."""
    span = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-(seconds - 1), 0)
    return events.withColumn("n", F.count("*").over(span))


def versioned(current: DataFrame, writes: DataFrame) -> DataFrame:
    """case_id, seq, accepted, version, fields: what becomes of writes, in order of seq (M01). current: case_id, version, fields (map); writes: case_id, seq, base_version, replaces, fields.

    A write is made on a version; if that is the latest when its turn comes it is accepted as the next version, else it is
    refused and changes nothing: of two writers on one version the first wins. It sets the fields that it names, or
    replaces the whole snapshot. A case that isn't there is at version 0 with nothing. version and fields are those that
    hold after the write. The writes of a case since the last run are folded as one array.
    """
    kind = dict(writes.dtypes)["fields"]
    in_order = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    gathered = writes.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", "base_version", "replaces", "fields")), in_order).alias("w"))
    met = gathered.join(current.select("case_id", F.col("version").alias("v0"), F.col("fields").alias("f0")), "case_id", "left")
    start = F.struct(F.coalesce("v0", F.lit(0)).cast("long").alias("version"), F.coalesce("f0", F.create_map().cast(kind)).alias("fields"), F.array().cast(f"array<struct<seq:{dict(writes.dtypes)['seq']},accepted:boolean,version:bigint,fields:{kind}>>").alias("out"))

    def step(state: Column, w: Column) -> Column:
        ok = F.coalesce(w["base_version"] == state["version"], F.lit(False))
        version = F.when(ok, state["version"] + 1).otherwise(state["version"])
        others = F.map_filter(state["fields"], lambda k, _: ~F.map_contains_key(w["fields"], k))
        fields = F.when(ok & w["replaces"], w["fields"]).when(ok, F.map_concat(others, w["fields"])).otherwise(state["fields"])
        return F.struct(version.alias("version"), fields.alias("fields"), F.concat(state["out"], F.array(F.struct(w["seq"].alias("seq"), ok.alias("accepted"), version.alias("version"), fields.alias("fields")))).alias("out"))

    return met.select("case_id", F.explode(F.aggregate("w", start, step, lambda s: s["out"])).alias("x")).select("case_id", "x.*")


#: What may happen to a document: from which states, and the state that follows.
STEPS = {
    "start": (("uploaded",), "extracting"), "finish": (("extracting",), "extracted"), "complete": (("extracted",), "complete"), "fail": (("uploaded", "extracting"), "failed"),
    "retry": (("extracted", "complete", "failed"), "uploaded"), "recover": (("uploaded", "extracting"), "failed"),
}


def replayed(events: DataFrame) -> DataFrame:
    """doc_id, state, held, n_retries, n_recovered, n_refused after a document's events in order of seq (M06). events: doc_id, seq, action.

    A document begins as uploaded, its content held. A step that its state doesn't allow is refused; "recover", which comes
    for all documents after a crash, takes up only those that were being worked on, and is never refused. "delete_content"
    is refused while a document is being worked on; a retry needs the content.
    """
    gathered = events.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("e"))
    start = F.struct(F.lit("uploaded").alias("state"), F.lit(True).alias("held"), *[F.lit(0).cast("long").alias(n) for n in ("n_retries", "n_recovered", "n_refused")])

    def step(s: Column, e: Column) -> Column:
        action, busy = e["action"], s["state"].isin("uploaded", "extracting")
        may = lambda name: (action == name) & s["state"].isin(*STEPS[name][0]) & (s["held"] if name == "retry" else F.lit(True))
        state = F.coalesce(*[F.when(may(name), F.lit(to)) for name, (_, to) in STEPS.items()], s["state"])
        deleted = (action == "delete_content") & ~busy
        done = F.greatest(*[may(name) for name in STEPS]) | deleted | (action == "recover")
        more = lambda name, when: (s[name] + when.cast("long")).alias(name)
        return F.struct(state.alias("state"), (s["held"] & ~deleted).alias("held"), more("n_retries", may("retry")), more("n_recovered", may("recover")), more("n_refused", ~done))

    return gathered.select("doc_id", F.aggregate("e", start, step).alias("s")).select("doc_id", "s.*")
