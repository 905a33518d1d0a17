"""Near-duplicate groups: MinHash, odd sketches and a check of full shingle sets.

1. Every text gives its distinct 5-word shingles (64-bit hashes), SAMPLES MinHash values, BANDS band keys of ROWS values
   each, and an odd sketch: the MinHash values folded into a bitmap of BITS parities.
2. Texts of equal shingle sets form a class; only its least document goes on, so copies never meet in a bucket.
3. Inside each bucket of a band key, sketches are compared by the population count of their XOR, which estimates the
   similarity; pairs that may reach the limit (LOOSE leaves five standard deviations) are joined into families by a
   spanning forest. Buckets over CHUNK members are dealt out in parts of about CHUNK, and each pair of parts is compared in
   a task of its own: no pair of a bucket is left out, and no task holds more than two parts.
4. The shingle sets of a family come together once, and exact similarities decide the links. Families over BLOCK members
   are compared block by block, each pair of blocks in a task of its own.
5. Components of the links give the groups.

A pair at the limit of 0.75 shares no band key with probability (1 - 0.75^4)^32 = 5e-6.

Defined cases: null and empty texts have no shingle and link with nothing; 1 to 4 words are one shingle; a document
without doc_id links with nothing, has no component_id and is kept; rows that repeat a doc_id are one document, and where
their texts differ, the links of any of them are the document's; very long texts are read whole; an empty table gives an
empty result; columns beside doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, give_back, mix64, runs, windows
from .common import small_batches, text_bytes, written
from .graph import components

SHINGLE, BANDS, ROWS, BITS = 5, 32, 4, 512
SAMPLES = BANDS * ROWS
CHUNK, BLOCK = 4096, 2048
#: Bytes of text worked on at once, in 4096 texts at most.
PIECE = 1 << 20
LOOSE = 0.55
PERCENT = 75
_rng = np.random.default_rng(20240611)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_ODD = (_rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and how many each has, text after text. At most 4096 texts."""
    hashes, text = windows(w := Words(texts), SHINGLE, whole_if_short=True)
    order = np.argsort((text.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12)))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=w.n)


def sketches(texts: list[bytes]) -> pd.DataFrame:
    """n_shingles, c1 and c2 (a hash of the set), bands, odd for each text."""
    hashes, sizes = shingles(texts)
    n = len(texts)
    full = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
    out = {k: np.zeros(n, np.int64) for k in ("c1", "c2")}
    bands, odd = np.zeros((n, BANDS), np.int64), np.zeros((n, BITS // 8), np.uint8)
    if len(full):
        with np.errstate(over="ignore"):
            out["c1"][full] = np.add.reduceat(mix64(hashes), starts).astype(np.int64)
            out["c2"][full] = np.add.reduceat(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts).astype(np.int64)
            x, values = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((len(full), SAMPLES), np.uint32)
            for j in range(SAMPLES):
                values[:, j] = np.minimum.reduceat((x ^ _XOR[j]) * _ODD[j], starts)
            key = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                key = mix64(key + values[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
            bands[full] = mix64(key + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
            bit = mix64(values.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
        flat = np.bincount((np.arange(len(full))[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=len(full) * BITS)
        odd[full] = np.packbits((flat.reshape(len(full), BITS) & 1).astype(np.uint8), axis=1)
    return pd.DataFrame({"n_shingles": sizes.astype(np.int64), **out, "bands": list(bands), "odd": [x.tobytes() for x in odd]})


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
        for a, b in runs([min(len(t), PIECE) + PIECE // 4096 for t in texts], PIECE):
            yield sketches(texts[a:b]).assign(doc_id=ids[a:b])
        give_back()


def similarity(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimates from odd sketches (rows of 64-bit words)."""
    differ = np.bitwise_count(left ^ right).sum(-1, dtype=np.int64)
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * differ / BITS, 1e-9))


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by keys, several groups in each frame."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(rows) - int(last[::-1].argmin() if not last.all() else len(last))
        if cut:
            yield rows.iloc[:cut]
        rest = rows.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def _edges_of(rows: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    k = rows[keys].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = (k[1:] != k[:-1]).any(axis=1)
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(rows)))


def _forest(near: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, the parent of each row in a breadth-first forest; roots are their own."""
    parent = np.full(len(near), -1)
    for root in range(len(near)):
        if parent[root] < 0:
            parent[root] = root
            todo = [root]
            while todo:
                at = todo.pop()
                fresh = np.flatnonzero(near[at] & (parent < 0))
                parent[fresh] = at
                todo += fresh.tolist()
    return parent


def _across(near: np.ndarray) -> np.ndarray:
    """The same of links between rows and columns, which are numbered after the rows."""
    n, parent = len(near), np.full(sum(near.shape), -1)
    for root in range(n):
        if parent[root] < 0:
            parent[root] = root
            todo = [root]
            while todo:
                at = todo.pop()
                fresh = np.flatnonzero(near[at] & (parent[n:] < 0)) + n if at < n else np.flatnonzero(near[:, at - n] & (parent[:n] < 0))
                parent[fresh] = at
                todo += fresh.tolist()
    return np.where(parent < 0, np.arange(len(parent)), parent)


def _near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of left may reach the limit with which of right."""
    near = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(left), 256):
        near[i : i + 256] = similarity(left[i : i + 256, None], right[None]) >= LOOSE
    return near


def _families(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of key, i, j, own, rep, odd sorted by all but the last: edges a-b of a forest over part i of a bucket, or between parts i and j."""
    for rows in _grouped(batches, ["key", "i", "j"]):
        ids, own = rows["rep"].to_numpy(), rows["own"].to_numpy()
        odd = np.frombuffer(b"".join(rows["odd"]), np.uint64).reshape(len(rows), -1)
        start, size = _edges_of(rows, ["key", "i", "j"])
        two = start[size == 2]
        hit = two[similarity(odd[two], odd[two + 1]) >= LOOSE]
        out = [np.stack([ids[hit], ids[hit + 1]], 1)]
        for s, m in zip(start[size > 2], size[size > 2]):
            n = int((own[s : s + m] == own[s]).sum())
            part, other = odd[s : s + n], odd[s + n : s + m]
            parent = (_across(_near(part, other)) if n < m else _forest(_near(part, part))) + s
            moved = np.flatnonzero(parent != np.arange(s, s + m))
            out.append(np.stack([ids[parent[moved]], ids[s + moved]], 1))
        found = np.concatenate(out)
        yield pd.DataFrame(found, columns=["a", "b"])


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for a, b in runs([min(len(t), PIECE) + PIECE // 4096 for t in texts], PIECE):
            hashes, sizes = shingles(texts[a:b])
            yield batch.iloc[a:b].drop(columns="text").assign(shingles=np.split(hashes.astype(np.int64), np.cumsum(sizes)[:-1]))
        give_back()


def links(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, the first of the group that exact similarities join it with."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, inverse = np.unique(every, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    posted, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(inverse))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(m - 1):
        mine = inverse[at[i] : at[i + 1]]
        begin, count = first[mine], first[mine + 1] - first[mine]
        spread = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        shared = np.bincount(posted[spread], minlength=m)
        union = sizes + sizes[i] - shared
        for j in np.flatnonzero((100 * shared >= PERCENT * union) & (np.arange(m) > i)):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(m)])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of family, i, j, rep, shingles sorted by the first three: edges of stars that exact similarities confirm."""
    for rows in _grouped(batches, ["family", "i", "j"]):
        start, size = _edges_of(rows, ["family", "i", "j"])
        ids, sets, out = rows["rep"].to_numpy(), rows["shingles"].tolist(), []
        for s, m in zip(start, size):
            order = s + np.argsort(ids[s : s + m], kind="stable")
            root = links([np.asarray(sets[k]) for k in order])
            moved = np.flatnonzero(root != np.arange(m))
            out.append(np.stack([ids[order[root[moved]]], ids[order[moved]]], 1))
        yield pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])
        give_back()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id long, text)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    sketched = "n_shingles long, c1 long, c2 long, bands array<long>, odd binary, doc_id long"
    known = written(texts.where("doc_id is not null").mapInPandas(_sketched, sketched))
    full = known.where("n_shingles > 0")
    classes = written(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")))
    named = classes.select("rep", F.col("c1").alias("d1"), F.col("c2").alias("d2"))
    alone = full.join(named, (F.col("doc_id") == F.col("rep")) & (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")), "left_semi")

    # c1 tells the texts of one id apart.
    spread = alone.select(F.col("doc_id").alias("rep"), "c1", F.explode("bands").alias("key"))
    # Sort-merge joins with written tables, here and below: where many rows have one key, Spark splits them.
    crowded = written(spread.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    members = spread.join(crowded.hint("merge"), "key").join(alone.select(F.col("doc_id").alias("rep"), "c1", "odd").dropDuplicates(["rep", "c1"]), ["rep", "c1"])
    parts = members.withColumn("parts", F.ceil(F.col("m") / CHUNK)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
    met = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "odd")
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "rep").mapInPandas(_families, "a long, b long")
    family = written(components(met).select(F.col("node").alias("rep"), F.col("root").alias("family")))

    sizes = written(family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    placed = family.join(sizes.hint("merge"), "family").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    # Texts are dealt out by id at every size; a broadcast of the smaller side would be bounded by nothing.
    sets = texts.join(placed.hint("merge"), F.col("doc_id") == F.col("rep")).select("rep", "family", "blocks", "own", "text")
    sets = sets.mapInPandas(_sets, "rep long, family long, blocks int, own int, shingles array<long>")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "shingles")
    checked = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInPandas(_verified, "a long, b long")
    # An id that different texts share joins their groups.
    ids = known.groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("x"), F.max(F.struct("c1", "c2")).alias("y")).where("x <> y").select(F.col("doc_id").alias("shared"))
    several = ids.limit(1).count() > 0
    if several:
        checked = checked.unionByName(full.join(ids, F.col("doc_id") == F.col("shared"), "left_semi").join(classes, ["c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    root = components(checked)

    # A class is a row here, however many members it has.
    found = classes.join(root, F.col("rep") == F.col("node"), "left").select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.coalesce("root", "rep").alias("found"))
    out = known.join(found.hint("merge"), (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col("n_shingles") > 0), "left")
    if several:
        one = ids.join(root, F.col("shared") == F.col("node")).select("shared", F.col("root").alias("whole"))
        out = out.join(one, F.col("doc_id") == F.col("shared"), "left").withColumn("found", F.coalesce("whole", "found"))
    out = out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    nameless = texts.where("doc_id is null").mapInPandas(_sketched, sketched).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, one for each doc_id (of rows that share it, that of the least hash of all its columns); rows without doc_id all stay."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    least = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("kept_id")).agg(F.min(own).alias("least"))
    kept = groups(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct().join(least, "kept_id")
    # No hash lies below the least one; written so, the join is by doc_id alone, as is what follows.
    known = docs.join(kept.hint("merge"), (F.col("doc_id") == F.col("kept_id")) & (own <= F.col("least")), "left_semi").dropDuplicates(["doc_id"])
    return known.unionByName(docs.where("doc_id is null"))
