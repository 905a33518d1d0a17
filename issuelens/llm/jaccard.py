"""Similarity join of word-shingle sets by signature trees: exact at a limit of 90 %.

1. Every text gives its distinct 3-word shingles (64-bit hashes). Texts of equal sets form a class; its least document
   stands for it.
2. Routing. Two sets that reach the limit differ in d shingles at most, d following from their sizes. Sizes are cut into
   ranges; inside a range the shingles are dealt by hash into d + 1 + e parts, so that linked sets agree in e + 1 parts at
   least. A set leaves out its e weakest parts (fewest shingles; the order is that of the parts, so the strongest part in
   which two sets agree stays in both) and its other d + 1 parts are its keys. A set within the limit of the range below
   has keys there too. Sets that share a key are joined into families. Members of a key in one task are joined with the first of
   them, and only that one meets the other tasks', so a key that many sets share is one row a task.
3. Signature trees. The sets of a family are the leaves of a tree, each with a bitmap of its shingles and its size; a node
   above has the OR of its children's bitmaps, the range of their sizes and the most shingles that fell on a bit already
   set. Two trees (or one and itself) are walked down together: a pair of nodes is left when the sizes, or the common bits
   and the shingles that bits may hide, can't reach the limit. Pairs of leaves that remain are compared exactly, those of
   most common bits first, and left when they are connected already.
4. Families over BLOCK sets are dealt into blocks, each a tree of its own that holds a few members of the family besides,
   PIVOTS, which connect the blocks. Sets outside the family's largest group, the rest, are then compared with all
   of it, a block of the rest with a block of all in a task. No pair of unconnected sets is left out; the work is quadratic
   in the rest of a family only.
5. Components of the links give the groups; a task folds its own links to stars first.

Defined cases: null and empty texts have no shingle and link with nothing; 1 or 2 words are one shingle; a document without
doc_id links with nothing and has no component_id; rows that repeat a doc_id are one document, and where their texts differ,
the links of any of them are the document's; very long texts are read whole; an empty table gives an empty result; columns
beside doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, give_back, mix64, runs, windows
from .common import small_batches, text_bytes, written
from .graph import components, folded

SHINGLE, PERCENT = 3, 90
BLOCK, PIVOTS = 2048, 64
#: Children of a node; bits of a bitmap for each shingle of the largest set; most bits.
FAN, WIDE, MOST_BITS = 8, 4, 1 << 17
#: Ranges of sizes grow by this.
GROWTH = 1.4
#: Bytes of text worked on at once, in 4096 texts at most; keys that a task joins at once.
PIECE, HELD = 1 << 20, 1 << 21


def shingles(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, rising, text after text, and how many each has. At most 65,536 texts."""
    hashes, text = windows(w := Words(texts), k, whole_if_short=True)
    order = np.argsort(hashes)
    order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=w.n)


def reach(size: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The largest size that a set of this size can link with."""
    return size * 100 // percent


class Ranges:
    """Ranges of sizes: first size, parts and parts to leave out of each."""

    def __init__(self, largest: int, percent: int = PERCENT, growth: float = GROWTH):
        first = [1]
        while first[-1] <= largest:
            first.append(max(reach(first[-1], percent) + 1, int(first[-1] * growth)))
        self.first = np.array(first, np.int64)
        top = self.first[1:] - 1
        # |x| + |y| <= t and 100 * common >= percent * union: they differ in t * (100 - percent) / (100 + percent) at most.
        self.differ = (top + reach(top, percent)) * (100 - percent) // (100 + percent)
        self.extra = np.where(self.differ > 0, 1 + self.differ // 10, 0)
        self.parts = self.differ + 1 + self.extra

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, size, "right") - 1

    def below(self, size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Can a set of this size link with one of the range below?"""
        least = -(-size * percent // 100)
        return (size > 0) & (self.of(np.maximum(least, 1)) < self.of(size))


def keys_of(hashes: np.ndarray, sizes: np.ndarray, ranges: Ranges) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set, set after set, and how many each has. Sets that can only link with equal ones have none."""
    start = np.cumsum(sizes) - sizes
    own, lower = ranges.of(np.maximum(sizes, 1)), np.flatnonzero(ranges.below(sizes))
    sets, place = np.concatenate([np.flatnonzero(sizes), lower]), np.concatenate([own[sizes > 0], own[lower] - 1])
    some = ranges.differ[place] > 0
    sets, place = sets[some], place[some]
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    size, parts = sizes[sets], ranges.parts[place]
    row = np.repeat(np.arange(len(sets)), size)
    tokens = hashes[np.arange(len(row)) - np.repeat(np.cumsum(size) - size - start[sets], size)]
    begin = np.cumsum(parts) - parts
    with np.errstate(over="ignore"):
        slot = begin[row] + (mix64(tokens ^ np.uint64(0x5BD1E9955BD1E995)) % parts[row].astype(np.uint64)).astype(np.int64)
        held, total = np.bincount(slot, minlength=int(parts.sum())), np.zeros(int(parts.sum()), np.uint64)
        np.add.at(total, slot, mix64(tokens))
        of = np.repeat(np.arange(len(sets)), parts)
        order = np.lexsort((total, held, of))
        rank = np.arange(len(order)) - begin[of]
        kept = np.sort(order[rank >= ranges.extra[place][of]])
        number = (kept - begin[of[kept]]).astype(np.uint64) + (place[of[kept]].astype(np.uint64) << np.uint64(40))
        keys = mix64(total[kept] + mix64(number + np.uint64(1)))
    back = np.argsort(sets[of[kept]], kind="stable")
    return keys[back], np.bincount(sets[of[kept]], minlength=len(sizes))


_KNOWN = "doc_id long, n_shingles long, c1 long, c2 long, keys array<long>"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_shingles, c1 and c2 (a hash of the set), and keys of each text."""
    ranges = Ranges(1 << 10)
    for batch in batches:
        texts, ids = [x.as_py() for x in batch.column("text")], batch.column("doc_id")
        for a, b in runs([min(len(t), PIECE) + PIECE // 4096 for t in texts], PIECE):
            hashes, sizes = shingles(texts[a:b])
            if sizes.max(initial=0) >= ranges.first[-1]:
                ranges = Ranges(int(sizes.max()))
            keys, n_keys = keys_of(hashes, sizes, ranges)
            with np.errstate(over="ignore"):
                at, c = np.concatenate([[0], np.cumsum(sizes)]), []
                for seed in (0, 0xA5A5A5A5A5A5A5A5):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(seed)))])
                    c.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_keys)]), pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes.astype(np.int64)), *map(pa.array, c), listed], ["doc_id", "n_shingles", "c1", "c2", "keys"])
        give_back()


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key, its first document here (key, a); and edges from that one to the others (a, b), spread by a key of their own."""

    def joined(ids: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        own, key = np.concatenate(ids), np.concatenate(keys)
        order = np.lexsort((own, key))
        own, key = own[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = own[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        kept = new | (own != first)
        new, own, key, first = new[kept], own[kept], key[kept], first[kept]
        spread = mix64(own.astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.where(new, key, spread)), pa.array(own), pa.array(first, mask=new)], ["key", "a", "b"])

    ids, keys, n = [], [], 0
    for batch in batches:
        listed = batch.column("keys")
        keys.append(listed.flatten().to_numpy(zero_copy_only=False))
        ids.append(np.repeat(batch.column("rep").to_numpy(), listed.value_lengths().to_numpy(zero_copy_only=False)))
        n += len(keys[-1])
        if n > HELD:
            yield joined(ids, keys)
            ids, keys, n = [], [], 0
    if n:
        yield joined(ids, keys)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _first_of_task in the order of key and a: all edges, and those from the least document of a key to its others."""
    last = first = None
    for batch in batches:
        is_edge = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        key, a = batch.column("key").to_numpy(), batch.column("a").to_numpy()
        yield _pairs(a[is_edge], batch.column("b").filter(batch.column("b").is_valid()).to_numpy())
        key, a = key[~is_edge], a[~is_edge]
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            least = np.where(start < 0, first if first is not None else 0, a[np.maximum(start, 0)])
            yield _pairs(a[~new], least[~new])
            last, first = key[-1], least[-1]


class Tree:
    """Levels of nodes over sets, leaves first: bitmap, least and largest size, most hidden shingles; each level's nodes have FAN children."""

    def __init__(self, tokens: list[np.ndarray], bits: int, fan: int = FAN):
        self.size = np.array([len(t) for t in tokens], np.int64)
        flat, words = np.concatenate(tokens).view(np.uint64), bits // 64
        bit = flat & np.uint64(bits - 1)
        at = np.repeat(np.arange(len(tokens)), self.size) * words + (bit >> np.uint64(6)).astype(np.int64)
        maps = np.zeros(len(tokens) * words, np.uint64)
        np.bitwise_or.at(maps, at, np.uint64(1) << (bit & np.uint64(63)))
        maps = maps.reshape(len(tokens), words)
        hidden = self.size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.fan, self.levels = fan, [(maps, self.size, self.size, hidden)]
        while len(self.levels[-1][1]) > fan:
            maps, least, most, hidden = self.levels[-1]
            start = np.arange(0, len(least), fan)
            self.levels.append((np.bitwise_or.reduceat(maps, start), np.minimum.reduceat(least, start), np.maximum.reduceat(most, start), np.maximum.reduceat(hidden, start)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of each node of a level, and how many it has."""
        first = nodes * self.fan
        return first, np.minimum(self.fan, len(self.levels[level - 1][1]) - first)


def may_link(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes i of one level and j of another may have sets below that link, and the most that such sets can have in common."""
    fits = (x[2][i] * 100 >= percent * y[1][j]) & (y[2][j] * 100 >= percent * x[1][i])
    i, j, at = i[fits], j[fits], np.flatnonzero(fits)
    common, step = np.empty(len(i), np.int64), max(1, (1 << 21) // max(1, x[0].shape[1]))
    for k in range(0, len(i), step):
        common[k : k + step] = np.bitwise_count(x[0][i[k : k + step]] & y[0][j[k : k + step]]).sum(1, dtype=np.int64)
    common = np.minimum(common + np.minimum(x[3][i], y[3][j]), np.minimum(x[2][i], y[2][j]))
    good = (100 + percent) * common >= percent * (x[1][i] + y[1][j])
    return at[good], common[good]


def walk(x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves that may link and the most they can have in common; of a tree with itself, each pair once."""
    up, over = len(x.levels) - 1, len(y.levels) - 1
    i, j = (g.ravel() for g in np.meshgrid(np.arange(len(x.levels[up][1])), np.arange(len(y.levels[over][1])), indexing="ij"))
    while True:
        if x is y:
            once = i <= j if up else i < j
            i, j = i[once], j[once]
        at, common = may_link(x.levels[up], y.levels[over], i, j)
        i, j = i[at], j[at]
        if not up and not over:
            return i, j, common
        (a, n), (b, m) = x.children(up, i) if up else (i, np.ones(len(i), np.int64)), y.children(over, j) if over else (j, np.ones(len(j), np.int64))
        each = n * m
        ramp = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(m, each)
        i, j = np.repeat(a, each) + ramp // np.maximum(wide, 1), np.repeat(b, each) + ramp % np.maximum(wide, 1)
        up, over = max(up - 1, 0), max(over - 1, 0)


class _Groups:
    """Groups of numbered things that are joined."""

    def __init__(self, of: np.ndarray):
        self.root = np.searchsorted(np.unique(of), of)
        first = np.full(len(of), len(of))
        np.minimum.at(first, self.root, np.arange(len(of)))
        self.root = first[self.root]

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)


def links(tokens: list[np.ndarray], of: np.ndarray, left: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of sets (rising uint64 shingles) that link and, with of (what is connected already), connect all that do: within all, or left (a mask) with all."""
    least = np.array([t[0] if len(t) else 0 for t in tokens], np.uint64)
    order = np.lexsort((np.fromiter(map(len, tokens), np.int64, len(tokens)), least))  # similar sets side by side
    bits = 64
    while bits < min(MOST_BITS, WIDE * max(map(len, tokens))):
        bits *= 2
    whole = order if left is None else order[~left[order]]
    part = order if left is None else order[left[order]]
    if not len(whole) or not len(part):
        return []
    y = Tree([tokens[k] for k in whole], bits)
    x = y if left is None else Tree([tokens[k] for k in part], bits)
    i, j, common = walk(x, y)
    size_x, size_y = x.size[i], y.size[j]
    i, j = part[i], whole[j]
    best = np.argsort(-common / (size_x + size_y), kind="stable")
    i, j = i[best], j[best]
    groups, found = _Groups(of), []
    # Shingles numbered over all sets, so that a set and a shingle make one rising number.
    flat, sizes = np.concatenate(tokens), np.array([len(t) for t in tokens], np.int64)
    different, number = np.unique(flat, return_inverse=True)
    held = np.repeat(np.arange(len(tokens)), sizes) * len(different) + number
    start = np.cumsum(sizes) - sizes
    step = 64
    while len(i):
        a, b = i[:step], j[:step]
        n = sizes[a]
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        asked = np.repeat(b, n) * len(different) + number[np.repeat(start[a], n) + ramp]
        at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
        shared = np.bincount(np.repeat(np.arange(len(a)), n)[held[at] == asked], minlength=len(a))
        for k in np.flatnonzero((100 + percent) * shared >= percent * (n + sizes[b])).tolist():
            if groups.root[a[k]] != groups.root[b[k]]:
                groups.join(a[k], b[k])
                found.append((int(a[k]), int(b[k])))
        i, j = i[step:], j[step:]
        apart = groups.root[i] != groups.root[j]
        i, j, step = i[apart], j[apart], min(2 * step, 4096)
    return found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with text: the text's shingles instead."""
    for batch in batches:
        texts = [x.as_py() for x in batch.column("text")]
        rest = batch.drop_columns(["text"])
        for a, b in runs([min(len(t), PIECE) + PIECE // 4096 for t in texts], PIECE):
            hashes, sizes = shingles(texts[a:b])
            yield rest.slice(a, b - a).append_column("shingles", pa.array([x.tobytes() for x in np.split(hashes, np.cumsum(sizes)[:-1])], pa.binary()))
        give_back()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by keys, groups never cut, and where groups begin (and the end)."""

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for k in keys:
            x = rows[k].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.append(np.flatnonzero(new), rows.num_rows)

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        at = begins(rows)
        if len(at) > 2:
            yield rows.slice(0, int(at[-2])), at[:-1]
        rest = rows.slice(int(at[-2])) if rows.num_rows else None
    if rest is not None:
        yield rest, begins(rest)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of family, i, j, rep, of, is_left (null: all with all), shingles, sorted by the first three: edges that connect what links."""
    for rows, at in _whole_groups(batches, ["family", "i", "j"]):
        rep, of = rows["rep"].to_numpy(), rows["of"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"].combine_chunks()]
        left = rows["is_left"].to_numpy()
        out = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            if e - s > 1:
                mask = None if left[s] is None else left[s:e].astype(bool)
                out += [(rep[s + a], rep[s + b]) for a, b in links(sets[s:e], of[s:e], mask)]
        found = np.array(out, np.int64).reshape(-1, 2)
        yield _pairs(found[:, 0], found[:, 1])
    give_back()


def _check(dealt: DataFrame) -> DataFrame:
    sets = dealt.mapInArrow(_sets, "family long, i int, j int, rep long, of long, is_left boolean, shingles binary")
    return folded(sets.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "rep").mapInArrow(_linked, "a long, b long"))


def _rest(placed: DataFrame, found: DataFrame) -> DataFrame | None:
    """Of families in several blocks, all sets beside those outside the largest group: rep, family, i (block of the rest), j (block of all), of (group so far), is_left."""
    many = placed.where("blocks > 1")
    if not many.limit(1).count():
        return None
    now = written(many.join(components(folded(found)).hint("merge"), F.col("rep") == F.col("node"), "left").select("rep", "family", "blocks", "own", F.coalesce("root", "rep").alias("of")))
    main = now.groupBy("family", "of").agg(F.count("*").alias("m")).groupBy("family").agg(F.max_by("of", F.struct("m", "of")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    # A row a family in several blocks, each of which has over BLOCK sets.
    main = main.withColumn("rests", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")).where("rests > 0").select("family", "main", "rests")
    known = now.join(main, "family")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rest = known.where("of <> main").withColumn("i", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rests").cast("long")).cast("int")).withColumn("j", every(F.col("blocks"))).withColumn("is_left", F.lit(True))
    whole = known.withColumn("i", every(F.col("rests"))).withColumn("j", F.col("own")).withColumn("is_left", F.lit(False))
    return rest.select("rep", "family", "i", "j", "of", "is_left").unionByName(whole.select("rep", "family", "i", "j", "of", "is_left"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id long, text)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    known = written(texts.mapInArrow(_described, _KNOWN))
    full = known.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")))
    named = classes.select("rep", F.col("c1").alias("d1"), F.col("c2").alias("d2"))
    alone = full.join(named, (F.col("doc_id") == F.col("rep")) & (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")), "left_semi").where(F.size("keys") > 0)
    near = alone.select(F.col("doc_id").alias("rep"), "keys").mapInArrow(_first_of_task, "key long, a long, b long")
    near = near.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_firsts, "a long, b long")
    # Read again, many small files make one split, whose stars are folded once more.
    family = written(components(folded(written(folded(near)))).select(F.col("node").alias("rep"), F.col("root").alias("family")))

    sizes = written(family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    placed = written(family.join(sizes.hint("merge"), "family").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")))
    # A family of b blocks has some PIVOTS of its members in each; fewer than one row in BLOCK / PIVOTS is copied.
    share = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks").cast("long") * BLOCK) < PIVOTS
    where = F.when((F.col("blocks") > 1) & share, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = placed.select("rep", "family", F.explode(where).alias("i"), F.lit(0).alias("j"), F.col("rep").alias("of"), F.lit(None).cast("boolean").alias("is_left"))
    with_text = lambda rows: texts.join(rows.hint("merge"), F.col("doc_id") == F.col("rep")).select("family", "i", "j", "rep", "of", "is_left", "text")
    found = written(_check(with_text(dealt)))
    rest = _rest(placed, found)
    if rest is not None:
        found = found.unionByName(_check(with_text(rest)))
    # An id that different texts share joins their groups.
    ids = known.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("x"), F.max(F.struct("c1", "c2")).alias("y")).where("x <> y").select(F.col("doc_id").alias("shared"))
    several = ids.limit(1).count() > 0
    if several:
        found = found.unionByName(full.join(ids, F.col("doc_id") == F.col("shared"), "left_semi").join(classes, ["c1", "c2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    root = components(folded(found))
    placed = classes.join(root, F.col("rep") == F.col("node"), "left").select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.coalesce("root", "rep").alias("found"))
    # A sort-merge join: where many rows are of one class, Spark splits them.
    out = known.join(placed.hint("merge"), (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & F.col("doc_id").isNotNull(), "left")
    if several:
        one = ids.join(root, F.col("shared") == F.col("node")).select("shared", F.col("root").alias("whole"))
        out = out.join(one, F.col("doc_id") == F.col("shared"), "left").withColumn("found", F.coalesce("whole", "found"))
    return out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
