"""Removal of repeated byte strings by a sparse, distributed, enhanced suffix array.

A byte goes if it lies in a string of SPAN bytes that also starts earlier (in an earlier document, or earlier in its own).

1. Anchors: of the GRAM-byte strings in each window of SPAN bytes, the one of least hash. Equal windows have equal
   anchors, so only suffixes at anchors (3 % of the places) are sorted. Each task drops, before the shuffle, anchors whose
   whole context (LEFT bytes before, SPAN after) it has seen already: those bytes repeat for certain.
2. Anchors are dealt to slices by hash. Equal contexts again leave their first place only; of what is left, an anchor
   found in several contexts is a boundary, where a repeat begins or ends.
3. The contexts of boundaries meet in their slice: a suffix array with common prefixes is scanned with a stack, which gives
   the tree of common-prefix intervals. Each interval of prefix p is a set of occurrences; its left extensions are
   compared, and an occurrence whose longest left extension shared with an earlier one is q belongs to a maximal repeat
   of q + p bytes, all of whose occurrences but the first go if that is SPAN or more.
4. Anchors with more contexts than one task should hold (found on a sample of documents, which decides how they are
   handled, not what is found) don't meet. Theirs are exploded into windows; each task folds equal ones, and their first
   places are found by a sum over hashes.
5. The spans of each document meet its text, which was dealt out once and is read twice.

Contexts are compared as two 64-bit hashes in steps 1, 2 and 4 and byte by byte in step 3.

A document is known by its doc_id and a 64-bit hash of its text, and documents are ordered by these two.

Defined cases: null text is empty; texts below SPAN bytes lose nothing; a null doc_id counts as the least of all; rows
that share a doc_id (or have none) and differ in text are different documents, in the order of the hash of their text;
rows that repeat both are one document, whose own copy is no earlier occurrence; an empty table gives an empty result;
columns beside doc_id and text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _power, give_back, mix64, runs
from .common import small_batches, splits, text_bytes, written

SPAN, GRAM = 100, 36
REACH = SPAN - GRAM + 1
LEFT = REACH - 1
WIDE = LEFT + SPAN
PIECE = 1 << 18
FLUSH = 125_000
#: Anchors with HOT_LEAST different contexts in one document of SAMPLE_OF (some 64,000 in all, 10 MB) don't meet in a task.
SAMPLE_OF, HOT_LEAST, HOT_BITS = 64, 1000, 26
#: A place, the bytes at hand left of it (64 at most) and right of it (100 at most) in one number.
ROOM = 1 << 14
NO_ID = -(1 << 63)
_BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))


class Laid:
    """Texts with SPAN zero bytes between, and sums that give the hash of any stretch."""

    def __init__(self, texts: list[bytes]):
        pad = bytes(SPAN)
        self.raw = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
        self.size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.start = np.concatenate([[0], np.cumsum(self.size + SPAN)])[:-1] + SPAN
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, at: np.ndarray | slice, length: int, which: int = 0) -> np.ndarray:
        base, inverse = _BASES[which]
        m = len(self.raw)
        with np.errstate(over="ignore"):
            if which not in self.sums:
                total = np.zeros(m + 1, np.uint64)
                np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * _power(base, m), out=total[1:])
                self.sums[which] = total
            total, back = self.sums[which], _power(inverse, m + 1)
            if isinstance(at, slice):
                return mix64((total[length:] - total[: m + 1 - length]) * back[: m + 1 - length])
            return mix64((total[at + length] - total[at]) * back[at] + np.uint64(length))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors in raw, and which text each is of."""
        x = self.hashes(slice(None), GRAM)
        inside = np.zeros(len(self.raw) + 1, np.int8)
        long = self.size >= SPAN
        np.add.at(inside, self.start[long], 1)
        np.add.at(inside, (self.start + self.size - SPAN + 1)[long], -1)
        window = np.cumsum(inside[: len(x)], dtype=np.int8) > 0
        grams = np.zeros(len(self.raw) + 1, np.int8)
        np.add.at(grams, self.start[long], 1)
        np.add.at(grams, (self.start + self.size - GRAM + 1)[long], -1)
        x = np.where(np.cumsum(grams[: len(x)], dtype=np.int8) > 0, x, np.uint64(0xFFFFFFFFFFFFFFFF))
        least = x
        for step in (1, 2, 4, 8, 16, 32):
            least = np.minimum(least[: len(least) - step], least[step:])
        least = np.minimum(least[:-1], least[1:])
        most = np.where(window[: len(least)], least, np.uint64(0))
        most = np.concatenate([np.zeros(LEFT, np.uint64), most, np.zeros(len(x) - len(least), np.uint64)])
        for step in (1, 2, 4, 8, 16, 32):
            most = np.maximum(most[: len(most) - step], most[step:])
        most = np.maximum(most[:-1], most[1:])
        place = np.flatnonzero((most[: len(x)] == x) & (x != np.uint64(0xFFFFFFFFFFFFFFFF)))
        return place, np.searchsorted(self.start, place, "right") - 1


def _ranked(*keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rank of each row among the distinct rows of some columns, and the distinct rows in order."""
    order = np.lexsort(keys[::-1])
    rows = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in rows], axis=0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, [k[new] for k in rows]


def _runs_of(own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value that occurs, and where."""
    order = np.argsort(own, kind="stable")
    cut = np.flatnonzero(np.diff(own[order], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(own))):
        yield int(own[order[a]]), order[a:b]


def _in(crowd: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter of bits holds (by their first HOT_BITS bits)."""
    if not len(crowd):
        return np.zeros(len(h), bool)
    at = h >> np.uint64(64 - HOT_BITS)
    return (crowd[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _anchored(texts: list[bytes], ids: np.ndarray) -> dict[str, np.ndarray]:
    """gram and context hashes, doc, place, and bytes at hand on the left and the right, of all anchors."""
    laid = Laid(texts)
    place, text = laid.anchors()
    at = place - laid.start[text]
    left, right = np.minimum(at, LEFT), np.minimum(laid.size[text] - at, SPAN)
    with np.errstate(over="ignore"):
        context = mix64(laid.hashes(place - LEFT, WIDE, 1) + (left * 128 + right).astype(np.uint64))
    return {"h": laid.hashes(place, GRAM), "c": context, "doc": ids[text], "at": at, "left": left, "right": right}


def _windows(texts: list[bytes], ids: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Both hashes, doc and place of each window around the anchors whose gram hash is hot."""
    laid = Laid(texts)
    place, text = laid.anchors()
    keep = _in(hot, laid.hashes(place, GRAM))
    place, text = place[keep], text[keep]
    for back in range(LEFT + 1):
        begin = place - back
        ok = (begin >= laid.start[text]) & (begin + SPAN <= laid.start[text] + laid.size[text])
        b, t = begin[ok], text[ok]
        yield laid.hashes(b, SPAN), laid.hashes(b, SPAN, 1), ids[t], b - laid.start[t]


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _first_seen(a: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchors by gram, context, doc and place, and which are the first of their gram and context."""
    order = np.lexsort((a["at"], a["doc"], a["c"], a["h"]))
    a = {k: v[order] for k, v in a.items()}
    new = np.ones(len(order), bool)
    new[1:] = (a["h"][1:] != a["h"][:-1]) | (a["c"][1:] != a["c"][:-1])
    # The very same place again (a repeated row) is no later occurrence.
    same = np.zeros(len(order), bool)
    same[1:] = ~new[1:] & (a["doc"][1:] == a["doc"][:-1]) & (a["at"][1:] == a["at"][:-1])
    a = {k: v[~same] for k, v in a.items()}
    return a, new[~same]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that touch or overlap in a document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    group = np.cumsum(fresh) - 1
    # Running largest end inside a document: shift each document above all ends of those before it.
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * top) - group * top
    new = fresh.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _covered(a: dict[str, np.ndarray], later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return merged(a["doc"][later], (a["at"] - a["left"])[later], (a["at"] + a["right"])[later])


ANCHORS = "slice int, spans boolean, h array<long>, c array<long>, doc array<long>, sub array<long>, at array<long>"


class Held:
    """What the texts of a task give, with the keys of the texts, until there is enough of it to pass on."""

    def __init__(self):
        self.parts: list[dict[str, np.ndarray]] = []
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.texts = 0

    def add(self, part: dict[str, np.ndarray], did: np.ndarray, sub: np.ndarray) -> None:
        """part["doc"] counts the texts of did and sub."""
        self.parts.append(part | {"doc": part["doc"] + self.texts})
        self.keys.append((did, sub))
        self.size, self.texts = self.size + len(part["doc"]), self.texts + len(did)

    def take(self) -> tuple[dict[str, np.ndarray], np.ndarray, list[np.ndarray]]:
        """All, the first of each gram and context marked; doc counts the rows of the keys, which come last."""
        rank, keys = _ranked(*(np.concatenate([k[i] for k in self.keys]) for i in (0, 1)))
        a = _joined(self.parts)
        a["doc"] = rank[a["doc"]]
        self.__init__()
        return *_first_seen(a), keys


def _keyed(batch: pd.DataFrame) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts of a batch in pieces, with their keys."""
    texts, did, sub = batch["text"].tolist(), batch["did"].to_numpy(np.int64), batch["sub"].to_numpy(np.int64)
    for i, j in runs([len(t) + SPAN for t in texts], PIECE):
        yield texts[i:j], did[i:j], sub[i:j]


def _dealt(slices: int, hot: np.ndarray):
    """Anchors of a task by slice, and the spans it is sure of."""

    def flush(held: Held, turn: int) -> pd.DataFrame:
        a, new, (did, sub) = held.take()
        doc, start, end = _covered(a, ~new)
        cold = new & ~_in(hot, a["h"])
        a = {k: v[cold] for k, v in a.items()}
        at = a["at"] * ROOM + a["left"] * 128 + a["right"]
        rows = []
        for s, r in _runs_of((a["h"] >> np.uint64(33)).astype(np.int64) % slices):
            rows.append((s, False, a["h"][r].astype(np.int64), a["c"][r].astype(np.int64), did[a["doc"][r]], sub[a["doc"][r]], at[r]))
        if len(doc):
            rows.append((turn % slices, True, end, np.zeros(0, np.int64), did[doc], sub[doc], start))
        give_back()
        return pd.DataFrame(rows, columns=["slice", "spans", "h", "c", "doc", "sub", "at"])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, turn = Held(), 0
        for batch in batches:
            for texts, did, sub in _keyed(batch):
                held.add(_anchored(texts, np.arange(len(texts))), did, sub)
                if held.size >= FLUSH:
                    yield flush(held, turn)
                    turn += 1
        if held.size:
            yield flush(held, turn)

    return deal


FOUND = "boundary boolean, did long, sub long, a long, b long"


def _sorted_out(rows: pd.DataFrame) -> pd.DataFrame:
    """One slice: spans that repeat for certain (a to b), and boundaries (place a, gram hash b)."""
    join = lambda k, of: np.concatenate([np.asarray(x, np.int64) for x in of[k]] or [np.zeros(0, np.int64)])
    sure, rest = rows[rows["spans"]], rows[~rows["spans"]]
    h = join("h", rest).astype(np.uint64)
    ordered = np.sort(h)
    keep = np.isin(h, np.unique(ordered[1:][ordered[1:] == ordered[:-1]]))
    n = int(keep.sum())
    rank, (did, sub) = _ranked(*(np.concatenate([join(k, rest)[keep], join(k, sure)]) for k in ("doc", "sub")))
    place = join("at", rest)[keep]
    room = place % ROOM
    a = {"h": h[keep], "c": join("c", rest)[keep].astype(np.uint64), "doc": rank[:n], "at": place // ROOM, "left": room // 128, "right": room % 128}
    a, new = _first_seen(a)
    doc, start, end = _covered(a, ~new)
    first = {k: v[new] for k, v in a.items()}
    several = np.zeros(len(first["h"]), bool)
    same = first["h"][1:] == first["h"][:-1]
    several[1:] |= same
    several[:-1] |= same
    doc, start, end = merged(np.concatenate([doc, rank[n:]]), np.concatenate([start, join("at", sure)]), np.concatenate([end, join("h", sure)]))
    every = np.concatenate([doc, first["doc"][several]])
    give_back()
    return pd.DataFrame({
        "boundary": np.arange(len(every)) >= len(doc), "did": did[every], "sub": sub[every], "a": np.concatenate([start, first["at"][several]]), "b": np.concatenate([end, first["h"][several].astype(np.int64)]),
    })


CONTEXTS = "slice int, doc array<long>, sub array<long>, at array<long>, context binary"


def _contexts(slices: int):
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pad = bytes(SPAN)
        for batch in batches:
            cut, at = [], []
            for text, place in zip(batch["text"], batch["a"]):
                place = np.asarray(place, np.int64)
                laid = np.frombuffer(pad + text + pad, np.uint8)
                cut.append(laid[(place + SPAN - LEFT)[:, None] + np.arange(WIDE)])
                at.append(place * ROOM + np.minimum(place, LEFT) * 128 + np.minimum(len(text) - place, SPAN))
            many = [len(x) for x in at]
            cut, at = np.concatenate(cut), np.concatenate(at)
            did, sub = (np.repeat(batch[k].to_numpy(np.int64), many) for k in ("did", "sub"))
            h = np.concatenate([np.asarray(x, np.int64) for x in batch["b"]]).astype(np.uint64)
            rows = [(s, did[r], sub[r], at[r], cut[r].tobytes()) for s, r in _runs_of((h >> np.uint64(33)).astype(np.int64) % slices)]
            yield pd.DataFrame(rows, columns=["slice", "doc", "sub", "at", "context"])
            give_back()

    return fetch


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of each common-prefix interval of a suffix array, from the common prefixes of neighbours; length GRAM at least."""
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*common.tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][1] > length:
            first, deep = stack.pop()
            yield first, i - 1, deep
        if length >= GRAM and (not stack or stack[-1][1] < length):
            stack.append((first, length))


def _shared(left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows, most at most."""
    differ = left != right
    return np.minimum(np.where(differ.any(1), differ.argmax(1), left.shape[1]), most)


def _left_shared(shared: list[int], rank: list[int]) -> list[int]:
    """Rows sorted by left context, shared: what each has in common with the next; of each, the most it shares with a row of lower rank (-1: none)."""
    best = [-1] * len(rank)
    for order, gap in ((range(len(rank)), -1), (range(len(rank) - 1, -1, -1), 0)):
        ranks: list[int] = []
        shares: list[int] = []  # of each entry, what it shares with the next one, the last with the row at hand
        for i in order:
            if ranks:
                shares[-1] = min(shares[-1], shared[i + gap])
            while ranks and ranks[-1] > rank[i]:
                ranks.pop()
                through = shares.pop()
                if ranks:
                    shares[-1] = min(shares[-1], through)
            if ranks:
                best[i] = max(best[i], shares[-1])
            ranks.append(rank[i])
            shares.append(LEFT)
    return best


def maximal_repeats(context: np.ndarray, doc: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the later occurrences of all repeats of SPAN bytes or more around anchors. context: LEFT bytes before and SPAN from the anchor on."""
    m = len(doc)
    after = np.ascontiguousarray(context[:, LEFT:])
    order = np.argsort(after.view(f"S{SPAN}").ravel(), kind="stable")
    after, doc, at, left, right = after[order], doc[order], at[order], left[order], right[order]
    before = np.ascontiguousarray(context[order][:, LEFT - 1 :: -1])
    common = _shared(after[1:], after[:-1], np.minimum(right[1:], right[:-1]))
    age = np.empty(m, np.int64)
    age[np.lexsort((at, doc))] = np.arange(m)
    left_rank = np.empty(m, np.int64)
    left_rank[np.argsort(before.view(f"S{LEFT}").ravel(), kind="stable")] = np.arange(m)
    spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pairs: list[tuple[int, int]] = []
    for first, last, deep in intervals(common):
        if last == first + 1:
            pairs.append((first, deep))
            continue
        rows = np.arange(first, last + 1)
        rows = rows[np.argsort(left_rank[rows])]
        shared = _shared(before[rows[1:]], before[rows[:-1]], np.minimum(left[rows[1:]], left[rows[:-1]]))
        if shared.max() + deep < SPAN:
            continue
        q = np.array(_left_shared(shared.tolist(), age[rows].tolist()))
        hit = q + deep >= SPAN
        spans.append((doc[rows[hit]], (at[rows] - q)[hit], at[rows[hit]] + deep))
    if pairs:
        one, deep = np.array(pairs, np.int64).T
        q = _shared(before[one], before[one + 1], np.minimum(left[one], left[one + 1]))
        hit = q + deep >= SPAN
        late = np.where(age[one] > age[one + 1], one, one + 1)[hit]
        spans.append((doc[late], at[late] - q[hit], at[late] + deep[hit]))
    if not spans:
        return (np.zeros(0, np.int64),) * 3
    return merged(*(np.concatenate([s[k] for s in spans]) for k in range(3)))


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    context = np.frombuffer(b"".join(rows["context"]), np.uint8).reshape(-1, WIDE)
    doc, sub, at = (np.concatenate([np.asarray(x, np.int64) for x in rows[k]]) for k in ("doc", "sub", "at"))
    rank, (did, sub) = _ranked(doc, sub)
    # A repeated row brings its contexts again; the same place is no second occurrence.
    _, once = np.unique(np.stack([rank, at], 1), axis=0, return_index=True)
    context, rank, at, room = context[once], rank[once], at[once] // ROOM, at[once] % ROOM
    doc, start, end = maximal_repeats(context, rank, at, room // 128, room % 128)
    give_back()
    return pd.DataFrame({"did": did[doc], "sub": sub[doc], "a": start, "b": end})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, a, b in zip(batch["text"], batch["a"], batch["b"]):
            start, end = (np.asarray(x if x is not None else [], np.int64) for x in (a, b))
            _, start, end = merged(np.zeros(len(start), np.int64), start, np.minimum(end, len(text)))
            spans = list(zip(start.tolist(), end.tolist()))
            kept = b"".join(text[i:j] for i, j in zip([0, *end.tolist()], [*start.tolist(), len(text)]))
            rows.append((len(text), len(text) - len(kept), [{"start": i, "end": j} for i, j in spans], kept))
        yield batch[["doc_id"]].reset_index(drop=True).join(pd.DataFrame(rows, columns=["n_bytes", "n_removed", "removed", "kept"]))
        del rows, batch
        give_back()


def hot_grams(texts: DataFrame) -> np.ndarray:
    """A filter of 2^HOT_BITS bits (8 MB at any size) of the grams found in HOT_LEAST different contexts on one document of SAMPLE_OF; empty if there are none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, did, _ in _keyed(batch):
                a = _anchored(own, np.arange(len(did)))
                yield pd.DataFrame({"h": a["h"].astype(np.int64), "c": a["c"].astype(np.int64)})

    sample = texts.where(F.pmod(F.xxhash64("did", "sub"), F.lit(SAMPLE_OF)) == 0)
    often = sample.mapInPandas(count, "h long, c long").distinct().groupBy("h").count().where(F.col("count") >= HOT_LEAST)
    bit = often.select(F.shiftrightunsigned("h", 64 - HOT_BITS).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    if not len(words):
        return np.zeros(0, np.uint64)
    crowd = np.zeros(1 << (HOT_BITS - 6), np.uint64)
    crowd[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint64)
    return crowd


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (spans) and kept (bytes) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    source = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), text_bytes().alias("text")).withColumn("sub", F.xxhash64("text"))
    slices = max(8, 4 * splits(docs))
    hot = hot_grams(source)
    dealt = source.select("did", "sub", "text").mapInPandas(_dealt(slices, hot), ANCHORS)
    found = written(dealt.groupBy("slice").applyInPandas(_sorted_out, FOUND))

    texts = source.repartition("did", "sub")
    of_document = lambda rows, name: rows.groupBy("did", "sub").agg(F.collect_list(F.struct("a", "b")).alias(name))
    marks = texts.join(of_document(found.where("boundary"), "marks"), ["did", "sub"]).select("did", "sub", "text", "marks.a", "marks.b")
    contexts = marks.mapInPandas(_contexts(slices), CONTEXTS)
    spans = found.where("not boundary").select("did", "sub", "a", "b").unionByName(contexts.groupBy("slice").applyInPandas(_repeated, "did long, sub long, a long, b long"))
    if len(hot):
        spans = spans.unionByName(_hot_spans(source.select("did", "sub", "text"), hot))
    id_type = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {id_type}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept binary"
    return texts.join(of_document(spans, "spans"), ["did", "sub"], "left").select("doc_id", "text", "spans.a", "spans.b").mapInPandas(_cut, shape)


def _hot_spans(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """Spans of windows around hot anchors that an earlier window equals."""

    def flush(held: Held) -> pd.DataFrame:
        a, new, (did, sub) = held.take()
        doc, start, end = _covered(a, ~new)
        every = np.concatenate([doc, a["doc"][new]])
        none = np.zeros(len(doc), np.int64)
        give_back()
        return pd.DataFrame({
            "sure": np.arange(len(every)) < len(doc), "w1": np.concatenate([none, a["h"][new].astype(np.int64)]), "w2": np.concatenate([none, a["c"][new].astype(np.int64)]),
            "did": did[every], "sub": sub[every], "a": np.concatenate([start, a["at"][new]]), "b": np.concatenate([end, a["at"][new] + SPAN]),
        })

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Held()
        for batch in batches:
            for own, did, sub in _keyed(batch):
                w1, w2, doc, at = (np.concatenate(p) for p in zip(*_windows(own, np.arange(len(own)), hot)))
                held.add({"h": w1, "c": w2, "doc": doc, "at": at, "left": np.zeros(len(at), np.int64), "right": np.full(len(at), SPAN)}, did, sub)
                if held.size >= 4 * FLUSH:
                    yield flush(held)
        if held.size:
            yield flush(held)

    windows = written(texts.mapInPandas(explode, "sure boolean, w1 long, w2 long, did long, sub long, a long, b long"))
    place = F.struct("did", "sub", "a")
    first = windows.where("not sure").groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.where("not sure").join(first, ["w1", "w2"]).where(place > F.col("first"))
    return windows.where("sure").select("did", "sub", "a", "b").unionByName(later.select("did", "sub", "a", "b"))


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
