"""Language-model scores: prediction by partial matching over a trie of byte contexts, and a smoothed unigram base.

The trie holds the counts of every byte after contexts of 0 to ORDER bytes in the training texts. A byte is predicted by
the longest context that has seen it: each longer one pays an escape (as often as it has distinct bytes), and bytes that
a longer context has seen are excluded from the shorter ones; a byte never seen at all is uniform over what is left.
Every text ends with a byte 0, and starts after ORDER of them. A-Z count as a-z.

How it runs: documents are dealt to chunks, a partition each. A chunk states the distinct grams (context and byte) and
words it holds, with their training counts, to the owners of slices of the keys (grams by the last three bytes of context,
words by hash); slices in which it holds nothing get no row. What the chunks state is added up FAN at a time, level by
level, so that the owner of a context that every chunk holds gets FAN tables at most, each no larger than its slice of the
trie; the answers go back the same way, and the chunk, dealt out once and read twice, adds up its texts. So the trie and
the vocabulary are never whole in one place, however large they get. Only contexts of up to two bytes, 2^24 counts at
most, go everywhere.

Defined cases: null and empty texts have one token and one byte (the end); a byte 0 inside a text counts as an end byte;
an empty table gives an empty result; without training texts the unigram base is uniform and bytes cost log10(256) each;
rows that repeat, or have no doc_id, are scored once each; columns beside doc_id and text aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, Words, give_back, mix64, runs
from .common import small_batches, splits, text_bytes, written

ORDER = 4
PIECE = 2 << 20
END = np.uint64(0x656E64)
CHUNKS_PER_SPLIT, SLICES_PER_SPLIT = 3, 2
#: Tables added up by one task at each level.
FAN = 64


def _tally(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of the counts of each."""
    key, n = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[start], np.add.reduceat(n, start) if len(start) else n


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[start], np.diff(np.append(start, len(keys)))


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER zero bytes, the text and an end byte, text after text; and where each text's bytes start."""
    raw = LOWER[np.frombuffer(b"".join(bytes(ORDER) + t + b"\0" for t in texts), np.uint8)]
    sizes = np.fromiter((len(t) + ORDER + 1 for t in texts), np.int64, len(texts))
    return raw, np.concatenate([[0], np.cumsum(sizes)])[:-1] + ORDER


def _grams(raw: np.ndarray, a: int, b: int, width: int = ORDER + 1) -> np.ndarray:
    """Of each place in raw[a:b], the key of the byte there and those before it, width bytes in all."""
    key = np.zeros(b - a, np.uint64)
    for back in range(width - 1, -1, -1):
        key = (key << np.uint64(8)) | raw[a - back : b - back].astype(np.uint64)
    return key


def _pieces(texts: list[bytes], each: list, width: int = ORDER + 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Grams of pieces of the texts, and of each gram which text it is of and what each has for that text."""
    raw, starts = _laid(texts)
    ends = np.append(starts[1:] - ORDER, len(raw))
    for lo in range(0, len(raw), PIECE):
        a, b = max(lo, ORDER), min(lo + PIECE, len(raw))
        if a >= b:
            continue
        text = np.searchsorted(starts - ORDER, np.arange(a, b), "right") - 1
        here = (np.arange(a, b) >= starts[text]) & (np.arange(a, b) < ends[text])
        yield _grams(raw, a, b, width)[here], text[here], np.asarray(each)[text[here]]


class Chunk:
    """What a chunk of texts holds: distinct words and grams in the order of their owners."""

    def __init__(self, texts: list[bytes], train: list[bool], slices: int):
        self.texts, words, of, grams, n_grams = texts, [], [], [], []
        for a, b in runs([len(t) for t in texts], PIECE):
            w = Words(texts[a:b])
            words += [w.hashes(), np.full(b - a, END)]
            of += [w.text + a, np.arange(a, b)]
        self.word, self.of = np.concatenate(words), np.concatenate(of)
        learned = np.asarray(train, bool)
        self.words, n = _distinct(self.word)
        known, times = _distinct(self.word[learned[self.of]])
        self.n_words = np.zeros(len(self.words), np.int64)
        self.n_words[np.searchsorted(self.words, known)] = times
        for key, _, train_here in _pieces(texts, learned):
            k, n = _distinct(key)
            grams.append(k)
            n_grams.append(np.zeros(len(k), np.int64))
            k, n = _distinct(key[train_here])
            grams.append(k)
            n_grams.append(n)
        self.grams, self.n_grams = _tally(grams, n_grams)
        with np.errstate(over="ignore"):
            self.word_slice = (self.words >> np.uint64(33)).astype(np.int64) % slices
            self.gram_slice = (mix64((self.grams >> np.uint64(8)) & np.uint64(0xFFFFFF)) >> np.uint64(33)).astype(np.int64) % slices
        self.slices = slices

    def statements(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """owner (slices of the words, then those of the grams), keys, training counts, of the slices that have keys."""
        for kind, key, n, own in ((0, self.words, self.n_words, self.word_slice), (1, self.grams, self.n_grams, self.gram_slice)):
            order = np.argsort(own, kind="stable")
            cut = np.flatnonzero(np.diff(own[order], prepend=-1))
            for i, j in zip(cut, np.append(cut[1:], len(own))):
                yield kind * self.slices + int(own[order[i]]), key[order[i:j]], n[order[i:j]]

    def values(self, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The answers for words and grams, in the order of their keys."""
        out = []
        for kind, own in ((0, self.word_slice), (1, self.gram_slice)):
            value, order = np.empty(len(own)), np.argsort(own, kind="stable")
            value[order] = np.concatenate([answers[kind * self.slices + int(s)] for s in np.unique(own)] or [np.zeros(0)])
            out.append(value)
        return out[0], out[1]


class LowOrders:
    """Contexts of up to two bytes: counts by three-byte key (context, byte), made to answer what longer contexts leave."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.tables = []
        key, n = keys.astype(np.int64), counts.astype(np.float64)
        for order in (2, 1, 0):
            size = 1 << (8 * order)
            if order < 2:
                rows, inverse = np.unique(key % (size << 8), return_inverse=True)
                key, n = rows, np.bincount(inverse, weights=n, minlength=len(rows))
            total, distinct = np.bincount(key >> 8, weights=n, minlength=1), np.bincount(key >> 8, minlength=1)
            self.tables.append((key, n, total, distinct))

    def count(self, order: int, key: np.ndarray) -> np.ndarray:
        keys, n = self.tables[2 - order][:2]
        key = key % (1 << (8 * (order + 1)))
        if not len(keys):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, n[at], 0.0)

    def sums(self, order: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of distinct bytes of the context of each key."""
        total, distinct = self.tables[2 - order][2:]
        context = (key >> 8) % (1 << (8 * order))
        inside = context < len(total)
        context = np.where(inside, context, 0)
        return np.where(inside, total[context], 0.0), np.where(inside, distinct[context], 0).astype(np.float64)

    def excluded(self, order: int, key: np.ndarray) -> np.ndarray:
        """Sum, in the context of this order, of the bytes that the context one longer (order + 1) has seen."""
        keys = self.tables[2 - order - 1][0]
        if not len(keys):
            return np.zeros(len(key))
        by_context = np.bincount(keys >> 8, weights=self.count(order, keys))
        context = (key >> 8) % (1 << (8 * (order + 1)))
        return np.where(context < len(by_context), by_context[np.minimum(context, len(by_context) - 1)], 0.0)


def gram_scores(keys: np.ndarray, counts: np.ndarray, low: LowOrders) -> np.ndarray:
    """log10 of the probability of the last byte of each five-byte key, keys rising and closed over contexts of three bytes."""
    key, n4 = keys.astype(np.int64), counts.astype(np.float64)
    if not len(key):
        return n4
    seen4 = (n4 > 0).astype(np.float64)
    context, at4 = np.unique(key >> 8, return_inverse=True)
    t4, q4 = np.bincount(at4, weights=n4), np.bincount(at4, weights=seen4)
    key3, at = np.unique(key & 0xFFFFFFFF, return_inverse=True)
    c3 = np.bincount(at, weights=n4)
    _, at3 = np.unique(key3 >> 8, return_inverse=True)
    t3, q3 = np.bincount(at3, weights=c3), np.bincount(at3, weights=(c3 > 0).astype(np.float64))
    out3 = np.bincount(at4, weights=c3[at] * seen4)
    c2_of3 = low.count(2, key3)
    out2 = np.bincount(at3, weights=c2_of3 * (c3 > 0))
    row3 = at3[at]
    t2, q2 = low.sums(2, key)
    t1, q1 = low.sums(1, key)
    t0, q0 = low.sums(0, key)
    levels = [
        (n4, t4[at4], q4[at4]),
        (c3[at], t3[row3] - out3[at4], q3[row3] - q4[at4]),
        (low.count(2, key), t2 - out2[row3], q2 - q3[row3]),
        (low.count(1, key), t1 - low.excluded(1, key), q1 - q2),
        (low.count(0, key), t0 - low.excluded(0, key), q0 - q1),
    ]
    score, open_ = np.zeros(len(key)), np.ones(len(key), bool)
    for count, total, distinct in levels:
        has = open_ & (total > 0.5)
        hit = has & (count > 0)
        score[hit] += np.log10(count[hit] / (total[hit] + distinct[hit]))
        open_ &= ~hit
        miss = has & ~hit
        score[miss] += np.log10(distinct[miss] / (total[miss] + distinct[miss]))
    score[open_] -= np.log10(np.maximum(256 - q0[open_], 1))
    return score


def gathered(docs: DataFrame) -> tuple[LowOrders, int, int]:
    """From the training rows (text as bytes) of docs: the low orders, 2^24 counts at most, and how many tokens and distinct tokens there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = [[], []], [[], []]

        def add(kind: int, key: np.ndarray) -> None:
            k, n = _distinct(key)
            keys[kind].append(k)
            counts[kind].append(n)
            if len(keys[kind]) > 16:
                k, n = _tally(keys[kind], counts[kind])
                keys[kind], counts[kind] = [k], [n]

        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in runs([len(t) + ORDER + 1 for t in texts], PIECE):
                add(0, np.concatenate([Words(texts[a:b]).hashes(), np.full(b - a, END)]))
                for key, _, _ in _pieces(texts[a:b], [0] * (b - a), 3):
                    add(1, key)
        for kind in (0, 1):
            key, n = _tally(keys[kind], counts[kind])
            yield pd.DataFrame({"kind": kind, "key": key.astype(np.int64), "n": n})
        give_back()

    found = written(docs.where("train").select("text").mapInPandas(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    tokens = found.where("kind = 0").agg(F.sum("n"), F.count("*")).first()
    rows = found.where("kind = 1").select("key", "n").toPandas().sort_values("key")
    return LowOrders(rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)), int(tokens[0] or 0), int(tokens[1])


TOLD = "owner int, unit int, told array<double>"


def _added_up(stated: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    asked = [np.asarray(k, np.int64).astype(np.uint64) for k in stated["keys"]]
    return asked, *_tally(asked, [np.asarray(x, np.int64) for x in stated["n"]])


def answered(stated: DataFrame, units: int, slices: int, low: LowOrders) -> DataFrame:
    """owner, unit, told (a value for each key), from what units state: owner, unit, keys, n."""

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        asked, key, n = _added_up(rows)
        value = n.astype(np.float64) if rows["owner"].iloc[0] < slices else gram_scores(key, n, low)
        told = [value[np.searchsorted(key, k)] for k in asked]
        give_back()
        return rows[["owner", "unit"]].assign(told=told)

    if units <= FAN:
        return stated.repartitionById(2 * slices, F.col("owner")).groupBy("owner").applyInPandas(own, TOLD)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        _, key, n = _added_up(rows)
        return pd.DataFrame([(rows["owner"].iloc[0], rows["group"].iloc[0], key.astype(np.int64), n)], columns=["owner", "unit", "keys", "n"])

    def pass_on(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        asked, key, _ = _added_up(rows)
        value = np.asarray(told["told"].iloc[0], np.float64)
        out = rows[["owner", "unit"]].assign(told=[value[np.searchsorted(key, k)] for k in asked])
        give_back()
        return out

    above = -(-units // FAN)
    dealt = stated.withColumn("group", F.floor(F.col("unit") / FAN).cast("int")).repartition(2 * slices * min(above, 8), "owner", "group")
    merged = dealt.groupBy("owner", "group").applyInPandas(merge, "owner int, unit int, keys array<long>, n array<long>")
    told = answered(merged, above, slices, low).withColumnRenamed("unit", "group")
    return dealt.groupBy("owner", "group").cogroup(told.repartition(2 * slices * min(above, 8), "owner", "group").groupBy("owner", "group")).applyInPandas(pass_on, TOLD)


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs; train marks the rows to learn from."""
    small_batches(docs.sparkSession)
    many = splits(docs)
    chunks, slices = max(4, CHUNKS_PER_SPLIT * many), max(4, SLICES_PER_SPLIT * many)
    rows = docs.select("doc_id", train.alias("train"), text_bytes().alias("text"))
    low, total, distinct = gathered(rows)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")).repartitionById(chunks, F.col("chunk"))

    def state(own: pd.DataFrame) -> pd.DataFrame:
        held = Chunk(own["text"].tolist(), own["train"].tolist(), slices)
        return pd.DataFrame([(owner, own["chunk"].iloc[0], key.astype(np.int64), n) for owner, key, n in held.statements()], columns=["owner", "unit", "keys", "n"])

    stated = rows.groupBy("chunk").applyInPandas(state, "owner int, unit int, keys array<long>, n array<long>")
    answers = answered(stated, chunks, slices, low).withColumnRenamed("unit", "chunk").repartitionById(chunks, F.col("chunk"))

    def finish(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        held = Chunk(own["text"].tolist(), own["train"].tolist(), slices)
        words, grams = held.values({int(o): np.asarray(v, np.float64) for o, v in zip(answers["owner"], answers["told"])})
        m = len(own)
        count = words[np.searchsorted(held.words, held.word)]
        n = np.bincount(held.of, minlength=m)
        floor = total + 0.5 * (distinct + 1)
        score = np.zeros(m)
        for key, text, _ in _pieces(held.texts, [0] * m):
            score += np.bincount(text, weights=grams[np.searchsorted(held.grams, key)], minlength=m)
        out = pd.DataFrame({
            "doc_id": own["doc_id"], "held_out": ~own["train"], "n_tokens": n, "n_known": np.bincount(held.of, weights=count > 0, minlength=m).astype(np.int64), "train_tokens": total,
            "base_score": np.bincount(held.of, weights=np.log10(count + 0.5), minlength=m) - n * math.log10(floor), "score": score,
        })
        give_back()
        return out

    id_type = dict(docs.dtypes)["doc_id"]
    shape = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(finish, shape)
