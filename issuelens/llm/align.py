"""Alignment of two tokenizers over the same texts, by pointer jumping.

A is a byte-level BPE (a tokenizers JSON file), B a BPE with byte fallback (a sentencepiece model); both encode space+text.

1. A text is cut before each blank that follows a character which is no white space. Neither tokenizer has a token over
   such a place (A splits there by its pattern, B has no piece with a blank behind another character; both are tested when
   the files are read, and else the text stays whole), so each unit is encoded, and aligned, once a chunk.
2. Over the tokens of all new units at once, every token points to its farthest-right overlapping token: the token of the
   other side that holds its last byte, and a token of B that ends where one of A ends points to itself. Replacing each
   pointer by its target's pointer doubles the way until nothing changes; then every token points to the last token of its
   group, which labels the group.
3. A chunk (some CHUNK bytes of consecutive texts of a task) keeps the links of its units and how often each id pair
   occurs in it. Pairs are summed over all chunks and the best partners of each id of B are marked; the sums return to the
   chunks that asked for them. No task holds the table of pairs.

Defined cases: a text that is null, empty, no valid UTF-8, or whose joined tokens of A or B differ from space+text has no
tokens: all zeros and empty groups; special tokens' strings are plain text; very long texts are read whole; repeated rows
count as often as they stand, in pair counts too; a null doc_id is a row like any other; an empty table gives an empty
result; columns beside doc_id and text aren't looked at.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import give_back, runs
from .common import small_batches, written

FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A chunk ends after so many bytes of text, or so many different units.
CHUNK, UNITS = 32 << 20, 1 << 18
#: Bytes of text worked on at once.
PIECE = 1 << 20
#: Units of more characters go to the tokenizer that doesn't recurse over them; both give the same ids.
LONG = 1000
_CUT, _BLANKS = re.compile(r"(?<=\S) "), re.compile(r"\s ")


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coders:
    """Both tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        special, of = {x["content"] for x in told["added_tokens"]}, byte_of()
        ranks = {bytes(of[c] for c in entry): i for entry, i in told["model"]["vocab"].items() if entry not in special}
        self.a = tiktoken.Encoding("a", pat_str=A_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_long = Tokenizer.from_file(a_path)
        self.a_long.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (1 + max(ranks.values()))
        for entry, i in ranks.items():
            self.a_bytes[i] = entry
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank = self.b.piece_to_id("▁")
        #: May texts be cut before blanks? Not if a piece of B has a blank behind another character.
        self.cuts = len(self.b_bytes[self.blank]) == 1 and not any(re.search(rb"[^ ] ", x) for x in self.b_bytes)

    def units(self, text: str) -> list[str]:
        """Pieces of space+text, each without the blank that it begins with."""
        if not self.cuts:
            return [text]
        return _CUT.split(text) if text.startswith(" ") or _BLANKS.search(text) else text.split(" ")

    def ids(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Of each unit (its first blank left out), the ids of A and of B; none where their bytes differ from the unit's."""
        a = [self.a.encode_ordinary(" " + u) if len(u) < LONG else self.a_long.encode(" " + u, add_special_tokens=False).ids for u in units]
        b = self.b.encode(units, num_threads=1)
        for i, u in enumerate(units):
            if not u:
                b[i] = [self.blank]
            want = b" " + u.encode()
            if b"".join(map(self.a_bytes.__getitem__, a[i])) != want or b"".join(map(self.b_bytes.__getitem__, b[i])) != want:
                a[i], b[i] = [], []
        return a, b


#: Fixed value: the split pattern that byte-level tokenizers of this family use.
A_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def coders(a_path: str, b_path: str) -> Coders:
    return Coders(a_path, b_path)


def jump(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The token at which the group of each token ends: tokens of A, then tokens of B, numbered on; a_end, b_end: their ends, the last ones equal."""
    n = len(a_end)
    to_b, to_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    own = np.arange(n, n + len(b_end))
    succ = np.concatenate([n + to_b, np.where(a_end[to_a] == b_end, own, to_a)]) if n else own
    while not np.array_equal(further := succ[succ], succ):
        succ = further
    return succ


def overlaps(a_end: np.ndarray, b_end: np.ndarray, a_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a token of A and one of B that share a byte."""
    first, last = np.searchsorted(b_end, a_end - a_len, "right"), np.searchsorted(b_end, a_end)
    size = last - first + 1
    ramp = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.arange(len(a_end)), size), np.repeat(first, size) + ramp


def spelled(ids: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in decimal digits, each followed by its byte of behind, as bytes; and how many bytes each takes."""
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 10))
    at = np.cumsum(digits + 1)
    out = np.empty(int(at[-1]) if len(at) else 0, np.uint8)
    rest = ids.astype(np.int64)
    for k in range(int(digits.max(initial=0))):
        has = digits > k
        out[at[has] - 2 - k] = 48 + rest[has] % 10
        rest //= 10
    out[at - 1] = behind
    return out, digits + 1


class Chunk:
    """Units of some consecutive texts, each aligned once."""

    def __init__(self, both: Coders):
        self.both, self.known, self.bytes = both, defaultdict(count().__next__), 0
        self.n_a = self.n_b = self.n_groups = np.zeros(0, np.int64)
        self.ok, self.said = np.zeros(0, bool), []
        self.n_links, self.pairs = [], []
        self.counts = np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Aligns new units, all tokens at once."""
        both = self.both
        a, b = both.ids(units)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a, b))
        a_id, b_id = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        a_end, b_end = np.cumsum(both.a_len[a_id]), np.cumsum(both.b_len[b_id])
        last = jump(a_end, b_end)
        ends = last[len(a_id) :] == np.arange(len(a_id), len(last))  # of B: is it the last of its group?
        group = (np.cumsum(ends) - 1)[last - len(a_id)]
        a_group, b_group = group[: len(a_id)], group[len(a_id) :]
        n_groups = np.diff(np.concatenate([[0], np.cumsum(ends)])[np.concatenate([[0], np.cumsum(n_b)])])
        # A text for each group: ids of A, then ids of B.
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        side = np.concatenate([np.full(len(a_id), ord("|")), np.full(len(b_id), ord(";"))])[order]
        key = np.concatenate([2 * a_group, 2 * b_group + 1])[order]
        more = np.append(key[1:] == key[:-1], False) if len(key) else np.zeros(0, bool)
        text, size = spelled(np.concatenate([a_id, b_id])[order], np.where(more, ord(","), side).astype(np.uint8))
        cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        raw = text.tobytes()
        self.said += [raw[i : max(i, j - 1)] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
        i, j = overlaps(a_end, b_end, both.a_len[a_id]) if len(a_id) else (np.zeros(0, np.int64),) * 2
        unit = np.repeat(np.arange(len(units)), n_a)
        self.n_links.append(np.bincount(unit[i], minlength=len(units)))
        self.pairs.append(a_id[i] << 32 | b_id[j])
        self.n_a, self.n_b, self.n_groups = (np.concatenate(x) for x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)))
        self.ok = np.concatenate([self.ok, n_a > 0])
        self.counts = np.concatenate([self.counts, np.zeros(len(units), np.int64)])

    def read(self, texts: list[str]) -> dict[str, object]:
        """n_a, n_b, n_groups, n_links, groups and units (indexes) of each text."""
        parts = [self.both.units(t) if t else [] for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(size.sum()))
        if len(self.known) > before:
            self.learn(list(self.known)[before:] if before else list(self.known))
        of = np.repeat(np.arange(len(texts)), size)
        good = (size > 0) & (np.bincount(of[~self.ok[at]], minlength=len(texts)) == 0)
        of, at = of[good[of]], at[good[of]]
        size = np.where(good, size, 0)
        self.counts += np.bincount(at, minlength=len(self.known))
        links = np.concatenate(self.n_links) if self.n_links else np.zeros(0, np.int64)
        total = lambda of_unit: np.bincount(of, weights=of_unit[at], minlength=len(texts)).astype(np.int64)
        split = np.split(at.astype(np.uint32), np.cumsum(size)[:-1]) if len(texts) else []
        said = [b";".join(map(self.said.__getitem__, x.tolist())).decode("ascii") for x in split]
        return {"n_a": total(self.n_a), "n_b": total(self.n_b), "n_groups": total(self.n_groups), "n_links": total(links), "groups": said, "units": [x.tobytes() for x in split]}

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Id pairs and how many links of this chunk hold each."""
        pairs, links = np.concatenate(self.pairs or [np.zeros(0, np.int64)]), np.concatenate(self.n_links or [np.zeros(0, np.int64)])
        times = np.repeat(self.counts, links)
        found, at = np.unique(pairs, return_inverse=True)
        n = np.bincount(at, weights=times, minlength=len(found)).astype(np.int64)
        return found[n > 0], n[n > 0]


_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, units binary, chunk long, links binary, pairs array<long>, counts array<long>"
_SHAPE = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), ("units", pa.binary()), ("chunk", pa.int64()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _rows(n: int, **columns: object) -> pa.RecordBatch:
    """n rows of align; columns that aren't given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SHAPE], schema=_SHAPE)


def _texts(raw: list[bytes | None]) -> list[str]:
    out = []
    for x in raw:
        try:
            out.append(bytes(x).decode() if x else "")
        except UnicodeDecodeError:
            out.append("")
    return out


def align(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """A row for each text: doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`), units, chunk; and a row for each chunk, with links, pairs and counts set instead of units."""
    a_path, b_path = f"{folder}/{a_file}", f"{folder}/{b_file}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, context = coders(a_path, b_path), TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        chunk = Chunk(both)

        def told() -> pa.RecordBatch:
            pairs, counts = chunk.pair_counts()
            links = np.concatenate([[len(chunk.known)], *chunk.n_links, *chunk.pairs]).astype(np.int64)
            return _rows(1, chunk=[number], links=[links.tobytes()], pairs=[pairs], counts=[counts])

        for batch in batches:
            texts, ids = _texts(batch.column("text").to_pylist()), batch.column("doc_id")
            for i, j in runs([len(t) for t in texts], PIECE):
                yield _rows(j - i, **chunk.read(texts[i:j]), doc_id=ids.slice(i, j - i), chunk=np.full(j - i, number))
                chunk.bytes += sum(map(len, texts[i:j]))
                if chunk.bytes > CHUNK or len(chunk.known) > UNITS:
                    yield told()
                    number, chunk = number + 1, Chunk(both)
                    give_back()
        if chunk.bytes or chunk.known:
            yield told()
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _FOUND)


def _meet(rows: pa.Table, replies: pa.Table) -> pa.Table:
    """n_best and count_sum of the texts of one chunk."""
    of_chunk = rows.filter(pc.is_valid(rows["links"]))
    texts = rows.filter(pc.is_null(rows["links"]))
    best_of, sum_of = np.zeros(1, np.int64), np.zeros(1, np.int64)
    if of_chunk.num_rows:
        flat = np.frombuffer(of_chunk["links"][0].as_buffer(), np.int64)
        n = int(flat[0])
        size, pairs = flat[1 : n + 1], flat[n + 1 :]
        code, total, best = (replies[c].to_numpy() for c in ("pair", "total", "best"))
        order = np.argsort(code, kind="stable")
        code, total, best = code[order], total[order], best[order]
        at = np.minimum(np.searchsorted(code, pairs), max(len(code) - 1, 0))
        has = code[at] == pairs if len(code) else np.zeros(len(pairs), bool)  # units of texts without tokens have no count
        start = np.concatenate([[0], np.cumsum(size)])
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(np.where(has, x[at] if len(code) else 0, 0))])[start])
        best_of, sum_of = sums(best.astype(np.int64)), sums(total)
    units = [np.frombuffer(x.as_buffer(), np.uint32) for x in texts["units"]]
    counted = {"n_best": best_of, "count_sum": sum_of}
    for name, of_unit in counted.items():
        texts = texts.append_column(name, pa.array([int(of_unit[u].sum()) for u in units], pa.int64()))
    return texts.drop_columns(["units", "links", "chunk"])


def with_counts(found: DataFrame) -> DataFrame:
    """The rows of found (a saved result of align, other columns may be added) that stand for texts, with n_best and count_sum."""
    asked = found.where("links is not null").select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(F.col("chunk").alias("asker"), F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    totals = asked.groupBy("pair").agg(F.sum("n").alias("total"))
    # An id of B has as many partners as A has ids at most.
    totals = totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy(b_id)))
    replies = asked.select("asker", "pair").join(totals, "pair").select("asker", "pair", "total", "best")
    rows = found.drop("pairs", "counts", "groups")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("units", "links", "chunk")]
    return rows.groupBy("chunk").cogroup(replies.groupBy("asker")).applyInArrow(_meet, ", ".join([*kept, "n_best long", "count_sum long"]))


def aligned(docs: DataFrame, **files: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for each row of docs."""
    said = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups"), 256)).otherwise("")
    return with_counts(written(align(docs, **files).withColumn("groups_sha256", F.when(F.col("links").isNull(), said)).drop("groups")))
