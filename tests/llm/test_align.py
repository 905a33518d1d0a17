"""Cross-tokenizer alignment: pointer jumping, units and pair counts against a plain version over whole texts."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest

from issuelens.llm import align

pytestmark = pytest.mark.skipif(not os.path.isdir(align.FOLDER), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def both():
    return align.coders(f"{align.FOLDER}/{align.A_FILE}", f"{align.FOLDER}/{align.B_FILE}")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{align.FOLDER}/{align.A_FILE}")
    t.encode_special_tokens = True
    return t


def plain(text, both, library):
    """Ids of both sides, groups as (ids, ids), and id pairs of all links: the whole text at once, the cuts from common ends."""
    a, b = library.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    want = (" " + text).encode()
    if not text or b"".join(both.a_bytes[i] for i in a) != want or b"".join(both.b_bytes[i] for i in b) != want:
        return [], [], [], []
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    a_end, b_end = ends(a, both.a_bytes), ends(b, both.b_bytes)
    groups, i, j = [], 0, 0
    for cut in sorted(set(a_end) & set(b_end)):
        x, y = i, j
        while i < len(a) and a_end[i] <= cut:
            i += 1
        while j < len(b) and b_end[j] <= cut:
            j += 1
        groups.append((a[x:i], b[y:j]))
    links = []
    j = 0
    for i, end in enumerate(a_end):
        begin = end - len(both.a_bytes[a[i]])
        while b_end[j] <= begin:
            j += 1
        k = j
        while k < len(b) and b_end[k] - len(both.b_bytes[b[k]]) < end:
            links.append((a[i], b[k]))
            k += 1
    return a, b, groups, links


def said(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def odd_texts(n=400, seed=3):
    rng = random.Random(seed)
    letters = ["a", "b", " ", " ", "  ", "é", "中", "\U0001f600", "▁", "\n", "\t", "　", "\x1c", "\x85", "'s", "1", "#", "<|endoftext|>", "</s>", "\r", "\x00"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_pointers_jump_to_the_end_of_their_group():
    #  A ends: 3 5 9 12;  B ends: 2 5 7 9 12 -> groups end at 5, 9, 12
    last = align.jump(np.array([3, 5, 9, 12]), np.array([2, 5, 7, 9, 12]))
    assert last.tolist() == [5, 5, 7, 8, 5, 5, 7, 7, 8]
    # A chain as long as the text: each token overlaps the next one of the other side.
    a, b = np.append(np.arange(2, 4001, 2), 4001), np.append(np.arange(1, 4001, 2), 4001)
    assert set(align.jump(a, b).tolist()) == {len(a) + len(b) - 1}


def test_numbers_are_spelled_in_decimals():
    text, size = align.spelled(np.array([0, 7, 10, 999, 50256]), np.frombuffer(b",|,;,", np.uint8))
    assert text.tobytes() == b"0,7|10,999;50256," and size.tolist() == [2, 2, 3, 4, 6]


def test_units_give_what_whole_texts_give(both, library):
    texts = [*odd_texts(), "", " ", "  x", "x ", "x  y\n z", "<|endoftext|> <s>", "q" * 3000, " " * 3000, "word " * 2000]
    got = align.Chunk(both).read(texts)
    for text, *row in zip(texts, *(got[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups")), strict=True):
        a, b, groups, links = plain(text, both, library)
        assert tuple(row) == (len(a), len(b), len(groups), len(links), said(groups)), text[:40]
    assert (got["n_a"] > 0).sum() > 100


def test_query_equals_the_plain_version(spark, both, library, tmp_path, monkeypatch):
    monkeypatch.setattr(align, "UNITS", 40)  # several chunks
    texts = [*odd_texts(60, 5), None, "", "the river of copper", "the river of copper", "the meadow of the river " * 40, "the"]
    rows = [(None if i == 7 else i, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_a string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    from issuelens.llm import queries

    count, told = collections.Counter(), []
    for t in texts:
        told.append(plain(t or "", both, library))
        count.update(told[-1][3])
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = []
    for (i, _, _), (a, b, groups, links) in zip(rows, told, strict=True):
        n_best, total = sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links)
        want.append((i, len(a), len(b), len(groups), len(links), n_best, total, hashlib.sha256(said(groups).encode()).hexdigest() if groups else ""))
    got = queries.QUERIES["op13_token_align"](spark, str(tmp_path))
    assert got.dtypes == [(c, "string" if c == "groups_sha256" else "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert queries.QUERIES["op13_token_align"](spark, f"{tmp_path}/none").count() == 0


def test_bytes_that_are_no_text_have_no_tokens(spark):
    rows = spark.sql("select 1L doc_id, cast(unhex('ff41') as string) text union all select 2L, 'a b'")
    got = {r.doc_id: r for r in align.aligned(rows).collect()}
    assert got[1].n_a == got[1].n_links == 0 and got[1].groups_sha256 == "" and got[2].n_a == 2
