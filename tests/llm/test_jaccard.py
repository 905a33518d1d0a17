"""Shingle join by signature trees: routing loses no link, trees prune no link, and groups equal brute force on odd tables and over several blocks."""

import random

import numpy as np
import pytest

from issuelens.llm import jaccard, queries


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def set_of(text, k=3):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, percent=90):
    """doc_id -> least doc_id reachable; rows: (doc_id, text)."""
    sets = [(i, set_of(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root}


def near_copies(rng, n, size, edits):
    """Texts of a base with so many words changed, each in places of its own."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_sets_that_link_share_a_key():
    rng, ranges, linked = np.random.default_rng(0), jaccard.Ranges(3000), 0
    for _ in range(1500):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(5, 400))).astype(np.uint64))
        y = np.delete(x, rng.permutation(len(x))[: int(rng.integers(0, len(x) // 10 + 1))])
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(rng.integers(0, len(x) // 12 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 90 * (len(x) + len(y) - common) and common < max(len(x), len(y)):
            keys, n = jaccard.keys_of(np.concatenate([x, y]), np.array([len(x), len(y)]), ranges)
            assert len(np.intersect1d(keys[: n[0]], keys[n[0] :]))
            linked += 1
    assert linked > 300


@pytest.mark.parametrize("split", [False, True])
def test_walk_keeps_every_pair_that_links_and_prunes_others(split):
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, int(rng.integers(20, 90))).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[int(rng.integers(0, 6)) :], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)])) for _ in range(5)]
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if 100 * (m := len(np.intersect1d(sets[a], sets[b]))) >= 90 * (len(sets[a]) + len(sets[b]) - m)}
    if split:
        x, y = jaccard.Tree(sets[:72], 512), jaccard.Tree(sets[72:], 512)
        i, j, common = jaccard.walk(x, y)
        got, want = set(zip(i.tolist(), (j + 72).tolist(), strict=True)), {(a, b) for a, b in want if a < 72 <= b}
    else:
        tree = jaccard.Tree(sets, 512)
        i, j, common = jaccard.walk(tree, tree)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert want and want <= got and len(got) < 1000 and len(got) == len(i)
    seconds = (j + 72) if split else j
    assert all(c >= len(np.intersect1d(sets[a], sets[b])) for a, b, c in zip(i.tolist(), seconds.tolist(), common.tolist(), strict=True))


def test_links_connect_what_is_not_connected_yet():
    x = np.arange(100, dtype=np.uint64)
    sets = [x, x[1:], x[2:], x + np.uint64(1000)]
    assert len(jaccard.links(sets, np.arange(4))) == 2
    assert jaccard.links(sets, np.array([7, 7, 7, 9])) == []
    left = np.array([True, False, False, False])
    assert len(jaccard.links(sets, np.array([5, 8, 8, 9]), left)) == 1


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = []
    for size, edits in ((400, 12), (60, 2), (30, 1), (12, 1)):
        for _ in range(3):
            texts += near_copies(rng, 12, size, edits)
    texts += ["One two", "one  TWO", "one two three", "One two three four", "", None, "\n\t", "é É", "é é", "a b c d " * 700]
    texts += [texts[0]] * 5
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[0]), (None, None), rows[0], rows[1], (3, texts[14]), (7, texts[40]), (9, None)]


@pytest.mark.parametrize("block", [2048, 4])
def test_query_equals_brute_force(spark, corpus, tmp_path, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    spark.createDataFrame([(i, t, 5) for i, t in corpus], "doc_id long, text string, n_shingles int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op11_ngram_join"](spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    got = out.collect()
    want = brute(corpus)
    assert {(r.doc_id, r.component_id) for r in got} == {*want.items(), (None, None)}
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(set_of(t))) for i, t in corpus)
    assert len(set(want.values())) < len(want) - 60


def test_empty_table(spark):
    assert jaccard.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
