"""Whitening by bidiagonalisation: against NumPy's decomposition, on odd tables, and with equal deviations."""

import numpy as np
import pytest

from issuelens.llm import queries, whiten


def plain(vectors, k=16):
    """n, S, V's eigenvalues (falling) and eigenvectors over the different vectors."""
    x = np.array(sorted({tuple(v) for v in vectors}))
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, found = np.linalg.eigh(y.T @ y / n)
    return n, s, values[::-1][:k], found[:, ::-1][:, :k], np.trace(y.T @ y / n)


def scaled(c):
    return np.floor(64 * np.asarray(c, np.float64)).astype(np.int64) + 1_000_000


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((20, 20)) * np.geomspace(4, 0.05, 20)
    return (rng.standard_normal((700, 20)) @ mix).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")


def test_query_equals_numpy(spark, drawn, tmp_path):
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(drawn)] + [(900, [float(x) for x in drawn[0]], None)] * 3 + [(None, [float(x) for x in drawn[1]], None)]
    bad = [(901, None, None), (902, [float("nan")] * 20, None), (903, [None] + [0.0] * 19, None), (904, [float("inf")] * 20, None)]
    frame(spark, rows + bad).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.QUERIES["op12_whitening"](spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = out.collect()
    assert len(got) == 16 * len(rows) and {r.component for r in got} == set(range(1, 17))
    n, s, values, vectors, trace = plain(scaled(drawn))
    assert {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    of = {i: scaled(v) for i, v in enumerate(drawn)} | {900: scaled(drawn[0]), None: scaled(drawn[1])}
    sign = {}
    for r in got:
        want = (of[r.vec_id] - s / n) @ vectors[:, r.component - 1] / np.sqrt(values[r.component - 1])
        if abs(want) > 0.1:
            sign.setdefault(r.component, np.sign(want * r.whitened))
        assert abs(want * sign.get(r.component, np.sign(want * r.whitened)) - r.whitened) < 1e-8
        assert r.deviation == sum((n * int(x) - int(t)) ** 2 for x, t in zip(of[r.vec_id], s, strict=True))
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-10


@pytest.mark.parametrize(
    ("vectors", "components"),
    [
        (np.vstack([np.eye(6), -np.eye(6)]), 6),  # six equal deviations
        (np.vstack([np.eye(6)[:3], -np.eye(6)[:3]]), 3),  # three of them, three without any
        (np.array([[1.0, 2, 3], [1, 2, 3], [1, 2, 5]]), 1),
        (np.outer(np.arange(30), [1.0, 2, -1, 0]), 1),
        (np.random.default_rng(1).standard_normal((5, 40)), 4),  # fewer vectors than dimensions
        (np.diag([1000.0, 500, 1, 0.1]), 3),
    ],
)
def test_dependent_and_equal_deviations(spark, vectors, components):
    found = whiten.fit(spark.createDataFrame([(scaled(v).tolist(),) for v in vectors], "x array<long>"))
    n, s, values, _, trace = plain(scaled(vectors))
    assert len(found.deviations) == components and found.identity_error < 1e-8
    assert np.allclose(found.deviations**2, values[:components], rtol=1e-9) and np.isclose(found.trace, trace)
    assert np.allclose(found.components.T @ found.components, np.eye(components), atol=1e-9)


def test_sums_of_many_tasks_are_added_in_rounds(spark, drawn):
    x = spark.createDataFrame([(scaled(v).tolist(),) for v in drawn], "x array<long>").repartition(20)
    rows = whiten._Rows(whiten._blocks(x, 20, 0), 20, fan=3)
    assert np.array_equal(rows.total(lambda b: b.sum(0).astype(float)), scaled(drawn).sum(0))


def test_nothing_to_whiten(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.QUERIES["op12_whitening"](spark, f"{tmp_path}/none").count() == 0
    frame(spark, [(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)]).write.parquet(f"{tmp_path}/one/embeddings.parquet")
    assert queries.QUERIES["op12_whitening"](spark, f"{tmp_path}/one").count() == 0


def test_short_vectors_have_zeros_behind_and_huge_entries_do_not_fail(spark, tmp_path):
    rows = [(1, [1.0, 0.0], None), (2, [1.0], None), (3, [], None), (4, [0.0, 3.0], None), (5, [3e38, 0.0], None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op12_whitening"](spark, str(tmp_path)).where("component = 1").collect()
    by = {r.vec_id: r for r in got}
    assert len(by) == 5 and by[1].whitened == by[2].whitened and by[1].n == 4
