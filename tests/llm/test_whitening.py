"""Whitening against numpy on whole vectors."""

import numpy as np
import pytest
from helpers import rows

from vigil.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, _row string, _c int, n int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors, components):
    """(n, deviations, whitened up to the sign, explained shares) with exact sums."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    apart = [[n * c - s for c, s in zip(v, sums)] for v in x]
    a = np.array(apart, dtype=float) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, [sum(d * d for d in v) for v in apart], a @ u / np.sqrt(e), e / np.trace(a.T @ a / n)


def check(got, vectors, components, ids=None):
    n, deviations, want, shares = brute(vectors, components)
    ids = list(range(len(vectors))) if ids is None else ids
    assert len(got) == n * components
    by = {(r.vec_id, r.component): r for r in got}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    made = np.array([[by[i, k + 1].whitened for k in range(components)] for i in ids])
    signs = np.sign((made * want).sum(axis=0))
    assert np.allclose(made, want * signs, rtol=1e-8, atol=1e-8)
    for i, d in zip(ids, deviations):
        assert int(by[i, 1].deviation) == d
    for k in range(components):
        assert by[ids[0], k + 1].explained == pytest.approx(shares[k], rel=1e-9)


def sample(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(1, 3, d) + 7 * rng.normal(size=d)).astype(np.float32).tolist()


@pytest.mark.parametrize("n, d, components", [(300, 6, 4), (50, 3, 32)])
def test_against_numpy(spark, n, d, components):
    vectors = sample(n, d, n)
    got = whitening.whiten(frame(spark, vectors).repartition(3), components).collect()
    check(got, vectors, min(components, d))


def test_many_slabs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 8)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 2)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    monkeypatch.setattr(whitening, "TASKS_A_SLAB", 2)
    vectors = sample(100, 5, 1)  # slabs of 32 rows: 32, 32, 32 and 4
    check(whitening.whiten(frame(spark, vectors), 3).collect(), vectors, 3)


def test_bad_vectors_are_left_out(spark):
    good = sample(40, 3, 2)
    bad = [None, [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], []]
    got = whitening.whiten(frame(spark, good[:20] + bad + good[20:], ids=[*range(20), *[100] * 6, *range(20, 40)]), 2)
    check(got.collect(), good, 2)


def test_repeated_and_null_ids(spark):
    good = sample(30, 3, 3)
    got = whitening.whiten(frame(spark, good + good[:1], ids=[None, None, *[5] * 29]), 2)
    assert got.count() == 62 and got.where("vec_id is null").count() == 4
    assert len(set(rows(got.where("component = 1"), "whitened", "deviation"))) == 30  # equal vectors, equal rows


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]])
def test_no_variance(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).count() == 0


def test_directions_without_variance_have_no_component(spark):
    vectors = [[a, b, a + b, 4.0] for a, b, *_ in sample(25, 2, 4)]
    vectors = [[float(round(c)) for c in v] for v in vectors]
    vectors = [[a, b, a + b, 4.0] for a, b, _, _ in vectors]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.component for r in got} == {1, 2}
    check(got, vectors, 2)


def test_registered_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = entry.queries()["op13_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(got.collect(), [r.embedding for r in table], 32, [r.vec_id for r in table])
