"""The bidiagonal solver and the whitening query against numpy's eigenvectors, and on odd rows."""

import numpy as np
import pytest

from wardlens.llm import queries, storage, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, k=16):
    """(n, sums, eigenvalues, eigenvectors as rows, trace) of the distinct grid vectors, by the covariance itself."""
    x = np.unique(np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000, axis=0)
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    return n, sums, e[::-1][:k], v[:, ::-1][:, :k].T, np.trace(cov)


@pytest.mark.parametrize("shape", [(40, 1), (50, 2), (60, 5), (300, 64), (600, 150)])
def test_components(shape):
    rng = np.random.default_rng(shape[1])
    x = np.floor(rng.normal(size=shape) * 8) @ np.diag(1 + rng.random(shape[1]))
    c = x - x.mean(0)
    e, v, total = whitening.components(np.linalg.qr(c, mode="r"), len(x))
    want, vectors = np.linalg.eigh(c.T @ c / len(x))
    k = min(16, shape[1])
    assert e == pytest.approx(want[::-1][:k], rel=1e-12) and total == pytest.approx(want.sum())
    assert np.abs(v @ v.T - np.eye(k)).max() < 1e-11
    assert np.abs(np.abs((v * vectors[:, ::-1][:, :k].T).sum(1)) - 1).max() < 1e-11


def test_components_that_are_equal_or_none():
    same = np.kron(np.eye(30), [[3.0], [-3.0]])
    e, v, _ = whitening.components(np.linalg.qr(same, mode="r"), len(same))
    assert e == pytest.approx(np.full(16, 0.3)) and np.abs(v @ v.T - np.eye(16)).max() < 1e-11
    rng = np.random.default_rng(0)
    flat = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 20))
    e, v, total = whitening.components(np.linalg.qr(flat - flat.mean(0), mode="r"), 200)
    assert (e[4:] == 0).all() and e.sum() == pytest.approx(total) and np.abs(v[:4] @ v[:4].T - np.eye(4)).max() < 1e-11
    assert (whitening.components(np.zeros((3, 3)), 5)[0] == 0).all()


def test_query(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, sums, e, v, total = brute(list(rows.values()))
    got = queries.op11_embedding_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows) and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    flip = {}
    for r in got:
        y = n * (np.floor(64 * np.array(rows[r.vec_id], np.float64)).astype(np.int64) + 1_000_000) - sums
        assert (r.n, r.deviation) == (n, int((y * y).sum()))
        assert r.explained == pytest.approx(e[r.component - 1] / total, rel=1e-10)
        w = (y / n) @ v[r.component - 1] / np.sqrt(e[r.component - 1])
        sign = flip.setdefault(r.component, np.sign(w * r.whitened))
        assert r.whitened == pytest.approx(sign * w, abs=1e-8)


def test_odd_rows(spark):
    storage.ready(spark)
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, 4.0], [3.0, -1.0, 0.25], [2.0, 2.0, 2.0], [1.0, 2.0, 0.5]]
    bad = [None, [], [1.0, None, 2.0], [nan, 0.0, 0.0], [0.0, inf, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    rows = [(None if i == 3 else i, v, 7, "x") for i, v in enumerate(good + bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int, component string")
    got = whitening.whitened(frame).collect()
    n, _, e, _, total = brute(good)
    assert len(got) == 15 and n == 4 and {r.vec_id for r in got} == {0, 1, 2, None, 4} and {r.n for r in got} == {4}
    assert sorted({r.explained for r in got}, reverse=True) == pytest.approx(list(e / total))
    first = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert first == {r.component: r.whitened for r in got if r.vec_id == 4}
    one = whitening.whitened(frame.where("vec_id in (0, 4)")).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in one)
    two = whitening.whitened(frame.where("vec_id in (0, 1)")).collect()
    assert {r.component: r.whitened is None for r in two} == {1: False, 2: True, 3: True} and {r.explained for r in two if r.component > 1} == {0.0}
    assert whitening.whitened(frame.where("vec_id > 4 and vec_id <> 10")).count() == 0
    many = spark.range(5000).selectExpr("id as vec_id", "array(cast(hash(id) % 64 as float) / 64, cast(hash(id, 1) % 32 as float) / 64) as embedding").repartition(40)
    assert whitening.whitened(many).agg({"identity_error": "max"}).first()[0] < 1e-10
