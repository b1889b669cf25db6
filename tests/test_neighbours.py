"""Neighbour lists against brute force: copies, hot cells cut into chunks, ties, recall of the approximate form."""

import numpy as np
import pytest

from wardlens.operators import neighbours as NB


def brute(rows, k, every):
    ids, v = [i for i, x in rows if x is not None], np.array([x for _, x in rows if x is not None])
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            score = np.round(v @ v[a], NB.DIGITS)
            best = sorted(((-s, j) for s, j in zip(score.tolist(), ids, strict=True) if j != i))[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append((r.neighbour, r.score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 5))
    x = centres[rng.integers(0, 30, 2400)] + 0.3 * rng.normal(size=(2400, 5))
    x[::3] = x[0]  # a third are copies
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v) for i, v in enumerate(x.tolist())] + [(9000, None), (9020, None)]


def test_lists_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(NB, "CHUNK", 50)
    monkeypatch.setattr(NB, "PER_CELL", 20)
    frame = spark.createDataFrame(rows, "id bigint, v array<double>")
    index = NB.build(frame, 5)
    assert len(index.centroids) > 40 and index.entries.count() < 1700
    queries = frame.where("id % 20 = 0")
    exact = NB.neighbours(index, queries, 5)
    want = brute(rows, 5, 20)
    got = lists(exact)
    assert {i: [j for j, _ in x] for i, x in got.items()} == {i: [j for j, _ in x] for i, x in want.items()}
    near = NB.recall(NB.neighbours(index, queries, 5, exact=False), exact).first()
    assert near.wanted == 5 * len(want) and near.recall >= 0.9


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, None)], "id bigint, v array<double>")
    assert lists(NB.neighbours(NB.build(few, 5), few.where("id % 20 = 0"), 5)) == {0: [(20, 0.0)], 20: [(0, 0.0)]}
    assert NB.neighbours(NB.build(few.limit(0), 5), few, 5).count() == 0
    with pytest.raises(ValueError):
        NB.neighbours(NB.build(few, 2), few, 5)


def test_cells_grow_with_the_rows_and_few_are_looked_into(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, v array<double>")
    assert len(NB.build(frame.limit(1500), 5).centroids) < len(NB.build(frame, 5).centroids)
    index, asked = NB.build(frame, 5), []
    kept = NB._asked
    monkeypatch.setattr(NB, "_asked", lambda *a: asked.append(kept(*a)) or asked[-1])
    queries = frame.where("id % 20 = 0")
    got, want = lists(NB.neighbours(index, queries, 5)), brute([(i, v) for i, v in enumerate(x.tolist())], 5, 20)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    # After the first cells less than one more for each query is looked into: the spheres around the centroids alone leave more.
    assert asked[1].count() < len(want)
