"""Whitening of embeddings by a bidiagonal qd solver.

Vectors are put on a grid of whole numbers, so their count and sums are exact.
Each task reduces the centred distinct vectors it holds to a triangle R by QR,
block after block; triangles are stacked and reduced again, some at a time,
until one is left.  Its R'R is n times the covariance, which is never formed.

R, as small as the dimension, is brought to a bidiagonal B by Householder
reflections.  The differential qd algorithm with shifts finds the squares of
B's singular values: a plain step gives the trace of the inverse, and so a
shift that is safely below the least of them.  For each of the largest, B'B
less the square is factorised from both ends; the twist where the two meet
best gives the direction, and a Rayleigh quotient the last digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.storage import discard, stored

COMPONENTS = 16
#: Vectors go on a grid of this many steps a unit, moved by this offset.
STEPS, OFFSET = 64, 1_000_000
#: An entry of this size or more counts as one that is not finite: sums and squares of smaller ones can be told exactly.
LARGEST = float(1 << 40)
#: Triangles that are reduced together.
TOGETHER = 16
#: Neighbours closer than this share of their size are made orthogonal by themselves.
CLOSE = 1e-5

_EPS = float(np.finfo(float).eps)


# --- the small problem -----------------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: ``(diagonal, above, w)`` of B = U' r w, U and w orthogonal."""
    a, d = np.array(r, float), r.shape[1]
    w = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = v @ v
        return v, 2 / size if size else 0.0

    for k in range(d):
        v, c = reflector(a[k:, k])
        a[k:, k:] -= c * np.outer(v, v @ a[k:, k:])
        if k + 2 < d:
            v, c = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= c * np.outer(a[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= c * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd step: the new ``q, e`` and the differences; None if the shift is above the least value."""
    d, new_q, new_e, ds = q[0] - shift, [], [], []
    for i in range(len(e)):
        ds.append(d)
        if d < 0:
            return None
        top = d + e[i]
        ratio = q[i + 1] / top if top else 0.0
        new_q.append(top)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    ds.append(d)
    return None if d < 0 else (new_q + [d], new_e, ds)


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of the singular values of a bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if not scale:
        return np.zeros(len(diagonal))
    # No q is quite zero: so small a change is below what the reflections have rounded.
    blocks = [((np.maximum(np.abs(diagonal / scale), _EPS) ** 2).tolist(), ((above / scale) ** 2).tolist(), 0.0)]
    found: list[float] = []
    while blocks:
        q, e, moved = blocks.pop()
        while q:
            cut = [i for i in range(len(e)) if e[i] <= _EPS * _EPS * (moved + q[i + 1])]
            if cut:
                i = cut[-1]
                if i < len(q) - 2:
                    blocks.append((q[:i + 1], e[:i], moved))
                    q, e = q[i + 1:], e[i + 1:]
                else:
                    found.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                continue
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if q[0] < q[-1]:  # the small end belongs at the bottom
                q, e = q[::-1], e[::-1]
            plain = _step(q, e, 0.0)
            q, e, ds = plain
            if min(ds) <= 0:
                continue
            shift = (1 - 8 * _EPS) / sum(1 / d for d in ds)
            shifted = _step(q, e, shift)
            while shifted is None:
                shift = shift / 2 if shift > _EPS * (moved + shift) else 0.0
                shifted = _step(q, e, shift)
            q, e, _ = shifted
            moved += shift
    return np.sort(np.array(found))[::-1] * scale ** 2


def twisted_vectors(diagonal: np.ndarray, above: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors of B'B for its eigenvalues ``squares``, falling, and the eigenvalues improved by them."""
    n, scale = len(diagonal), np.abs(diagonal).max(initial=0.0)
    a = np.where(np.abs(diagonal) < _EPS * scale, _EPS * scale, diagonal)
    q, e, off, tiny = a * a, above * above, a[:-1] * above, (_EPS * scale) ** 2 * _EPS or 1e-300
    out, values = np.zeros((len(squares), n)), np.array(squares, float)

    def factorised(x: float):
        """The multipliers from the top and from the bottom, and what is left at each twist."""
        s, p, up, down = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
        s[0], p[-1] = -x, q[-1] - x
        for i in range(n - 1):
            pivot = s[i] + q[i] or tiny
            up[i] = off[i] / pivot
            s[i + 1] = e[i] * (s[i] / pivot) - x
        for i in range(n - 2, -1, -1):
            pivot = e[i] + p[i + 1] or tiny
            down[i] = off[i] / pivot
            p[i] = p[i + 1] * (q[i] / pivot) - x
        return up, down, s + p + x

    def vector(up, down, k: int) -> np.ndarray:
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -up[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -down[i] * z[i]
        return z

    for j, x in enumerate(values):
        for _ in range(4):
            up, down, left = factorised(x)
            k = int(np.argmin(np.abs(left)))
            z = vector(up, down, k)
            better = max(0.0, x + left[k] / (z @ z))
            if abs(better - x) <= 2 * _EPS * abs(x):
                break
            if any(abs(better - y) < abs(x - y) / 2 for i, y in enumerate(values) if abs(i - j) == 1):
                break  # it would run into a neighbour
            x = better
        values[j] = x
        near = [i for i in range(j) if values[i] - x <= CLOSE * values[i]]
        for k in np.argsort(np.abs(left)) if near else [k]:
            z = vector(up, down, k)
            z /= np.linalg.norm(z)
            for _ in range(2 if near else 0):
                z -= out[near].T @ (out[near] @ z)
            if np.linalg.norm(z) > 0.1:
                break
        out[j] = z / np.linalg.norm(z)
    return out, values


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """``(variances, directions, total)``: the largest eigenvalues of r'r / n, falling, their unit eigenvectors as rows, and the trace.

    The sign of a direction makes its largest entry positive.
    """
    diagonal, above, w = bidiagonal(r)
    most = min(most, len(diagonal))
    squares = squared_singular_values(diagonal, above)[:most]
    vectors, squares = twisted_vectors(diagonal, above, squares)
    directions = vectors @ w.T
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    directions *= np.sign(directions[np.arange(most), np.abs(directions).argmax(1)])[:, None]
    total = float((r * r).sum())
    # What is left by rounding of a direction without variance is none.
    squares = np.where(squares <= len(diagonal) * _EPS * _EPS * 1e4 * max(total, 0.0), 0.0, squares)
    return squares / n, directions, total / n


# --- the tables ------------------------------------------------------------------------------

@dataclass
class Whitening:
    """What was fitted: numbers of the size of one vector or a few."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``n * x - sums`` exactly, and the same over n."""
        sums = np.array(self.sums, object)
        wide = self.n * int(np.abs(x).max(initial=0)) >= 1 << 61
        exact = self.n * (x.astype(object) if wide else x) - (sums if wide else sums.astype(np.int64))
        return exact, exact.astype(float) / self.n

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Whitened components of centred vectors; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, centred @ self.directions.T / np.sqrt(self.variances), np.nan)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def on_grid(vectors: DataFrame, steps: int = STEPS, offset: int = OFFSET) -> DataFrame:
    """``(vec_id, x)`` of the rows of ``vectors(vec_id, embedding, ...)`` whose embedding is whole.

    Not whole are a null or empty vector, one with an entry that is null, not
    finite or of ``LARGEST`` and more, and one of another length than most
    have (of two lengths that are as frequent, the longer counts).
    """
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")) \
        .where(F.coalesce((F.size("v") > 0) & whole, F.lit(False)))
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is not None:
        good = good.where(F.size("v") == usual["d"])
    return good.select("vec_id", F.transform("v", lambda c: F.floor(c * steps) + offset).alias("x"))


def _triangles(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred vectors: one triangle a task, then ``TOGETHER`` triangles to one until one is left."""
    d, own = len(sums), Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    names, kinds = ["at", "r"], "at long, r array<double>"

    def reduced(blocks):
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.vstack((r, block)), mode="r")
        return r

    def row(at: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=names)

    def first(batches):
        from pyspark import TaskContext
        r = reduced(own.centred(_matrix(b.column("x").slice(i, 4096)))[1] for b in batches for i in range(0, len(b), 4096))
        if len(r):
            yield row(TaskContext.get().partitionId(), r)

    def joined(group: pa.Table) -> pa.Table:
        at = group.column("at")[0].as_py() // TOGETHER
        parts = sorted(zip(group.column("at").to_pylist(), group.column("r").to_pylist(), strict=True))
        return pa.Table.from_batches([row(at, reduced(np.array(r).reshape(-1, d) for _, r in parts))])

    found = made = stored(vectors.select("x").mapInArrow(first, kinds), "triangles")
    last = found.agg(F.max("at")).first()[0]
    while last:
        found = found.groupBy(F.expr(f"at div {TOGETHER}").alias("of")).applyInArrow(joined, kinds)
        last //= TOGETHER
    r = np.array(found.first()["r"]).reshape(-1, d)
    discard(made)
    return np.vstack((r, np.zeros((max(0, d - len(r)), d))))


def fit(rows: DataFrame, most: int = COMPONENTS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of ``rows(x)``, each distinct vector counted once, and the table of those; None without rows."""
    distinct = stored(rows.select("x").distinct(), "vectors")

    def summed(batches):
        total, n = None, 0
        for batch in batches:
            own = _matrix(batch.column("x"))
            total = own.sum(0) if total is None else total + own.sum(0)
            n += len(batch)
        if n:
            # The count goes as one more dimension.
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], names=["i", "s"])
    sums = {r["i"]: int(r["s"]) for r in distinct.mapInArrow(summed, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    if not sums:
        return None
    n, sums = sums[-1], [sums[i] for i in range(len(sums) - 1)]
    return Whitening(n, sums, *components(_triangles(distinct, n, sums), n, most)), distinct


def identity_error(found: Whitening, distinct: DataFrame) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over the components that vary; None without any."""
    able = np.flatnonzero(found.variances > 0)
    k = len(able)

    def products(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            for i in range(0, len(batch), 4096):
                w = found.projected(found.centred(_matrix(batch.column("x").slice(i, 4096)))[1])[:, able]
                total += np.concatenate((w.sum(0), (w.T @ w).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "s"])
    if not k:
        return None
    sums = {r["i"]: r["s"] / found.n for r in distinct.mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    mean, square = np.array([sums[i] for i in range(k)]), np.array([sums[i] for i in range(k, k + k * k)]).reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each whole row of ``vectors(vec_id, embedding, ...)`` and component.

    Rows that are not whole (see ``on_grid``) have no result.  Repeated rows
    are returned each, though a vector counts once in the fit.  A null vec_id
    is passed through; other columns are ignored; an empty table gives an
    empty result.  There are as many components as ``most`` and the dimension
    allow.  One without variance has a null ``whitened`` and explains 0; with
    no variance at all ``explained`` and ``identity_error`` are null.
    ``deviation`` is null where it passes the range of a long.
    """
    rows = on_grid(vectors)
    fitted = fit(rows, most)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], kinds)
    model, distinct = fitted
    error, k = identity_error(model, distinct), len(model.variances)
    discard(distinct)

    def run(batches):
        explained = pa.array(model.variances / model.total if model.total > 0 else [None] * k, pa.float64())
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                exact, centred = model.centred(_matrix(part.column("x")))
                wide = (exact.astype(float) ** 2).sum(1) >= 9e18
                safe = np.where(wide[:, None], 0, exact)
                deviation = pa.array(np.where(wide, 0, (safe * safe).sum(1)).astype(np.int64), pa.int64(), mask=wide)
                w = model.projected(centred).ravel()
                of = pa.array(np.repeat(np.arange(len(part)), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.array(np.full(len(of), model.n)),
                     deviation.take(of), pa.array(w, mask=np.isnan(w)), explained.take(pa.array(np.tile(np.arange(k), len(part)))),
                     pa.array([error] * len(of), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, kinds)
