"""Model attributions: permutation-sampling Shapley values (N1-N3).

For every explained row, ``permutations`` feature orders are drawn from a
hash of (row, permutation, feature) — deterministic under any partitioning.
Along each order the features switch one at a time from the baseline (the
feature means) to the row's values, and each feature's attribution is the
score change when it switches, averaged over the orders.  Per order the
changes telescope, so sum(phi) = f(x) - f(baseline) exactly.

Of boosted trees a leaf is reached while certain features have switched and
certain others have not, so it counts from one step of an order to another.
Those steps give the scores of all prefixes of all orders in one walk down
each tree, batch by batch.  Any other model scores the F+1 prefixes in a
``transform`` over exploded rows: each score counts for the feature that
switched last and against the next one.  Either way there is one row for each
explained one to shuffle, and neither a window nor a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that walk down the trees at once.
WALK_ROWS = 4096


def shapley_values(model, df: DataFrame, features: list[str], id_col: str, permutations: int = 8,
                   seed: int = 42, output: str = "probability") -> DataFrame:
    """(id, feature, phi, value) for every row of ``df``.

    ``model``: a fitted MLlib model whose input is a ``features`` vector
    column in the order of ``features``.  ``output``: 'probability' (class-1
    probability) or 'prediction'."""
    boosted = isinstance(model, GBTRegressionModel) and output == "prediction" or isinstance(model, GBTClassificationModel) and output == "probability"
    each = _walked if boosted else _switched
    parts = each(model, df, features, id_col, permutations, seed, output)
    # Rows of one id count together.  They are dealt out by id before, so the sums of a task stay few whatever the size of the input's files.
    sums = [F.sum(F.col(f"p{i}")).alias(f"p{i}") for i in range(len(features))]
    values = [F.any_value(F.col(f"v{i}")).alias(f"v{i}") for i in range(len(features))]
    phi = parts.groupBy("__id").agg(*sums, *values)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"p{i}") / permutations).alias("phi"), F.col(f"v{i}").alias("value"))
                     for i, f in enumerate(features)])
    return phi.select(F.col("__id").alias(id_col), F.explode(rows).alias("s")).select(id_col, "s.*")


def _baseline(df: DataFrame, features: list[str]):
    return df.agg(F.struct(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).alias("b"))


def _switched(model, df: DataFrame, features: list[str], id_col: str, permutations: int, seed: int, output: str) -> DataFrame:
    """``(__id, p0.., v0..)``: the credits of any model's scores, one row for each order and step."""
    nf = len(features)
    base = _baseline(df, features).scalar()
    e = df.select(F.col(id_col).alias("__id"), *[F.col(f).cast("double").alias(f) for f in features]).hint("rebalance", "__id")
    e = e.withColumn("__perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    keyed = F.array(*[F.struct(F.xxhash64(F.col("__id"), F.col("__perm"), F.lit(i), F.lit(seed)).alias("h"),
                               F.lit(i).alias("f")) for i in range(nf)])
    e = e.withColumn("__order", F.transform(F.array_sort(keyed), lambda s: s["f"]))
    e = e.withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(nf))))
    vals = [F.when(F.array_position(F.col("__order"), i) <= F.col("__j"), F.col(f)).otherwise(base.getField(f))
            for i, f in enumerate(features)]
    scored = model.transform(e.withColumn("features", array_to_vector(F.array(*vals))))
    score = vector_to_array("probability")[1] if output == "probability" else F.col("prediction")
    # A score is what the feature that switched last has reached, and what the next one starts from: it counts for the one and against the other.
    order, j = F.col("__order"), F.col("__j")
    s = scored.select("__id", *features, score.alias("__s"), F.when(j > 0, F.get(order, j - 1)).alias("__last"), F.when(j < nf, F.get(order, j)).alias("__next"))
    credits = [F.when(F.col("__last") == i, F.col("__s")).when(F.col("__next") == i, -F.col("__s")).otherwise(0.0).alias(f"p{i}") for i in range(nf)]
    return s.select("__id", *credits, *[F.col(f).alias(f"v{i}") for i, f in enumerate(features)])


def _tree(node):
    """A fitted tree in plain values: a leaf's score, or (feature, threshold or the categories that go left, left, right)."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    if "Categorical" in split.getClass().getSimpleName():
        # As MLlib does, the shorter list decides, and a value of no category goes to the other side.
        left, right = list(split.leftCategories()), list(split.rightCategories())
        rule = ("in", np.array(left)) if len(left) <= (len(left) + len(right)) // 2 else ("not in", np.array(right))
    else:
        rule = ("<=", float(split.threshold()))
    return split.featureIndex(), rule, _tree(node.leftChild()), _tree(node.rightChild())


def _goes_left(rule, x: np.ndarray) -> np.ndarray:
    kind, at = rule
    return x <= at if kind == "<=" else np.isin(x, at, invert=kind == "not in")


def _steps(tree, weight: float, x: np.ndarray, base: np.ndarray, place: np.ndarray, change: np.ndarray) -> None:
    """Add to ``change[row, order, step]`` what the tree's score changes by when a step of an order is taken.

    ``place[row, order, feature]`` is the step, from 1, at which a feature
    switches.  A leaf counts from the step at which the last feature that it
    needs has switched until the first one that it must not have switched.
    """
    n, orders, nf = place.shape
    flat, width = change.reshape(-1), nf + 2
    todo = [(tree, np.arange(n), np.zeros((n, orders), np.int8), np.full((n, orders), nf + 1, np.int8))]
    while todo:
        node, rows, first, end = todo.pop()
        if not isinstance(node, tuple):
            at, order = np.nonzero(first < end)
            # A row comes to a leaf once, so no place is added to twice.
            line = (rows[at] * orders + order) * width
            flat[line + first[at, order]] += weight * node
            flat[line + end[at, order]] -= weight * node
            continue
        feature, rule, left, right = node
        own = _goes_left(rule, x[rows, feature])
        base_left = bool(_goes_left(rule, base[feature:feature + 1])[0])
        step = place[rows, :, feature]
        near, far = (left, right) if base_left else (right, left)
        parts = own != base_left  # those whose own value leaves the baseline's side: that side is theirs until the feature switches
        todo.append((near, rows, first, np.where(parts[:, None], np.minimum(end, step), end)))
        if parts.any():
            todo.append((far, rows[parts], np.maximum(first[parts], step[parts]), end[parts]))


def _walked(model, df: DataFrame, features: list[str], id_col: str, permutations: int, seed: int, output: str) -> DataFrame:
    """``(__id, p0.., v0..)`` of boosted trees: each task walks its rows down the trees, all orders at once."""
    nf = len(features)
    trees = [(_tree(t._call_java("rootNode")), float(w)) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    means = _baseline(df, features).first()["b"]
    base = np.array([np.nan if v is None else v for v in means], float)
    hashes = F.array(*[F.xxhash64(F.col("__id"), F.lit(p), F.lit(i), F.lit(seed)) for p in range(permutations) for i in range(nf)])
    rows = df.select(F.col(id_col).alias("__id"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(features)])
    names = [*(f"p{i}" for i in range(nf)), *(f"v{i}" for i in range(nf))]

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), WALK_ROWS):
                batch = whole.slice(at, WALK_ROWS)
                x = np.stack([batch.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(nf)], 1).astype(float)
                keys = batch.column("__keys").flatten().to_numpy().reshape(len(batch), permutations, nf)
                order = np.argsort(keys, axis=2, kind="stable")
                place = np.empty(order.shape, np.int8)
                np.put_along_axis(place, order, np.arange(1, nf + 1, dtype=np.int8)[None, None], 2)
                change = np.zeros((len(batch), permutations, nf + 2))
                for tree, weight in trees:
                    _steps(tree, weight, x, base, place, change)
                score = np.cumsum(change[:, :, :nf + 1], axis=2)
                if output == "probability":
                    score = 1 - 1 / (1 + np.exp(2 * score))
                # The change at a step is its feature's.
                phi = np.zeros((len(batch), permutations, nf))
                np.put_along_axis(phi, order, np.diff(score, axis=2), 2)
                yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(c) for c in phi.sum(1).T), *(batch.column(f"v{i}") for i in range(nf))],
                                                 names=["__id", *names])
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.withColumn("__keys", hashes).mapInArrow(run, f"__id {kind}, " + ", ".join(f"{c} double" for c in names)).hint("rebalance", "__id")


def shap_summary(phi: DataFrame) -> DataFrame:
    """Global importance: mean |phi| per feature, largest first."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"),
                                      F.avg("phi").alias("mean_phi")).orderBy(F.desc("mean_abs_phi"))


def shap_dependence(phi: DataFrame, feature: str = "urea", bins: int = 20) -> DataFrame:
    """Attribution against the feature's value, as (bin, value range, mean
    phi, rows) over equal-width value bins."""
    p = phi.where(F.col("feature") == feature)
    st = p.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("s")).scalar()
    width = (st.getField("hi") - st.getField("lo")) / bins
    b = F.least(F.floor((F.col("value") - st.getField("lo")) / F.when(width > 0, width).otherwise(F.lit(1.0))),
                F.lit(bins - 1)).cast("int")
    return p.groupBy(b.alias("bin")).agg(F.min("value").alias("value_min"), F.max("value").alias("value_max"),
                                         F.avg("phi").alias("mean_phi"), F.count(F.lit(1)).alias("rows"))


# --- N4 local surrogate ------------------------------------------------------------------

def _hash_normal(*cols, seed: int):
    """Standard normal from two hash-derived uniforms (Box-Muller):
    deterministic per (cols, seed) on any partitioning."""
    two64 = 18446744073709551616.0

    def u(salt):
        h = F.xxhash64(*cols, F.lit(seed), F.lit(salt)).cast("double")
        return (h + 9223372036854775808.0 + 0.5) / two64
    return F.sqrt(-2.0 * F.log(u(1))) * F.cos(2.0 * 3.141592653589793 * u(2))


def local_surrogate(model, train: DataFrame, instances: DataFrame, features: list[str], id_col: str,
                    samples: int = 5000, num_features: int = 10, ridge: float = 1.0, seed: int = 42,
                    output: str = "probability") -> DataFrame:
    """LIME-style explanation of each row of ``instances``: ``samples``
    Gaussian perturbations around the training means (scaled by training
    population sd; the first sample is the instance itself), exponential
    kernel of width 0.75*sqrt(F) on scaled distance, weighted ridge on the
    scaled samples; the ``num_features`` largest |coef * scaled instance|
    are kept and the ridge is refitted on them.  Returns
    (id, feature, weight, intercept).  The regression uses sufficient
    statistics aggregated per instance; only a F x F solve runs in Python."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    nf = len(features)
    st = train.agg(F.struct(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f)
                              for f in features])).scalar()
    inst = instances.select(F.col(id_col).alias("__id"), *[F.col(f).cast("double").alias(f) for f in features])
    e = inst.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    xs, zs = [], []
    for f in features:
        m, s = st.getField(f).getField("m"), st.getField(f).getField("s")
        sd = F.when(s > 0, s).otherwise(F.lit(1.0))
        draw = _hash_normal(F.col("__id"), F.col("__k"), F.lit(f), seed=seed) * sd + m
        x = F.when(F.col("__k") == 0, F.col(f)).otherwise(draw)
        xs.append(x.alias(f"__x_{f}"))
        zs.append(((F.col(f"__x_{f}") - m) / sd).alias(f"__z_{f}"))
        zs.append(((F.col(f) - m) / sd).alias(f"__zi_{f}"))
    e = e.select("__id", "__k", *features, *xs).select("__id", "__k", *[F.col(f"__x_{f}") for f in features], *zs)
    e = e.withColumn("features", array_to_vector(F.array(*[F.col(f"__x_{f}") for f in features])))
    sc = model.transform(e)
    y = vector_to_array("probability")[1] if output == "probability" else F.col("prediction")
    width = 0.75 * (nf ** 0.5)
    d2 = sum(((F.col(f"__z_{f}") - F.col(f"__zi_{f}")) ** 2 for f in features), F.lit(0.0))
    w = F.sqrt(F.exp(-d2 / (width * width)))
    sc = sc.select("__id", y.alias("__y"), w.alias("__w"), *[F.col(f"__z_{f}").alias(f"z{i}")
                                                              for i, f in enumerate(features)],
                   *[F.col(f"__zi_{f}").alias(f"zi{i}") for i, f in enumerate(features)])
    aggs = [F.sum("__w").alias("sw"), F.sum(F.col("__w") * F.col("__y")).alias("swy")]
    aggs += [F.first(f"zi{i}").alias(f"zi{i}") for i in range(nf)]
    aggs += [F.sum(F.col("__w") * F.col(f"z{i}")).alias(f"sx{i}") for i in range(nf)]
    aggs += [F.sum(F.col("__w") * F.col(f"z{i}") * F.col("__y")).alias(f"sxy{i}") for i in range(nf)]
    aggs += [F.sum(F.col("__w") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"sxx{i}_{j}")
             for i in range(nf) for j in range(i, nf)]
    stats = sc.groupBy("__id").agg(*aggs)
    schema = T.StructType([T.StructField(id_col, instances.schema[id_col].dataType),
                           T.StructField("feature", T.StringType()), T.StructField("weight", T.DoubleType()),
                           T.StructField("intercept", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        sw, swy = r["sw"], r["swy"]
        sx = np.array([r[f"sx{i}"] for i in range(nf)])
        sxy = np.array([r[f"sxy{i}"] for i in range(nf)])
        sxx = np.zeros((nf, nf))
        for i in range(nf):
            for j in range(i, nf):
                sxx[i, j] = sxx[j, i] = r[f"sxx{i}_{j}"]
        zi = np.array([r[f"zi{i}"] for i in range(nf)])
        cxx = sxx - np.outer(sx, sx) / sw   # weighted, centred (intercept not penalised)
        cxy = sxy - sx * swy / sw

        def fit(idx):
            a = cxx[np.ix_(idx, idx)] + ridge * np.eye(len(idx))
            coef = np.linalg.solve(a, cxy[idx])
            icpt = (swy - sx[idx] @ coef) / sw
            return coef, icpt
        coef, _ = fit(list(range(nf)))
        keep = sorted(np.argsort(-np.abs(coef * zi))[:num_features].tolist())
        coef, icpt = fit(keep)
        return pd.DataFrame({id_col: r["__id"], "feature": [features[i] for i in keep], "weight": coef,
                             "intercept": icpt})
    return stats.groupBy("__id").applyInPandas(solve, schema)
