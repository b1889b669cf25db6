import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from wardlens.plans.explain import shap_summary, shapley_values


def test_shapley_exact_for_linear_model(spark):
    rows = [(i, float(i % 5), float((i * 7) % 3), 2.0 * (i % 5) - 1.0 * ((i * 7) % 3) + 0.5 + 0.01 * (i % 2))
            for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    lr = LinearRegression(featuresCol="features", labelCol="y").fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    means = {"a": sum(r[1] for r in rows) / len(rows), "b": sum(r[2] for r in rows) / len(rows)}
    coef = dict(zip(["a", "b"], lr.coefficients.toArray()))
    phi = shapley_values(lr, df, ["a", "b"], "id", permutations=3, output="prediction").collect()
    assert len(phi) == 2 * len(rows)
    for r in phi:
        assert r.phi == pytest.approx(coef[r.feature] * (r.value - means[r.feature]), abs=1e-9)
    summary = {r.feature: r.mean_abs_phi for r in shap_summary(
        shapley_values(lr, df, ["a", "b"], "id", permutations=2, output="prediction")).collect()}
    assert set(summary) == {"a", "b"}


def test_local_surrogate_recovers_linear_slopes(spark):
    import statistics

    from wardlens.plans.explain import local_surrogate
    rows = [(i, float(i % 11), float((i * 7) % 5), 3.0 * (i % 11) - 2.0 * ((i * 7) % 5) + 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    lr = LinearRegression(featuresCol="features", labelCol="y", regParam=0.0).fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    out = {r.feature: r.weight for r in local_surrogate(lr, df, df.where("id = 5"), ["a", "b"], "id",
                                                         samples=2000, output="prediction").collect()}
    sd = {"a": statistics.pstdev(r[1] for r in rows), "b": statistics.pstdev(r[2] for r in rows)}
    assert out["a"] == pytest.approx(3.0 * sd["a"], rel=0.02)
    assert out["b"] == pytest.approx(-2.0 * sd["b"], rel=0.02)


def test_signed_credits_add_up_on_boosted_trees(spark):
    from pyspark.ml.regression import GBTRegressor
    rows = [(i, float(i % 7), float((i * 5) % 11), float((i * 3) % 4), float((i % 7) * ((i * 5) % 11) + (i % 4))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    model = GBTRegressor(featuresCol="features", labelCol="y", maxIter=5, seed=1).fit(data)
    out = shapley_values(model, df, names, "id", permutations=4, output="prediction")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    means = [sum(r[k] for r in rows) / len(rows) for k in (1, 2, 3)]
    base = model.predict(VectorAssembler(inputCols=names, outputCol="f").transform(spark.createDataFrame([tuple(means)], "a double, b double, c double")).first().f)
    total, value = {}, {}
    for r in out.collect():
        total[r.id] = total.get(r.id, 0.0) + r.phi
        value[r.id, r.feature] = r.value
    for r in model.transform(data).collect():
        assert total[r.id] == pytest.approx(r.prediction - base, abs=1e-9) and value[r.id, "b"] == r.b


def test_walk_down_the_trees_equals_scores_of_every_prefix(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorIndexer
    from pyspark.sql import functions as F

    from wardlens.plans import explain
    rows = [(i // 2 if i < 20 else None if i == 20 else i, float(i % 7), float((i * 5) % 11), float((i * 3) % 3), float((i % 7) * ((i * 5) % 11) + 9 * (i % 3 == 1) > 20))
            for i in range(150)]  # ids that come twice and a null one
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    names = ["a", "b", "c"]
    data = VectorAssembler(inputCols=names, outputCol="raw").transform(df)
    data = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=3).fit(data).transform(data)
    model = GBTClassifier(featuresCol="features", labelCol="y", maxIter=5, seed=1).fit(data)
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(3)]
    walk, switch = ({r["__id"]: r for r in each(model, df, names, "id", 4, 42, "probability").groupBy("__id").agg(*sums).collect()}
                    for each in (explain._walked, explain._switched))
    assert walk.keys() == switch.keys() and None in walk and len(walk) == 140
    for i, r in walk.items():
        assert [r.p0, r.p1, r.p2] == pytest.approx([switch[i].p0, switch[i].p1, switch[i].p2], abs=1e-9)
    out = shapley_values(model, df, names, "id", permutations=4)
    assert out.count() == 3 * 140
    # No row comes out of the scores but one for each explained row.
    assert "Generate explode" not in explain._walked(model, df, names, "id", 4, 42, "probability")._jdf.queryExecution().optimizedPlan().toString()
