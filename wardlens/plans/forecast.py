"""Monthly panel forecasting.

The reference forecasts one hospital-wide series at a time.  Here the
series are a panel keyed by (series_id, measure) — the whole hospital
('ALL') and every department, for admissions, mean stay and deaths:

* P1: one Spark aggregate per (series, month), months without admissions
  filled in from a per-series ``sequence`` of months;
* P3: a grid of parameters as rows, each with the squared residuals that it
  leaves, and the best row of each series; finer grids around it follow;
* P4: normal equations as grouped sums of products over all series at once,
  one small system solved for each series;
* P5: error metrics as Spark aggregates over the fitted values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.columns import month_start
from wardlens.session import cut_lineage

MEASURES = ["monthly_admissions", "avg_los", "monthly_mortality"]


def monthly_series(fact: DataFrame, by: str = "department") -> DataFrame:
    """(series_id, month, monthly_admissions, avg_los, monthly_mortality)."""
    ids = F.array(F.lit("ALL"), F.col(by).cast("string"))
    base = fact.select(F.explode(ids).alias("series_id"), month_start("doa").alias("month"), "mrd_no",
                       "length_of_stay", F.col("is_mortality_case").cast("int").alias("mortality_flag")) \
               .where(F.col("series_id").isNotNull() & F.col("month").isNotNull())
    g = base.groupBy("series_id", "month").agg(
        F.count("mrd_no").alias("monthly_admissions"), F.avg("length_of_stay").alias("avg_los"),
        F.sum("mortality_flag").alias("monthly_mortality"))
    span = g.groupBy("series_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select("series_id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    out = months.join(g, ["series_id", "month"], "left")
    return out.select("series_id", "month",
                      F.coalesce("monthly_admissions", F.lit(0)).cast("bigint").alias("monthly_admissions"),
                      "avg_los", F.coalesce("monthly_mortality", F.lit(0)).cast("bigint").alias("monthly_mortality"))


def trend_data(series: DataFrame) -> DataFrame:
    """Long form (series_id, month, measure, value) for charts and models."""
    return series.unpivot(["series_id", "month"], MEASURES, "measure", "value") \
                 .withColumn("value", F.col("value").cast("double"))


# --- seasonal model: a grid of parameters as rows ------------------------------------------------

#: Months of a season, and months that the model loses to differences.
SEASON = 12
LOST = SEASON + 1
#: Parameters are searched on a grid from -0.9 to 0.9, then on finer ones around the best so far.
COARSE, ROUNDS = 0.3, 4


def _residuals(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Residuals of differenced series (rows) under their parameters (rows of phi, theta, seasonal phi, seasonal theta); what lies before counts as 0."""
    s, (phi, theta, sphi, stheta) = SEASON, p.T
    x, e = np.pad(w, ((0, 0), (s + 1, 0))), np.zeros((len(w), w.shape[1] + s + 1))
    for t in range(s + 1, e.shape[1]):
        e[:, t] = x[:, t] - phi * x[:, t - 1] - sphi * x[:, t - s] + phi * sphi * x[:, t - s - 1] \
            - theta * e[:, t - 1] - stheta * e[:, t - s] - theta * stheta * e[:, t - s - 1]
    return e[:, s + 1:]


def _differences(y: np.ndarray) -> np.ndarray:
    """Monthly and yearly differences of series (rows)."""
    return y[:, LOST:] - y[:, SEASON:-1] - y[:, 1:-SEASON] + y[:, :-LOST]


def series_arrays(long: DataFrame) -> DataFrame:
    """``(series_id, measure, last, y)``: one row per series, its values by month.

    A month without a value takes the one on the line between its neighbours,
    or the nearest at an end.  A series is bounded by the calendar."""
    keys = ["series_id", "measure"]
    w = Window.partitionBy(*keys).orderBy("month")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.struct(_month_number(F.col("month")).alias("t"), "value"))
    d = long.withColumns({"lo": F.last(at, ignorenulls=True).over(before), "hi": F.first(at, ignorenulls=True).over(after)})
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    part = (_month_number(F.col("month")) - lo["t"]) / F.nullif(hi["t"] - lo["t"], F.lit(0))
    y = lo["value"] + (hi["value"] - lo["value"]) * F.coalesce(part, F.lit(0.0))
    rows = d.select(*keys, F.struct("month", y.alias("y")).alias("r"))
    return rows.groupBy(*keys).agg(F.max("r.month").alias("last"), F.transform(F.array_sort(F.collect_list("r")), lambda r: r["y"]).alias("y"))


def _css(candidates: DataFrame) -> DataFrame:
    """Candidates with ``css``, the sum of squared residuals after the first season."""
    def run(batches):
        for part in batches:
            css = np.full(len(part), np.inf)
            for n, own in part.groupby(part["y"].map(len)).indices.items():
                p = np.stack(part["p"].to_numpy()[own])
                e = _residuals(_differences(np.stack(part["y"].to_numpy()[own])), p)[:, LOST:]
                css[own] = np.where((np.abs(p) < 0.99).all(1), (e * e).sum(1), np.inf)
            yield part.assign(css=css)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in candidates.schema)
    return candidates.mapInPandas(run, kinds + ", css double")


def seasonal_model(long: DataFrame) -> DataFrame:
    """``(series_id, measure, last, y, p)``: the parameters of least squares for each series of 28 months or more.

    Every candidate is a row, so the search is spread over the cluster whatever
    the number of series; each round keeps the best row of a series (of equal
    ones, the least parameters)."""
    keys = ["series_id", "measure", "last", "y"]
    found = cut_lineage(series_arrays(long).where(F.size("y") > 2 * LOST + 1).withColumn("p", F.array(*[F.lit(0.0)] * 4)))
    step = COARSE
    for i in range(ROUNDS + 1):
        span = range(-3, 4) if not i else range(-2, 3)
        around = F.array(*[F.lit(k * step) for k in span])
        grid = found
        for k in range(4):
            grid = grid.withColumn(f"d{k}", F.explode(around))
        candidates = grid.select(*keys, F.array(*[F.col("p")[k] + F.col(f"d{k}") for k in range(4)]).alias("p"))
        found = cut_lineage(_css(candidates).groupBy(*keys).agg(F.min(F.struct("css", "p")).alias("b")).select(*keys, "b.p"))
        step /= 2.5
    return found


def seasonal_forecast(long: DataFrame, steps: int = 6) -> DataFrame:
    """``steps`` months ahead by SARIMA(1,1,1)(1,1,1,12) with a 95% band; a series that is too short gets nulls."""
    def run(batches):
        for part in batches:
            rows = []
            for i in range(len(part)):
                y = np.array(part["y"].iloc[i])
                p = part["p"].iloc[i]
                rows.append(_ahead(y, np.array(p), steps) if p is not None else [(None, None)] * steps)
            out = part.loc[part.index.repeat(steps), ["series_id", "measure", "last"]]
            yield out.assign(h=np.tile(np.arange(1, steps + 1, dtype=np.int32), len(part)), yhat=[x[0] for r in rows for x in r], sd=[x[1] for r in rows for x in r])
    keys = ["series_id", "measure"]
    each = series_arrays(long).join(seasonal_model(long).select(*keys, "p"), keys, "left")
    ahead = each.mapInPandas(run, "series_id string, measure string, last date, h int, yhat double, sd double")
    return ahead.select(*keys, F.lit("sarima").alias("model"), F.add_months("last", F.col("h")).alias("month"), "yhat",
                        (F.col("yhat") - _Z95 * F.col("sd")).alias("yhat_lower"), (F.col("yhat") + _Z95 * F.col("sd")).alias("yhat_upper"))


def _ahead(y: np.ndarray, p: np.ndarray, steps: int) -> list[tuple[float, float]]:
    """Forecasts of one series and their standard deviations."""
    s, (phi, theta, sphi, stheta) = SEASON, p
    w = _differences(y[None])
    e = _residuals(w, p[None])[0]
    w, e, y = list(w[0]), list(e), list(y)
    sigma2 = float(np.mean(np.square(e[LOST:])))
    out, psi = [], []
    # The weights of past shocks in the undifferenced series: from the product of all lag polynomials.
    ar = np.convolve(np.convolve([1, -phi], np.r_[1, np.zeros(s - 1), -sphi]), np.convolve([1, -1], np.r_[1, np.zeros(s - 1), -1]))
    ma = np.convolve([1, theta], np.r_[1, np.zeros(s - 1), stheta])
    for h in range(steps):
        w.append(phi * w[-1] + sphi * w[-s] - phi * sphi * w[-s - 1] + theta * e[-1] + stheta * e[-s] + theta * stheta * e[-s - 1])
        e.append(0.0)
        y.append(w[-1] + y[-1] + y[-s] - y[-s - 1])
        psi.append((ma[h] if h < len(ma) else 0.0) - sum(ar[i] * psi[h - i] for i in range(1, min(h, len(ar) - 1) + 1)))
        out.append((y[-1], float(np.sqrt(sigma2 * np.sum(np.square(psi))))))
    return out


# --- additive model: normal equations as grouped sums ------------------------------------------

#: A constant, a trend, and sine and cosine of the year and of its second and third parts.
TERMS = 8
_Z95 = 1.959963984540054


def _month_number(month):
    return F.year(month) * 12 + F.month(month)


def _terms(month, first, months):
    """The terms of the design at ``month`` for a series of ``months`` months from ``first``."""
    x = [F.lit(1.0), (_month_number(month) - _month_number(first)) / F.greatest(months - 1, F.lit(1))]
    for k in (1, 2, 3):
        turn = F.lit(2 * math.pi * k / 12.0) * F.month(month)
        x += [F.sin(turn), F.cos(turn)]
    return F.array(*x)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solved(xx: pd.Series, xy: pd.Series) -> pd.Series:
    """Least squares from sums of products: one small system for each series."""
    return pd.Series([np.linalg.lstsq(np.array(a).reshape(TERMS, TERMS), np.array(b), rcond=1e-12)[0] for a, b in zip(xx, xy, strict=True)])


def _spans(long: DataFrame) -> DataFrame:
    return long.groupBy("series_id", "measure").agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count(F.lit(1)).alias("months"))


def additive_model(long: DataFrame, holdout: int = 0) -> DataFrame:
    """``(series_id, measure, first, last, months, beta, sd)``: trend and yearly seasonality by least squares, one row per series.

    Months without a value, and the last ``holdout`` months, are left out of
    the sums.  A series with fewer than 3 values has no coefficients.
    """
    d = long.join(_spans(long), ["series_id", "measure"])
    d = d.where(F.col("value").isNotNull() & (F.col("month") <= F.add_months("last", -holdout))) \
        .select("*", _terms(F.col("month"), F.col("first"), F.col("months")).alias("x"))
    x = [F.col("x")[i] for i in range(TERMS)]
    upper = {(i, j): F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(TERMS) for j in range(i, TERMS)}
    sums = d.groupBy("series_id", "measure", "first", "last", "months").agg(
        F.count(F.lit(1)).alias("n"), *upper.values(), *[F.sum(x[i] * F.col("value")).alias(f"t{i}") for i in range(TERMS)])
    xx = F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(TERMS) for j in range(TERMS)])
    xy = F.array(*[F.col(f"t{i}") for i in range(TERMS)])
    fit = sums.where("n >= 3").select("series_id", "measure", "first", "last", "months", _solved(xx, xy).alias("beta"))
    gap = F.col("value") - _at(F.col("x"))
    left = d.join(fit.select("series_id", "measure", "beta"), ["series_id", "measure"]).groupBy("series_id", "measure").agg(
        F.sqrt(F.sum(gap * gap) / F.greatest(F.count(F.lit(1)) - TERMS, F.lit(1))).alias("sd"))
    return fit.join(left, ["series_id", "measure"])


def _at(x):
    return sum((x[i] * F.col("beta")[i] for i in range(TERMS)), F.lit(0.0))


def additive_forecast(long: DataFrame, steps: int = 6) -> DataFrame:
    """``steps`` months ahead of each series with a 95% band; a series without a model gets nulls."""
    ahead = _spans(long).join(additive_model(long).select("series_id", "measure", "beta", "sd"), ["series_id", "measure"], "left") \
        .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("month", F.add_months("last", F.col("h")))
    yhat = _at(_terms(F.col("month"), F.col("first"), F.col("months")))
    return ahead.withColumn("yhat", yhat).select("series_id", "measure", F.lit("additive").alias("model"), "month", "yhat",
                                                 (F.col("yhat") - _Z95 * F.col("sd")).alias("yhat_lower"), (F.col("yhat") + _Z95 * F.col("sd")).alias("yhat_upper"))


def forecast(long: DataFrame, model: str = "sarima", steps: int = 6) -> DataFrame:
    """6-month forecasts with a 95% band for every (series, measure)."""
    return (additive_forecast if model == "additive" else seasonal_forecast)(long, steps)


def fitted_values(long: DataFrame, holdout: int = 6) -> DataFrame:
    """Additive model: in-sample fitted values on all months, plus a true
    holdout prediction for the last ``holdout`` months (fit on the rest)."""
    keys = ["series_id", "measure"]
    whole, rest = (additive_model(long, n).select(*keys, F.col("beta").alias(name)) for n, name in ((0, "whole"), (holdout, "rest")))
    d = long.join(_spans(long), keys).join(whole, keys, "left").join(rest, keys, "left") \
        .withColumn("x", _terms(F.col("month"), F.col("first"), F.col("months")))
    held = F.when(F.col("month") > F.add_months("last", -holdout), _at(F.col("x")))
    return d.withColumnRenamed("whole", "beta").withColumn("fitted", _at(F.col("x"))).drop("beta").withColumnRenamed("rest", "beta") \
        .select(*keys, "month", F.col("value").alias("y"), "fitted", held.alias("holdout_pred"))


def forecast_eval(fitted: DataFrame, last_n: int = 6) -> DataFrame:
    """MAE / RMSE on each series' last ``last_n`` months: in-sample (the
    reference's comparison) and holdout."""
    # <= one row per month per series: the window sees a calendar-bounded group.
    w = Window.partitionBy("series_id", "measure").orderBy(F.desc("month"))
    f = fitted.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= last_n)
    rows = f.select("series_id", "measure", F.explode(F.array(
        F.struct(F.lit("insample").alias("mode"), (F.col("fitted") - F.col("y")).alias("err")),
        F.struct(F.lit("holdout").alias("mode"), (F.col("holdout_pred") - F.col("y")).alias("err")))).alias("s"))
    return rows.groupBy("series_id", "measure", "s.mode").agg(
        F.avg(F.abs("s.err")).alias("mae"), F.sqrt(F.avg(F.col("s.err") * F.col("s.err"))).alias("rmse"))
