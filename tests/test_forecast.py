"""Forecasts on made series: what the models recover, months without values, short series."""

import datetime as dt
import math

import numpy as np
import pytest

from wardlens.plans import forecast as FC


def _long(spark, series):
    rows = []
    for name, values in series.items():
        for t, v in enumerate(values):
            rows.append((name, dt.date(2015 + t // 12, t % 12 + 1, 1), "m", None if v is None else float(v)))
    return spark.createDataFrame(rows, "series_id string, month date, measure string, value double")


def _curve(t):
    return 50 + 0.4 * t + 6 * math.sin(2 * math.pi * (t % 12 + 1) / 12) - 2 * math.cos(4 * math.pi * (t % 12 + 1) / 12)


def test_additive_model_recovers_its_terms(spark):
    whole, holes = [_curve(t) for t in range(60)], [None if t in (0, 7, 30, 59) else _curve(t) for t in range(60)]
    long = _long(spark, {"whole": whole, "holes": holes, "short": [1.0, None], "none": [None, None]})
    got = {}
    for r in FC.forecast(long, "additive").orderBy("month").collect():
        got.setdefault(r.series_id, []).append((r.yhat, r.yhat_lower))
    for name in ("whole", "holes"):
        assert [y for y, _ in got[name]] == pytest.approx([_curve(t) for t in range(60, 66)], abs=1e-6)
    assert got["short"] == got["none"] == [(None, None)] * 6
    errors = {(r.series_id, r.mode): r.mae for r in FC.forecast_eval(FC.fitted_values(long)).collect()}
    assert errors["whole", "holdout"] == pytest.approx(0, abs=1e-6) and errors["holes", "insample"] == pytest.approx(0, abs=1e-6)


def test_seasonal_model(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(size=108)
    w = np.zeros(108)
    for t in range(1, 108):
        w[t] = 0.6 * w[t - 1] + e[t]
    y = np.zeros(108)
    y[:13] = 100 + rng.normal(size=13)
    for t in range(13, 108):
        y[t] = w[t] + y[t - 1] + y[t - 12] - y[t - 13]
    holes = [None if t in (0, 50, 51) else v for t, v in enumerate(y)]
    long = _long(spark, {"whole": y, "holes": holes, "short": [1.0] * 20, "flat": [7.0] * 40})
    arrays = {r.series_id: r.y for r in FC.series_arrays(long).collect()}
    assert arrays["holes"][50] == pytest.approx(y[49] + (y[52] - y[49]) / 3) and arrays["holes"][0] == y[1]
    model = {r.series_id: r.p for r in FC.seasonal_model(long.where("series_id <> 'holes'")).collect()}
    assert set(model) == {"whole", "flat"}

    def css(p):
        r = FC._residuals(FC._differences(y[None]), np.array([p]))[0, FC.LOST:]
        return float(r @ r)
    best = css(model["whole"])
    assert abs(model["whole"][0] + model["whole"][1] - 0.6) < 0.4
    assert all(best <= css(np.clip(np.array(model["whole"]) + d, -0.98, 0.98)) + 1e-3 * best for d in rng.normal(size=(200, 4)) * 0.2)
    got = {}
    for r in FC.forecast(long, "sarima").orderBy("month").collect():
        got.setdefault(r.series_id, []).append(r)
    assert all(r.yhat is None for r in got["short"]) and [r.yhat for r in got["flat"]] == pytest.approx([7.0] * 6)
    assert all(r.yhat_lower < r.yhat < r.yhat_upper for r in got["whole"] + got["holes"]) and got["short"][0].month == dt.date(2016, 9, 1)
