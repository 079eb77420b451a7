"""The fitted forecasters: against plain loops, without leaks, on short and empty input."""

import datetime as dt

import numpy as np
import pytest

from mensura.operators import forecast, panel


def months(rows, start=(2019, 1)):
    y, m = start
    return [(k, dt.date(y + (m - 1 + i) // 12, (m - 1 + i) % 12 + 1, 1), float(v)) for k, ys in rows.items() for i, v in enumerate(ys)]


def test_smoothing_of_a_level_follows_the_plain_recursion():
    ys = np.array([4.0, 9, 2, 7, 7, 1, 8, 3])
    best = None
    for a in forecast.WEIGHTS:
        level, sse = ys[0], 0.0
        for y in ys[1:]:
            sse, level = sse + (y - level) ** 2, level + a * (y - level)
        best = min(best or (sse, level), (sse, level))
    # Eight months carry neither a trend nor seasons here, so the simple kind wins.
    got = forecast.predictions([ys], [0], 2, ["AutoETS"])["AutoETS"][0, 0]
    assert got == pytest.approx([best[1]] * 2)


def test_theta_adds_half_the_slope():
    ys = np.arange(10.0) * 3 + 5
    got = forecast.predictions([ys], [0], 3, ["AutoTheta"])["AutoTheta"][0, 0]
    assert np.diff(got) == pytest.approx([1.5, 1.5])


def test_autoregression_finds_its_own_rule():
    ys = [1.0, 4.0]
    for _ in range(20):
        ys.append(2 + 0.6 * ys[-1] - 0.5 * ys[-2])
    got = forecast.predictions([np.array(ys)], [0], 4, ["AutoARIMA"])["AutoARIMA"][0, 0]
    for _ in range(4):
        ys.append(2 + 0.6 * ys[-1] - 0.5 * ys[-2])
    assert got == pytest.approx(ys[-4:], rel=1e-4)


@pytest.mark.parametrize("model", forecast.KERNELS)
def test_nothing_after_a_cut_counts_and_a_season_is_found(model):
    rng = np.random.default_rng(3)
    t = np.arange(72)
    ys = 50 + 20 * np.sin(t * np.pi / 6) + rng.normal(0, 1, 72)
    other = np.concatenate([ys[:60], ys[60:] * 5 + 9])
    a, b = (forecast.predictions([x], [12], 12, [model])[model] for x in (ys, other))
    assert a == pytest.approx(b)
    assert np.abs(a[0, 0] - ys[60:]).mean() < 0.25 * np.abs(ys[59] - ys[60:]).mean()


def test_batches_do_not_change_a_series():
    rng = np.random.default_rng(5)
    series = [rng.poisson(4, n).astype(float) for n in (1, 3, 4, 13, 30, 61)]
    together = forecast.predictions(series, [0, 2], 6, list(forecast.KERNELS))
    for i, s in enumerate(series):
        alone = forecast.predictions([s], [0, 2], 6, list(forecast.KERNELS))
        for m in forecast.KERNELS:
            assert together[m][i] == pytest.approx(alone[m][0], nan_ok=True, rel=1e-6, abs=1e-6)


def test_fitted_frame(spark):
    rows = months({1: [5, 6, 7, 8, 9, 8, 7, 6], 2: [0, 0, 0, 0, 0, 0, 0, 0]}) + [(3, dt.date(2019, 8, 1), 4.0)]
    df = spark.createDataFrame(rows, "product_id long, month date, units double")
    cuts = spark.createDataFrame([(dt.date(2019, 6, 1),), (dt.date(2019, 8, 1),)], "cut date")
    got = {(r.product_id, r.cut.month, r.horizon): r for r in forecast.fitted(df, cuts, ["product_id"], 2).collect()}
    # The third series begins after the first cut, and its one month is repeated.
    assert set(got) == {(p, c, h) for p in (1, 2) for c in (6, 8) for h in (1, 2)} | {(3, 8, 1), (3, 8, 2)}
    assert {got[3, 8, h].AutoETS for h in (1, 2)} == {4.0}
    assert [got[2, 8, 1][m] for m in forecast.KERNELS] == pytest.approx([0, 0, 0], abs=1e-6)
    assert forecast.fitted(df.limit(0), cuts, ["product_id"], 2, ["AutoETS"]).collect() == []
    report = panel.backtest(panel.intermittent_states(df, ["product_id"]), cuts, ["product_id"], 2)
    wide = forecast.combined(report, df, cuts, ["product_id"], 2)
    assert wide.count() == report.count() == 4
    assert {*forecast.KERNELS, "CrostonSBA", "TSB", "SeasonalNaive"} <= set(wide.columns)


def test_models_asked_for_keep_their_order():
    assert forecast.chosen(["AutoARIMA", "AutoETS"]) == ["AutoETS", "AutoARIMA"]
    with pytest.raises(ValueError, match="Prophet"):
        forecast.chosen(["Prophet"])
