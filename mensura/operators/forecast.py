"""Forecasters that are fitted: exponential smoothing, theta and autoregression, as own variants of the automatic ones.

A series is one row with its months in order, so a task handles whole batches of series
as one matrix, right-aligned at the last month. A recursion runs once over time for every
cut: what a model knows at a month depends on nothing later, and parameters are chosen at
each cut by the one-step errors up to it. Series of up to three months repeat their last value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON = 12
#: The grid of smoothing weights, and the damping of a trend.
WEIGHTS = (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
DAMPING = 0.9
#: Months of history from which a seasonal model may be fitted, and up to which only the last value is repeated.
LEAST_SEASONAL, SHORT = 24, 3


def _score(sse: np.ndarray, n: np.ndarray, parameters: int) -> np.ndarray:
    """Akaike's criterion, corrected for few months; infinite where the months are too few."""
    room = n - parameters - 1
    return np.where(room > 0, n * np.log(np.maximum(sse, 1e-9) / np.maximum(n, 1)) + 2 * parameters * n / np.maximum(room, 1), np.inf)


def smoothing(y: np.ndarray, first: np.ndarray, cuts: list[int], horizon: int) -> np.ndarray:
    """(series, cut, horizon): the best of simple, damped-trend and additive seasonal smoothing at each cut.

    ``y`` is (series, months), months before ``first`` are ignored; ``cuts`` are columns.
    """
    rows, months = y.shape
    each, steps = np.arange(rows), np.arange(1, horizon + 1)
    kinds = [(a, 0.0, 0.0) for a in WEIGHTS] + [(a, b, 0.0) for a in WEIGHTS[1::2] for b in WEIGHTS[:3]] + [(a, 0.0, g) for a in WEIGHTS[1::2] for g in WEIGHTS[:3]]
    year = np.stack([y[each, np.minimum(first + k, months - 1)] for k in range(SEASON)], 1)
    best = np.full((len(cuts), rows), np.inf)
    out = np.full((rows, len(cuts), horizon), np.nan)
    damped = np.cumsum(DAMPING**steps)
    for alpha, beta, gamma in kinds:
        level, trend, sse, n = y[each, np.minimum(first, months - 1)].copy(), np.zeros(rows), np.zeros(rows), np.zeros(rows)
        # Seasons by place in the year since the series began; the first year sets them.
        seasons = year - year.mean(1, keepdims=True) if gamma else np.zeros((rows, SEASON))
        if gamma:
            level = year.mean(1)
        for t in range(months):
            age = t - first
            # A seasonal model's first year has set its state, so its errors count from the second.
            on = age >= (SEASON if gamma else 1)
            place = age % SEASON
            season = seasons[each, place]
            error = np.where(on, y[:, t] - (level + DAMPING * trend + season), 0.0)
            sse += error**2
            n += on
            level = np.where(on, level + DAMPING * trend + alpha * error, level)
            trend = np.where(on, DAMPING * trend + alpha * beta * error, trend)
            if gamma:
                seasons[each, place] = season + gamma * error
            if t in cuts:
                k = cuts.index(t)
                # Criteria compare the mean error of a month, as kinds count different months.
                score = _score(sse, n, 2 + 2 * (beta > 0) + 2 * (gamma > 0)) / np.maximum(n, 1)
                if gamma:
                    score = np.where(age + 1 >= LEAST_SEASONAL, score, np.inf)
                better = score < best[k]
                best[k] = np.where(better, score, best[k])
                ahead = level[:, None] + damped * trend[:, None] + seasons[each[:, None], (age[:, None] + steps) % SEASON]
                out[:, k] = np.where(better[:, None], ahead, out[:, k])
    return out


def theta(y: np.ndarray, first: np.ndarray, cuts: list[int], horizon: int) -> np.ndarray:
    """(series, cut, horizon): smoothing with half the slope of the trend line, of series freed of their seasons where these are strong."""
    rows, months = y.shape
    out = np.full((rows, len(cuts), horizon), np.nan)
    column, steps, each = np.arange(months), np.arange(1, horizon + 1), np.arange(rows)
    for k, cut in enumerate(cuts):
        on = (column >= first[:, None]) & (column <= cut)
        n = on.sum(1)
        x = np.where(on, column - first[:, None], 0.0)
        size = np.maximum(n, 1)
        centre = np.where(on, y - (np.where(on, y, 0).sum(1) / size)[:, None], 0.0)
        # The seasons count where the correlation at a year's distance is significant at 90 %.
        near = (centre[:, :-SEASON] ** 2).sum(1) if months > SEASON else np.zeros(rows)
        link = (centre[:, SEASON:] * centre[:, :-SEASON]).sum(1) if months > SEASON else np.zeros(rows)
        strong = (n >= LEAST_SEASONAL) & (near > 0) & (link / np.maximum((centre**2).sum(1), 1e-12) > 1.645 / np.sqrt(size))
        seasons = np.zeros((rows, SEASON))
        for s in range(SEASON):
            of = on & ((column - first[:, None]) % SEASON == s)
            seasons[:, s] = np.where(strong, np.where(of, centre, 0).sum(1) / np.maximum(of.sum(1), 1), 0.0)
        plain = y - seasons[each[:, None], (column - first[:, None]) % SEASON]
        mean_x, mean_y = x.sum(1) / size, np.where(on, plain, 0).sum(1) / size
        dx = np.where(on, x - mean_x[:, None], 0.0)
        slope = (dx * np.where(on, plain - mean_y[:, None], 0.0)).sum(1) / np.maximum((dx**2).sum(1), 1e-12)
        best = np.full(rows, np.inf)
        for alpha in WEIGHTS:
            level, sse = plain[each, np.minimum(first, months - 1)].copy(), np.zeros(rows)
            for t in range(cut + 1):
                live = t > first
                error = np.where(live, plain[:, t] - level, 0.0)
                sse += error**2
                level = level + alpha * error
            better = sse < best
            best = np.where(better, sse, best)
            drift = slope[:, None] / 2 * (steps - 1 + ((1 - (1 - alpha) ** n) / alpha)[:, None])
            ahead = level[:, None] + drift + seasons[each[:, None], (cut - first[:, None] + steps) % SEASON]
            out[:, k] = np.where(better[:, None], ahead, out[:, k])
    return out


def autoregression(y: np.ndarray, first: np.ndarray, cuts: list[int], horizon: int, orders: int = 3) -> np.ndarray:
    """(series, cut, horizon): least-squares autoregressions of order 0 to 3 with a constant, the best by Akaike's criterion.

    They are fitted to the differences over a year where these vary less than the series, else to the series itself.
    """
    rows, months = y.shape
    out = np.full((rows, len(cuts), horizon), np.nan)
    column = np.arange(months)
    yearly = y.copy()
    yearly[:, SEASON:] = y[:, SEASON:] - y[:, :-SEASON]
    for k, cut in enumerate(cuts):
        age = column - first[:, None]
        seen = column <= cut
        seasonal = (cut - first + 1 >= LEAST_SEASONAL + orders) & (_variance(yearly, seen & (age >= SEASON)) < _variance(y, seen & (age >= 0)))
        z = np.where(seasonal[:, None], yearly, y)
        start = np.where(seasonal, SEASON, 0)
        on = seen & (age >= (start + orders)[:, None])
        n = on.sum(1)
        best = np.full(rows, np.inf)
        for p in range(orders + 1):
            x = np.stack([np.ones_like(z), *[np.pad(z, ((0, 0), (lag, 0)))[:, :months] for lag in range(1, p + 1)]], 2)
            x = np.where(on[:, :, None], x, 0.0)
            gram = np.einsum("rta,rtb->rab", x, x)
            gram += np.eye(p + 1) * (1e-8 * np.trace(gram, axis1=1, axis2=2) + 1e-9)[:, None, None]
            weights = np.linalg.solve(gram, np.einsum("rta,rt->ra", x, np.where(on, z, 0.0))[:, :, None])[:, :, 0]
            sse = (np.where(on, z - np.einsum("rta,ra->rt", x, weights), 0.0) ** 2).sum(1)
            score = _score(sse, n, p + 2)
            better = score < best
            best = np.where(better, score, best)
            past = [z[:, cut - lag] if cut >= lag else np.zeros(rows) for lag in range(orders)]
            whole = [y[:, cut - lag] if cut >= lag else np.zeros(rows) for lag in range(SEASON)]
            for h in range(horizon):
                value = weights[:, 0] + sum(weights[:, lag + 1] * past[lag] for lag in range(p))
                past = [value, *past[:-1]]
                total = value + np.where(seasonal, whole[SEASON - 1], 0.0)
                whole = [total, *whole[:-1]]
                out[:, k, h] = np.where(better, total, out[:, k, h])
    return out


def _variance(z: np.ndarray, on: np.ndarray) -> np.ndarray:
    n = np.maximum(on.sum(1), 1)
    mean = np.where(on, z, 0.0).sum(1) / n
    return np.where(on, (z - mean[:, None]) ** 2, 0.0).sum(1) / n


KERNELS = {"AutoETS": smoothing, "AutoTheta": theta, "AutoARIMA": autoregression}


def chosen(models: list[str] | None) -> list[str]:
    """The fitted models asked for, in their own order; all by default."""
    unknown = sorted(set(models or []) - set(KERNELS))
    if unknown:
        raise ValueError(f"unknown models {unknown}, known are {sorted(KERNELS)}")
    return [m for m in KERNELS if models is None or m in models]


def predictions(series: list[np.ndarray], back: list[int], horizon: int, models: list[str]) -> dict[str, np.ndarray]:
    """Per model (series, cut, horizon); ``back`` has the cuts as months before the end. NaN where a series begins after a cut."""
    lengths = np.array([len(s) for s in series])
    # Room for a year even where all series are short.
    months = max(int(lengths.max()), max(back) + 1, SEASON + 1)
    y = np.zeros((len(series), months))
    for i, s in enumerate(series):
        y[i, months - len(s) :] = s
    first = months - lengths
    cuts = [months - 1 - b for b in back]
    out = {}
    for m in models:
        got = KERNELS[m](y, first, cuts, horizon)
        for k, cut in enumerate(cuts):
            known = cut - first + 1
            fallback = (known <= SHORT) | np.isnan(got[:, k, 0])
            got[:, k] = np.where(fallback[:, None], y[:, cut][:, None], got[:, k])
            got[:, k][known < 1] = np.nan
        out[m] = got
    return out


def fitted(panel: DataFrame, cut_rows: DataFrame, keys: list[str], horizon: int = 12, models: list[str] | None = None) -> DataFrame:
    """keys, cut, horizon and a column for each model, from a dense panel whose series all end in one month.

    NULL does not occur: cuts before a series' beginning have no rows.
    """
    models = chosen(models)
    series = panel.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "units"))), lambda x: x["units"]).alias("ys"), F.max("month").alias("end"))
    spans = cut_rows.agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    series = series.crossJoin(F.broadcast(spans)).withColumn("back", F.transform("cuts", lambda c: F.months_between("end", c).cast("int")))
    kinds = dict(panel.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["cut date", "horizon int"] + [f"{m} double" for m in models])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            for _, same in b.groupby(b["back"].map(tuple), sort=False):
                back = [int(x) for x in same["back"].iloc[0]]
                # Cuts from a series' end on would need months that it lacks.
                back_in = [x for x in back if x >= 0]
                found = predictions([np.asarray(y, dtype=float) for y in same["ys"]], back_in, horizon, models)
                at = [back.index(x) for x in back_in]
                size = len(at) * horizon
                out = {k: np.repeat(same[k].to_numpy(), size) for k in keys}
                out["cut"] = np.concatenate([np.repeat(np.asarray(c)[at], horizon) for c in same["cuts"]])
                out["horizon"] = np.tile(np.arange(1, horizon + 1), len(same) * len(at))
                for m in models:
                    out[m] = found[m].reshape(-1)
                rows = pd.DataFrame(out)
                yield rows[rows[models[0]].notna()] if models else rows

    return series.select(*keys, "ys", "cuts", "back").mapInPandas(run, schema)


def combined(report: DataFrame, panel: DataFrame, cut_rows: DataFrame, keys: list[str], horizon: int = 12, models: list[str] | None = None) -> DataFrame:
    """A report with the fitted models' columns beside its own."""
    return report.join(fitted(panel, cut_rows, keys, horizon, models), [*keys, "cut", "horizon"])
