"""Sales forecasts for any number of daily series at once.

The additive model is fitted per series into one table of coefficients, which is all a forecast needs: it
can be stored, and predicts without the history.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Holdout and horizon in days, and the shape of the additive model
# (Taylor & Letham 2018).
HOLDOUT_DAYS, HORIZON_DAYS, BASELINE_DAYS = 60, 90, 7
CHANGE_POINTS, HISTORY_WITH_CHANGES = 25, 0.8
YEAR, YEARLY_ORDER, WEEK, WEEKLY_ORDER = 365.25, 10, 7.0, 3
INTERVAL, SIMULATIONS = 0.8, 1000
SLOPE_PENALTY, SEASON_PENALTY = 0.05, 0.1
HINGE_PENALTY = 10.0  # of the ridge fit that estimates the noise
UNIQUE = 1e-6  # of trend changes, so that few days still have one optimum
CHANGE_SCALE = 0.05  # prior scale of trend changes (Laplace)
FORMAT = 1  # of a stored table of fits


def holdout_split(
    daily: DataFrame, days: int = HOLDOUT_DAYS, series: Sequence[str] = ()
) -> DataFrame:
    """Add ``part``: 'test' for the last ``days`` calendar days of each series, else 'train'."""
    last = F.max("ds").over(Window.partitionBy(*series))
    test = F.col("ds") > F.date_sub(last, days)
    return daily.withColumn("part", F.when(test, "test").otherwise("train"))


def baseline_forecast(
    split: DataFrame, days: int = BASELINE_DAYS, series: Sequence[str] = ()
) -> DataFrame:
    """The test rows with ``yhat``: the mean of the last ``days`` training days of the series."""
    whole = Window.partitionBy(*series)
    train_end = F.max(F.when(F.col("part") == "train", F.col("ds"))).over(whole)
    recent = (F.col("part") == "train") & (F.col("ds") > F.date_sub(F.col("_end"), days))
    return (
        split.withColumn("_end", train_end)
        .withColumn("yhat", F.avg(F.when(recent, F.col("y"))).over(whole))
        .where(F.col("part") == "test")
        .select(*series, "ds", "y", "yhat")
    )


def forecast_metrics(forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse and mape in %; days with actual 0 are left out of mape only."""
    error = F.col("y") - F.col("yhat")
    return forecast.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(error, F.nullif("y", F.lit(0.0))))) * 100).alias("mape"),
    )


def _design(day: np.ndarray, first: float, span: float) -> np.ndarray:
    """Columns: level, slope, slope changes, yearly and weekly waves."""
    t = (day - first) / span
    changes = np.linspace(0, HISTORY_WITH_CHANGES, CHANGE_POINTS + 1)[1:]
    columns = [np.ones_like(t), t, *[np.maximum(t - c, 0) for c in changes]]
    for period, order in ((YEAR, YEARLY_ORDER), (WEEK, WEEKLY_ORDER)):
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * day / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


_HINGES = slice(2, 2 + CHANGE_POINTS)


def _ridges() -> np.ndarray:
    """Quadratic penalty of each column: none on the level; the trend changes have another beside."""
    seasonal = 2 * (YEARLY_ORDER + WEEKLY_ORDER)
    return np.concatenate([[0.0, SLOPE_PENALTY], np.full(CHANGE_POINTS, UNIQUE), np.full(seasonal, SEASON_PENALTY)])


def _lasso(gram: np.ndarray, target: np.ndarray, penalty: float) -> np.ndarray:
    """argmin of b'Gb / 2 - t'b + penalty * |b|_1, along the path of optima from the penalty at which all is
    zero: between its corners the columns in use move in a straight line."""
    n = len(target)
    b, signs, used = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    level, changed = float(np.abs(target).max(initial=0.0)), -1
    if level > penalty:
        changed = int(np.argmax(np.abs(target)))
        used[changed], signs[changed] = True, np.sign(target[changed])
    for _ in range(100 * n):
        if level <= penalty or not used.any():
            break
        own = gram[np.ix_(used, used)]
        fixed, moving = np.linalg.solve(own, np.column_stack([target[used], signs[used]])).T
        left, pull = target - gram[:, used] @ fixed, gram[:, used] @ moving
        # the next corner below: a column comes in where its slope reaches the level, or goes at zero
        corners = np.full(n, -np.inf)
        side = np.zeros(n)
        for sign in (1.0, -1.0):
            with np.errstate(divide="ignore", invalid="ignore"):
                at = sign * left / (1.0 - sign * pull)
            better = ~used & (1.0 - sign * pull > 1e-12) & (at <= level * (1 + 1e-12)) & (at > corners)
            corners[better], side[better] = at[better], sign
        with np.errstate(divide="ignore", invalid="ignore"):
            at = fixed / moving
        corners[used] = np.where((at < level) & (at > 0) & (np.sign(fixed - level * moving) == signs[used]), at, -np.inf)
        if changed >= 0:
            corners[changed] = -np.inf if not used[changed] or corners[changed] >= level * (1 - 1e-12) else corners[changed]
        changed = int(np.argmax(corners))
        level = max(penalty, min(level, float(corners[changed])))
        b[:] = 0.0
        b[used] = fixed - level * moving
        if level <= penalty:
            break
        used[changed] = not used[changed]
        signs[changed] = side[changed] if used[changed] else 0.0
        if not used[changed]:
            b[changed] = 0.0
    return b


def _violation(x: np.ndarray, target: np.ndarray, beta: np.ndarray, ridges: np.ndarray, penalty: float) -> float:
    """How far ``beta`` is from the conditions of the optimum: the slope is zero, for a trend change in
    use equal to its penalty, for one not in use not above it."""
    slope = x.T @ (target - x @ beta) - ridges * beta
    changes, hinges = beta[_HINGES], slope[_HINGES]
    # sign by sign, as the penalty bends there
    away = np.where(changes != 0, np.abs(hinges - penalty * np.sign(changes)), np.maximum(np.abs(hinges) - penalty, 0))
    return float(max(np.abs(np.delete(slope, np.arange(_HINGES.start, _HINGES.stop))).max(), away.max()))


def _fit(day: np.ndarray, y: np.ndarray) -> dict:
    """The additive model on (day, y): ridge on slope and waves, L1 on the trend changes, so that most of
    them are zero. The noise that weighs the penalties comes from a ridge fit.

    One formula for a history of any length, a single day included: every column but the level has
    a penalty, so what few days cannot tell stays near zero.
    """
    first, span, scale = float(day[0]), float(max(day[-1] - day[0], 1.0)), float(max(np.abs(y).max(), 1e-12))
    x, target = _design(day, first, span), y / scale
    gram, slope = x.T @ x, x.T @ target
    ridges = _ridges()
    loose = ridges.copy()
    loose[_HINGES] = HINGE_PENALTY
    start = np.linalg.solve(gram + np.diag(loose), slope)
    noise = float(max(np.mean((target - x @ start) ** 2), 1e-6))
    penalty = noise / CHANGE_SCALE
    # level, slope and waves follow from the trend changes; what is left is a problem in these alone
    hinge = np.zeros(len(slope), bool)
    hinge[_HINGES] = True
    whole = gram + np.diag(ridges)
    own = np.linalg.pinv(whole[np.ix_(~hinge, ~hinge)], hermitian=True)
    shared = whole[np.ix_(hinge, ~hinge)] @ own
    reduced = whole[np.ix_(hinge, hinge)] - shared @ whole[np.ix_(~hinge, hinge)]
    beta = np.zeros(len(slope))
    beta[hinge] = _lasso(reduced, slope[hinge] - shared @ slope[~hinge], penalty)
    # all columns in use at once, so that rounding of the reduction does not stay
    used = ~hinge | (beta != 0)
    signs = np.where(hinge, penalty * np.sign(beta), 0.0)
    wanted = (slope - signs)[used]
    system = whole[np.ix_(used, used)]
    solved = np.linalg.lstsq(system, wanted, rcond=None)[0]
    solved += np.linalg.lstsq(system, wanted - system @ solved, rcond=None)[0]
    if (np.sign(solved[hinge[used]]) == np.sign(beta[used & hinge])).all():
        beta[used] = solved
    return {
        "first": first,
        "span": span,
        "last": float(day[-1]),
        "scale": scale,
        "sigma": float(np.std((target - x @ beta) * scale)),
        "change": float(np.mean(np.abs(beta[_HINGES]))),
        "beta": beta,
        "violation": _violation(x, target, beta, ridges, penalty),
    }


def _values(fit, ahead: np.ndarray) -> np.ndarray:
    return _design(ahead, fit["first"], fit["span"]) @ np.asarray(fit["beta"], float) * fit["scale"]


def _bounds(fit, days: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance of the lower and the upper bound from the forecast of the next days: quantiles of simulated
    noise and of trend changes as frequent and as large as those of the history."""
    draw = np.random.default_rng(seed % (1 << 63))
    often = min(1.0, CHANGE_POINTS / fit["span"])
    size = (SIMULATIONS, days)
    changes = np.where(draw.random(size) < often, draw.laplace(0.0, 1.0, size), 0.0) * fit["change"]
    trend = np.cumsum(np.cumsum(changes, axis=1), axis=1) / fit["span"] * fit["scale"]
    # the same noise on all days, so that bounds differ by what the trend may do only
    whole = trend + draw.normal(0.0, 1.0, (SIMULATIONS, 1)) * fit["sigma"]
    low, high = np.quantile(whole, [(1 - INTERVAL) / 2, (1 + INTERVAL) / 2], axis=0)
    # a later day is no surer; only the drawn quantiles may say so
    return np.minimum.accumulate(np.minimum(low, 0.0)), np.maximum.accumulate(np.maximum(high, 0.0))


def _predict(day: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, float]:
    """Values for ``ahead`` of the model fitted on (day, y), and its residual deviation."""
    fit = _fit(day, y)
    return _values(fit, ahead), fit["sigma"]


_EPOCH = np.datetime64("1970-01-01")


def _days(ds: pd.Series) -> np.ndarray:
    return (ds.to_numpy().astype("datetime64[D]") - _EPOCH).astype(float)


def _as_dates(day: np.ndarray) -> list:
    return (_EPOCH + day.astype("timedelta64[D]")).astype(object).tolist()


def _series_schema(df: DataFrame, series: Sequence[str], tail: str) -> str:
    keys = [f"{c} {df.schema[c].dataType.simpleString()}" for c in series]
    return ", ".join([*keys, tail])


def seasonal_holdout_forecast(split: DataFrame, series: Sequence[str]) -> DataFrame:
    """Fit each series on its training days and predict its test days: (series..., ds, y, yhat).

    One task holds one series, one row per calendar day of it, never its orders.
    """
    series = list(series)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        train, test = pdf[pdf["part"] == "train"], pdf[pdf["part"] == "test"]
        yhat = np.nan  # becomes NULL: nothing to learn from
        if len(train):
            yhat, _ = _predict(_days(train["ds"]), train["y"].to_numpy(), _days(test["ds"]))
        return test[[*series, "ds", "y"]].assign(yhat=yhat)

    schema = _series_schema(split, series, "ds date, y double, yhat double")
    return split.groupBy(*series).applyInPandas(fit, schema)


_FIT = (
    "format int, first double, span double, last double, scale double, sigma double, change double, "
    "violation double, beta array<double>"
)


def fit_forecasts(daily: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per series: its keys and the coefficients of the model fitted on all its days.

    ``violation`` tells how far they are from the optimum. One task holds one series, one row per
    calendar day of it. Write the table to store the fits.
    """
    series = list(series)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        out = pdf[series].head(1).reset_index(drop=True)
        found = _fit(_days(pdf["ds"]), pdf["y"].to_numpy(dtype=float))
        return out.assign(format=FORMAT, **{k: [v] for k, v in found.items()})

    return daily.groupBy(*series).applyInPandas(fit, _series_schema(daily, series, _FIT))


def predict_forecasts(fits: DataFrame, series: Sequence[str], days: int = HORIZON_DAYS) -> DataFrame:
    """The next ``days`` of every fitted series: (series..., ds, yhat, yhat_lower, yhat_upper). Needs the
    fits only; the simulations are drawn by a hash of the keys, so reruns agree. Fits of another
    format are an error."""
    series = list(series)
    seeded = fits.withColumn("_seed", F.xxhash64(*series))

    def predict(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if row["format"] != FORMAT:
                    raise ValueError(f"fits of format {row['format']}, not {FORMAT}")
                ahead = row["last"] + np.arange(1, days + 1)
                yhat, (low, high) = _values(row, ahead), _bounds(row, days, row["_seed"])
                out = pd.DataFrame({c: [row[c]] * days for c in series})
                yield out.assign(ds=_as_dates(ahead), yhat=yhat, yhat_lower=yhat + low, yhat_upper=yhat + high)

    tail = "ds date, yhat double, yhat_lower double, yhat_upper double"
    return seeded.mapInPandas(predict, _series_schema(fits, series, tail))


def seasonal_forecast(
    daily: DataFrame, series: Sequence[str], days: int = HORIZON_DAYS
) -> DataFrame:
    """Fit each series on all its days and predict the next ``days``:
    (series..., ds, yhat, yhat_lower, yhat_upper)."""
    return predict_forecasts(fit_forecasts(daily, series), series, days)
