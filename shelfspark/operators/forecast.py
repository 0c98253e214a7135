"""Forecasts of series: single models as folds over ordered arrays; the competition of all models on matrices of series.

A series is one row, so every model works on all series of a batch at once; Spark deals the batches out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA = 0.2


def as_arrays(series: DataFrame) -> DataFrame:
    """(sku, q): each item's quantities in order of period."""
    packed = F.array_sort(F.collect_list(F.struct("period", "qty")))
    return series.groupBy("sku").agg(F.transform(packed, lambda x: x.qty).alias("q"))


def mean_of(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def naive(q: Column) -> Column:
    """The last value. (D-15)"""
    return F.element_at(q, -1)


def moving_average(q: Column, n: int = 3) -> Column:
    """Mean of the last n values. (D-15)"""
    return mean_of(F.slice(q, F.greatest(F.size(q) - n + 1, F.lit(1)), F.lit(n)))


def simple_smoothing(q: Column, alpha: float = ALPHA) -> Column:
    """Level that starts at the series' mean and moves from the second value on. (D-16)"""
    rest = F.slice(q, F.lit(2), F.greatest(F.size(q) - 1, F.lit(0)))
    return F.aggregate(rest, mean_of(q), lambda level, x: alpha * x + (1 - alpha) * level)


def _positive(q: Column) -> Column:
    return F.filter(q, lambda x: x > 0)


def std_of(a: Column) -> Column:
    """Sample deviation of an array."""
    m = mean_of(a)
    return F.sqrt(F.try_divide(F.aggregate(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x), F.size(a) - 1))


def _hits(q: Column) -> Column:
    """Places (from 0) of periods with demand."""
    return F.filter(F.transform(q, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def _after_first(q: Column) -> Column:
    at = F.coalesce(F.get(_hits(q), F.lit(0)), F.lit(0))
    return F.slice(q, at + 2, F.greatest(F.size(q) - at - 1, F.lit(0)))


def _result(q: Column, found: Column) -> Column:
    """Mean and deviation of a series without demand; the deviation also where no error could be measured."""
    none = F.struct(mean_of(q).alias("value"), std_of(q).alias("rmse"))
    return F.when(F.size(_positive(q)) > 0, F.struct(found["value"].alias("value"), F.coalesce(found.rmse, std_of(q)).alias("rmse"))).otherwise(none)


def croston(q: Column, alpha: float = ALPHA) -> Column:
    """Demand size over interval, both smoothed where demand occurs after its first period; (value, rmse there). (D-17)

    Size starts at its mean, the interval at the mean gap (the series' length where demand occurs once).
    """
    hits = _hits(q)
    gaps = F.transform(F.slice(hits, F.lit(2), F.greatest(F.size(hits) - 1, F.lit(0))), lambda g, k: (g - F.get(hits, k)).cast("double"))
    gap = F.when(F.size(gaps) > 0, mean_of(gaps)).otherwise(F.greatest(F.size(q), F.lit(1)).cast("double"))
    start = F.struct(mean_of(_positive(q)).alias("z"), gap.alias("p"), F.lit(1.0).alias("since"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        hit, error = x > 0, x - acc.z / acc.p
        return F.struct(
            F.when(hit, alpha * x + (1 - alpha) * acc.z).otherwise(acc.z).alias("z"),
            F.when(hit, alpha * acc.since + (1 - alpha) * acc.p).otherwise(acc.p).alias("p"),
            F.when(hit, F.lit(1.0)).otherwise(acc.since + 1).alias("since"),
            (acc.sq + F.when(hit, error * error).otherwise(0.0)).alias("sq"),
            (acc.n + F.when(hit, 1.0).otherwise(0.0)).alias("n"),
        )

    found = F.aggregate(_after_first(q), start, step, lambda acc: F.struct(F.try_divide(acc.z, acc.p).alias("value"), F.sqrt(F.try_divide(acc.sq, acc.n)).alias("rmse")))
    return _result(q, found)


def tsb(q: Column, alpha: float = ALPHA, beta: float = ALPHA) -> Column:
    """Demand size times its probability, which decays in empty periods; (value, rmse where demand occurs). (D-18)"""
    share = F.try_divide(F.size(_positive(q)), F.size(q)).cast("double")
    start = F.struct(mean_of(_positive(q)).alias("z"), share.alias("p"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        hit, error = x > 0, x - acc.z * acc.p
        return F.struct(
            F.when(hit, alpha * x + (1 - alpha) * acc.z).otherwise(acc.z).alias("z"),
            (beta * F.when(hit, 1.0).otherwise(0.0) + (1 - beta) * acc.p).alias("p"),
            (acc.sq + F.when(hit, error * error).otherwise(0.0)).alias("sq"),
            (acc.n + F.when(hit, 1.0).otherwise(0.0)).alias("n"),
        )

    found = F.aggregate(_after_first(q), start, step, lambda acc: F.struct((acc.z * acc.p).alias("value"), F.sqrt(F.try_divide(acc.sq, acc.n)).alias("rmse")))
    return _result(q, found)


#: Weights that the fits try, in this order; the first of the best ones stands.
ALPHAS, BETAS, GAMMAS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.1, 0.3, 0.5), (0.1, 0.3, 0.5)
#: Autoregressive and moving-average weights that the fit of ARIMA(1,1,1) tries.
PHIS = THETAS = (-0.8, -0.4, 0.0, 0.4, 0.8)
#: Cycle lengths that are looked for, shortest first.
CYCLES = (3, 4, 6, 12)
#: Candidates in the order that settles equal scores.
MODELS = ("ets", "ets_trend", *(f"ets_seasonal{m}" for m in CYCLES), *(f"ets_mul_seasonal{m}" for m in CYCLES), "arima", "croston", "tsb", "moving_average", "smoothing", "naive")
LEAST_POINTS = 12


def trending(q: np.ndarray, drift: float = 0.2, t_least: float = 2.0) -> np.ndarray:
    """Rows of a matrix of series with a slope that stands out and moves the mean. As D-13."""
    n = q.shape[1]
    if n < 3:
        return np.zeros(len(q), bool)
    x = np.arange(n) - (n - 1) / 2
    sxx, mean = (x * x).sum(), q.mean(1)
    slope = q @ x / sxx
    rest = np.maximum(((q - mean[:, None]) ** 2).sum(1) - slope * (q @ x), 0)
    error = np.sqrt(rest / (n - 2) / sxx)
    t = np.where(error > 1e-12, np.abs(slope) / np.where(error > 1e-12, error, 1), np.inf)
    return (np.abs(slope) > 1e-12) & (t >= t_least) & (np.abs(slope) * (n - 1) >= drift * np.abs(mean))


def cycles(q: np.ndarray, least: float = 0.3, z: float = 2.5) -> np.ndarray:
    """The shortest cycle of each series that its month-to-month changes repeat; 0 for none. As D-14."""
    n, found = q.shape[1], np.zeros(len(q), np.int64)
    d = np.diff(q, axis=1)
    e = d - d.mean(1, keepdims=True) if n > 1 else d
    total = (e * e).sum(1)
    for m in reversed(CYCLES):
        if n >= 2 * m:
            share = (e[:, m:] * e[:, :-m]).sum(1) / np.where(total > 0, total, 1)
            found[(total > 0) & (share >= max(least, z / np.sqrt(n - 1)))] = m
    return found


Fit = tuple[np.ndarray, np.ndarray]


def _best(fits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Fit:
    """Values ahead, and the error within the sample, of each series' first fit with the least squared error."""
    sse = np.round(np.array([f[0] for f in fits]), 6)
    pick, rows = np.argmin(sse, axis=0), np.arange(sse.shape[1])
    return np.array([f[1] for f in fits])[pick, rows], np.array([f[2] for f in fits])[pick, rows]


def smoothed_at(q: np.ndarray, ends: list[int], h: int, trend: bool = False, cycle: int = 0, mul: bool = False) -> dict[int, Fit]:
    """Exponential smoothing of level, trend and season by the best weights of the grid, a series a row. (D-19)

    The level starts at the first value, the trend at the first step; with a season, at the first cycle's mean, the step
    between the means of the first two cycles, and the first cycle's departures. Fits to the first `end` values are read
    off one pass over the series, as no start depends on the end. Returns (values ahead, rmse) by end.
    """
    start = cycle or 1
    mean = q[:, :start].mean(1)
    first = (q[:, cycle : 2 * cycle].mean(1) - mean) / cycle if cycle else q[:, 1] - q[:, 0]
    fits: dict[int, list] = {end: [] for end in ends}
    for alpha in ALPHAS:
        for beta in BETAS if trend else (0.0,):
            for gamma in GAMMAS if cycle else (0.0,):
                level, slope, sse = mean.copy(), first * trend, np.zeros(len(q))
                season = [(q[:, i] / mean if mul else q[:, i] - mean) if cycle else np.full(len(q), float(mul)) for i in range(start)]
                for t in range(start, max(ends)):
                    x, s, ahead = q[:, t], season[t % start], level + slope
                    sse = sse + (x - (ahead * s if mul else ahead + s)) ** 2
                    new = alpha * (x / s if mul else x - s) + (1 - alpha) * ahead
                    slope = beta * (new - level) + (1 - beta) * slope if trend else slope
                    if cycle:
                        season[t % start] = gamma * (x / new if mul else x - new) + (1 - gamma) * s
                    level = new
                    if t + 1 in fits:
                        steps = [(level + (i + 1) * slope, season[(t + 1 + i) % start]) for i in range(h)]
                        fits[t + 1].append((sse, np.stack([a * s if mul else a + s for a, s in steps], 1), np.sqrt(sse / (t + 1 - start))))
    return {end: _best(found) for end, found in fits.items()}


def smoothed(q: np.ndarray, h: int, trend: bool = False, cycle: int = 0, mul: bool = False) -> Fit:
    """`smoothed_at` the end of the series."""
    return smoothed_at(q, [q.shape[1]], h, trend, cycle, mul)[q.shape[1]]


def arima_at(q: np.ndarray, ends: list[int], h: int) -> dict[int, Fit]:
    """ARIMA(1,1,1) by the least conditional sum of squares on a grid, a series a row: (values ahead, rmse) by end. (D-20)"""
    w = np.diff(q, axis=1)
    fits: dict[int, list] = {end: [] for end in ends}
    for phi in PHIS:
        for theta in THETAS:
            e, sse = np.zeros(len(q)), np.zeros(len(q))
            for t in range(1, max(ends) - 1):
                e = w[:, t] - phi * w[:, t - 1] - theta * e
                sse = sse + e * e
                if t + 2 in fits:
                    step, at, out = phi * w[:, t] + theta * e, q[:, t + 1], []
                    for _ in range(h):
                        at = at + step
                        out.append(at)
                        step = phi * step
                    fits[t + 2].append((sse, np.stack(out, 1), np.sqrt(sse / t)))
    return {end: _best(found) for end, found in fits.items()}


def arima(q: np.ndarray, h: int) -> Fit:
    """`arima_at` the end of the series."""
    return arima_at(q, [q.shape[1]], h)[q.shape[1]]


def intermittent(q: np.ndarray, dying: bool) -> tuple[np.ndarray, np.ndarray]:
    """Croston, or TSB (`dying`), of a series a row, as the folds of D-17 and D-18: (value, rmse)."""
    n, hit = q.shape[1], q > 0
    count = hit.sum(1)
    some = count > 0
    at = np.where(hit, np.arange(n), -1)
    first, last = np.where(some, hit.argmax(1), n), at.max(1)
    z = q.sum(1, where=hit) / np.maximum(count, 1)
    p = count / n if dying else np.where(count > 1, (last - first) / np.maximum(count - 1, 1), max(n, 1)).astype(float)
    since, sq, k = np.ones(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for t in range(1, n):
        live, x = t > first, q[:, t]
        now = live & hit[:, t]
        error = x - (z * p if dying else z / p)
        sq, k = sq + np.where(now, error * error, 0), k + now
        if dying:
            p = np.where(live, ALPHA * now + (1 - ALPHA) * p, p)
        else:
            p = np.where(now, ALPHA * since + (1 - ALPHA) * p, p)
        since = np.where(now, 1.0, since + live)
        z = np.where(now, ALPHA * x + (1 - ALPHA) * z, z)
    spread = q.std(1, ddof=1) if n > 1 else np.full(len(q), np.nan)
    value = np.where(some, z * p if dying else z / np.where(some, p, 1), q.mean(1))
    return value, np.where(some & (k > 0), np.sqrt(sq / np.maximum(k, 1)), spread)


def admitted(q: np.ndarray, density: np.ndarray) -> dict[str, np.ndarray]:
    """Which series may use each model: rows by model, without those that none may use. (D-21)

    Trend and season are tried beside the plain level, where they are found in these values, each cycle length as a model
    of its own; the multiplying season only without empty months. ARIMA is for series with demand in half of the months
    or more (`density`, over the whole series), Croston and TSB for those with less than 76 %.
    """
    n, every = q.shape[1], np.ones(len(q), bool)
    out = {}
    if n >= LEAST_POINTS:
        cycle, full = cycles(q), (q > 0).all(1)
        out |= {"ets": every, "ets_trend": trending(q)}
        for m in CYCLES:
            out |= {f"ets_seasonal{m}": cycle == m, f"ets_mul_seasonal{m}": (cycle == m) & full}
    if n >= 8:
        out["arima"] = density >= 0.5
    out |= {"croston": density < 0.76, "tsb": density < 0.76, "moving_average": every, "smoothing": every, "naive": every}
    return {m: np.flatnonzero(out[m]) for m in MODELS if m in out and out[m].any()}


def _ahead_at(model: str, q: np.ndarray, ends: list[int], h: int, up: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """A model's values ahead of the first `end` values of a series a row; up[end] marks those with a trend there.

    A season is fitted with the trend that its series has at the end.
    """
    flat = lambda v: np.repeat(v[:, None], h, 1)
    if model in ("ets", "ets_trend"):
        return {end: v for end, (v, _) in smoothed_at(q, ends, h, model == "ets_trend").items()}
    if model.startswith("ets"):
        cycle, values = int(model.rpartition("seasonal")[2]), {end: np.zeros((len(q), h)) for end in ends}
        for trend in (False, True):
            at = np.flatnonzero(np.any([up[end] == trend for end in ends], axis=0))
            with np.errstate(all="ignore"):  # of a series that isn't admitted at every end
                found = smoothed_at(q[at], ends, h, trend, cycle, "mul" in model)
            for end in ends:
                mine = up[end][at] == trend
                values[end][at[mine]] = found[end][0][mine]
        return values
    if model == "arima":
        return {end: v for end, (v, _) in arima_at(q, ends, h).items()}
    if model in ("croston", "tsb"):
        return {end: flat(intermittent(q[:, :end], model == "tsb")[0]) for end in ends}
    if model == "smoothing":
        out = {}
        for end in ends:
            level = q[:, :end].mean(1)
            for t in range(1, end):
                level = ALPHA * q[:, t] + (1 - ALPHA) * level
            out[end] = flat(level)
        return out
    return {end: flat(q[:, end - 3 : end].mean(1) if model == "moving_average" else q[:, end - 1]) for end in ends}


def candidates_at(q: np.ndarray, ends: list[int], h: int, density: np.ndarray) -> dict[int, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Values ahead of every model that a series may use at an end, by end and model: (rows, values), never below 0. (D-21)"""
    may = {end: admitted(q[:, :end], density) for end in ends}
    up = {end: trending(q[:, :end]) for end in ends}
    out: dict[int, dict] = {end: {} for end in ends}
    for m in MODELS:
        mine = [end for end in ends if m in may[end]]
        if mine:
            rows = np.unique(np.concatenate([may[end][m] for end in mine]))
            found = _ahead_at(m, q[rows], mine, h, {end: up[end][rows] for end in mine})
            for end in mine:
                out[end][m] = may[end][m], np.maximum(found[end][np.searchsorted(rows, may[end][m])], 0)
    return out


def candidates(q: np.ndarray, h: int, density: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """`candidates_at` the end of the series."""
    return candidates_at(q, [q.shape[1]], h, density)[q.shape[1]]


def density_of(q: np.ndarray) -> np.ndarray:
    """Share of months with demand from the first such month on; 0 for none. As D-12."""
    hit = q > 0
    return np.where(hit.any(1), hit.sum(1) / (q.shape[1] - hit.argmax(1)), 0.0)


def _by_length(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Items of a batch whose series are of one length, and these as a matrix."""
    for pdf in batches:
        for _, part in pdf.groupby(pdf.q.map(len)):
            yield part, np.array([np.asarray(v, float) for v in part.q])


def backtest(arrays: DataFrame, folds: int = 3, steps: int = 3) -> DataFrame:
    """Errors of each candidate, pooled over the last origins and `steps` ahead: rmse, mape, mase. (D-21, D-22)

    `admitted` says whether the whole series, too, may use the model: an origin may have seen a trend that has ended.
    Each of the `folds` origins leaves `steps` values to forecast; the last origin's are the series' last ones. Series
    of fewer than 12 months have no origins, and origins have at least 9 months. The mean absolute first difference of
    the whole series scales mase; mape needs 4 values other than 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, q in _by_length(batches):
            n, density = q.shape[1], density_of(q)
            origins = [o for o in range(n - steps - folds + 1, n - steps + 1) if o >= max(LEAST_POINTS - steps, 4)]
            if n < LEAST_POINTS or not origins:
                continue
            error = {m: np.full((len(q), len(origins) * steps), np.nan) for m in MODELS}
            actual = np.concatenate([q[:, o : o + steps] for o in origins], 1)
            made = candidates_at(q, origins, steps, density)
            for i, o in enumerate(origins):
                for m, (rows, values) in made[o].items():
                    error[m][rows, i * steps : (i + 1) * steps] = values - q[rows, o : o + steps]
            scale, last = np.abs(np.diff(q, axis=1)).mean(1), admitted(q, density)
            for i, m in enumerate(MODELS):
                e = error[m]
                rows = np.flatnonzero(~np.isnan(e).all(1))
                e, a = e[rows], actual[rows]
                there, hit = ~np.isnan(e), ~np.isnan(e) & (a != 0)
                mape = np.nansum(np.abs(e) / np.where(hit, a, 1), 1, where=hit) / np.maximum(hit.sum(1), 1)
                some = scale[rows] > 0
                yield pd.DataFrame(
                    {
                        "sku": part.sku.to_numpy()[rows], "ord": i, "model": m, "rmse": np.sqrt(np.nanmean(e * e, 1)) if len(rows) else [],
                        "mape": pd.array(np.where(hit.sum(1) >= 4, mape, np.nan), "Float64"), "mase": pd.array(np.where(some, np.nanmean(np.abs(e), 1) / np.where(some, scale[rows], 1), np.nan) if len(rows) else [], "Float64"),
                        "has_zero": (there & (a == 0)).any(1), "all_zero": ~hit.any(1), "admitted": np.isin(rows, last.get(m, [])),
                    }
                )

    found = arrays.mapInPandas(run, "sku string, ord int, model string, rmse double, mape double, mase double, has_zero boolean, all_zero boolean, admitted boolean")
    return found.select("sku", "ord", "model", "rmse", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("mape", "mase")], "has_zero", "all_zero", "admitted")


def choose_model(scores: DataFrame) -> DataFrame:
    """The model with the lowest error of those that the whole series admits. (D-23)

    The error is mape where no actual is 0 and all models have one, else mase, else rmse; ties go by the order of MODELS.
    Where no scored model is admitted, the lowest stands. A window without demand has measured nothing: such items go to
    TSB, without scores.
    """
    whole = W.partitionBy("sku")
    rows = scores.withColumn("use_mape", ~F.max("has_zero").over(whole) & (F.count("mape").over(whole) == F.count("*").over(whole)))
    rows = rows.withColumn("use_mase", F.count("mase").over(whole) == F.count("*").over(whole)).withColumn("quiet", F.min("all_zero").over(whole))
    metric = F.when(F.col("use_mape"), "mape").when(F.col("use_mase"), "mase").otherwise("rmse")
    score = F.when(F.col("use_mape"), F.col("mape")).when(F.col("use_mase"), F.col("mase")).otherwise(F.col("rmse"))
    rows = rows.withColumn("metric", metric).withColumn("score", score)
    rows = rows.withColumn("naive_score", F.max(F.when(F.col("model") == "naive", F.col("score"))).over(whole))
    best = rows.withColumn("place", F.row_number().over(whole.orderBy(F.desc("admitted"), F.round("score", 9), "ord"))).where("place = 1")
    judged = lambda c: F.when(~F.col("quiet"), c)
    return best.select(
        "sku", F.when(F.col("quiet"), "tsb").otherwise(F.col("model")).alias("model"), F.when(F.col("quiet"), "no demand in window").otherwise(F.col("metric")).alias("metric"), judged(F.col("score")).alias("score"),
        judged(F.try_divide("score", "naive_score")).alias("ratio_to_naive"), judged(F.col("rmse")).alias("rmse"), judged(F.col("mape")).alias("mape"), judged(F.col("mase")).alias("mase"),
    )


def shape_of(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean size of a demand, and months between two, the run since the last one included, of a series a row. As D-11."""
    n, hit = q.shape[1], q > 0
    count = hit.sum(1)
    first, last = hit.argmax(1), n - 1 - hit[:, ::-1].argmax(1)
    gaps = np.maximum(count - 1, 0) + (last < n - 1)
    months = np.where(gaps > 0, (n - 1 - first) / np.maximum(gaps, 1), n)
    return np.where(count > 0, q.sum(1, where=hit) / np.maximum(count, 1), 0.0), np.where(count > 0, np.maximum(months, 1.0), np.nan)


#: What a forecast rests on, beside its quantities. (D-25)
PROVENANCE = ("model", "selected_by", "backtest_mape", "backtest_mase", "backtest_rmse", "vs_naive", "forecast_rmse", "expected_order_size", "expected_interval")


def forecast(arrays: DataFrame, chosen: DataFrame, hints: DataFrame | None = None, horizon: int = 6) -> DataFrame:
    """The chosen model's values on the whole series, to one digit, a row for each of the next months (h). (D-24)

    Items without a choice (too short to hold anything out) go by their hints (sku, stocking_policy, demand_pattern):
    TSB when made to order or with gaps; else ARIMA from 8 months on, else the average of the last three. Series of under
    4 months or without demand have none. Beside `forecast_qty` stand PROVENANCE and whether trend and cycle were found.
    """
    scored = [F.col(c).alias(f"backtest_{c}") for c in ("mape", "mase", "rmse")]
    rows = arrays.join(chosen.select("sku", F.col("model").alias("chosen"), "metric", "ratio_to_naive", *scored), "sku", "left")
    made = F.lit(False)
    if hints is not None:
        rows = rows.join(hints.select("sku", "stocking_policy", "demand_pattern"), "sku", "left")
        made = F.coalesce(F.col("stocking_policy") == "MTO", made)
    gaps = made if hints is None else F.coalesce(F.col("demand_pattern").isin("intermittent", "lumpy"), F.lit(False))
    rows = rows.where((F.size("q") >= 4) & F.exists("q", lambda x: x > 0))
    short = F.when(made | gaps, "tsb").when(F.size("q") >= 8, "arima").otherwise("moving_average")
    quiet = F.col("metric") == "no demand in window"
    by = F.when(quiet, F.lit("no demand in window: tsb")).when(F.col("chosen").isNotNull(), F.concat(F.lit("backtest:"), "metric")).when(made, "policy:MTO").otherwise("pattern")
    rows = rows.select("sku", "q", F.coalesce("chosen", short).alias("model"), F.col("chosen").isNotNull().alias("tested"), by.alias("selected_by"), "backtest_mape", "backtest_mase", "backtest_rmse", F.round(F.round("ratio_to_naive", 9), 3).alias("vs_naive"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, q in _by_length(batches):
            model, tested, up = part.model.to_numpy(), part.tested.to_numpy(bool), trending(q)
            values, rmse = np.zeros((len(q), horizon)), part.backtest_rmse.to_numpy(float).copy()
            before = np.array([[q[i, max(0, t - 3) : t].mean() for t in range(1, q.shape[1])] for i in np.flatnonzero(~tested)]).reshape(-1, q.shape[1] - 1)
            rmse[~tested] = np.sqrt(((q[~tested][:, 1:] - before) ** 2).mean(1))
            for m in np.unique(model):
                at = np.flatnonzero(model == m)
                values[at] = np.maximum(_ahead_at(m, q[at], [q.shape[1]], horizon, {q.shape[1]: up[at]})[q.shape[1]], 0)
            late = np.flatnonzero((model == "tsb") & part.backtest_rmse.isna().to_numpy())  # quiet windows and short series
            rmse[late] = intermittent(q[late], True)[1]
            early = np.flatnonzero(~tested & (model == "arima"))
            if len(early):
                rmse[early] = arima(q[early], horizon)[1]
            size, interval = shape_of(q)
            out = pd.DataFrame({"sku": part.sku.to_numpy(), "trend_detected": up, "seasonal_detected": cycles(q) > 0, "rmse": rmse, "size": size, "interval": interval})
            for c in ("model", "selected_by", "backtest_mape", "backtest_mase", "backtest_rmse", "vs_naive"):
                out[c] = part[c].to_numpy()
            out = out.loc[np.repeat(np.arange(len(q)), horizon)]
            yield out.assign(h=np.tile(np.arange(1, horizon + 1), len(q)), value=values.reshape(-1))

    kinds = "sku string, model string, selected_by string, trend_detected boolean, seasonal_detected boolean, backtest_mape double, backtest_mase double, backtest_rmse double, vs_naive double"
    found = rows.mapInPandas(run, f"{kinds}, h int, value double, rmse double, size double, interval double")
    value = F.bround(F.greatest(F.col("value"), F.lit(0.0)), 1)
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return found.select(
        "sku", "h", value.alias("forecast_qty"), "model", "selected_by", "trend_detected", "seasonal_detected", F.round(F.round(known("rmse"), 9), 3).alias("forecast_rmse"),
        *[known(c).alias(c) for c in ("backtest_mape", "backtest_mase", "backtest_rmse", "vs_naive")], F.bround("size", 1).alias("expected_order_size"), F.bround(known("interval"), 2).alias("expected_interval"),
    )


def forecast_detail(forecasts: DataFrame, last: DataFrame) -> DataFrame:
    """The forecasts by month instead of h; the first month is marked. last: one row, `period`. (D-25)"""
    rows = forecasts.crossJoin(F.broadcast(last))  # one row
    rest = [c for c in forecasts.columns if c not in ("sku", "h")]
    return rows.select("sku", F.add_months("period", F.col("h")).alias("period"), *rest, (F.col("h") == 1).alias("is_next_period"))


def forecast_summary(detail: DataFrame) -> DataFrame:
    """Next month, mean and total over the horizon, and error of each item, with its model and what was found. (D-26)

    Of a reviewed detail (D-29), `statistical_next_period` and `statistical_total` say what the model said, and
    `forecast_source` whether the next month was reviewed.
    """
    ahead = lambda c: F.max(F.when(F.col("is_next_period"), F.col(c)))
    exact = lambda c: F.col(c).cast("decimal(20,1)")  # noqa: E731  quantities have one digit
    keys = [c for c in ("model", "trend_detected", "seasonal_detected") if c in detail.columns]
    more = []
    if "statistical_qty" in detail.columns:
        more = [ahead("statistical_qty").alias("statistical_next_period"), F.sum(exact("statistical_qty")).cast("double").alias("statistical_total"), ahead("forecast_source").alias("forecast_source")]
    return detail.groupBy("sku", *keys).agg(
        ahead("forecast_qty").alias("forecast_next_period"), F.bround(F.avg(exact("forecast_qty")), 1).cast("double").alias("forecast_avg_monthly"), F.sum(exact("forecast_qty")).cast("double").alias("forecast_total"), F.max("forecast_rmse").alias("forecast_rmse"), *more,
    )


def apply_review(detail: DataFrame, plan: DataFrame) -> DataFrame:
    """Reviewed quantities over the forecast, with both values and the source. plan: sku, period, reviewed_qty. (D-29)"""
    rows = detail.withColumnRenamed("forecast_qty", "statistical_qty").join(plan.select("sku", "period", "reviewed_qty"), ["sku", "period"], "left")
    return rows.withColumn("forecast_qty", F.coalesce("reviewed_qty", "statistical_qty")).withColumn("forecast_source", F.when(F.col("reviewed_qty").isNotNull(), "reviewed").otherwise("statistical")).drop("reviewed_qty")


def plan_accuracy(plans: DataFrame, actuals: DataFrame, price: DataFrame) -> DataFrame:
    """The earliest reviewed plan of each item and month against what happened, in units and money. (D-30)"""
    first = W.partitionBy("sku", "period").orderBy("planned_at", "plan_qty")
    rows = plans.where("reviewed").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    rows = rows.join(actuals.select("sku", "period", F.col("qty").alias("actual_qty")), ["sku", "period"]).join(price.select("sku", "price"), "sku", "left")
    bias = F.col("plan_qty") - F.col("actual_qty")
    return rows.withColumn("bias_qty", bias).withColumn("abs_error_qty", F.abs(bias)).withColumn("bias_value", bias * F.coalesce("price", F.lit(0.0)))


def accuracy_by(detail: DataFrame, keys: list[str]) -> DataFrame:
    """Plan, actual, bias and its direction (5 % of plan) by keys. (D-31)"""
    out = detail.groupBy(*keys).agg(F.sum("plan_qty").alias("plan_qty"), F.sum("actual_qty").alias("actual_qty"), F.sum("bias_qty").alias("bias_qty"), F.sum("abs_error_qty").alias("abs_error_qty"), F.sum("bias_value").alias("bias_value"))
    way = F.when(F.abs("bias_qty") <= 0.05 * F.col("plan_qty"), "balanced").when(F.col("bias_qty") > 0, "over").otherwise("under")
    return out.withColumn("direction", way)


def month_columns(months: list, **measures: str) -> list[Column]:
    """A column for each measure and month, named `<label> yyyy-MM`, of rows with `period`: aggregates for one groupBy.

    measures: source column by label with _ for space. The months are given, so no pass over the rows looks for them.
    """
    cell = lambda c, m: F.max(F.when(F.col("period") == F.lit(m), F.col(c)))
    return [cell(c, m).alias(f"{label.replace('_', ' ')} {m:%Y-%m}") for label, c in measures.items() for m in months]


def months_of(rows: DataFrame, last: int | None = None) -> list:
    """The distinct months of rows, or the last so many, in order: a short list, from an aggregate."""
    found = rows.select("period").distinct().orderBy(F.desc("period"))
    return sorted(r.period for r in (found if last is None else found.limit(last)).collect())


def history_and_forecast(series: DataFrame, detail: DataFrame, past: list, coming: list) -> DataFrame:
    """A row an item of the detail: PROVENANCE, then a column for each past and each coming month. For export. (D-27)

    past, coming: months, as of `months_of`. An item without history in the months has nulls there.
    """
    meta = [c for c in PROVENANCE if c in detail.columns]
    ahead = detail.groupBy("sku").agg(*[F.max(F.when(F.col("is_next_period"), F.col(c))).alias(c) for c in meta], *month_columns(coming, fcst="forecast_qty"))
    before = series.where(F.col("period").isin(past)).groupBy("sku").agg(*month_columns(past, hist="qty"))
    hist, fcst = ([c for c in x.columns if c.startswith(k)] for x, k in ((before, "hist "), (ahead, "fcst ")))
    return ahead.join(before, "sku", "left").select("sku", *meta, *[F.col(f"`{c}`") for c in hist + fcst])


def reviewed_plan(wide: DataFrame, prefix: str = "reviewed qty ") -> DataFrame:
    """Reviewed quantities from columns named by month; blanks are no review; countries of one item and month add up. (D-28)"""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    rows = wide.unpivot(["sku", "reviewer"], columns, "c", "q").where("q is not null")
    month = F.to_date(F.concat(F.substring("c", len(prefix) + 1, 7), F.lit("-01")))
    return rows.groupBy("sku", month.alias("period")).agg(F.sum("q").alias("reviewed_qty"), F.array_join(F.array_sort(F.collect_set("reviewer")), ", ").alias("reviewers"))


def review_effect(reviewed: DataFrame) -> DataFrame:
    """Rows that a review changed, largest change first. (D-32)"""
    delta = F.col("forecast_qty") - F.col("statistical_qty")
    rows = reviewed.where("forecast_source = 'reviewed'").withColumn("delta", delta).where("delta <> 0")
    return rows.select("sku", "period", "statistical_qty", "forecast_qty", "delta", F.try_divide("delta", "statistical_qty").alias("delta_share")).orderBy(F.desc(F.abs("delta")), "sku", "period")
