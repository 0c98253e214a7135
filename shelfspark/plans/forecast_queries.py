"""Queries and oracles of the forecast section. Croston and TSB run on part-level series, which are sparse."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfspark.operators import demand as D
from shelfspark.operators import forecast as Fc
from shelfspark.operators import planning as L
from shelfspark.plans.demand_queries import classified, lines, series, totals
from shelfspark.plans.fixtures import ORACLE_VIEWS, once, query, tidy, view
from shelfspark.plans.supply_queries import at

#: A folded item: its quantities by month, i from 1; f is the first month with demand.
ORACLE_VIEWS["f_num"] = "SELECT *, row_number() OVER (PARTITION BY sku ORDER BY period) AS i, count(*) OVER (PARTITION BY sku) AS n FROM d_series"
ORACLE_VIEWS["f_hit"] = """
SELECT *, count(*) OVER (PARTITION BY sku) AS k, row_number() OVER (PARTITION BY sku ORDER BY i) AS j, i - lag(i) OVER (PARTITION BY sku ORDER BY i) AS gap FROM f_num WHERE qty > 0"""


#: Windows of the competition: three origins and the whole series, o months long each.
ORACLE_VIEWS["f_den"] = "SELECT sku, max(n) AS n, avg(CASE WHEN qty > 0 THEN 1.0 ELSE 0 END) FILTER (i >= f) AS density FROM (SELECT *, min(i) FILTER (qty > 0) OVER (PARTITION BY sku) AS f FROM f_num) GROUP BY sku"
ORACLE_VIEWS["f_win"] = "SELECT sku, n, density, o FROM (SELECT *, unnest([n - 5, n - 4, n - 3, n]) AS o FROM f_den WHERE n >= 12) WHERE o >= 9"
ORACLE_VIEWS["f_x"] = "SELECT w.sku, w.n, density, o, i, qty, qty - lag(qty) OVER (PARTITION BY w.sku, o ORDER BY i) AS d FROM f_win w JOIN f_num q ON q.sku = w.sku AND i <= o"
ORACLE_VIEWS["f_trend"] = """
SELECT sku, o, coalesce(abs(slope) > 1e-12 AND abs(slope) * (o - 1) >= 0.2 * abs(mean) AND (NOT err > 1e-12 OR abs(slope) / err >= 2), false) AS up FROM (
SELECT sku, o, regr_slope(qty, i) AS slope, avg(qty) AS mean, sqrt(greatest(regr_syy(qty, i) - regr_slope(qty, i) * regr_sxy(qty, i), 0) / (count(*) - 2) / regr_sxx(qty, i)) AS err FROM f_x GROUP BY sku, o)"""
ORACLE_VIEWS["f_cyc"] = """
SELECT sku, o, CASE WHEN o >= 6 AND s3 / ee >= b THEN 3 WHEN o >= 8 AND s4 / ee >= b THEN 4 WHEN o >= 12 AND s6 / ee >= b THEN 6 WHEN o >= 24 AND s12 / ee >= b THEN 12 ELSE 0 END AS p
FROM (SELECT sku, o, greatest(0.3, 2.5 / sqrt(count(*))) AS b, nullif(sum(e * e), 0) AS ee, sum(e * e3) AS s3, sum(e * e4) AS s4, sum(e * e6) AS s6, sum(e * e12) AS s12 FROM (
  SELECT *, lag(e, 3) OVER w AS e3, lag(e, 4) OVER w AS e4, lag(e, 6) OVER w AS e6, lag(e, 12) OVER w AS e12 FROM (
    SELECT sku, o, i, d - avg(d) OVER (PARTITION BY sku, o) AS e FROM f_x WHERE d IS NOT NULL) WINDOW w AS (PARTITION BY sku, o ORDER BY i)) GROUP BY sku, o)"""
ORACLE_VIEWS["f_arr"] = "SELECT sku, o, any_value(density) AS density, list(qty ORDER BY i) AS q FROM f_x GROUP BY sku, o"
#: A row a window, variant and point of the grid, before its first step: c months a cycle (1 without one).
ORACLE_VIEWS["f_grid"] = """
SELECT v.*, alpha, CASE WHEN up THEN beta ELSE 0 END AS beta, CASE WHEN p > 0 THEN gamma ELSE 0 END AS gamma, row_number() OVER (PARTITION BY v.sku, v.o, model ORDER BY alpha, beta, gamma) AS g
FROM (SELECT sku, o, q, 'ets' AS model, false AS up, 0 AS p, 1 AS c, false AS mul FROM f_arr WHERE o >= 12
  UNION ALL SELECT sku, o, q, 'ets_trend', true, 0, 1, false FROM f_arr JOIN f_trend USING (sku, o) WHERE o >= 12 AND up
  UNION ALL SELECT sku, o, q, CASE WHEN m THEN 'ets_mul_seasonal' ELSE 'ets_seasonal' END || p, up, p, p, m FROM f_arr JOIN f_trend USING (sku, o) JOIN f_cyc USING (sku, o) CROSS JOIN (VALUES (false), (true)) x(m)
    WHERE o >= 12 AND p > 0 AND (NOT m OR list_min(q) > 0)) v
CROSS JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) a(alpha) JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5)) b(beta) ON up OR beta = 0.1::DOUBLE JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5)) c(gamma) ON p > 0 OR gamma = 0.1::DOUBLE"""
ORACLE_VIEWS["f_fold"] = """
SELECT sku, o, q, model, up, p, c, mul, alpha, beta, gamma, g, c AS i, list_avg(q[1:c])::DOUBLE AS l, CASE WHEN NOT up THEN 0 WHEN p > 0 THEN (list_avg(q[p + 1:2 * p]) - list_avg(q[1:p])) / p ELSE q[2] - q[1] END::DOUBLE AS b,
  CASE WHEN p = 0 THEN [0.0::DOUBLE] WHEN mul THEN list_transform(q[1:p], lambda x: x / list_avg(q[1:p])) ELSE list_transform(q[1:p], lambda x: x - list_avg(q[1:p])) END AS s, 0.0::DOUBLE AS sse FROM f_grid
UNION ALL
SELECT sku, o, q, model, up, p, c, mul, alpha, beta, gamma, g, i + 1, l2, CASE WHEN up THEN beta * (l2 - l) + (1 - beta) * b ELSE b END,
  CASE WHEN p = 0 THEN s ELSE list_concat(list_concat(s[1:k - 1], [gamma * (CASE WHEN mul THEN x / l2 ELSE x - l2 END) + (1 - gamma) * s[k]]), s[k + 1:c]) END, sse + e * e
FROM (SELECT *, alpha * (CASE WHEN mul THEN x / s[k] ELSE x - s[k] END) + (1 - alpha) * (l + b) AS l2, x - CASE WHEN mul THEN (l + b) * s[k] ELSE l + b + s[k] END AS e
  FROM (SELECT *, q[i + 1] AS x, i % c + 1 AS k FROM f_fold WHERE i < o))"""
ORACLE_VIEWS["f_ar"] = """
SELECT sku, o, q, phi, theta, row_number() OVER (PARTITION BY sku, o ORDER BY phi, theta) AS g, 2 AS i, 0.0::DOUBLE AS e, 0.0::DOUBLE AS sse FROM f_arr
CROSS JOIN (VALUES (-0.8::DOUBLE), (-0.4), (0), (0.4), (0.8)) a(phi) CROSS JOIN (VALUES (-0.8::DOUBLE), (-0.4), (0), (0.4), (0.8)) b(theta) WHERE density >= 0.5
UNION ALL
SELECT sku, o, q, phi, theta, g, i + 1, e2, sse + e2 * e2 FROM (SELECT *, (q[i + 1] - q[i]) - phi * (q[i] - q[i - 1]) - theta * e AS e2 FROM f_ar WHERE i < o)"""
ORACLE_VIEWS["f_ahead"] = "SELECT unnest(range(1, 7))::INT AS h"
ORACLE_VIEWS["f_gap"] = """
SELECT sku, o, mean, CASE WHEN k IS NULL THEN mean ELSE (mz * pow(0.8, k - 1) + sz) / (mg * pow(0.8, k - 1) + sg) END AS croston, CASE WHEN k IS NULL THEN mean ELSE (mz * pow(0.8, k - 1) + sz) * (p0 * pow(0.8, m) + sp) END AS tsb
FROM (SELECT sku, o, avg(qty) AS mean FROM f_x GROUP BY sku, o) LEFT JOIN (
SELECT sku, o, max(k) AS k, avg(qty) AS mz, coalesce(avg(gap), o) AS mg, coalesce(sum(0.2 * pow(0.8, k - j) * qty) FILTER (j > 1), 0) AS sz, coalesce(sum(0.2 * pow(0.8, k - j) * gap) FILTER (j > 1), 0) AS sg,
  max(k) / o AS p0, o - min(i) AS m, coalesce(sum(0.2 * pow(0.8, o - i)) FILTER (j > 1), 0) AS sp
FROM (SELECT *, count(*) OVER w AS k, row_number() OVER (PARTITION BY sku, o ORDER BY i) AS j, i - lag(i) OVER (PARTITION BY sku, o ORDER BY i) AS gap FROM f_x WHERE qty > 0 WINDOW w AS (PARTITION BY sku, o)) GROUP BY sku, o) USING (sku, o)"""
ORACLE_VIEWS["f_cand"] = """
SELECT sku, o, model, ord, h, greatest(v, 0) AS v FROM (
SELECT sku, o, model, (list_position(['ets', 'ets_trend', 'ets_seasonal3', 'ets_seasonal4', 'ets_seasonal6', 'ets_seasonal12', 'ets_mul_seasonal3', 'ets_mul_seasonal4', 'ets_mul_seasonal6', 'ets_mul_seasonal12'], model) - 1)::INT AS ord, h, CASE WHEN mul THEN (l + h * b) * s[(o + h - 1) % c + 1] ELSE l + h * b + s[(o + h - 1) % c + 1] END AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY sku, o, model ORDER BY round(sse, 6), g) AS place FROM f_fold WHERE i = o) CROSS JOIN f_ahead WHERE place = 1
UNION ALL SELECT sku, o, 'arima', 10, h, q[o] + (phi * (q[o] - q[o - 1]) + theta * e) * (1 - pow(phi, h)) / (1 - phi)
  FROM (SELECT *, row_number() OVER (PARTITION BY sku, o ORDER BY round(sse, 6), g) AS place FROM f_ar WHERE i = o) CROSS JOIN f_ahead WHERE place = 1
UNION ALL SELECT sku, o, 'croston', 11, h, croston FROM f_gap JOIN f_den USING (sku) CROSS JOIN f_ahead WHERE density < 0.76
UNION ALL SELECT sku, o, 'tsb', 12, h, tsb FROM f_gap JOIN f_den USING (sku) CROSS JOIN f_ahead WHERE density < 0.76
UNION ALL SELECT sku, o, 'moving_average', 13, h, list_avg(q[o - 2:o]) FROM f_arr CROSS JOIN f_ahead
UNION ALL SELECT sku, o, 'smoothing', 14, h, any_value(m) * pow(0.8, o - 1) + sum(0.2 * pow(0.8, o - i) * qty) FILTER (i > 1) FROM (SELECT *, avg(qty) OVER (PARTITION BY sku, o) AS m FROM f_x) CROSS JOIN f_ahead GROUP BY sku, o, h
UNION ALL SELECT sku, o, 'naive', 15, h, q[o] FROM f_arr CROSS JOIN f_ahead)"""
ORACLE_VIEWS["f_score"] = """
SELECT sku, ord, model, sqrt(avg(e * e)) AS rmse, CASE WHEN count(*) FILTER (a <> 0) >= 4 THEN avg(abs(e / a)) FILTER (a <> 0) END AS mape, CASE WHEN any_value(scale) > 0 THEN avg(abs(e)) / any_value(scale) END AS mase, bool_or(a = 0) AS has_zero, bool_and(a = 0) AS all_zero,
  (sku, model) IN (SELECT (sku, model) FROM f_cand JOIN f_den USING (sku) WHERE o = n) AS admitted
FROM (SELECT c.*, q.qty AS a, c.v - q.qty AS e, scale FROM f_cand c JOIN f_num q ON q.sku = c.sku AND q.i = c.o + c.h JOIN (SELECT sku, avg(abs(d)) AS scale FROM f_x WHERE o = n GROUP BY sku) x ON x.sku = c.sku WHERE h <= 3 AND o < q.n)
GROUP BY sku, ord, model"""
ORACLE_VIEWS["f_pick"] = """
SELECT sku, CASE WHEN quiet THEN 'tsb' ELSE model END AS model, CASE WHEN quiet THEN 'no demand in window' ELSE metric END AS metric, CASE WHEN NOT quiet THEN score END AS score, CASE WHEN NOT quiet THEN score / nullif(ns, 0) END AS ratio_to_naive, CASE WHEN NOT quiet THEN rmse END AS rmse, CASE WHEN NOT quiet THEN mape END AS mape, CASE WHEN NOT quiet THEN mase END AS mase
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY admitted DESC, round(score, 9), ord) AS place, max(score) FILTER (model = 'naive') OVER (PARTITION BY sku) AS ns FROM (
  SELECT *, CASE metric WHEN 'mape' THEN mape WHEN 'mase' THEN mase ELSE rmse END AS score FROM (SELECT *, CASE WHEN NOT bool_or(has_zero) OVER w AND count(mape) OVER w = count(*) OVER w THEN 'mape' WHEN count(mase) OVER w = count(*) OVER w THEN 'mase' ELSE 'rmse' END AS metric,
    bool_and(all_zero) OVER w AS quiet FROM f_score WINDOW w AS (PARTITION BY sku)))) WHERE place = 1"""
#: TSB's own errors over the whole series, for items whose window had no demand.
ORACLE_VIEWS["f_tsb"] = """
SELECT sku, q, list_position(list_transform(q, lambda x: x > 0), true) AS i, list_avg(list_filter(q, lambda x: x > 0)) AS z, len(list_filter(q, lambda x: x > 0)) / len(q) AS p, 0.0::DOUBLE AS sq, 0 AS k FROM f_arr JOIN f_den USING (sku) WHERE o = n
UNION ALL
SELECT sku, q, i + 1, CASE WHEN x > 0 THEN 0.2 * x + 0.8 * z ELSE z END, 0.2 * CASE WHEN x > 0 THEN 1 ELSE 0 END + 0.8 * p, sq + CASE WHEN x > 0 THEN (x - z * p) * (x - z * p) ELSE 0 END, k + CASE WHEN x > 0 THEN 1 ELSE 0 END FROM (SELECT *, q[i + 1] AS x FROM f_tsb WHERE i < len(q))"""
ORACLE_VIEWS["f_out"] = """
SELECT p.sku, x.h, round_even(coalesce(c.v, greatest(tsb, 0)), 1) AS forecast_qty, p.model, CASE WHEN metric LIKE 'no %' THEN 'no demand in window: tsb' ELSE 'backtest:' || metric END AS selected_by, up AS trend_detected, coalesce(cy.p, 0) > 0 AS seasonal_detected,
  round(round(coalesce(p.rmse, t.rmse), 9), 3) AS forecast_rmse, mape AS backtest_mape, mase AS backtest_mase, p.rmse AS backtest_rmse, round(round(ratio_to_naive, 9), 3) AS vs_naive, expected_order_size, expected_interval
FROM f_pick p CROSS JOIN f_ahead x JOIN f_den d ON d.sku = p.sku JOIN f_gap g ON g.sku = p.sku AND g.o = d.n JOIN f_trend tr ON tr.sku = p.sku AND tr.o = d.n LEFT JOIN f_cyc cy ON cy.sku = p.sku AND cy.o = d.n
LEFT JOIN f_cand c ON c.sku = p.sku AND c.o = d.n AND c.model = p.model AND c.h = x.h
LEFT JOIN (SELECT sku, CASE WHEN k > 0 THEN sqrt(sq / k) END AS rmse FROM f_tsb WHERE i = len(q)) t ON t.sku = p.sku
LEFT JOIN (SELECT sku, round_even(avg(qty), 1) AS expected_order_size, round_even(greatest(1, coalesce((max(n) - min(i)) / nullif(count(*) - 1 + CASE WHEN max(i) < max(n) THEN 1 ELSE 0 END, 0), max(n))), 2) AS expected_interval FROM f_num WHERE qty > 0 GROUP BY sku) e ON e.sku = p.sku"""
ORACLE_VIEWS["f_det"] = "SELECT sku, (last + to_months(h))::DATE AS period, * EXCLUDE (sku, h, last), h = 1 AS is_next_period FROM f_out CROSS JOIN (SELECT max(period) AS last FROM d_series)"
ORACLE_VIEWS["f_rev"] = "SELECT *, CASE WHEN is_next_period AND sku LIKE '%-1' THEN forecast_qty + 5 END AS reviewed FROM f_det"


#: The months of the driver's tables that wide tables have columns for, a year back and half a year ahead.
PAST = [datetime.date(1999, m, 1) for m in range(2, 13)] + [datetime.date(2000, 1, 1)]
COMING = [datetime.date(2000, m, 1) for m in range(2, 8)]


def wide(label: str, value: str, months: list, where: str = "true") -> str:
    """Oracle text: a column for each month."""
    return ", ".join(f"max({value}) FILTER (period = DATE '{m}' AND {where}) AS \"{label} {m:%Y-%m}\"" for m in months)


def spine(spark, sf_dir):
    """The last year's months of the series, and the next half year's."""
    past = Fc.months_of(D.months_in(totals(spark, sf_dir)).select(F.explode("periods").alias("period")), 12)
    ends = [past[-1].year * 12 + past[-1].month + i for i in range(6)]
    return past, [datetime.date(i // 12, i % 12 + 1, 1) for i in ends]


def arrays(spark, sf_dir):
    return D.arrays_of(totals(spark, sf_dir))


@once
def chosen(spark, sf_dir):
    return Fc.choose_model(Fc.backtest(arrays(spark, sf_dir)))


def forecasts(spark, sf_dir):
    hints = classified(spark, sf_dir).join(view(spark, sf_dir, "fx_item_master"), "sku", "left")
    return Fc.forecast(arrays(spark, sf_dir), chosen(spark, sf_dir), hints)


@once
def detail(spark, sf_dir):
    return Fc.forecast_detail(forecasts(spark, sf_dir), D.months_in(totals(spark, sf_dir)).select(F.array_max("periods").alias("period")))


@query("""SELECT sku, round(arg_max(qty, period), 6) AS naive, round(avg(qty) FILTER (i > n - 3), 6) AS moving_average FROM f_num GROUP BY sku""")
def d15_naive_and_average(spark, sf_dir):
    q = F.col("q")
    return tidy(arrays(spark, sf_dir).select("sku", Fc.naive(q).alias("naive"), Fc.moving_average(q).alias("moving_average")))


@query("""SELECT sku, round(any_value(m) * pow(0.8, max(n) - 1) + coalesce(sum(0.2 * pow(0.8, n - i) * qty) FILTER (i > 1), 0), 6) AS level FROM (SELECT *, avg(qty) OVER (PARTITION BY sku) AS m FROM f_num) GROUP BY sku""")
def d16_simple_smoothing(spark, sf_dir):
    return tidy(arrays(spark, sf_dir).select("sku", Fc.simple_smoothing(F.col("q")).alias("level")))


@query("""SELECT sku, round((mz * pow(0.8, k - 1) + sz) / (mg * pow(0.8, k - 1) + sg), 6) AS value FROM (SELECT sku, max(k) AS k, avg(qty) AS mz, coalesce(avg(gap), greatest(max(n), 1)) AS mg,
coalesce(sum(0.2 * pow(0.8, k - j) * qty) FILTER (j > 1), 0) AS sz, coalesce(sum(0.2 * pow(0.8, k - j) * gap) FILTER (j > 1), 0) AS sg FROM f_hit GROUP BY sku)""")
def d17_croston(spark, sf_dir):
    return tidy(arrays(spark, sf_dir).select("sku", Fc.croston(F.col("q"))["value"].alias("value")))


@query("""SELECT sku, round((mz * pow(0.8, k - 1) + sz) * (p0 * pow(0.8, m) + coalesce(sp, 0)), 6) AS value FROM (SELECT sku, max(k) AS k, avg(qty) AS mz, coalesce(sum(0.2 * pow(0.8, k - j) * qty) FILTER (j > 1), 0) AS sz,
  max(k) / max(n) AS p0, max(n) - min(i) AS m, sum(0.2 * pow(0.8, n - i)) FILTER (j > 1) AS sp FROM f_hit GROUP BY sku)""")
def d18_tsb(spark, sf_dir):
    return tidy(arrays(spark, sf_dir).select("sku", Fc.tsb(F.col("q"))["value"].alias("value")))


def _fits(spark, sf_dir, fit, name):
    def run(batches):
        for pdf in batches:
            for _, part in pdf.groupby(pdf.q.map(len)):
                values, _ = fit(np.array(part.q.tolist()))
                yield pd.DataFrame({"sku": part.sku, name: values[:, 0], f"{name}_last": values[:, -1]})

    return arrays(spark, sf_dir).where("size(q) >= 12").mapInPandas(run, f"sku string, {name} double, {name}_last double")


@query("""SELECT sku, round(l + b, 6) AS next, round(l + 3 * b, 6) AS next_last FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY round(sse, 6), alpha, beta) AS place FROM f_hw WHERE i = n) WHERE place = 1""")
def d19_trend_grid(spark, sf_dir):
    return tidy(_fits(spark, sf_dir, lambda q: Fc.smoothed(q, 3, True), "next"))


ORACLE_VIEWS["f_hw"] = """
SELECT sku, n, q, alpha, beta, 1 AS i, q[1] AS l, q[2] - q[1] AS b, 0.0::DOUBLE AS sse FROM f_arr JOIN f_den USING (sku) CROSS JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7), (0.9)) x(alpha) CROSS JOIN (VALUES (0.1::DOUBLE), (0.3), (0.5)) y(beta) WHERE o = n
UNION ALL
SELECT sku, n, q, alpha, beta, i + 1, l2, beta * (l2 - l) + (1 - beta) * b, sse + (x - l - b) * (x - l - b) FROM (SELECT *, q[i + 1] AS x, alpha * q[i + 1] + (1 - alpha) * (l + b) AS l2 FROM f_hw WHERE i < n)"""
ORACLE_VIEWS["f_ar1"] = ORACLE_VIEWS["f_ar"].replace("f_ar ", "f_ar1 ").replace("WHERE density >= 0.5", "JOIN f_den USING (sku) WHERE o = n").replace("FROM f_arr\n", "FROM f_arr\n")


@query("""SELECT sku, round(q[o] + s, 6) AS next, round(q[o] + s * (1 - phi * phi * phi) / (1 - phi), 6) AS next_last FROM (SELECT *, phi * (q[o] - q[o - 1]) + theta * e AS s, row_number() OVER (PARTITION BY sku ORDER BY round(sse, 6), g) AS place FROM f_ar1 WHERE i = o) WHERE place = 1""")
def d20_arima(spark, sf_dir):
    return tidy(_fits(spark, sf_dir, lambda q: Fc.arima(q, 3), "next"))


@query("""SELECT sku, string_agg(model, ',' ORDER BY ord) AS models FROM (SELECT DISTINCT sku, model, ord FROM f_score) GROUP BY sku""")
def d21_candidates(spark, sf_dir):
    found = Fc.backtest(arrays(spark, sf_dir)).groupBy("sku").agg(F.array_sort(F.collect_list(F.struct("ord", "model"))).alias("m"))
    return found.select("sku", F.array_join(F.transform("m", lambda x: x.model), ",").alias("models"))


@query("SELECT sku, ord, model, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(mase, 6) AS mase, has_zero, all_zero, admitted FROM f_score")
def d22_backtest(spark, sf_dir):
    return tidy(Fc.backtest(arrays(spark, sf_dir)))


@query("SELECT sku, model, metric, round(score, 6) AS score, round(ratio_to_naive, 6) AS ratio_to_naive, round(rmse, 6) AS rmse, round(mape, 6) AS mape, round(mase, 6) AS mase FROM f_pick")
def d23_chosen_models(spark, sf_dir):
    return tidy(chosen(spark, sf_dir))


def _scored(df):
    """Rounded twice: what the order of addition leaves in the last digits must not decide a tie."""
    return tidy(df.withColumns({c: F.round(c, 9) for c in ("backtest_mape", "backtest_mase", "backtest_rmse")}))


@query("SELECT * REPLACE (round(round(backtest_mape, 9), 6) AS backtest_mape, round(round(backtest_mase, 9), 6) AS backtest_mase, round(round(backtest_rmse, 9), 6) AS backtest_rmse) FROM f_out")
def d24_forecasts(spark, sf_dir):
    return _scored(forecasts(spark, sf_dir))


@query("SELECT * REPLACE (round(round(backtest_mape, 9)::DECIMAL(28,9), 6)::DOUBLE AS backtest_mape, round(round(backtest_mase, 9)::DECIMAL(28,9), 6)::DOUBLE AS backtest_mase, round(round(backtest_rmse, 9)::DECIMAL(28,9), 6)::DOUBLE AS backtest_rmse) FROM f_det")
def d25_forecast_detail(spark, sf_dir):
    return _scored(detail(spark, sf_dir))


def _tenth(total: str) -> str:
    """Oracle text: the mean, to one digit with ties to even, of amounts of one digit."""
    return f"((({total}) // count(*) + CASE WHEN 2 * (({total}) % count(*)) > count(*) OR (2 * (({total}) % count(*)) = count(*) AND ({total}) // count(*) % 2 = 1) THEN 1 ELSE 0 END) / 10)::DOUBLE"


_TENTHS = "sum(round(forecast_qty * 10)::BIGINT)::BIGINT"


@query(f"""SELECT sku, model, trend_detected, seasonal_detected, max(forecast_qty) FILTER (is_next_period) AS forecast_next_period, {_tenth(_TENTHS)} AS forecast_avg_monthly, ({_TENTHS} / 10)::DOUBLE AS forecast_total, max(forecast_rmse) AS forecast_rmse
FROM f_det GROUP BY ALL""")
def d26_forecast_summary(spark, sf_dir):
    return Fc.forecast_summary(detail(spark, sf_dir))


@query(f"""SELECT sku, model, trend_detected, seasonal_detected, max(forecast_qty) FILTER (is_next_period) AS forecast_next_period, {_tenth(_TENTHS)} AS forecast_avg_monthly, ({_TENTHS} / 10)::DOUBLE AS forecast_total, max(forecast_rmse) AS forecast_rmse,
max(statistical_qty) FILTER (is_next_period) AS statistical_next_period, (sum(round(statistical_qty * 10)::BIGINT) / 10)::DOUBLE AS statistical_total, max(CASE WHEN reviewed IS NOT NULL THEN 'reviewed' ELSE 'statistical' END) FILTER (is_next_period) AS forecast_source
FROM (SELECT * REPLACE (coalesce(reviewed, forecast_qty) AS forecast_qty), forecast_qty AS statistical_qty FROM f_rev) GROUP BY sku, model, trend_detected, seasonal_detected""")
def d26_reviewed_summary(spark, sf_dir):
    return Fc.forecast_summary(reviewed(spark, sf_dir))


def reviewed(spark, sf_dir):
    rows = detail(spark, sf_dir)
    plan = rows.where("is_next_period").select("sku", "period", (F.col("forecast_qty") + 5).alias("reviewed_qty")).where("sku like '%-1'")
    return Fc.apply_review(rows, plan)


@query("SELECT sku, period, forecast_qty AS statistical_qty, model, forecast_rmse, is_next_period, coalesce(reviewed, forecast_qty) AS forecast_qty, CASE WHEN reviewed IS NOT NULL THEN 'reviewed' ELSE 'statistical' END AS forecast_source FROM f_rev")
def d29_reviewed_plan(spark, sf_dir):
    return reviewed(spark, sf_dir).select("sku", "period", "statistical_qty", "model", "forecast_rmse", "is_next_period", "forecast_qty", "forecast_source")


ORACLE_VIEWS["f_plan"] = """
SELECT s.sku, s.period, s.qty AS actual_qty, s.qty + (CASE WHEN s.sku LIKE '%-0' THEN 3 WHEN s.sku LIKE '%-1' THEN -4 ELSE 0 END) AS plan_qty, s.qty + 100 AS later FROM d_series s"""
ORACLE_VIEWS["f_price"] = "SELECT sku, sum(amount::DECIMAL(24,6)) FILTER (demand_date > DATE '1999-01-01')::DOUBLE / sum(qty) FILTER (demand_date > DATE '1999-01-01') AS p12, sum(amount::DECIMAL(24,6))::DOUBLE / sum(qty) AS pa FROM d_lines GROUP BY sku"


def plans(spark, sf_dir):
    s = series(spark, sf_dir)
    shift = F.when(F.col("sku").endswith("-0"), 3).when(F.col("sku").endswith("-1"), -4).otherwise(0)
    early = s.select("sku", "period", (F.col("qty") + shift).alias("plan_qty"), F.lit("1999-06-01").alias("planned_at"), F.lit(True).alias("reviewed"))
    late = s.select("sku", "period", (F.col("qty") + 100).alias("plan_qty"), F.lit("1999-06-20").alias("planned_at"), F.lit(True).alias("reviewed"))
    draft = s.select("sku", "period", (F.col("qty") - 100).alias("plan_qty"), F.lit("1999-05-20").alias("planned_at"), F.lit(False).alias("reviewed"))
    return early.unionByName(late).unionByName(draft)


def accuracy(spark, sf_dir):
    price = L.selling_price(lines(spark, sf_dir), view(spark, sf_dir, "fx_item_master"), at())
    return Fc.plan_accuracy(plans(spark, sf_dir), series(spark, sf_dir), price)


@query("SELECT sku, period, plan_qty, actual_qty, plan_qty - actual_qty AS bias_qty, abs(plan_qty - actual_qty) AS abs_error_qty, round((plan_qty - actual_qty) * coalesce(p12, pa), 2) AS bias_value FROM f_plan LEFT JOIN f_price USING (sku)")
def d30_plan_accuracy(spark, sf_dir):
    return tidy(accuracy(spark, sf_dir).select("sku", "period", "plan_qty", "actual_qty", "bias_qty", "abs_error_qty", "bias_value"), bias_value=2)


@query("""SELECT sku, plan_qty, actual_qty, plan_qty - actual_qty AS bias_qty, e AS abs_error_qty, CASE WHEN abs(plan_qty - actual_qty) <= 0.05 * plan_qty THEN 'balanced' WHEN plan_qty > actual_qty THEN 'over' ELSE 'under' END AS direction
FROM (SELECT sku, sum(plan_qty) AS plan_qty, sum(actual_qty) AS actual_qty, sum(abs(plan_qty - actual_qty)) AS e FROM f_plan GROUP BY sku)""")
def d31_accuracy_by_item(spark, sf_dir):
    return Fc.accuracy_by(accuracy(spark, sf_dir), ["sku"]).drop("bias_value")


@query("""SELECT sku, round(arg_max(qty, period), 6) AS naive FROM (SELECT s.sku, p.period, coalesce(q.qty, 0) AS qty FROM (SELECT DISTINCT part::VARCHAR AS sku FROM d_lines) s CROSS JOIN (SELECT DISTINCT period FROM d_series) p
LEFT JOIN (SELECT part::VARCHAR AS sku, date_trunc('month', demand_date)::DATE AS period, sum(qty) AS qty FROM d_lines GROUP BY ALL) q ON q.sku = s.sku AND q.period = p.period) GROUP BY sku""")
def d15_naive_by_part(spark, sf_dir):
    parts = D.monthly_series(lines(spark, sf_dir).withColumn("sku", F.col("part").cast("string")))
    return tidy(Fc.as_arrays(parts).select("sku", Fc.naive(F.col("q")).alias("naive")))


@query(f"""SELECT * EXCLUDE (k) FROM (SELECT sku, any_value(model) AS model, any_value(selected_by) AS selected_by, round(round(any_value(backtest_mape), 9), 6) AS backtest_mape, round(round(any_value(backtest_mase), 9), 6) AS backtest_mase, round(round(any_value(backtest_rmse), 9), 6) AS backtest_rmse, any_value(vs_naive) AS vs_naive,
any_value(forecast_rmse) AS forecast_rmse, any_value(expected_order_size) AS expected_order_size, any_value(expected_interval) AS expected_interval, {wide("fcst", "forecast_qty", COMING)} FROM f_det GROUP BY sku) LEFT JOIN (SELECT sku AS k, {wide("hist", "qty", PAST)} FROM d_series GROUP BY sku) ON k = sku""")
def d27_history_and_forecast(spark, sf_dir):
    return _scored(Fc.history_and_forecast(series(spark, sf_dir), detail(spark, sf_dir), *spine(spark, sf_dir)))
