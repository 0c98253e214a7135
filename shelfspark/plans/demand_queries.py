"""Queries and oracles of the demand section."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import demand as D
from shelfspark.plans.fixtures import AS_OF, ORACLE_VIEWS, once, query, tidy, view

ORACLE_VIEWS["d_lines"] = "SELECT *, coalesce(ship_date, order_date) AS demand_date FROM fx_sales WHERE coalesce(ship_date, order_date) IS NOT NULL AND qty > 0"
ORACLE_VIEWS["d_series"] = """
SELECT s.sku, p.period, coalesce(q.qty, 0) AS qty
FROM (SELECT DISTINCT sku FROM d_lines) s CROSS JOIN (SELECT DISTINCT date_trunc('month', demand_date)::DATE AS period FROM d_lines) p
LEFT JOIN (SELECT sku, date_trunc('month', demand_date)::DATE AS period, sum(qty) AS qty FROM d_lines GROUP BY 1, 2) q ON q.sku = s.sku AND q.period = p.period"""
ORACLE_VIEWS["d_class0"] = """
SELECT sku, count(*) FILTER (qty > 0) AS active, count(*) AS total, avg(qty) AS mean, avg(qty) FILTER (qty > 0) AS mean_active, stddev_samp(qty) AS sd
FROM d_series WHERE period IN (SELECT DISTINCT period FROM d_series ORDER BY period DESC LIMIT 12) GROUP BY sku"""
ORACLE_VIEWS["d_class"] = """
SELECT sku, active AS active_cycles, total AS total_cycles, round_even(mean, 2) AS demand_mean_rolling, round_even(coalesce(mean_active, 0), 2) AS demand_mean_conditional,
  round_even(sd, 2) AS demand_std_rolling, CASE WHEN mean > 0 THEN round_even(sd / mean, 3) END AS demand_cv,
  CASE WHEN active >= 9 THEN 'stocking-high' WHEN active >= 6 THEN 'stocking-med' ELSE 'non-stocking' END AS stocking_class,
  CASE WHEN active >= 9 THEN 0.95 WHEN active >= 6 THEN 0.9 END::DOUBLE AS service_level, CASE WHEN active >= 9 THEN 1.645 WHEN active >= 6 THEN 1.282 END::DOUBLE AS z_score,
  CASE WHEN active < 6 THEN 'non-stocking' WHEN NOT mean > 0 THEN 'unknown'
    WHEN active / total >= 0.75 THEN CASE WHEN round_even(sd / mean, 3) <= 0.5 THEN 'smooth' WHEN round_even(sd / mean, 3) < 1 THEN 'variable' ELSE 'erratic' END
    WHEN round_even(sd / mean, 3) >= 1 THEN 'lumpy' ELSE 'intermittent' END AS demand_pattern
FROM d_class0"""


def lines(spark, sf_dir):
    return D.demand_lines(view(spark, sf_dir, "fx_sales"))


@once
def totals(spark, sf_dir):
    return D.month_totals(lines(spark, sf_dir))


def series(spark, sf_dir):
    return D.series_of(totals(spark, sf_dir))


def classified(spark, sf_dir):
    return D.classify(series(spark, sf_dir))


@query("SELECT so_number, so_line_number, sku, demand_date, round(qty, 6) AS qty FROM d_lines")
def d01_demand_lines(spark, sf_dir):
    return tidy(lines(spark, sf_dir).select("so_number", "so_line_number", "sku", "demand_date", "qty"))


@query("""SELECT count(*) AS lines, count(*) FILTER (coalesce(ship_date, order_date) IS NULL) AS undated,
  count(*) FILTER (coalesce(ship_date, order_date) IS NOT NULL AND qty < 0) AS returns, count(*) FILTER (coalesce(ship_date, order_date) IS NOT NULL AND qty = 0) AS zero FROM fx_sales""")
def d01_dropped_lines(spark, sf_dir):
    return D.demand_line_counts(view(spark, sf_dir, "fx_sales"))


@query("SELECT sku, period, round(qty, 6) AS qty FROM d_series")
def d02_monthly_series(spark, sf_dir):
    return tidy(series(spark, sf_dir))


@query("""SELECT s.sku, round(demand_mean, 6) AS demand_mean, round(demand_std, 6) AS demand_std, active_cycles, total_cycles, round(total_qty, 6) AS total_qty,
  first_sale, last_sale, round(CASE WHEN mean_all > 0 THEN demand_std / mean_all END, 6) AS demand_cv
FROM (SELECT sku, avg(qty) FILTER (qty > 0) AS demand_mean, stddev_samp(qty) AS demand_std, avg(qty) AS mean_all, count(*) FILTER (qty > 0) AS active_cycles,
  count(*) AS total_cycles, sum(qty) AS total_qty FROM d_series GROUP BY sku) s
LEFT JOIN (SELECT sku, min(demand_date) AS first_sale, max(demand_date) AS last_sale FROM d_lines GROUP BY sku) d ON s.sku = d.sku""")
def d03_demand_summary(spark, sf_dir):
    s = lines(spark, sf_dir)
    return tidy(D.demand_summary(D.monthly_series(s), s))


@query("""SELECT sku, round(m, 6) AS demand_mean, round(sd, 6) AS demand_std, active_cycles, total_cycles, round(total_qty, 6) AS total_qty, round(CASE WHEN m > 0 THEN sd / m END, 6) AS demand_cv
FROM (SELECT sku, coalesce(avg(qty) FILTER (qty > 0), 0) AS m, stddev_samp(qty) AS sd, count(*) FILTER (qty > 0) AS active_cycles, count(*) AS total_cycles, sum(qty) AS total_qty FROM d_series GROUP BY sku)""")
def d04_matrix_summary(spark, sf_dir):
    return tidy(D.matrix_summary(series(spark, sf_dir)))


@query("""SELECT sku, round(avg(qty) FILTER (qty > 0), 6) AS demand_mean, 'demand_history' AS demand_source FROM d_series GROUP BY sku
UNION ALL SELECT DISTINCT sku, 0.0::DOUBLE, 'item_master' FROM fx_item_master WHERE sku NOT IN (SELECT sku FROM d_lines)""")
def d05_population(spark, sf_dir):
    s = lines(spark, sf_dir)
    summary = D.demand_summary(D.monthly_series(s), s)
    return tidy(D.extend_population(summary, [("item_master", view(spark, sf_dir, "fx_item_master")), ("inventory", view(spark, sf_dir, "fx_inventory"))]))


@query("""SELECT d AS as_of, DATE '2000-01-01' - d AS stale_days FROM (SELECT greatest((SELECT max(ship_date) FROM fx_sales WHERE ship_date <= DATE '2000-01-01'),
  (SELECT max(po_date) FROM fx_po_history WHERE po_date <= DATE '2000-01-01')) AS d)""")
def d06_newest_date(spark, sf_dir):
    found = D.newest_date([(view(spark, sf_dir, "fx_sales"), "ship_date"), (view(spark, sf_dir, "fx_po_history"), "po_date")], F.lit(AS_OF).cast("date"))
    return found.withColumn("stale_days", F.col("stale_days").cast("long"))


@query("SELECT * FROM d_class")
def d07_classification(spark, sf_dir):
    return classified(spark, sf_dir)


@query("SELECT demand_pattern, stocking_class, count(*) AS items FROM d_class GROUP BY ALL")
def d08_pattern_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("demand_pattern", "stocking_class").agg(F.count("*").alias("items"))


@query("""SELECT sku, CASE WHEN active_cycles < 6 THEN 'MTO' ELSE 'MTS' END AS suggested_policy, format('demand in {}/{} months', active_cycles, total_cycles) AS evidence,
  CASE WHEN active_cycles < 6 THEN 'too sporadic to hold' ELSE format('recurs in {:.0f}% of months', 100.0 * active_cycles / total_cycles) END AS reading FROM d_class""")
def d09_suggested_policy(spark, sf_dir):
    # the ratio in the middle of the text is cut out: engines print its last digit differently
    evidence, reading = F.regexp_extract("policy_basis", r"^([^,]*),", 1), F.regexp_extract("policy_basis", r" - (.*)$", 1)
    return D.suggest_policy(classified(spark, sf_dir)).select("sku", "suggested_policy", evidence.alias("evidence"), reading.alias("reading"))


@query("""SELECT CASE WHEN stocking_policy = 'MTO' AND stocking_class <> 'non-stocking' THEN 'held MTO, recurs' WHEN stocking_policy = 'MTS' AND stocking_class = 'non-stocking'
  THEN 'held MTS, sporadic' ELSE 'agrees' END AS finding, count(*) AS items FROM d_class JOIN fx_item_master USING (sku) GROUP BY 1""")
def d10_policy_conflicts(spark, sf_dir):
    return D.policy_conflicts(classified(spark, sf_dir), view(spark, sf_dir, "fx_item_master"))


@query("""SELECT sku, round(avg(qty), 6) AS mean_size, round(greatest(1, coalesce((coalesce(sum(gap), 0) + max(n) - max(i)) / nullif(count(gap) + CASE WHEN max(n) > max(i) THEN 1 ELSE 0 END, 0), 1)), 6) AS mean_gap
FROM (SELECT sku, qty, i, n, i - lag(i) OVER (PARTITION BY sku ORDER BY i) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY period) AS i,
  count(*) OVER (PARTITION BY sku) AS n FROM d_series) WHERE qty > 0) GROUP BY sku""")
def d11_demand_shape(spark, sf_dir):
    return tidy(D.demand_shape(series(spark, sf_dir)))


@query("""SELECT sku, round(avg(CASE WHEN qty > 0 THEN 1.0 ELSE 0 END) FILTER (period >= f), 6) AS density
FROM (SELECT *, min(period) FILTER (qty > 0) OVER (PARTITION BY sku) AS f FROM d_series) GROUP BY sku""")
def d12_density(spark, sf_dir):
    return tidy(D.density_since_first(series(spark, sf_dir)))


@query("""SELECT sku, round(slope, 6) AS slope, coalesce(n >= 3 AND abs(slope) > 1e-12 AND abs(slope) * (n - 1) >= 0.2 * abs(m)
  AND (NOT e > 1e-12 OR abs(slope) / e >= 2), false) AS has_trend
FROM (SELECT *, sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / sxx) AS e FROM (SELECT sku, count(*) AS n, avg(qty) AS m, regr_slope(qty, i) AS slope, regr_sxx(qty, i) AS sxx,
  regr_syy(qty, i) AS syy, regr_sxy(qty, i) AS sxy FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY period)::DOUBLE AS i FROM d_series) GROUP BY sku))""")
def d13_trend(spark, sf_dir):
    return tidy(D.trend_test(series(spark, sf_dir)))


@query("""SELECT sku, CASE WHEN n + 1 >= 6 AND s3 / ee >= b THEN 3 WHEN n + 1 >= 8 AND s4 / ee >= b THEN 4 WHEN n + 1 >= 12 AND s6 / ee >= b THEN 6 WHEN n + 1 >= 24 AND s12 / ee >= b THEN 12 END AS season
FROM (SELECT sku, count(*) AS n, greatest(0.3, 2.5 / sqrt(count(*))) AS b, nullif(sum(e * e), 0) AS ee, sum(e * e3) AS s3, sum(e * e4) AS s4, sum(e * e6) AS s6, sum(e * e12) AS s12 FROM (
  SELECT *, lag(e, 3) OVER w AS e3, lag(e, 4) OVER w AS e4, lag(e, 6) OVER w AS e6, lag(e, 12) OVER w AS e12 FROM (
    SELECT sku, period, d - avg(d) OVER (PARTITION BY sku) AS e FROM (SELECT *, qty - lag(qty) OVER (PARTITION BY sku ORDER BY period) AS d FROM d_series) WHERE d IS NOT NULL)
  WINDOW w AS (PARTITION BY sku ORDER BY period)) GROUP BY sku)""")
def d14_season(spark, sf_dir):
    return D.season_test(series(spark, sf_dir))
