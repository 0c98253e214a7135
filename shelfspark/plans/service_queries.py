"""Queries and oracles of the service and cadence sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import replenish as R
from shelfspark.operators import service as V
from shelfspark.plans.demand_queries import lines as demand_lines
from shelfspark.plans.fixtures import ORACLE_VIEWS, query, tidy, view
from shelfspark.plans.supply_queries import AT, at, stock

ORACLE_VIEWS["v_ship"] = """
SELECT sku, customer, order_date, customer_request_date, qty, amount AS value, greatest(ship_date - customer_request_date, CASE WHEN customer_request_date IS NULL THEN NULL ELSE 0 END) AS days_late,
  CASE WHEN customer_request_date IS NULL THEN 'unjudgeable' WHEN ship_date <= customer_request_date THEN 'on_time' ELSE 'shipped_late' END AS state FROM fx_sales"""
ORACLE_VIEWS["v_cad"] = f"""
SELECT *, sum(po_qty - demand_qty) OVER (PARTITION BY sku ORDER BY month) AS balance FROM (
SELECT k.sku, m.month, coalesce(p.q, 0) AS po_qty, coalesce(d.q, 0) AS demand_qty
FROM (SELECT sku FROM fx_po_history WHERE date_trunc('month', po_date) >= DATE '1999-02-01' INTERSECT SELECT sku FROM d_lines WHERE date_trunc('month', demand_date) >= DATE '1999-02-01') k
CROSS JOIN (SELECT unnest(generate_series(DATE '1999-02-01', DATE '2000-01-01', INTERVAL 1 MONTH))::DATE AS month) m
LEFT JOIN (SELECT sku, date_trunc('month', po_date)::DATE AS month, sum(po_qty) AS q FROM fx_po_history GROUP BY ALL) p ON p.sku = k.sku AND p.month = m.month
LEFT JOIN (SELECT sku, date_trunc('month', demand_date)::DATE AS month, sum(qty) AS q FROM d_lines GROUP BY ALL) d ON d.sku = k.sku AND d.month = m.month)"""
ORACLE_VIEWS["v_oc"] = "SELECT sku, count(DISTINCT po_number) AS order_count FROM fx_po_history WHERE date_trunc('month', po_date) >= DATE '1999-02-01' GROUP BY sku"
ORACLE_VIEWS["v_met"] = """
SELECT sku, count(*) AS months, sum(po_qty) AS po_qty, sum(demand_qty) AS demand_qty, max(order_count) AS order_count, count(*) FILTER (po_qty > 0) AS order_months, arg_max(balance, month) AS closing_balance,
  count(*) FILTER (side = -1) AS deficit_months, count(*) FILTER (side = 1) AS surplus_months, coalesce(max(run) FILTER (side = -1), 0) AS longest_deficit_run,
  coalesce(max(run) FILTER (side = 1), 0) AS longest_surplus_run, greatest(-min(balance), 0) AS max_deficit, greatest(max(balance), 0) AS max_surplus, max(tol) AS tolerance_qty,
  CASE WHEN sum(demand_qty) > 0 THEN arg_max(balance, month) / sum(demand_qty) END AS imbalance_pct
FROM (SELECT *, count(*) OVER (PARTITION BY sku, side, island) AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY month) - row_number() OVER (PARTITION BY sku, side ORDER BY month) AS island FROM (
    SELECT *, CASE WHEN balance < -tol THEN -1 WHEN balance > tol THEN 1 ELSE 0 END AS side FROM (
      SELECT c.*, coalesce(order_count, 0) AS order_count, greatest(0.5 * avg(demand_qty) OVER (PARTITION BY c.sku), coalesce(sum(po_qty) OVER (PARTITION BY c.sku) / nullif(order_count, 0), 0)) AS tol
      FROM v_cad c LEFT JOIN v_oc o ON o.sku = c.sku)))) GROUP BY sku"""
ORACLE_VIEWS["v_ver"] = """
SELECT *, round_even(excess_value + shortfall_value + avoidable_order_cost, 2) AS exposure_value FROM (
SELECT *, round_even(max_surplus * unit_cost, 2) AS excess_value, round_even(max_deficit * unit_cost, 2) AS shortfall_value, CASE WHEN frequency_earned THEN 0 ELSE round_even(greatest(order_count - expected_orders, 0) * 350.0, 2) END AS avoidable_order_cost,
  CASE WHEN longest_deficit_run >= 2 AND longest_surplus_run >= 2 THEN 'oscillating' WHEN short AND closing_balance < -tolerance_qty AND order_count / expected_orders < 1 / 1.25 THEN 'under_ordered' WHEN short THEN 'chasing'
    WHEN longest_surplus_run >= 3 OR (coalesce(imbalance_pct, 0) > 0.25 AND closing_balance > tolerance_qty) THEN 'losing_control'
    WHEN abs(closing_balance) <= tolerance_qty AND deficit_months = 0 AND order_count / expected_orders > 1.5 THEN 'unearned_frequency' ELSE 'controlled' END AS verdict
FROM (SELECT m.*, i.unit_cost, coalesce(abc_class = 'A', false) AS frequency_earned, greatest(round_even(months / (30.0 / 30.44), 0), 1) AS expected_orders, longest_deficit_run >= 2 OR deficit_months >= months / 3 AS short
  FROM v_met m LEFT JOIN fx_item_master i ON i.sku = m.sku LEFT JOIN p_abc a ON a.sku = m.sku WHERE order_count >= 2))"""
ORACLE_VIEWS["v_daily"] = "SELECT sku, sum(qty) FILTER (demand_date > DATE '1999-01-01') / 365.0 AS daily_demand FROM d_lines GROUP BY sku"


def shipped(spark, sf_dir):
    return V.shipped_lines(view(spark, sf_dir, "fx_sales"))


def opened(spark, sf_dir):
    order = F.concat_ws("/", F.lpad(F.col("so_number").cast("string"), 12, "0"), F.col("so_line_number"), F.lpad(F.col("part").cast("string"), 12, "0"), F.col("open_qty"), F.col("open_amount"))
    rows = view(spark, sf_dir, "fx_open_so").withColumn("line_order", order)
    return R.allocate(rows, stock(spark, sf_dir))


def every_line(spark, sf_dir):
    return shipped(spark, sf_dir).unionByName(V.open_lines(opened(spark, sf_dir), at()))


def matrix(spark, sf_dir):
    return V.cadence_matrix(view(spark, sf_dir, "fx_po_history"), demand_lines(spark, sf_dir), at())


def metrics(spark, sf_dir):
    return V.cadence_metrics(matrix(spark, sf_dir), V.order_counts(view(spark, sf_dir, "fx_po_history"), at()))


def verdicts(spark, sf_dir):
    from shelfspark.plans.policy_queries import classes

    attrs = view(spark, sf_dir, "fx_item_master").select("sku", "unit_cost").join(classes(spark, sf_dir).select("sku", "abc_class"), "sku", "left")
    return V.cadence_verdict(metrics(spark, sf_dir), attrs)


def daily(spark, sf_dir):
    recent = F.sum(F.when(F.col("demand_date") > F.add_months(at(), -12), F.col("qty")))
    return demand_lines(spark, sf_dir).groupBy("sku").agg((recent / 365.0).alias("daily_demand"))


ORACLE_VIEWS["r_lines"] = """
SELECT *, row_number() OVER (PARTITION BY sku ORDER BY customer_request_date NULLS LAST, lpad(so_number::VARCHAR, 12, '0'), so_line_number, lpad(part::VARCHAR, 12, '0'), open_qty, open_amount) AS i FROM fx_open_so"""
ORACLE_VIEWS["r_walk"] = """
SELECT l.*, s.qty_on_hand >= l.open_qty * 0.95 AS fillable, CASE WHEN s.qty_on_hand >= l.open_qty * 0.95 THEN greatest(s.qty_on_hand - l.open_qty, 0) ELSE s.qty_on_hand END AS rest FROM r_lines l JOIN s_stock s ON s.sku = l.sku WHERE i = 1
UNION ALL SELECT l.*, w.rest >= l.open_qty * 0.95, CASE WHEN w.rest >= l.open_qty * 0.95 THEN greatest(w.rest - l.open_qty, 0) ELSE w.rest END FROM r_walk w JOIN r_lines l ON l.sku = w.sku AND l.i = w.i + 1"""
ORACLE_VIEWS["v_open"] = f"""
SELECT *, CASE WHEN customer_request_date IS NULL THEN 'unjudgeable' WHEN customer_request_date >= {AT} THEN 'not_yet_due' WHEN fillable THEN 'past_due_available' ELSE 'past_due_short' END AS state,
  greatest({AT} - customer_request_date, 0) AS days_late FROM r_walk"""
ORACLE_VIEWS["r_judged"] = f"SELECT *, CASE WHEN fillable THEN open_qty ELSE 0 END AS idle FROM r_walk WHERE customer_request_date < {AT}"
ORACLE_VIEWS["r_rate"] = "SELECT greatest(least(coalesce(1 - sum(idle) / sum(open_qty), 1), 1), 0.25) AS rate, count(*) AS n FROM r_judged"


@query("SELECT so_number, so_line_number, sku, part, open_qty, fillable FROM r_walk")
def r11_allocated_stock(spark, sf_dir):
    return opened(spark, sf_dir).select("so_number", "so_line_number", "sku", "part", "open_qty", "fillable")


@query("""SELECT sku, n AS lines, round_even(greatest(least((n * own + 3 * rate) / (n + 3), 1), 0.25), 3) AS realization_rate
FROM (SELECT sku, count(*) AS n, 1 - sum(idle) / sum(open_qty) AS own FROM r_judged GROUP BY sku) CROSS JOIN (SELECT rate FROM r_rate)""")
def r12_realization(spark, sf_dir):
    return R.realization(opened(spark, sf_dir), at())[0]


@query("SELECT round(rate, 6) AS portfolio_rate, n AS judged_lines FROM r_rate")
def r12_portfolio_realization(spark, sf_dir):
    return tidy(R.realization(opened(spark, sf_dir), at())[1])


@query("SELECT sku, customer, customer_request_date, open_qty AS qty, open_amount AS value, state, days_late FROM v_open")
def v02_open_lines(spark, sf_dir):
    found = V.open_lines(opened(spark, sf_dir), at())
    return found.select("sku", "customer", "customer_request_date", "qty", "value", "state", F.col("days_late").cast("long").alias("days_late"))


@query("SELECT sku, count(*) AS lines, sum(open_qty) AS qty, round(sum(open_amount), 2) AS value, max(days_late) AS oldest_days FROM v_open WHERE state = 'past_due_available' GROUP BY sku")
def v08_uncollected(spark, sf_dir):
    found = V.uncollected(V.open_lines(opened(spark, sf_dir), at()))
    return tidy(found, value=2).withColumn("oldest_days", F.col("oldest_days").cast("long"))


@query("SELECT sku, customer, customer_request_date, qty, value, state, days_late FROM v_ship")
def v01_shipped_lines(spark, sf_dir):
    found = shipped(spark, sf_dir).select("sku", "customer", "customer_request_date", "qty", "value", "state", "days_late")
    return found.withColumn("days_late", F.col("days_late").cast("long"))


@query("""SELECT round(n / nullif(n + late, 0), 6) AS line_rate, round(n / nullif(n + late, 0), 6) AS harsh_rate, round(cn / nullif(call, 0), 6) AS clean_rate, round(v / nullif(va, 0), 6) AS value_rate,
  0 AS past_due_lines, 0.0::DOUBLE AS past_due_value FROM (SELECT count(*) FILTER (state = 'on_time') AS n, count(*) FILTER (state = 'shipped_late') AS late,
  count(*) FILTER (state = 'on_time' AND customer_request_date > order_date) AS cn, count(*) FILTER (state IN ('on_time', 'shipped_late') AND customer_request_date > order_date) AS call,
  sum(value) FILTER (state = 'on_time') AS v, sum(value) FILTER (state IN ('on_time', 'shipped_late')) AS va FROM v_ship)""")
def v03_service_rates(spark, sf_dir):
    return tidy(V.service_rates(shipped(spark, sf_dir)))


@query("""SELECT s.state, s.label, coalesce(c.lines, 0) AS lines, round(coalesce(c.lines, 0) / (SELECT count(*) FROM v_ship), 6) AS share FROM (VALUES ('on_time', 'shipped by the requested date'),
  ('shipped_late', 'shipped after the requested date'), ('not_yet_due', 'open, requested later'), ('past_due_available', 'open and past due, stock could fill it'),
  ('past_due_short', 'open and past due, stock is short'), ('unjudgeable', 'no requested date')) s(state, label) LEFT JOIN (SELECT state, count(*) AS lines FROM v_ship GROUP BY state) c ON c.state = s.state""")
def v04_state_counts(spark, sf_dir):
    return tidy(V.state_counts(shipped(spark, sf_dir)))


@query("""SELECT lines, missing, same_as_order, before_order, clean, round(clean / lines, 6) AS clean_rate, clean / lines >= 0.7 AS trusted FROM (SELECT count(*) AS lines, count(*) FILTER (customer_request_date IS NULL) AS missing,
  count(*) FILTER (customer_request_date = order_date) AS same_as_order, count(*) FILTER (customer_request_date < order_date) AS before_order, count(*) FILTER (customer_request_date > order_date) AS clean FROM v_ship)""")
def v05_request_dates(spark, sf_dir):
    return tidy(V.request_date_quality(shipped(spark, sf_dir)))


@query(f"""SELECT m.month, coalesce(lines, 0) AS lines, coalesce(on_time, 0) AS on_time, round(on_time / lines, 6) AS rate, coalesce(lines, 0) < 5 AS thin, last_day(m.month) >= {AT} AS partial
FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(customer_request_date))::DATE FROM v_ship), (SELECT date_trunc('month', max(customer_request_date))::DATE FROM v_ship), INTERVAL 1 MONTH))::DATE AS month) m
LEFT JOIN (SELECT date_trunc('month', customer_request_date)::DATE AS month, count(*) AS lines, count(*) FILTER (state = 'on_time') AS on_time FROM v_ship WHERE customer_request_date IS NOT NULL GROUP BY 1) c ON c.month = m.month""")
def v06_monthly_on_time(spark, sf_dir):
    return tidy(V.monthly_on_time(shipped(spark, sf_dir), at()))


def _failures(key: str) -> str:
    return f"""SELECT {key}, failures, judged, round(value, 2) AS value, round(avg_days_late, 6) AS avg_days_late, max_days_late, round(failures / judged, 6) AS rate,
  round(sum(value) OVER (ORDER BY value DESC, {key} ROWS UNBOUNDED PRECEDING) / sum(value) OVER (), 6) AS cumulative_share
FROM (SELECT {key}, count(*) FILTER (state = 'shipped_late') AS failures, count(*) AS judged, coalesce(sum(value) FILTER (state = 'shipped_late'), 0) AS value,
  avg(days_late) FILTER (state = 'shipped_late') AS avg_days_late, max(days_late) FILTER (state = 'shipped_late') AS max_days_late FROM v_ship WHERE state <> 'unjudgeable' GROUP BY {key}) WHERE failures > 0"""


@query(_failures("sku"))
def v07_failures_by_item(spark, sf_dir):
    return tidy(V.failures_by(shipped(spark, sf_dir), "sku"), value=2).withColumn("max_days_late", F.col("max_days_late").cast("long"))


@query(_failures("customer"))
def v07_failures_by_customer(spark, sf_dir):
    return tidy(V.failures_by(shipped(spark, sf_dir), "customer"), value=2).withColumn("max_days_late", F.col("max_days_late").cast("long"))


@query("SELECT date_trunc('month', min(customer_request_date))::DATE AS first_month, date_trunc('month', max(customer_request_date))::DATE AS last_month FROM v_ship")
def v09_measured_window(spark, sf_dir):
    return V.measured_window(shipped(spark, sf_dir))


@query("SELECT * FROM v_cad")
def v10_cadence_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@query("SELECT * REPLACE (round(tolerance_qty, 6) AS tolerance_qty, round(imbalance_pct, 6) AS imbalance_pct) FROM v_met")
def v11_cadence_metrics(spark, sf_dir):
    return tidy(metrics(spark, sf_dir))


@query("SELECT sku, verdict, frequency_earned, expected_orders, excess_value, shortfall_value, avoidable_order_cost, exposure_value FROM v_ver")
def v12_cadence_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir).select("sku", "verdict", "frequency_earned", "expected_orders", "excess_value", "shortfall_value", "avoidable_order_cost", "exposure_value")


@query("SELECT verdict, count(*) AS items, round(sum(exposure_value), 2) AS exposure_value, round(count(*) / (SELECT count(*) FROM v_ver), 6) AS share FROM v_ver GROUP BY verdict")
def v13_verdict_counts(spark, sf_dir):
    return tidy(V.verdict_counts(verdicts(spark, sf_dir)), exposure_value=2)


@query("""SELECT sku, bought, round(bought / nullif(daily_demand, 0), 6) AS days_bought, round((bought - 365 * daily_demand) * unit_cost, 2) AS excess_value
FROM (SELECT sku, sum(po_qty) AS bought FROM fx_po_history WHERE po_date > DATE '1999-01-01' GROUP BY sku) JOIN v_daily USING (sku) JOIN fx_item_master USING (sku) WHERE daily_demand = 0 OR bought / nullif(daily_demand, 0) > 365""")
def v14_over_ordering(spark, sf_dir):
    demand = daily(spark, sf_dir).join(view(spark, sf_dir, "fx_item_master").select("sku", "unit_cost"), "sku")
    return tidy(V.over_ordering(view(spark, sf_dir, "fx_po_history"), demand, at()), excess_value=2)


@query("""SELECT sku, orders, round(m, 6) AS mean_lot, round(cv, 6) AS lot_cv FROM (SELECT sku, count(*) AS orders, avg(po_qty) AS m, stddev_samp(po_qty) / avg(po_qty) AS cv
FROM fx_po_history WHERE po_qty > 0 GROUP BY sku) WHERE orders >= 4 AND cv > 0.6""")
def v15_erratic_lots(spark, sf_dir):
    return tidy(V.erratic_lots(view(spark, sf_dir, "fx_po_history")))


@query("""SELECT sku, orders, air_orders, round(air_spend, 2) AS air_spend, round(air_orders / orders, 6) AS air_share FROM (SELECT sku, count(*) AS orders, count(*) FILTER (transport_mode = 'AIR') AS air_orders,
sum(po_amount) FILTER (transport_mode = 'AIR') AS air_spend FROM fx_po_history GROUP BY sku) WHERE orders >= 3 AND air_orders / orders >= 0.3""")
def v16_air_freight(spark, sf_dir):
    return tidy(V.air_freight(view(spark, sf_dir, "fx_po_history")), air_spend=2)


@query(f"""SELECT sku, days_left, horizon, inbound_before, round(qty_at_risk, 6) AS qty_at_risk, round(qty_at_risk * unit_cost, 2) AS value_at_risk, days_left <= 30 AS urgent FROM (
SELECT *, floor((qty_on_hand + inbound_before) / daily_demand)::BIGINT AS days_left, greatest(horizon * daily_demand - qty_on_hand - inbound_before, 0) AS qty_at_risk FROM (
SELECT s.sku, qty_on_hand, s.unit_cost, daily_demand, CASE WHEN lead_time_days > 0 THEN lead_time_days ELSE 180.0 END AS horizon,
  coalesce((SELECT sum(open_qty) FROM fx_open_po p WHERE p.sku = s.sku AND committed_delivery >= {AT} AND committed_delivery <= {AT} + floor(qty_on_hand / daily_demand)::INT), 0) AS inbound_before
FROM s_stock s JOIN v_daily d ON d.sku = s.sku LEFT JOIN fx_item_master m ON m.sku = s.sku WHERE daily_demand > 0)) WHERE days_left < horizon""")
def v17_stockout_forecast(spark, sf_dir):
    lead = view(spark, sf_dir, "fx_item_master").select("sku", F.col("lead_time_days").alias("lead_days"))
    return tidy(V.stockout_forecast(stock(spark, sf_dir), daily(spark, sf_dir), view(spark, sf_dir, "fx_open_po"), lead, at()), value_at_risk=2)


@query("""SELECT s.sku, qty_on_hand, round(qty_on_hand / nullif(coalesce(daily_demand, 0), 0), 6) AS cover_days, round(qty_on_hand * unit_cost, 2) AS stock_value FROM s_stock s LEFT JOIN v_daily d ON d.sku = s.sku
WHERE qty_on_hand > 0 AND (coalesce(daily_demand, 0) = 0 OR qty_on_hand / nullif(daily_demand, 0) > 365)""")
def v18_slow_burn(spark, sf_dir):
    return tidy(V.slow_burn(stock(spark, sf_dir), daily(spark, sf_dir)), stock_value=2)
