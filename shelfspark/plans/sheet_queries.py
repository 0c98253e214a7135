"""Queries and oracles of sheets, report tables, the stock target and stock by status."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import demand as D
from shelfspark.operators import forecast as Fc
from shelfspark.operators import planning as L
from shelfspark.operators import profile as Pr
from shelfspark.operators import replenish as R
from shelfspark.operators import reports as Rp
from shelfspark.operators import service as V
from shelfspark.operators import supply as S
from shelfspark.operators import target as T
from shelfspark.plans.demand_queries import classified, lines, series
from shelfspark.plans.fixtures import ORACLE_VIEWS, once, query, tidy, view
from shelfspark.plans.forecast_queries import COMING, PAST, accuracy, detail, reviewed, spine, wide
from shelfspark.plans.planning_queries import balance
from shelfspark.plans.policy_queries import classes, lever_results, shouldbe
from shelfspark.plans.profile_queries import profile_params, suggested
from shelfspark.plans.service_queries import daily, opened
from shelfspark.plans.supply_queries import AT, at, inbound, projection, recommended, stock
from shelfspark.sources import files

ORACLE_VIEWS["g_price"] = """
SELECT sku, src AS price_source, CASE src WHEN 'trailing_12m' THEN p12 WHEN 'trailing_3m' THEN p3 WHEN 'all_history' THEN pa WHEN 'standard_cost' THEN unit_cost END AS price FROM (
SELECT *, CASE WHEN p12 > 0 THEN 'trailing_12m' WHEN p3 > 0 THEN 'trailing_3m' WHEN pa > 0 THEN 'all_history' WHEN unit_cost > 0 THEN 'standard_cost' ELSE 'none' END AS src
FROM (SELECT sku, sum(amount::DECIMAL(24,6)) FILTER (demand_date > DATE '1999-01-01')::DOUBLE / sum(qty) FILTER (demand_date > DATE '1999-01-01') AS p12, sum(amount::DECIMAL(24,6)) FILTER (demand_date > DATE '1999-10-01')::DOUBLE / sum(qty) FILTER (demand_date > DATE '1999-10-01') AS p3,
  sum(amount::DECIMAL(24,6))::DOUBLE / sum(qty) AS pa FROM d_lines GROUP BY sku) FULL JOIN fx_item_master USING (sku))"""
ORACLE_VIEWS["g_share"] = """
SELECT sku, country, (q + CASE WHEN place = 1 THEN t - sum(q) OVER (PARTITION BY sku) ELSE 0 END) / t AS share FROM (
SELECT *, row_number() OVER (PARTITION BY sku ORDER BY raw DESC, country) AS place FROM (SELECT sku, country, q, sum(q) OVER (PARTITION BY sku) AS t, q / sum(q) OVER (PARTITION BY sku) AS raw FROM (
  SELECT sku, country, CASE WHEN sum(r) OVER (PARTITION BY sku) > 0 THEN coalesce(r, 0) ELSE a END AS q FROM (
    SELECT sku, country, sum(qty) FILTER (demand_date > DATE '1999-01-01') AS r, sum(qty) AS a FROM d_lines GROUP BY ALL)))) WHERE raw >= 0.02 OR place = 1"""
ORACLE_VIEWS["g_rows"] = """
SELECT x.sku, coalesce(country, '(not stated)') AS country, period, kind, qty * coalesce(share, 1) AS qty, CASE kind WHEN 'history' THEN amount * coalesce(share, 1) ELSE qty * coalesce(share, 1) * price END AS amount,
  CASE WHEN coalesce(share, 1) < 1 THEN 'top-down by share' ELSE 'single country' END AS split_basis
FROM (SELECT d.sku, d.period, 'history' AS kind, qty, amount FROM d_series d SEMI JOIN f_det g ON g.sku = d.sku LEFT JOIN (SELECT sku, date_trunc('month', demand_date)::DATE AS period, sum(amount::DECIMAL(24,6))::DOUBLE AS amount FROM d_lines GROUP BY ALL) v ON v.sku = d.sku AND v.period = d.period
  WHERE d.period IN (SELECT DISTINCT period FROM d_series ORDER BY period DESC LIMIT 12)
  UNION ALL SELECT sku, period, 'forecast', forecast_qty, NULL FROM f_det) x
LEFT JOIN g_price p ON p.sku = x.sku LEFT JOIN g_share s ON s.sku = x.sku"""
ORACLE_VIEWS["g_attr"] = """
SELECT m.sku, m.product_family, m.business_unit, m.stocking_policy, m.unit_cost, abc_class, annual_value, CASE WHEN active_cycles IS NULL THEN NULL WHEN active_cycles < 6 THEN 'MTO' ELSE 'MTS' END AS suggested_policy
FROM fx_item_master m LEFT JOIN p_abc a ON a.sku = m.sku LEFT JOIN d_class c ON c.sku = m.sku"""


def sheet_items(spark, sf_dir):
    past, _ = spine(spark, sf_dir)
    return L.sop_items(series(spark, sf_dir), detail(spark, sf_dir), L.value_series(lines(spark, sf_dir)), past)


def shares(spark, sf_dir):
    return L.country_shares(lines(spark, sf_dir), at())


def dimensions(spark, sf_dir):
    return view(spark, sf_dir, "fx_item_master").select("sku", "business_unit", "product_family", "stocking_policy")


@once
def prices(spark, sf_dir):
    return L.selling_price(lines(spark, sf_dir), view(spark, sf_dir, "fx_item_master"), at())


def attributes(spark, sf_dir):
    master = view(spark, sf_dir, "fx_item_master").select("sku", "product_family", "business_unit", "stocking_policy", "unit_cost")
    wanted = D.suggest_policy(classified(spark, sf_dir)).select("sku", "suggested_policy")
    return master.join(classes(spark, sf_dir), "sku", "left").join(wanted, "sku", "left")


@query("SELECT sku, country, period, kind, qty, amount, split_basis FROM g_rows", shared="fx_sales")
def l09_sop_rows(spark, sf_dir):
    return L.sop_rows(sheet_items(spark, sf_dir), prices(spark, sf_dir), shares(spark, sf_dir))  # sums and quotients are exact or the same in both engines: nothing is rounded


ORACLE_VIEWS["g_tot"] = """
SELECT sku, country, any_value(split_basis) AS split_basis, sum(floor(qty * 10000 + 0.5)::BIGINT) FILTER (kind = 'history')::DOUBLE / 10000 AS history_qty_total, sum(floor(amount * 10000 + 0.5)::BIGINT) FILTER (kind = 'history')::DOUBLE / 10000 AS history_amount_total,
  sum(floor(qty * 10000 + 0.5)::BIGINT) FILTER (kind = 'forecast')::DOUBLE / 10000 AS forecast_qty_total, sum(floor(amount * 10000 + 0.5)::BIGINT) FILTER (kind = 'forecast')::DOUBLE / 10000 AS forecast_amount_total FROM g_rows GROUP BY sku, country"""
_SHEET = """sku, country, business_unit, product_family, stocking_policy, history_qty_total, history_amount_total, forecast_qty_total, forecast_amount_total,
model, selected_by, vs_naive, round(round(backtest_mape, 9), 6) AS backtest_mape, price AS asp, price_source AS price_basis, split_basis"""
_JOINED = "FROM g_tot LEFT JOIN fx_item_master USING (sku) LEFT JOIN g_price USING (sku) LEFT JOIN (SELECT sku, model, selected_by, vs_naive, backtest_mape FROM f_det WHERE is_next_period) USING (sku)"


def _shown(df):
    return df.withColumn("backtest_mape", F.round(F.round("backtest_mape", 9), 6))


def sheet(spark, sf_dir, spread):
    made = sheet_items(spark, sf_dir), shares(spark, sf_dir), dimensions(spark, sf_dir), prices(spark, sf_dir), detail(spark, sf_dir)
    return _shown(L.sop_sheet(*made, *spine(spark, sf_dir), spread))


@query(f"SELECT {_SHEET} {_JOINED}", shared="fx_sales")
def l09_sop_totals(spark, sf_dir):
    return sheet(spark, sf_dir, False)


_CELLS = ", ".join(wide(f"{k} {unit}", c, months, f"kind = '{kind}'") for k, kind, months in (("hist", "history", PAST), ("fcst", "forecast", COMING)) for unit, c in (("qty", "qty"), ("amt", "amount")))


@query(f"SELECT {_SHEET}, s.* EXCLUDE (sku, country) {_JOINED} JOIN (SELECT sku, country, {_CELLS} FROM g_rows GROUP BY sku, country) s USING (sku, country)", shared="fx_sales")
def l09_sop_sheet(spark, sf_dir):
    return sheet(spark, sf_dir, True)


@query("""SELECT sku, location_id, CASE WHEN held THEN 0 ELSE qty_on_hand END AS qty_on_hand, qty_in_transit, CASE WHEN held THEN qty_on_hand ELSE 0 END AS qty_not_sellable, CASE WHEN held THEN location_id ELSE '' END AS stock_locations_excluded,
CASE WHEN held THEN qty_on_hand ELSE 0 END AS qty_quarantine FROM (SELECT *, location_id = '02' AS held FROM fx_inventory)""")
def c31_stock_by_status(spark, sf_dir):
    found = S.split_by_status(view(spark, sf_dir, "fx_inventory"), {"01": "sellable", "02": "quarantine"})
    return found.select("sku", "location_id", "qty_on_hand", "qty_in_transit", "qty_not_sellable", "stock_locations_excluded", "qty_quarantine")


@query("""SELECT finding, place, sku, abc_class, annual_value, items, round(value, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY annual_value DESC NULLS LAST, sku) AS place, count(*) OVER (PARTITION BY finding) AS items, sum(annual_value) OVER (PARTITION BY finding) AS value
FROM (SELECT *, CASE WHEN stocking_policy = 'MTO' AND suggested_policy = 'MTS' THEN 'recurs' WHEN stocking_policy = 'MTS' AND suggested_policy = 'MTO' THEN 'sporadic' END AS finding FROM g_attr) WHERE finding IS NOT NULL) WHERE place <= 12""")
def v19_policy_to_review(spark, sf_dir):
    return tidy(Rp.policy_to_review(attributes(spark, sf_dir)), value=2)


@query("""SELECT r.sku, a.stocking_policy, on_hand_cover_days, supply_gap_days, days_to_next_arrival, inbound_past_due_qty, period_demand, annual_value FROM r_rec r LEFT JOIN g_attr a ON a.sku = r.sku WHERE supply_gap ORDER BY supply_gap_days DESC NULLS LAST, r.sku LIMIT 12""")
def v19_supply_gaps(spark, sf_dir):
    return Rp.supply_gaps(recommended(spark, sf_dir), attributes(spark, sf_dir))


@query("""SELECT sku, stocking_policy, recommended_action, action_qty, round(action_qty * unit_cost, 2) AS action_value, days_of_supply, net_requirement FROM (SELECT r.sku, a.stocking_policy, recommended_action, CASE WHEN suggested_po_qty > 0 THEN suggested_po_qty ELSE pushout_open_po_qty END AS action_qty,
a.unit_cost, days_of_supply, net_requirement FROM r_rec r LEFT JOIN g_attr a ON a.sku = r.sku WHERE NOT starts_with(recommended_action, 'HOLD')) ORDER BY action_qty * unit_cost DESC, sku LIMIT 12""")
def v19_materials_to_act(spark, sf_dir):
    return tidy(Rp.materials_to_act(recommended(spark, sf_dir), attributes(spark, sf_dir)), action_value=2)


ORACLE_VIEWS["g_slow"] = "SELECT s.sku, qty_on_hand / daily_demand AS cover FROM s_stock s JOIN v_daily d ON d.sku = s.sku WHERE qty_on_hand > 0 AND daily_demand > 0 AND qty_on_hand / daily_demand > 365"
ORACLE_VIEWS["g_out"] = f"""
SELECT * FROM (SELECT *, floor((qty_on_hand + inbound_before) / daily_demand) AS days_left FROM (SELECT s.sku, qty_on_hand, daily_demand, CASE WHEN lead_time_days > 0 THEN lead_time_days ELSE 180.0 END AS horizon,
  coalesce((SELECT sum(open_qty) FROM fx_open_po p WHERE p.sku = s.sku AND committed_delivery >= {AT} AND committed_delivery <= {AT} + floor(qty_on_hand / daily_demand)::INT), 0) AS inbound_before
  FROM s_stock s JOIN v_daily d ON d.sku = s.sku LEFT JOIN fx_item_master m ON m.sku = s.sku WHERE daily_demand > 0)) WHERE days_left < horizon"""


@query("""SELECT sku, po_number, po_line_number, stocking_policy, action, open_qty, open_amount AS po_value, committed_delivery AS eta, round(cover, 6) AS days_of_cover FROM (
SELECT p.*, stocking_policy, cover, CASE WHEN cover IS NOT NULL THEN 'push out or cancel' WHEN days_to_next_arrival > days_left THEN 'pull in' END AS action
FROM fx_open_po p LEFT JOIN g_slow s ON s.sku = p.sku LEFT JOIN g_out o ON o.sku = p.sku LEFT JOIN s_in i ON i.sku = p.sku LEFT JOIN fx_item_master m ON m.sku = p.sku WHERE open_qty > 0) WHERE action IS NOT NULL ORDER BY po_value DESC, po_number, po_line_number, sku LIMIT 12""")
def v19_orders_to_change(spark, sf_dir):
    have, due, rate = stock(spark, sf_dir), view(spark, sf_dir, "fx_open_po"), daily(spark, sf_dir)
    master = view(spark, sf_dir, "fx_item_master")
    risk = V.stockout_forecast(have, rate, due, master.select("sku", F.col("lead_time_days").alias("lead_days")), at())
    return tidy(Rp.orders_to_change(due, V.slow_burn(have, rate), risk, inbound(spark, sf_dir), master))


@query("""SELECT state, place, kind, skus, CASE WHEN state = 'excluded' THEN 0 ELSE released END::DOUBLE AS released, theoretical::DOUBLE AS theoretical, annual_cost::DOUBLE AS annual_cost, service_risk, kind <> 'cut_below_policy' AS reversible, days_to_effect, CASE WHEN state = 'planned' THEN cur - run END::DOUBLE AS running_balance,
state = 'planned' AND cur - run <= tgt AS hits_target, state = 'planned' AND cur - run + released > tgt AS needed FROM (
SELECT *, row_number() OVER w AS place, sum(released) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT 'planned' AS state, 'stop_buying' AS kind, count(*) AS skus, sum(round(least(actual_qty - should_be_qty, demand_mean / 30.0 * 60) * unit_cost, 4)::DECIMAL(20,4)) AS released, sum(round(gap_value, 4)::DECIMAL(20,4)) AS theoretical, 'none' AS service_risk, 0 AS pain, 0 AS days_to_effect, 0.0::DECIMAL(20,4) AS annual_cost FROM p_gap WHERE gap_value > 0
  UNION ALL SELECT 'planned', 'push_out_po', count(*), sum(round(v, 4)::DECIMAL(20,4)), sum(round(v, 4)::DECIMAL(20,4)), 'low', 1, 0, 0 FROM (SELECT least(q, actual_qty - should_be_qty) * unit_cost AS v FROM p_gap JOIN (SELECT sku, sum(open_qty) AS q FROM fx_open_po GROUP BY sku) USING (sku) WHERE gap_value > 0) WHERE v > 0
  UNION ALL SELECT CASE WHEN lever = 'review_weekly' AND sum(stock_saving * 0.22 - ordering_cost) < 0 THEN 'excluded' WHEN lever IN ('lt_reliability', 'forecast_accuracy') THEN 'too_slow' ELSE 'planned' END, 'lever:' || lever, count(*) FILTER (stock_saving > 0),
    sum(round(stock_saving, 4)::DECIMAL(20,4)), sum(round(stock_saving, 4)::DECIMAL(20,4)), CASE lever WHEN 'service_level_down' THEN 'high' WHEN 'lt_speed' THEN 'low' ELSE 'none' END, CASE lever WHEN 'service_level_down' THEN 3 WHEN 'lt_speed' THEN 1 ELSE 0 END,
    CASE lever WHEN 'lt_reliability' THEN 180 WHEN 'forecast_accuracy' THEN 90 WHEN 'lt_speed' THEN 60 ELSE 30 END, CASE WHEN lever = 'review_weekly' THEN sum(round(ordering_cost, 4)::DECIMAL(20,4)) END FROM p_lev GROUP BY lever
  UNION ALL SELECT 'excluded', 'cut_below_policy', count(*), 0, sum(round(-gap_value, 4)::DECIMAL(20,4)), 'high', 3, 0, 0 FROM p_gap WHERE gap_value < 0 HAVING count(*) > 0)
WHERE state = 'excluded' OR released > 0 WINDOW w AS (PARTITION BY state ORDER BY pain, released DESC, kind))
CROSS JOIN (SELECT sum(round(actual_value, 4)::DECIMAL(20,4)) AS cur, 1000.0::DECIMAL(20,4) AS tgt FROM p_gap) WHERE cur > tgt""")
def r22_target_frontier(spark, sf_dir):
    items = shouldbe(spark, sf_dir)
    target = spark.range(1).select(F.lit(1000.0).alias("target_value"))
    return T.target_frontier(items, view(spark, sf_dir, "fx_open_po"), lever_results(spark, sf_dir), target, days_left=60)


def dims(spark, sf_dir):
    return view(spark, sf_dir, "fx_item_master").select("sku", "product_family", "business_unit")


@query("""SELECT x.sku, x.model, x.forecast_rmse, "hist 2000-01", "fcst 2000-02", product_family, business_unit, a.plan_qty AS plan_qty_prior_plan, CASE WHEN abs(a.plan_qty - a.actual_qty) <= 0.05 * a.plan_qty THEN 'balanced' WHEN a.plan_qty > a.actual_qty THEN 'over' ELSE 'under' END AS direction_prior_plan,
r.period AS period_review, round(r.delta, 6) AS delta_review FROM (SELECT sku, any_value(model) AS model, any_value(forecast_rmse) AS forecast_rmse, max(forecast_qty) FILTER (is_next_period) AS "fcst 2000-02" FROM f_det GROUP BY sku) x
LEFT JOIN (SELECT sku, qty AS "hist 2000-01" FROM d_series WHERE period = DATE '2000-01-01') h USING (sku) LEFT JOIN (SELECT sku, sum(plan_qty) AS plan_qty, sum(actual_qty) AS actual_qty FROM f_plan GROUP BY sku) a USING (sku) LEFT JOIN fx_item_master m USING (sku)
LEFT JOIN (SELECT sku, period, reviewed - forecast_qty AS delta FROM f_rev WHERE reviewed IS NOT NULL) r USING (sku)""", shared=True)
def c08_forecast_table(spark, sf_dir):
    made = Fc.history_and_forecast(series(spark, sf_dir), detail(spark, sf_dir), *spine(spark, sf_dir))
    found = files.forecast_table(made, dims(spark, sf_dir), Fc.accuracy_by(accuracy(spark, sf_dir), ["sku"]), Fc.review_effect(reviewed(spark, sf_dir)))
    return tidy(found.select("sku", "model", "forecast_rmse", "`hist 2000-01`", "`fcst 2000-02`", "product_family", "business_unit", "plan_qty_prior_plan", "direction_prior_plan", "period_review", "delta_review"))


@query("""SELECT g.sku, round(should_be_qty, 6) AS should_be_qty, g.unit_cost, product_family, business_unit, CASE WHEN demand_cv IS NULL THEN 'unknown' WHEN demand_cv <= 0.1 THEN 'constant' ELSE 'variable' END AS demand_variability,
CASE WHEN g.demand_mean > 0 THEN eoq END AS eoq_qty_suggested, s_level AS suggested_service_level_suggested, false AS unit_cost_twice FROM g_sug g JOIN p_gap p ON p.sku = g.sku JOIN fx_item_master m ON m.sku = g.sku""", shared=True)
def c08_parameters_table(spark, sf_dir):
    made = Pr.policy_profile(profile_params(spark, sf_dir), S.backlog(view(spark, sf_dir, "fx_open_so"), at()))
    found = files.parameters_table(shouldbe(spark, sf_dir), dims(spark, sf_dir), made, suggested(spark, sf_dir))
    twice = F.lit("unit_cost_suggested" in found.columns).alias("unit_cost_twice")
    return tidy(found.select("sku", "should_be_qty", "unit_cost", "product_family", "business_unit", "demand_variability", "eoq_qty_suggested", "suggested_service_level_suggested", twice))


@query("""SELECT r.sku, recommended_action, suggested_po_qty, product_family, business_unit, n AS lines_realization, CASE WHEN n > 0 THEN round_even(greatest(least((n * own + 3 * rate) / (n + 3), 1), 0.25), 3) END AS realization_rate_realization
FROM r_rec r JOIN fx_item_master m ON m.sku = r.sku LEFT JOIN (SELECT sku, count(*) AS n, 1 - sum(idle) / sum(open_qty) AS own FROM r_judged GROUP BY sku) j ON j.sku = r.sku CROSS JOIN (SELECT rate FROM r_rate)""", shared=True)
def c08_purchase_table(spark, sf_dir):
    found = files.purchase_table(recommended(spark, sf_dir), dims(spark, sf_dir), R.realization(opened(spark, sf_dir), at())[0])
    return found.select("sku", "recommended_action", "suggested_po_qty", "product_family", "business_unit", "lines_realization", "realization_rate_realization")


@query("""SELECT p.sku, round(should_be_qty, 6) AS should_be_qty, actual_qty, days_of_supply, on_hand_cover_days, inventory_status, effective_position, product_family, business_unit FROM p_gap p JOIN r_proj r ON r.sku = p.sku JOIN fx_item_master m ON m.sku = p.sku""", shared=True)
def c08_inventory_table(spark, sf_dir):
    found = files.inventory_table(shouldbe(spark, sf_dir), dims(spark, sf_dir), projection(spark, sf_dir))
    return tidy(found.select("sku", "should_be_qty", "actual_qty", "days_of_supply", "on_hand_cover_days", "inventory_status", "effective_position", "product_family", "business_unit"))


@query(f"""SELECT b.sku, first_short_period, short_periods, "closing qty 2000-07", product_family, business_unit, recommended_action, suggested_po_qty, pushout_open_po_qty
FROM (SELECT sku, min(period) FILTER (gap_qty > 0) AS first_short_period, count(*) FILTER (gap_qty > 0) AS short_periods, {wide("closing qty", "round(closing_qty, 6)", COMING[-1:])} FROM l_bal GROUP BY sku) b LEFT JOIN fx_item_master m ON m.sku = b.sku LEFT JOIN r_rec r ON r.sku = b.sku""", shared=True)
def c08_plan_table(spark, sf_dir):
    found = files.plan_table(L.balance_by_item(balance(spark, sf_dir), spine(spark, sf_dir)[1]), dims(spark, sf_dir), recommended(spark, sf_dir))
    return tidy(found.select("sku", "first_short_period", "short_periods", "`closing qty 2000-07`", "product_family", "business_unit", "recommended_action", "suggested_po_qty", "pushout_open_po_qty"))
