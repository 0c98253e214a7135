"""Queries and oracles of the supply and replenishment sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import replenish as R
from shelfspark.operators import supply as S
from shelfspark.plans.demand_queries import classified
from shelfspark.plans.fixtures import AS_OF, ORACLE_VIEWS, once, query, tidy, view

AT = "DATE '2000-01-01'"
ORACLE_VIEWS["s_po"] = """
SELECT *, CASE WHEN receive_date - po_date > 0 AND receive_date - po_date <= 730 THEN (receive_date - po_date)::DOUBLE END AS lt
FROM fx_po_history WHERE sku IS NOT NULL AND supplier IS NOT NULL AND po_date IS NOT NULL"""
ORACLE_VIEWS["s_lt"] = """
SELECT sku, supplier, round_even(sum(w * lt) / sum(w), 1) AS wma_lead_time_days, round_even(stddev_pop(lt), 1) AS lt_std_days, count(*) AS sample_count,
  min(lt) AS min_lt_days, max(lt) AS max_lt_days,
  CASE WHEN bool_or(hr) THEN 'measured' ELSE 'measured_outside_window' END AS lt_source
FROM (SELECT *, row_number() OVER (PARTITION BY sku, supplier ORDER BY po_date, receive_date, po_number, po_line_number, part, po_qty, po_amount) AS w
  FROM (SELECT *, bool_or(recent AND lt IS NOT NULL) OVER (PARTITION BY sku, supplier) AS hr FROM (
    SELECT *, po_date >= (SELECT max(po_date) FROM s_po) - INTERVAL 6 MONTH AS recent FROM s_po)) WHERE (recent OR NOT hr) AND lt IS NOT NULL) GROUP BY sku, supplier"""
ORACLE_VIEWS["s_terms"] = """
SELECT sku, supplier, incoterm FROM (SELECT sku, supplier, incoterm, row_number() OVER (PARTITION BY sku, supplier ORDER BY count(*) DESC, incoterm) AS n FROM s_po GROUP BY sku, supplier, incoterm) WHERE n = 1"""
ORACLE_VIEWS["s_one"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY sample_count DESC, wma_lead_time_days, supplier) AS n FROM s_lt) WHERE n = 1"
ORACLE_VIEWS["s_in"] = f"""
SELECT sku, sum(open_qty) AS total_open_po_qty, sum(open_amount) AS open_po_amount, count(*) AS open_po_lines, min(committed_delivery) AS earliest_delivery,
  max(committed_delivery) AS latest_delivery, coalesce(sum(open_qty) FILTER (committed_delivery < {AT}), 0) AS inbound_past_due_qty,
  coalesce(sum(open_qty) FILTER (committed_delivery >= {AT} AND committed_delivery <= {AT} + 30), 0) AS inbound_due_qty,
  coalesce(sum(open_qty) FILTER (committed_delivery > {AT} + 30), 0) AS inbound_beyond_qty,
  (min(committed_delivery) FILTER (committed_delivery >= {AT}) - {AT})::DOUBLE AS days_to_next_arrival, min(incoterm) AS incoterm FROM fx_open_po WHERE open_qty > 0 GROUP BY sku"""
ORACLE_VIEWS["s_back"] = f"""
SELECT sku, sum(open_qty) AS backlog_qty, sum(open_amount) AS backlog_amount, count(*) AS backlog_lines, min(customer_request_date) AS earliest_request,
  max(customer_request_date) AS latest_request, coalesce(sum(open_qty) FILTER (customer_request_date IS NULL OR customer_request_date <= {AT} + 30), 0) AS backlog_due_qty,
  coalesce(sum(open_qty) FILTER (customer_request_date < {AT}), 0) AS backlog_past_due_qty FROM fx_open_so WHERE open_qty > 0 GROUP BY sku"""
ORACLE_VIEWS["s_by"] = f"""
SELECT sku, coalesce(sum(open_qty) FILTER (ob IS NULL OR ob <= {AT} + 30), 0) AS mto_actionable_qty, coalesce(sum(open_qty) FILTER (ob < {AT}), 0) AS mto_order_past_due_qty,
  min(ob) AS mto_order_by, min(customer_request_date) AS mto_next_request
FROM (SELECT o.*, customer_request_date - ceil(coalesce(wma_lead_time_days, 0))::INT AS ob FROM fx_open_so o LEFT JOIN s_one USING (sku) WHERE open_qty > 0) GROUP BY sku"""
ORACLE_VIEWS["s_stock"] = """
SELECT sku, sum(qty_on_hand) AS qty_on_hand, sum(qty_in_transit) AS qty_in_transit, arg_min(unit_cost, location_id) AS unit_cost, max(snapshot_date) AS snapshot_date,
  string_agg(DISTINCT location_id, ',' ORDER BY location_id) AS location_id FROM fx_inventory GROUP BY sku"""
ORACLE_VIEWS["s_pos"] = """
SELECT s.sku, qty_on_hand, CASE WHEN coalesce(i.incoterm, t.incoterm) IN ('EXW', 'FOB', 'CIF') THEN qty_in_transit ELSE 0 END AS qty_in_transit_adj,
  coalesce(total_open_po_qty, 0) AS total_open_po_qty,
  qty_on_hand + CASE WHEN coalesce(i.incoterm, t.incoterm) IN ('EXW', 'FOB', 'CIF') THEN qty_in_transit ELSE 0 END + coalesce(total_open_po_qty, 0) AS effective_position
FROM s_stock s LEFT JOIN s_in i ON i.sku = s.sku LEFT JOIN (SELECT sku, min(incoterm) AS incoterm FROM s_terms GROUP BY sku) t ON t.sku = s.sku"""
ORACLE_VIEWS["r_ss"] = """
SELECT *, round_even(round(dde + safety_stock, 9), 1) AS reorder_point FROM (
  SELECT c.*, coalesce(wma_lead_time_days, 0) AS lt, coalesce(lt_std_days, 0) AS lts, coalesce(wma_lead_time_days, 0) + 30.0 AS ss_exposure_days,
    CASE WHEN stocking_class <> 'non-stocking' THEN round_even(round(z_score * sqrt((coalesce(wma_lead_time_days, 0) + 30.0) / 30.0 * demand_std_rolling * demand_std_rolling
      + demand_mean_rolling * demand_mean_rolling * (coalesce(lt_std_days, 0) / 30.0) * (coalesce(lt_std_days, 0) / 30.0)), 9), 1) ELSE 0 END AS safety_stock,
    round_even(round(demand_mean_rolling * ((coalesce(wma_lead_time_days, 0) + 30.0) / 30.0), 9), 1) AS dde,
    round_even(round(demand_mean_rolling * coalesce(wma_lead_time_days, 0) / 30.0, 9), 1) AS demand_during_lt
  FROM d_class c LEFT JOIN s_one o ON o.sku = c.sku)"""
ORACLE_VIEWS["r_proj"] = """
SELECT *, CASE WHEN supply_gap THEN round_even(round(greatest(coalesce(days_to_next_arrival, 30.0) - on_hand_cover_days, 0), 9), 1) ELSE 0 END AS supply_gap_days,
  inventory_status = 'EXCESS' AND coalesce(total_open_po_qty, 0) > 0 AND NOT supply_gap AS pushout_candidate FROM (
SELECT *, CASE WHEN stocking_class = 'non-stocking' THEN 'non-stocking' WHEN effective_position IS NULL THEN 'no-data' WHEN surplus_deficit < -0.5 * safety_stock THEN 'SHORTAGE-RISK'
    WHEN surplus_deficit > 0 AND days_of_supply > 90 THEN 'EXCESS' WHEN surplus_deficit > 0 THEN 'slightly-over' ELSE 'OK' END AS inventory_status,
  (coalesce(on_hand_cover_days < days_to_next_arrival, false) OR coalesce(inbound_past_due_qty > 0 AND on_hand_cover_days < 30, false))
    AND stocking_class <> 'non-stocking' AND effective_position IS NOT NULL AS supply_gap FROM (
SELECT r.* EXCLUDE (sku), r.sku AS sku, qty_on_hand, qty_in_transit_adj, p.total_open_po_qty, effective_position, coalesce(inbound_past_due_qty, 0) AS inbound_past_due_qty, days_to_next_arrival,
  dde + safety_stock AS should_be_inventory, effective_position - (dde + safety_stock) AS surplus_deficit,
  round_even(round(effective_position / nullif(demand_mean_rolling / 30.0, 0), 9), 0) AS days_of_supply,
  round_even(round((coalesce(qty_on_hand, 0) + coalesce(qty_in_transit_adj, 0)) / nullif(demand_mean_rolling / 30.0, 0), 9), 1) AS on_hand_cover_days
FROM r_ss r LEFT JOIN s_pos p ON p.sku = r.sku LEFT JOIN s_in i ON i.sku = r.sku))"""
ORACLE_VIEWS["r_req"] = """
SELECT *, round_even(round(gross_requirement + order_lot, 9), 1) AS order_up_to FROM (
SELECT *, round_even(round(CASE WHEN coalesce(eoq_qty, min_order_qty) > 0 THEN ceil(greatest(coalesce(eoq_qty, min_order_qty), min_order_qty) / order_multiple) * order_multiple ELSE 0 END, 9), 1) AS order_lot FROM (
SELECT *, round_even(round(greatest(gross_requirement - effective_position, 0), 9), 1) AS net_requirement,
  CASE WHEN demand_mean_rolling > 0 AND unit_cost > 0 THEN round_even(round(sqrt(2 * (demand_mean_rolling * 12) * 350 / (unit_cost * 0.22)), 9), 0) END AS eoq_qty FROM (
SELECT *, round_even(round(period_demand + safety_stock, 9), 1) AS gross_requirement FROM (
SELECT *, round_even(round(greatest(forecast_horizon_qty, firm), 9), 1) AS period_demand, CASE WHEN firm > forecast_horizon_qty THEN 'backlog' ELSE 'forecast' END AS demand_driver FROM (
SELECT p.*, coalesce(min_order_qty, 0) AS min_order_qty, coalesce(order_multiple, 1) AS order_multiple, m.unit_cost AS unit_cost, CASE WHEN stocking_policy = 'MTO' THEN 'make_to_order' ELSE 'periodic' END AS method,
  round_even(round(demand_mean_rolling * ss_exposure_days / 30.0, 9), 1) AS forecast_horizon_qty, coalesce(backlog_qty, 0) AS backlog_qty, coalesce(backlog_due_qty, 0) AS backlog_due_qty,
  round_even(round(coalesce(backlog_due_qty, 0), 9), 1) AS firm
FROM r_proj p LEFT JOIN fx_item_master m ON m.sku = p.sku LEFT JOIN s_back b ON b.sku = p.sku)))))"""


def at():
    return F.lit(AS_OF).cast("date")


def receipts(spark, sf_dir):
    return S.sane_lead_times(view(spark, sf_dir, "fx_po_history"))


@once
def lead_times(spark, sf_dir):
    return S.supplier_lead_times(receipts(spark, sf_dir))


@once
def inbound(spark, sf_dir):
    return S.inbound_schedule(view(spark, sf_dir, "fx_open_po"), at())


def stock(spark, sf_dir):
    return S.consolidate(view(spark, sf_dir, "fx_inventory"))


def position(spark, sf_dir):
    return S.effective_position(stock(spark, sf_dir), inbound(spark, sf_dir), lead_times(spark, sf_dir))


def safety(spark, sf_dir):
    return R.safety_stock(classified(spark, sf_dir), S.one_supplier(lead_times(spark, sf_dir)))


def projection(spark, sf_dir):
    return R.project(safety(spark, sf_dir), position(spark, sf_dir), inbound(spark, sf_dir))


def parameters(spark, sf_dir):
    method = F.when(F.col("stocking_policy") == "MTO", "make_to_order").otherwise("periodic")
    master = view(spark, sf_dir, "fx_item_master")
    return master.select("sku", "min_order_qty", "order_multiple", "unit_cost", method.alias("replenishment_method"), F.lit(30.0).alias("review_period_days"))


def required(spark, sf_dir):
    rows = R.attach_policy(projection(spark, sf_dir), parameters(spark, sf_dir))
    rows = R.period_demand(rows, None, S.backlog(view(spark, sf_dir, "fx_open_so"), at()))
    return R.order_quantity(R.requirement(rows))


def recommended(spark, sf_dir):
    schedule = S.order_by_schedule(view(spark, sf_dir, "fx_open_so"), S.one_supplier(lead_times(spark, sf_dir)), at())
    return R.recommend(R.order_status(required(spark, sf_dir), schedule))


@query("SELECT po_number, po_line_number, sku, supplier, po_date, lt AS lead_time_days FROM s_po")
def c24_sane_lead_times(spark, sf_dir):
    return receipts(spark, sf_dir).select("po_number", "po_line_number", "sku", "supplier", "po_date", "lead_time_days")


@query("SELECT * FROM s_stock")
def c32_consolidated_stock(spark, sf_dir):
    return stock(spark, sf_dir)


@query("""SELECT po_number, po_line_number, sku, CASE WHEN use_stated AND sd > 0 AND sd <= 730 THEN sd WHEN rd > 0 AND rd <= 730 THEN rd WHEN dd > 0 AND dd <= 730 THEN dd END AS lead_time_days,
  CASE WHEN use_stated AND sd > 0 AND sd <= 730 THEN 'stated' WHEN rd > 0 AND rd <= 730 THEN 'receipt' WHEN dd > 0 AND dd <= 730 THEN 'dispatch_plus_transit' END AS lt_basis
FROM (SELECT *, (SELECT count(*) FILTER (sd > 0 AND sd <= 730) / count(*) > 0.5 FROM (SELECT CASE WHEN po_line_number % 3 = 0 THEN 40.0 END AS sd FROM fx_po_history)) AS use_stated FROM (
  SELECT po_number, po_line_number, sku, CASE WHEN po_line_number % 3 = 0 THEN 40.0 END AS sd, (receive_date - po_date)::DOUBLE AS rd, (5 + 21)::DOUBLE AS dd FROM fx_po_history))""")
def s01_line_lead_times(spark, sf_dir):
    po = view(spark, sf_dir, "fx_po_history")
    po = po.withColumn("stated_days", F.when(F.col("po_line_number") % 3 == 0, 40.0)).withColumn("confirmed_date", F.date_add("po_date", 5))
    return S.line_lead_times(po, F.lit(21.0)).select("po_number", "po_line_number", "sku", "lead_time_days", "lt_basis")


@query("""SELECT supplier, CASE WHEN supplier = 'V1' THEN 'V1' WHEN supplier LIKE 'V%' THEN 'V' ELSE '*' END AS prefix, CASE WHEN supplier = 'V1' THEN 12 WHEN supplier LIKE 'V%' THEN 30 ELSE 45 END AS days,
  CASE WHEN supplier = 'V1' THEN 'AIR' ELSE 'SEA' END AS mode FROM (SELECT DISTINCT supplier FROM fx_po_history)""")
def s02_transit_days(spark, sf_dir):
    table = spark.createDataFrame([("V", 30, "SEA"), ("V1", 12, "AIR"), ("*", 45, "SEA")], "prefix string, days int, mode string")
    return S.transit_by_prefix(view(spark, sf_dir, "fx_po_history"), table)


@query("""SELECT sku, supplier, wma_lead_time_days, lt_std_days, sample_count, min_lt_days, max_lt_days, incoterm, lt_source FROM s_lt JOIN s_terms USING (sku, supplier)""")
def s03_supplier_lead_times(spark, sf_dir):
    return lead_times(spark, sf_dir)


@query("""SELECT sku, supplier, wma_lead_time_days, lt_std_days, sample_count, lt_source FROM s_lt UNION ALL
SELECT sku, supplier, lead_time_days, 0.0::DOUBLE, 0, 'item_master' FROM fx_item_master WHERE lead_time_days > 0 AND sku NOT IN (SELECT sku FROM s_lt)""")
def s04_filled_lead_times(spark, sf_dir):
    return S.fill_lead_times(lead_times(spark, sf_dir), [("item_master", view(spark, sf_dir, "fx_item_master"))])


@query("SELECT sku, supplier, wma_lead_time_days, sample_count FROM s_one")
def s05_supplier_by_samples(spark, sf_dir):
    return S.one_supplier(lead_times(spark, sf_dir)).select("sku", "supplier", "wma_lead_time_days", "sample_count")


@query("""SELECT sku, supplier, wma_lead_time_days, sample_count FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY wma_lead_time_days, sample_count DESC, supplier) AS n FROM s_lt) WHERE n = 1""")
def s05_supplier_by_speed(spark, sf_dir):
    return S.one_supplier(lead_times(spark, sf_dir), "speed").select("sku", "supplier", "wma_lead_time_days", "sample_count")


@query("""SELECT po_number, po_line_number, sku, open_qty, committed_delivery IS NULL AS estimated, coalesce(committed_delivery, order_date + round_even(coalesce(lt,
  (SELECT median(lt) FROM (SELECT min(wma_lead_time_days) AS lt FROM s_lt GROUP BY sku))), 0)::INT) AS delivery
FROM fx_open_po LEFT JOIN (SELECT sku, min(wma_lead_time_days) AS lt FROM s_lt GROUP BY sku) USING (sku)""")
def s06_estimated_deliveries(spark, sf_dir):
    found = S.estimate_deliveries(view(spark, sf_dir, "fx_open_po"), lead_times(spark, sf_dir))
    return found.select("po_number", "po_line_number", "sku", "open_qty", "estimated", "delivery")


@query("SELECT * REPLACE (round(open_po_amount, 2) AS open_po_amount) FROM s_in")
def s07_inbound_schedule(spark, sf_dir):
    return tidy(inbound(spark, sf_dir), open_po_amount=2)


@query("SELECT * REPLACE (round(backlog_amount, 2) AS backlog_amount) FROM s_back")
def s08_backlog(spark, sf_dir):
    return tidy(S.backlog(view(spark, sf_dir, "fx_open_so"), at()), backlog_amount=2)


@query("SELECT * FROM s_by")
def s09_order_by_schedule(spark, sf_dir):
    return S.order_by_schedule(view(spark, sf_dir, "fx_open_so"), S.one_supplier(lead_times(spark, sf_dir)), at())


@query("SELECT * FROM s_pos")
def s10_effective_position(spark, sf_dir):
    return position(spark, sf_dir)


@query("""SELECT sku, CASE WHEN sku IN (SELECT sku FROM fx_inventory WHERE location_id = '01' AND qty_on_hand > 60) THEN 'PCS' ELSE 'KG' END AS uom FROM fx_item_master""")
def s11_one_unit(spark, sf_dir):
    first = view(spark, sf_dir, "fx_inventory").where("location_id = '01' and qty_on_hand > 60").select("sku", F.lit("PCS").alias("uom"))
    return S.one_unit([first, view(spark, sf_dir, "fx_item_master").select("sku", F.lit("KG").alias("uom"))])


@query("""SELECT so_number, so_line_number, sku, part, qty, CASE WHEN so_line_number % 2 = 0 THEN round_even(qty * 0.37, 1) ELSE round_even(qty * 0.37, 0) END AS rounded FROM fx_sales""")
def s12_unit_rounding(spark, sf_dir):
    uom = F.when(F.col("so_line_number") % 2 == 0, "kg").otherwise("pcs")
    return view(spark, sf_dir, "fx_sales").select("so_number", "so_line_number", "sku", "part", "qty", S.rounded_quantity(F.col("qty") * 0.37, uom).alias("rounded"))


@query("""SELECT sku, CASE WHEN unit_cost > 0 AND lead_time_days > 0 THEN round(sqrt(2 * (lead_time_days * 12) * 350 / (unit_cost * 0.22)), 6) END AS eoq,
  CASE WHEN lead_time_days * 1.7 > 0 THEN ceil(greatest(lead_time_days * 1.7, min_order_qty) / order_multiple) * order_multiple ELSE 0 END AS lot FROM fx_item_master""")
def r01_r02_lot_sizes(spark, sf_dir):
    eoq = R.economic_order_quantity(F.col("lead_time_days") * 12, F.col("unit_cost"), 350.0, 0.22)
    lot = R.round_to_lot(F.col("lead_time_days") * 1.7, F.col("min_order_qty"), F.col("order_multiple"))
    return tidy(view(spark, sf_dir, "fx_item_master").select("sku", eoq.alias("eoq"), lot.alias("lot")))


@query("""SELECT sku, safety_stock, demand_during_lt, dde AS demand_during_exposure, reorder_point, ss_exposure_days,
  round_even(round(safety_stock / nullif(demand_mean_rolling / 30.0, 0), 9), 0) AS ss_coverage_days FROM r_ss""")
def r03_safety_stock(spark, sf_dir):
    return safety(spark, sf_dir).select("sku", "safety_stock", "demand_during_lt", "demand_during_exposure", "reorder_point", "ss_exposure_days", "ss_coverage_days")


@query("SELECT sku, should_be_inventory, round(surplus_deficit, 6) AS surplus_deficit, days_of_supply, inventory_status FROM (SELECT * REPLACE (round(should_be_inventory, 6) AS should_be_inventory) FROM r_proj)")
def r09_projection(spark, sf_dir):
    return tidy(projection(spark, sf_dir).select("sku", "should_be_inventory", "surplus_deficit", "days_of_supply", "inventory_status"))


@query("""SELECT sku, on_hand_cover_days, supply_gap, supply_gap_days, pushout_candidate,
  CASE WHEN pushout_candidate THEN round_even(round(greatest(least(surplus_deficit, total_open_po_qty), 0), 9), 1) ELSE 0 END AS pushout_open_po_qty FROM r_proj""")
def r10_supply_gap(spark, sf_dir):
    return projection(spark, sf_dir).select("sku", "on_hand_cover_days", "supply_gap", "supply_gap_days", "pushout_candidate", "pushout_open_po_qty")


@query("SELECT sku, ss_exposure_days AS coverage_days, 'rules' AS policy_source, 'safety_stock_exposure' AS coverage_basis, method AS replenishment_method FROM r_req")
def r13_policy_and_cover(spark, sf_dir):
    rows = R.attach_policy(projection(spark, sf_dir), parameters(spark, sf_dir))
    return rows.select("sku", "coverage_days", "policy_source", "coverage_basis", "replenishment_method")


@query("""SELECT sku, CASE WHEN mto_actionable_qty IS NULL THEN 'unscoped' WHEN mto_order_past_due_qty > 0 THEN 'order-past-due' WHEN mto_actionable_qty > 0 THEN 'order-now'
  WHEN backlog_qty > 0 THEN 'scheduled' ELSE 'none' END AS mto_order_status, mto_order_by FROM r_req LEFT JOIN s_by USING (sku)""")
def r14_order_by_status(spark, sf_dir):
    return recommended(spark, sf_dir).select("sku", "mto_order_status", "mto_order_by")


@query("SELECT sku, forecast_horizon_qty, backlog_due_qty, period_demand, demand_driver FROM r_req")
def r15_period_demand(spark, sf_dir):
    return required(spark, sf_dir).select("sku", "forecast_horizon_qty", "backlog_due_qty", "period_demand", "demand_driver")


@query("SELECT sku, gross_requirement, net_requirement, eoq_qty, order_lot, order_up_to FROM r_req")
def r16_requirement(spark, sf_dir):
    return required(spark, sf_dir).select("sku", "gross_requirement", "net_requirement", "eoq_qty", "order_lot", "order_up_to")


@query("""SELECT sku, CASE WHEN net_requirement > 0 AND method <> 'make_to_order' THEN round_even(round(net_requirement + order_lot, 9), 1) ELSE 0 END AS order_quantity FROM r_req""")
def r17_order_quantity(spark, sf_dir):
    return required(spark, sf_dir).select("sku", "order_quantity")


ORACLE_VIEWS["r_rec"] = """
SELECT *, CASE recommended_action WHEN 'PURCHASE-REQUEST' THEN order_quantity WHEN 'ORDER-FOR-BACKLOG' THEN backlog_shortfall ELSE 0 END AS suggested_po_qty,
  CASE WHEN pushout_candidate THEN round_even(round(greatest(least(surplus_deficit, total_open_po_qty), 0), 9), 1) ELSE 0 END AS pushout_open_po_qty FROM (
SELECT *, CASE WHEN stocking_class = 'non-stocking' THEN CASE WHEN backlog_shortfall > 0 THEN 'ORDER-FOR-BACKLOG' ELSE 'NO-ACTION' END
  WHEN supply_gap THEN CASE WHEN total_open_po_qty > 0 THEN 'EXPEDITE-INBOUND' ELSE 'PURCHASE-REQUEST' END WHEN pushout_candidate THEN 'PUSH-OUT-OPEN-PO'
  WHEN net_requirement > 0 THEN 'PURCHASE-REQUEST' WHEN inventory_status = 'EXCESS' THEN 'HOLD-EXCESS' ELSE 'HOLD-OK' END AS recommended_action FROM (
SELECT r_req.*, CASE WHEN net_requirement > 0 AND method <> 'make_to_order' THEN round_even(round(net_requirement + order_lot, 9), 1) ELSE 0 END AS order_quantity,
  round_even(round(greatest(round_even(round(coalesce(mto_actionable_qty, backlog_due_qty), 9), 1) - coalesce(effective_position, 0), 0), 9), 1) AS backlog_shortfall
FROM r_req LEFT JOIN s_by USING (sku)))"""


@query("SELECT sku, recommended_action, suggested_po_qty FROM r_rec", shared=True)
def r18_recommendations(spark, sf_dir):
    return recommended(spark, sf_dir).select("sku", "recommended_action", "suggested_po_qty")
