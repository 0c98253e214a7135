"""Queries and oracles of the feedback section: a plan of each month is derived from the three months before it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.operators import asof as A
from shelfspark.operators import feedback as B
from shelfspark.operators import supply as S
from shelfspark.operators.shared import shared_dir
from shelfspark.plans.demand_queries import classified, lines, series
from shelfspark.plans.fixtures import ORACLE_VIEWS, query, tidy, view
from shelfspark.plans.forecast_queries import detail, reviewed
from shelfspark.plans.profile_queries import suggested
from shelfspark.plans.supply_queries import lead_times, recommended, stock

ORACLE_VIEWS["b_plan"] = """
SELECT * FROM (SELECT sku, period AS month, lag(qty) OVER w AS forecast, lag(qty, 2) OVER w AS suggested, 30.0 AS available, qty AS actual_demand, least(lag(qty, 2) OVER w, 10) AS receipts, lag(qty, 3) OVER w + 5 AS eom_inv
FROM d_series WINDOW w AS (PARTITION BY sku ORDER BY period)) WHERE eom_inv IS NOT NULL"""
ORACLE_VIEWS["b_loss"] = """
SELECT sku, month, round_even(forecast - actual_demand, 2) AS forecast_error, CASE WHEN actual_demand > 0 THEN round_even(abs((forecast - actual_demand) / actual_demand), 4) END AS ape,
  round_even(CASE WHEN suggested > 0 THEN suggested - receipts ELSE 0 END, 1) AS supply_gap, round_even(greatest(0, actual_demand - available), 1) AS demand_gap,
  CASE WHEN eom_inv <> 0 AND actual_demand > 0 THEN round_even(eom_inv / actual_demand * 30, 1) END AS dos_realized FROM b_plan"""


def _gaps(gap: str) -> str:
    return f"""
SELECT sku, coalesce(stop - 1, n) AS months_in_a_row, round_even(g, 1) AS cumulative_gap FROM (SELECT sku, min(r) FILTER (NOT {gap} > 0) AS stop, max(r) AS n, coalesce(sum({gap}) FILTER ({gap} > 0), 0) AS g
FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY month DESC) AS r FROM b_loss) GROUP BY sku) WHERE coalesce(stop - 1, n) >= 3"""


ORACLE_VIEWS["b_dev"], ORACLE_VIEWS["b_risk"] = _gaps("supply_gap"), _gaps("demand_gap")
ORACLE_VIEWS["b_dec"] = """
SELECT sku, so_line_number AS n, CASE so_line_number % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' ELSE 'deferred' END AS decision, CASE WHEN part % 2 = 0 THEN 'moq' ELSE 'budget' END AS reason_code,
  CASE WHEN customer % 2 = 0 THEN 'push_out' ELSE 'expedite' END AS action_kind, qty AS value_at_stake FROM fx_sales"""

ORACLE_VIEWS["b_ref"] = "SELECT d.*, product_family, supplier FROM b_dec d LEFT JOIN fx_item_master m ON m.sku = d.sku WHERE decision <> 'accepted'"


def plans(spark, sf_dir):
    w = W.partitionBy("sku").orderBy("period")
    rows = series(spark, sf_dir).select(
        "sku", F.col("period").alias("month"), F.lag("qty").over(w).alias("forecast"), F.lag("qty", 2).over(w).alias("suggested"), F.lit(30.0).alias("available"), F.col("qty").alias("actual_demand"),
        F.least(F.lag("qty", 2).over(w), F.lit(10.0)).alias("receipts"), (F.lag("qty", 3).over(w) + 5).alias("eom_inv"),
    )
    return rows.where("eom_inv is not null")


def loss(spark, sf_dir):
    return B.monthly_loss(plans(spark, sf_dir))


def decisions(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_sales")
    kind = F.when(F.col("so_line_number") % 3 == 0, "rejected").when(F.col("so_line_number") % 3 == 1, "accepted").otherwise("deferred")
    return rows.select("sku", kind.alias("decision"), F.when(F.col("part") % 2 == 0, "moq").otherwise("budget").alias("reason_code"), F.when(F.col("customer") % 2 == 0, "push_out").otherwise("expedite").alias("action_kind"), F.col("qty").alias("value_at_stake"))


@query("""SELECT r.sku, stocking_class, demand_pattern, demand_cv, recommended_action, suggested_po_qty, effective_position AS available_supply, net_requirement, safety_stock, days_of_supply, inventory_status, demand_mean_rolling AS forecast_qty,
o.wma_lead_time_days AS lead_time_days, o.lt_std_days AS lt_sigma_days, o.sample_count AS lt_samples, o.lt_source, o.supplier, '2000-01-01T00:00:00' AS run_at, '2000-01' AS planning_month FROM r_rec r LEFT JOIN s_one o ON o.sku = r.sku""", shared=True)
def f01_plan_snapshot(spark, sf_dir):
    return B.publish(recommended(spark, sf_dir), S.one_supplier(lead_times(spark, sf_dir)), "2000-01-01T00:00:00", "2000-01")


@query("""SELECT sku, period, coalesce(reviewed, forecast_qty) AS forecast_qty, forecast_qty AS statistical_qty, CASE WHEN reviewed IS NOT NULL THEN 'reviewed' ELSE 'statistical' END AS forecast_source, run_at, '2000-01' AS planning_month, '2000-01-01' AS as_of, run_at = 'r2' AS reviewed
FROM f_rev CROSS JOIN (VALUES ('r1'), ('r2')) r(run_at)""", shared=True)
def f01_published_plan(spark, sf_dir):
    root = f"{shared_dir(spark)}/plans-{uuid.uuid4().hex}"
    for run, committed in (("r1", False), ("r2", False), ("r2", True)):  # the second run is published twice
        plan = B.published_plan(reviewed(spark, sf_dir), run, "2000-01", "2000-01-01", committed)
        B.save_snapshot(plan, root)
    return B.read_snapshots(plan, root)


@query("""SELECT coalesce(d.sku, s.sku) AS sku, coalesce(actual_demand, 0) AS actual_demand, qty_on_hand AS actual_eom_inv FROM (SELECT sku, sum(qty) AS actual_demand FROM d_lines WHERE demand_date > DATE '1999-11-01' AND demand_date <= DATE '1999-12-01' GROUP BY sku) d
FULL JOIN s_stock s ON s.sku = d.sku""")
def f02_actuals(spark, sf_dir):
    return B.actuals_after(lines(spark, sf_dir), stock(spark, sf_dir), F.lit("1999-11-01").cast("date"))


@query("""SELECT sku, coalesce(actual_demand, 0) AS actual_demand, qty_on_hand AS actual_eom_inv, coalesce(actual_receipts, 0) AS actual_receipts FROM (SELECT sku, sum(qty) AS actual_demand FROM d_lines WHERE demand_date > DATE '1999-11-01' AND demand_date <= DATE '1999-12-01' GROUP BY sku)
FULL JOIN (SELECT sku, qty_on_hand FROM s_stock) USING (sku) FULL JOIN (SELECT sku, sum(po_qty) AS actual_receipts FROM fx_po_history WHERE receive_date > DATE '1999-11-01' AND receive_date <= DATE '1999-12-01' GROUP BY sku) USING (sku)""")
def f03_actual_receipts(spark, sf_dir):
    return B.actuals_after(lines(spark, sf_dir), stock(spark, sf_dir), F.lit("1999-11-01").cast("date"), view(spark, sf_dir, "fx_po_history"))


@query("SELECT * FROM b_loss")
def f04_monthly_loss(spark, sf_dir):
    return loss(spark, sf_dir)


@query("""SELECT month, skus, round(md, 6) AS md, round(mad, 6) AS mad, round(mape, 6) AS mape, round(avg_dos, 6) AS avg_dos, round(excess_rate, 6) AS excess_rate, CASE WHEN md / mad > 0.2 THEN 'over-forecast' WHEN md / mad < -0.2 THEN 'under-forecast' ELSE 'neutral' END AS bias
FROM (SELECT month, count(*) AS skus, avg(forecast_error) AS md, avg(abs(forecast_error)) AS mad, avg(ape) AS mape, avg(dos_realized) AS avg_dos, avg(CASE WHEN dos_realized > 90 THEN 1.0 WHEN dos_realized IS NOT NULL THEN 0 END) AS excess_rate FROM b_loss GROUP BY month)""")
def f05_loss_summary(spark, sf_dir):
    return tidy(B.loss_summary(loss(spark, sf_dir), ["month"]))


@query("SELECT * FROM b_dev")
def f06_under_executed(spark, sf_dir):
    return B.persistent_gaps(loss(spark, sf_dir), "supply_gap")


@query("SELECT * FROM b_risk")
def f06_short_items(spark, sf_dir):
    return B.persistent_gaps(loss(spark, sf_dir), "demand_gap")


@query("""SELECT bias, deviations, risks, overlap, round(coalesce(overlap / nullif(risks, 0), 0), 6) AS explained, bias <> 'neutral' AND coalesce(overlap / nullif(risks, 0), 0) < 0.5 AS change_model FROM
(SELECT CASE WHEN avg(forecast_error) / avg(abs(forecast_error)) > 0.2 THEN 'over-forecast' WHEN avg(forecast_error) / avg(abs(forecast_error)) < -0.2 THEN 'under-forecast' ELSE 'neutral' END AS bias FROM b_loss),
(SELECT (SELECT count(*) FROM b_dev) AS deviations, (SELECT count(*) FROM b_risk) AS risks, (SELECT count(*) FROM b_dev JOIN b_risk USING (sku)) AS overlap)""")
def f07_attribution(spark, sf_dir):
    x = loss(spark, sf_dir)
    return tidy(B.attribution(x, B.persistent_gaps(x, "supply_gap"), B.persistent_gaps(x, "demand_gap")))


@query("""SELECT sku, months, first_month, last_month, a AS first_lt, b AS last_lt, b - a AS change, CASE WHEN sa <> sb THEN 'source_change' WHEN sa = 'measured' AND abs(b - a) >= 5 AND abs(b - a) / a >= 0.2 THEN 'move' ELSE 'steady' END AS kind
FROM (SELECT sku, count(*) AS months, min(m) AS first_month, max(m) AS last_month, arg_min(lt, m) AS a, arg_max(lt, m) AS b, arg_min(src, m) AS sa, arg_max(src, m) AS sb FROM (
  SELECT sku, m, lt, src FROM (SELECT sku, strftime(po_date, '%Y-%m') AS m, lt, CASE WHEN sku LIKE '%-2' AND po_date < DATE '1999-01-01' THEN 'item_master' ELSE 'measured' END AS src,
    row_number() OVER (PARTITION BY sku, strftime(po_date, '%Y-%m') ORDER BY po_date DESC, po_number DESC, po_line_number DESC, part DESC) AS n FROM s_po WHERE lt IS NOT NULL) WHERE n = 1) GROUP BY sku) WHERE months > 1""")
def f08_lead_time_drift(spark, sf_dir):
    po = S.sane_lead_times(view(spark, sf_dir, "fx_po_history"), drop=True)
    run = F.concat_ws("/", F.col("po_date"), F.lpad(F.col("po_number").cast("string"), 12, "0"), F.col("po_line_number"), F.lpad(F.col("part").cast("string"), 12, "0"))
    source = F.when(F.col("sku").endswith("-2") & (F.col("po_date") < "1999-01-01"), "item_master").otherwise("measured")
    return B.lead_time_drift(po.select("sku", run.alias("run_at"), F.date_format("po_date", "yyyy-MM").alias("planning_month"), "lead_time_days", source.alias("lt_source")))


@query("""SELECT 'product_family' AS attribute, product_family AS value, reason_code, action_kind, count(*) AS occurrences, count(DISTINCT sku) AS skus, sum(value_at_stake) AS value_at_stake FROM b_ref GROUP BY ALL HAVING count(*) >= 3
UNION ALL SELECT 'supplier', supplier, reason_code, action_kind, count(*), count(DISTINCT sku), sum(value_at_stake) FROM b_ref GROUP BY ALL HAVING count(*) >= 3
UNION ALL SELECT 'all', 'all', reason_code, action_kind, count(*), count(DISTINCT sku), sum(value_at_stake) FROM b_ref GROUP BY ALL HAVING count(*) >= 6""")
def f09_recurring_refusals(spark, sf_dir):
    return B.recurring_refusals(decisions(spark, sf_dir), view(spark, sf_dir, "fx_item_master"), ["product_family", "supplier"])


@query("SELECT action_kind, count(*) AS proposed, count(*) FILTER (decision = 'accepted') AS accepted, sum(value_at_stake) AS value_at_stake, round(count(*) FILTER (decision = 'accepted') / count(*), 6) AS acceptance_rate FROM b_dec GROUP BY action_kind")
def f10_acceptance_rate(spark, sf_dir):
    return tidy(B.acceptance_rate(decisions(spark, sf_dir)))


@query("SELECT same AS same_inputs, true AS same_settings, true AS same_code, CASE WHEN same THEN 'identical' ELSE 'new_data' END AS basis FROM (SELECT count(*) = count(*) FILTER (qty > 1) AS same FROM fx_sales)")
def x01_compared_runs(spark, sf_dir):
    def run(rows):
        return A.fingerprint(rows).select(F.col("fingerprint").alias("inputs"), F.lit("s1").alias("settings"), F.lit("c1").alias("code"))

    rows = view(spark, sf_dir, "fx_sales")
    return B.compare_runs(run(rows), run(rows.where("qty > 1")))


@query("""SELECT flag, sku, round(value, 6) AS value, place, flagged FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY abs(value) DESC, sku) AS place, count(*) OVER (PARTITION BY flag) AS flagged FROM (
SELECT 'policy' AS flag, c.sku, demand_mean_rolling AS value FROM d_class c JOIN fx_item_master m ON m.sku = c.sku WHERE (stocking_policy = 'MTO') <> (stocking_class = 'non-stocking')
UNION ALL SELECT 'volatile', sku, demand_mean_rolling FROM d_class WHERE demand_cv > 1)) WHERE place <= 10""")
def x02_review_list(spark, sf_dir):
    rows = classified(spark, sf_dir).join(view(spark, sf_dir, "fx_item_master").select("sku", "stocking_policy"), "sku")
    flags = {"policy": (F.col("stocking_policy") == "MTO") != (F.col("stocking_class") == "non-stocking"), "volatile": F.col("demand_cv") > 1}
    return tidy(B.review_list(rows, flags, "demand_mean_rolling", 10))


@query("SELECT period, 'history' AS kind, qty AS value FROM d_series WHERE sku = 'S1-1' UNION ALL SELECT period, 'forecast', forecast_qty FROM f_det WHERE sku = 'S1-1'")
def x03_item_detail(spark, sf_dir):
    return B.item_detail(series(spark, sf_dir), detail(spark, sf_dir), "S1-1")


@query("""SELECT sku, p.parameter, p.in_force, p.suggested, p.in_force IS NOT DISTINCT FROM p.suggested AS agrees FROM (SELECT sku, unnest([{'parameter': 'review_period_days', 'in_force': review_period_days::VARCHAR, 'suggested': s_review::VARCHAR},
{'parameter': 'replenishment_method', 'in_force': method, 'suggested': s_method}, {'parameter': 'service_level', 'in_force': service_level::VARCHAR, 'suggested': s_level::VARCHAR}]) AS p FROM g_sug)""", shared=True)
def x03_parameter_pairs(spark, sf_dir):
    return B.parameter_pairs(suggested(spark, sf_dir))
