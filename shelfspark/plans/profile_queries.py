"""Queries and oracles of profiles and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import policy as P
from shelfspark.operators import profile as R
from shelfspark.operators import supply as S
from shelfspark.plans.demand_queries import classified
from shelfspark.plans.fixtures import ORACLE_VIEWS, query, tidy, view
from shelfspark.plans.policy_queries import params, values
from shelfspark.plans.supply_queries import at, lead_times, stock

ORACLE_VIEWS["g_par"] = """
SELECT p.*, CASE WHEN s <= 0.8 THEN 'A' WHEN s <= 0.95 THEN 'B' ELSE 'C' END AS abc_class, demand_pattern, demand_cv, active_cycles, total_cycles, sample_count, order_multiple, location_id
FROM p_par p JOIN (SELECT sku, sum(annual_value) OVER (ORDER BY annual_value DESC, sku ROWS UNBOUNDED PRECEDING) / sum(annual_value) OVER () AS s FROM p_val) v ON v.sku = p.sku JOIN d_class c ON c.sku = p.sku
LEFT JOIN s_one o ON o.sku = p.sku JOIN fx_item_master m ON m.sku = p.sku LEFT JOIN s_stock t ON t.sku = p.sku"""
ORACLE_VIEWS["g_sug"] = """
SELECT *, CASE WHEN stocking_class = 'non-stocking' THEN 'make_to_order' WHEN abc_class = 'C' AND unit_cost < 20 THEN 'min_max' WHEN demand_pattern IN ('erratic', 'lumpy') THEN 'reorder_point' ELSE method END AS s_method,
  CASE WHEN stocking_class = 'non-stocking' THEN 0.0 WHEN abc_class = 'C' THEN 0.9 WHEN abc_class = 'A' THEN 0.98 ELSE 0.95 END::DOUBLE AS s_level,
  CASE WHEN lt_sigma_days > 0.5 * lead_time_days AND lead_time_days > 0 THEN 14.0 WHEN lead_time_days > 90 THEN 30.0 WHEN abc_class = 'C' AND unit_cost < 20 AND stocking_class <> 'non-stocking' THEN 90.0
    WHEN er > 0 THEN (SELECT arg_min(x, (round(abs(ln(er) - ln(x)), 9), x)) FROM (VALUES (7.0::DOUBLE), (14.0), (30.0), (60.0), (90.0)) l(x)) ELSE review_period_days END AS s_review
FROM (SELECT *, round_even(sqrt(2 * (demand_mean * 12) * 350 / (unit_cost * 0.22)), 0) AS eoq, CASE WHEN demand_mean > 0 THEN round_even(sqrt(2 * (demand_mean * 12) * 350 / (unit_cost * 0.22)) / (demand_mean * 12 / 365), 0) END AS er FROM g_par)"""


def profile_params(spark, sf_dir):
    cls = classified(spark, sf_dir).select("sku", "demand_pattern", "demand_cv", "active_cycles", "total_cycles")
    abc = P.abc_classes(values(spark, sf_dir)).select("sku", "abc_class")
    samples = S.one_supplier(lead_times(spark, sf_dir)).select("sku", F.col("sample_count").alias("lt_samples"))
    master = view(spark, sf_dir, "fx_item_master").select("sku", "order_multiple")
    where = stock(spark, sf_dir).select("sku", F.col("location_id").alias("stock_locations"))
    rows = params(spark, sf_dir).join(cls, "sku").join(abc, "sku").join(samples, "sku", "left").join(master, "sku").join(where, "sku", "left")
    return rows.withColumn("applied_rules", F.when(F.col("abc_class") == "A", "R1"))


def suggested(spark, sf_dir):
    return R.suggest(profile_params(spark, sf_dir))


@query("""SELECT sku, CASE WHEN demand_cv IS NULL THEN 'unknown' WHEN demand_cv <= 0.1 THEN 'constant' ELSE 'variable' END AS demand_variability,
  CASE WHEN coalesce(coalesce(backlog_due_qty, 0) / nullif(demand_mean, 0), 0) >= 1 THEN 'known' WHEN backlog_due_qty > 0 THEN 'mixed' ELSE 'random' END AS demand_certainty, demand_pattern AS demand_continuity,
  CASE WHEN lead_time_days <= 0 THEN 'unknown' WHEN coalesce(sample_count, 0) < 3 THEN 'thinly-sampled' WHEN lt_sigma_days / lead_time_days >= 0.2 THEN 'variable' ELSE 'constant' END AS lead_time_behaviour,
  CASE WHEN contains(location_id, ',') THEN 'merged-multi' ELSE 'single' END AS location_scope, CASE WHEN min_order_qty > 0 OR order_multiple > 1 THEN 'lot-constrained' ELSE 'unconstrained' END AS capacity
FROM g_par LEFT JOIN s_back USING (sku)""")
def p10_policy_profile(spark, sf_dir):
    found = R.policy_profile(profile_params(spark, sf_dir), S.backlog(view(spark, sf_dir, "fx_open_so"), at()))
    return found.select("sku", "demand_variability", "demand_certainty", "demand_continuity", "lead_time_behaviour", "location_scope", "capacity")


@query("""SELECT sku, i AS policy_implied, f AS policy_in_force, i = f AS agrees FROM (SELECT sku, CASE WHEN stocking_class = 'non-stocking' THEN 'make_to_order' WHEN abc_class = 'C' AND unit_cost < 20 THEN 'reorder_point' ELSE 'periodic' END AS i,
CASE method WHEN 'min_max' THEN 'reorder_point' ELSE method END AS f FROM g_par)""")
def p11_implied_policy(spark, sf_dir):
    return R.implied_policy(profile_params(spark, sf_dir)).select("sku", "policy_implied", "policy_in_force", "agrees")


@query("SELECT sku, eoq AS eoq_qty, er AS eoq_review_days, s_review AS suggested_review_period_days, s_method AS suggested_replenishment_method, s_level AS suggested_service_level FROM (SELECT * REPLACE (CASE WHEN demand_mean > 0 THEN eoq END AS eoq) FROM g_sug)")
def p13_suggestions(spark, sf_dir):
    return suggested(spark, sf_dir).select("sku", "eoq_qty", "eoq_review_days", "suggested_review_period_days", "suggested_replenishment_method", "suggested_service_level")


ORACLE_VIEWS["g_ss"] = """
SELECT g.sku, safety_qty AS current_safety_stock,
  CASE WHEN g.stocking_class <> 'non-stocking' THEN round_even(CASE s_level WHEN 0.9 THEN 1.282 WHEN 0.95 THEN 1.645 ELSE 2.054 END * sqrt((g.lead_time_days + CASE WHEN s_method IN ('periodic', 'min_max') THEN s_review ELSE 0 END) / 30.0 * g.demand_sigma * g.demand_sigma
    + g.demand_mean * g.demand_mean * (g.lt_sigma_days / 30.0) * (g.lt_sigma_days / 30.0)), 1) ELSE 0 END AS suggested_safety_stock FROM g_sug g JOIN p_sb b ON b.sku = g.sku"""


@query("SELECT sku, suggested_safety_stock, current_safety_stock, round_even(suggested_safety_stock - current_safety_stock, 1) AS ss_delta_qty FROM g_ss")
def p14_suggested_safety(spark, sf_dir):
    return R.suggested_safety(suggested(spark, sf_dir)).select("sku", "suggested_safety_stock", "current_safety_stock", "ss_delta_qty")


@query("""SELECT sku, suggested_safety_stock, planner_safety_stock, round_even(d, 1) AS delta_qty, round(d / nullif(planner_safety_stock, 0), 6) AS delta_share, CASE WHEN abs(d) <= 0.1 * planner_safety_stock THEN 'agrees' WHEN d > 0 THEN 'planner holds less' ELSE 'planner holds more' END AS verdict
FROM (SELECT g.sku, suggested_safety_stock, min_order_qty AS planner_safety_stock, suggested_safety_stock - min_order_qty AS d FROM g_ss g JOIN fx_item_master m ON m.sku = g.sku)""")
def p15_against_planner(spark, sf_dir):
    planner = view(spark, sf_dir, "fx_item_master").select("sku", F.col("min_order_qty").alias("planner_safety_stock"))
    return tidy(R.against_planner(R.suggested_safety(suggested(spark, sf_dir)), planner))


@query("""SELECT sku, CASE WHEN t = '' THEN 'no change' ELSE t END AS changes FROM (SELECT sku, concat_ws('; ', CASE WHEN s_level IS DISTINCT FROM service_level THEN concat('service level: ', coalesce(service_level::VARCHAR, 'none'), ' to ', coalesce(s_level::VARCHAR, 'none')) END,
CASE WHEN s_method IS DISTINCT FROM method THEN concat('method: ', coalesce(method, 'none'), ' to ', coalesce(s_method, 'none')) END,
CASE WHEN s_review IS DISTINCT FROM review_period_days THEN concat('review days: ', coalesce(review_period_days::VARCHAR, 'none'), ' to ', coalesce(s_review::VARCHAR, 'none')) END) AS t FROM g_sug)""")
def p16_change_list(spark, sf_dir):
    return R.change_list(suggested(spark, sf_dir))


@query("""SELECT rule_id, items FROM (SELECT 'S-001' AS rule_id, count(*) AS items FROM g_sug UNION ALL SELECT 'S-002', count(*) FILTER (abc_class = 'A') FROM g_sug UNION ALL SELECT 'S-003', count(*) FILTER (abc_class = 'C') FROM g_sug
UNION ALL SELECT 'S-004', count(*) FILTER (demand_pattern IN ('erratic', 'lumpy')) FROM g_sug UNION ALL SELECT 'S-005', count(*) FILTER (abc_class = 'C' AND unit_cost < 20 AND stocking_class <> 'non-stocking') FROM g_sug
UNION ALL SELECT 'S-006', count(*) FILTER (lead_time_days > 90) FROM g_sug UNION ALL SELECT 'S-007', count(*) FILTER (lt_sigma_days > 0.5 * lead_time_days AND lead_time_days > 0) FROM g_sug
UNION ALL SELECT 'S-008', count(*) FILTER (stocking_class = 'non-stocking') FROM g_sug) WHERE items > 0""")
def p16_rule_hits(spark, sf_dir):
    return R.rule_hits(suggested(spark, sf_dir))
