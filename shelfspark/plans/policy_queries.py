"""Queries and oracles of the policy section."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import policy as P
from shelfspark.operators import replenish as R
from shelfspark.operators import supply as S
from shelfspark.plans.demand_queries import classified, lines
from shelfspark.plans.fixtures import ORACLE_VIEWS, query, tidy, view
from shelfspark.plans.supply_queries import at, lead_times, stock

ORACLE_VIEWS["p_par"] = """
SELECT c.sku, demand_mean_rolling AS demand_mean, coalesce(demand_std_rolling, 0) AS demand_sigma, coalesce(wma_lead_time_days, m.lead_time_days) AS lead_time_days, coalesce(lt_std_days, 0) AS lt_sigma_days, 30.0::DOUBLE AS review_period_days,
  CASE WHEN c.sku LIKE '%-2' THEN 'min_max' WHEN c.sku LIKE '%-1' THEN 'reorder_point' ELSE 'periodic' END AS method, CASE WHEN c.sku LIKE '%-2' THEN min_order_qty END AS order_qty,
  coalesce(service_level, 0.9) AS service_level, t.incoterm, m.unit_cost, stocking_class, m.min_order_qty
FROM d_class c JOIN fx_item_master m ON m.sku = c.sku LEFT JOIN s_one o ON o.sku = c.sku LEFT JOIN (SELECT sku, min(incoterm) AS incoterm FROM s_terms GROUP BY sku) t ON t.sku = c.sku"""


def _should(par: str) -> str:
    return f"""
SELECT *, CASE WHEN held THEN cycle_qty + safety_qty + pipeline_qty ELSE greatest(cycle_qty + safety_qty + pipeline_qty, committed_qty) END AS should_be_qty FROM (
SELECT p.*, stocking_class <> 'non-stocking' AS held, demand_mean / 30.0 AS daily_demand, qty_on_hand AS actual_qty, committed_qty,
  CASE WHEN stocking_class <> 'non-stocking' THEN round_even(round(greatest(CASE WHEN method IN ('min_max', 'reorder_point') AND order_qty IS NOT NULL THEN order_qty ELSE demand_mean / 30.0 * review_period_days END, 0), 9), 1) ELSE 0 END AS cycle_qty,
  CASE WHEN stocking_class <> 'non-stocking' THEN round_even(round((CASE WHEN service_level <= 0.5 THEN 0 WHEN service_level >= 0.999 THEN 3.09 ELSE (SELECT za + (service_level - a) / (b - a) * (zb - za) FROM
      (VALUES (0.5::DOUBLE, 0.75::DOUBLE, 0.0::DOUBLE, 0.674::DOUBLE), (0.75, 0.8, 0.674, 0.842), (0.8, 0.85, 0.842, 1.036), (0.85, 0.9, 1.036, 1.282), (0.9, 0.91, 1.282, 1.341), (0.95, 0.96, 1.645, 1.751)) z(a, b, za, zb)
      WHERE service_level >= a AND service_level < b) END)
    * sqrt((lead_time_days + CASE WHEN method IN ('periodic', 'min_max') THEN review_period_days ELSE 0 END) / 30.0 * demand_sigma * demand_sigma + demand_mean * demand_mean * (lt_sigma_days / 30.0) * (lt_sigma_days / 30.0)), 9), 1) ELSE 0 END AS safety_qty,
  round_even(round(demand_mean / 30.0 * CASE WHEN incoterm IN ('EXW', 'FOB', 'CIF') THEN lead_time_days * 0.45 ELSE 0 END, 9), 1) AS pipeline_qty
FROM {par} p LEFT JOIN s_stock s ON s.sku = p.sku LEFT JOIN (SELECT sku, round_even(round(mto_actionable_qty, 9), 1) AS committed_qty FROM s_by) b ON b.sku = p.sku)"""


ORACLE_VIEWS["p_sb"] = _should("p_par")
ORACLE_VIEWS["p_gap"] = "SELECT *, should_be_qty * unit_cost AS should_be_value, actual_qty * unit_cost AS actual_value, (actual_qty - should_be_qty) * unit_cost AS gap_value FROM (SELECT * REPLACE (coalesce(should_be_qty, 0) AS should_be_qty) FROM p_sb)"
ORACLE_VIEWS["p_val"] = "SELECT m.sku, coalesce(sum(qty) FILTER (demand_date > DATE '1999-01-01'), 0) * any_value(unit_cost) AS annual_value FROM fx_item_master m LEFT JOIN d_lines d ON d.sku = m.sku GROUP BY m.sku"


def params(spark, sf_dir):
    lt = lead_times(spark, sf_dir)
    one = S.one_supplier(lt).select("sku", "wma_lead_time_days", F.col("lt_std_days").alias("lt_sigma_days"))
    terms = lt.groupBy("sku").agg(F.min("incoterm").alias("incoterm"))
    rows = classified(spark, sf_dir).join(view(spark, sf_dir, "fx_item_master").select("sku", F.col("lead_time_days").alias("stated"), "unit_cost", "min_order_qty"), "sku").join(one, "sku", "left").join(terms, "sku", "left")
    method = F.when(F.col("sku").endswith("-2"), "min_max").when(F.col("sku").endswith("-1"), "reorder_point").otherwise("periodic")
    return rows.select(
        "sku", F.col("demand_mean_rolling").alias("demand_mean"), F.col("demand_std_rolling").alias("demand_sigma"), F.coalesce("wma_lead_time_days", "stated").alias("lead_time_days"), F.coalesce("lt_sigma_days", F.lit(0.0)).alias("lt_sigma_days"),
        F.lit(30.0).alias("review_period_days"), method.alias("replenishment_method"), F.when(F.col("sku").endswith("-2"), F.col("min_order_qty")).alias("order_qty"), F.coalesce("service_level", F.lit(0.9)).alias("service_level"),
        "incoterm", "unit_cost", "stocking_class", "min_order_qty",
    )


def on_hand(spark, sf_dir):
    return stock(spark, sf_dir).select("sku", F.col("qty_on_hand").alias("qty"))


def shouldbe(spark, sf_dir):
    schedule = S.order_by_schedule(view(spark, sf_dir, "fx_open_so"), S.one_supplier(lead_times(spark, sf_dir)), at())
    return P.should_be(params(spark, sf_dir), on_hand(spark, sf_dir), schedule)


def values(spark, sf_dir):
    recent = F.sum(F.when(F.col("demand_date") > F.add_months(at(), -12), F.col("qty")))
    sold = lines(spark, sf_dir).groupBy("sku").agg(recent.alias("q"))
    rows = view(spark, sf_dir, "fx_item_master").join(sold, "sku", "left")
    return rows.select("sku", (F.coalesce("q", F.lit(0.0)) * F.col("unit_cost")).alias("annual_value"))


@query("""SELECT sku, CASE WHEN sku LIKE '%-0' THEN product_family WHEN sku LIKE '%-1' THEN upper(business_unit) ELSE 'S' END AS product_family, CASE WHEN sku LIKE '%-0' THEN 'master' WHEN sku LIKE '%-1' THEN 'description' ELSE 'sku_prefix' END AS family_source
FROM (SELECT * REPLACE (split_part(business_unit, ' ', 1) AS business_unit) FROM fx_item_master)""")
def p05_product_family(spark, sf_dir):
    m = view(spark, sf_dir, "fx_item_master")
    rows = m.select("sku", F.when(F.col("sku").endswith("-0"), F.col("product_family")).alias("product_family"), F.when(F.col("sku").endswith("-1"), F.concat("business_unit", F.lit(" unit"))).alias("description"))
    return P.product_family(rows).select("sku", "product_family", "family_source")


ORACLE_VIEWS["p_abc"] = """
SELECT sku, annual_value, CASE WHEN s <= 0.8 THEN 'A' WHEN s <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM (
SELECT *, sum(annual_value) OVER (ORDER BY annual_value DESC, sku ROWS UNBOUNDED PRECEDING) / sum(annual_value) OVER () AS s FROM p_val)"""


def classes(spark, sf_dir):
    return P.abc_classes(values(spark, sf_dir)).select("sku", "annual_value", "abc_class")


@query("SELECT * FROM p_abc")
def p06_abc_classes(spark, sf_dir):
    return classes(spark, sf_dir)


@query("SELECT CASE WHEN demand_cv <= 0.5 THEN 'stable' WHEN demand_cv <= 1 THEN 'variable' ELSE 'erratic' END AS volatility, count(*) AS items FROM d_class GROUP BY 1")
def p07_volatility(spark, sf_dir):
    return classified(spark, sf_dir).groupBy(P.volatility_class(F.col("demand_cv")).alias("volatility")).agg(F.count("*").alias("items"))


RULES = [
    {"id": "R1", "scope": "stocking_policy = 'MTO'", "needs": ["stocking_policy"], "set": {"review": 14.0, "method": "make_to_order"}},
    {"id": "R2", "scope": "unit_cost > 150", "needs": ["unit_cost"], "set": {"review": 7.0}},
    {"id": "R3", "scope": "absent = 1", "needs": ["absent"], "set": {"review": 1.0}},
    {"id": "R4", "scope": "product_family = 'pumps'", "needs": ["product_family"], "set": {"method": "reorder_point", "review": 60.0}},
]
ORACLE_VIEWS["p_rules"] = """
SELECT sku, CASE WHEN product_family = 'pumps' THEN 60.0 WHEN unit_cost > 150 THEN 7.0 WHEN stocking_policy = 'MTO' THEN 14.0 ELSE 30.0 END::DOUBLE AS review,
  CASE WHEN product_family = 'pumps' THEN 'reorder_point' WHEN stocking_policy = 'MTO' THEN 'make_to_order' ELSE 'periodic' END AS method,
  CASE WHEN product_family = 'pumps' THEN 'R4' WHEN unit_cost > 150 AND stocking_policy = 'MTO' THEN 'R1,R2' WHEN unit_cost > 150 THEN 'R2' WHEN stocking_policy = 'MTO' THEN 'R1' ELSE '' END AS applied_rules,
  stocking_policy = 'MTO' AS m1, unit_cost > 150 AS m2, product_family = 'pumps' AS m4 FROM fx_item_master"""


def _resolved(spark, sf_dir):
    return P.resolve_rules(view(spark, sf_dir, "fx_item_master"), {"review": 30.0, "method": "periodic"}, RULES)


@query("SELECT sku, review, method, applied_rules FROM p_rules")
def p08_resolved_rules(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("sku", "review", "method", "applied_rules")


@query("""SELECT 'R1' AS rule_id, count(*) FILTER (m1) AS matched, count(*) FILTER (contains(applied_rules, 'R1')) AS standing FROM p_rules UNION ALL SELECT 'R2', count(*) FILTER (m2), count(*) FILTER (contains(applied_rules, 'R2')) FROM p_rules
UNION ALL SELECT 'R4', count(*) FILTER (m4), count(*) FILTER (contains(applied_rules, 'R4')) FROM p_rules""")
def p09_rule_audit(spark, sf_dir):
    return _resolved(spark, sf_dir)[1]


@query("""SELECT sku, round(CASE WHEN sl <= 0.5 THEN 0 WHEN sl < 0.75 THEN (sl - 0.5) / 0.25 * 0.674 WHEN sl < 0.8 THEN 0.674 + (sl - 0.75) / 0.05 * 0.168 WHEN sl < 0.85 THEN 0.842 + (sl - 0.8) / 0.05 * 0.194
  WHEN sl < 0.9 THEN 1.036 + (sl - 0.85) / 0.05 * 0.246 ELSE 1.282 END, 6) AS z FROM (SELECT sku, 0.4 + lead_time_days / 120 AS sl FROM fx_item_master)""")
def p12_service_z(spark, sf_dir):
    return tidy(view(spark, sf_dir, "fx_item_master").select("sku", P.z_of(0.4 + F.col("lead_time_days") / 120).alias("z")))


@query("SELECT sku, cycle_qty FROM p_sb")
def r04_cycle_stock(spark, sf_dir):
    return shouldbe(spark, sf_dir).select("sku", "cycle_qty")


@query("SELECT sku, safety_qty FROM p_sb")
def r05_safety_stock(spark, sf_dir):
    return shouldbe(spark, sf_dir).select("sku", "safety_qty")


@query("SELECT sku, pipeline_qty FROM p_sb")
def r06_pipeline_stock(spark, sf_dir):
    return shouldbe(spark, sf_dir).select("sku", "pipeline_qty")


@query("""SELECT sku, round(should_be_qty, 6) AS should_be_qty, actual_qty, round(should_be_value, 2) AS should_be_value, round(gap_value, 2) AS gap_value, round(CASE WHEN should_be_qty > 0 THEN actual_qty / should_be_qty END, 6) AS coverage_ratio,
round(CASE WHEN demand_mean > 0 THEN should_be_qty / (demand_mean * 12 / 365) END, 6) AS should_be_dioh FROM p_gap""")
def r07_should_be(spark, sf_dir):
    found = shouldbe(spark, sf_dir).select("sku", "should_be_qty", "actual_qty", "should_be_value", "gap_value", "coverage_ratio", "should_be_dioh")
    return tidy(found, should_be_value=2, gap_value=2)


@query("""SELECT round(sum(should_be_value), 1) AS should_be_value, round(sum(actual_value), 1) AS actual_value, round(sum(gap_value), 1) AS net_gap_value, round(sum(greatest(gap_value, 0)), 1) AS excess_value, round(sum(greatest(-gap_value, 0)), 1) AS shortfall_value,
round(sum(daily_demand * unit_cost), 2) AS daily_cogs, 0 AS unpriced_skus FROM p_gap""")
def r08_portfolio(spark, sf_dir):
    return tidy(P.portfolio(shouldbe(spark, sf_dir)), should_be_value=1, actual_value=1, net_gap_value=1, excess_value=1, shortfall_value=1, daily_cogs=2)


@query("SELECT 45.0::DOUBLE AS target_days, round(45 * sum(daily_demand * unit_cost), 1) AS target_value, round(sum(actual_value) - 45 * sum(daily_demand * unit_cost), 1) AS to_release FROM p_gap")
def r23_stated_target(spark, sf_dir):
    return tidy(P.stated_target(P.portfolio(shouldbe(spark, sf_dir)), 45.0), target_value=1, to_release=1)


ORACLE_VIEWS["p_lpar"] = """
SELECT p.* EXCLUDE (review_period_days, lt_sigma_days, demand_sigma, lead_time_days, service_level), lever, CASE WHEN lever = 'review_weekly' THEN 7.0 ELSE review_period_days END AS review_period_days,
  CASE WHEN lever = 'lt_reliability' THEN lt_sigma_days * 0.5 ELSE lt_sigma_days END AS lt_sigma_days, CASE WHEN lever = 'forecast_accuracy' THEN demand_sigma * 0.75 ELSE demand_sigma END AS demand_sigma,
  CASE WHEN lever = 'lt_speed' THEN lead_time_days * 2 / 3 ELSE lead_time_days END AS lead_time_days, CASE WHEN lever = 'service_level_down' THEN greatest(service_level - 0.05, 0.5) ELSE service_level END AS service_level
FROM p_par p CROSS JOIN (VALUES ('review_weekly'), ('lt_reliability'), ('forecast_accuracy'), ('lt_speed'), ('service_level_down')) l(lever)"""
ORACLE_VIEWS["p_lsb"] = _should("p_lpar").replace("greatest(cycle_qty + safety_qty + pipeline_qty, committed_qty)", "cycle_qty + safety_qty + pipeline_qty")
ORACLE_VIEWS["p_lev"] = """
SELECT l.sku, l.lever, (b.cycle_qty + b.safety_qty + b.pipeline_qty - l.should_be_qty) * l.unit_cost AS stock_saving, CASE WHEN l.lever = 'review_weekly' THEN (365 / 7.0 - 365 / 30.0) * 350 ELSE 0 END AS ordering_cost
FROM p_lsb l JOIN p_sb b ON b.sku = l.sku"""


def lever_results(spark, sf_dir):
    return P.levers(params(spark, sf_dir), on_hand(spark, sf_dir))


@query("SELECT sku, lever, round(stock_saving, 2) AS stock_saving, round(ordering_cost, 6) AS ordering_cost, round(stock_saving * 0.22 - ordering_cost, 6) AS net_annual FROM p_lev")
def r19_levers(spark, sf_dir):
    return tidy(lever_results(spark, sf_dir).select("sku", "lever", "stock_saving", "ordering_cost", "net_annual"), stock_saving=2)


@query("SELECT lever, sum(round(stock_saving, 4)::DECIMAL(20,4))::DOUBLE AS stock_saving, sum(round(stock_saving * 0.22 - ordering_cost, 4)::DECIMAL(20,4))::DOUBLE AS net_annual, count(*) FILTER (stock_saving * 0.22 - ordering_cost > 0) AS items_that_pay FROM p_lev GROUP BY lever")
def r20_lever_ranking(spark, sf_dir):
    return P.lever_ranking(lever_results(spark, sf_dir))


@query("SELECT sku, lever FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY round(stock_saving * 0.22 - ordering_cost, 6) DESC, lever) AS n FROM p_lev) WHERE n = 1")
def r20_best_lever(spark, sf_dir):
    return P.best_lever(lever_results(spark, sf_dir)).select("sku", "lever")


@query("""SELECT sku, 'lead_time_over_review' AS finding FROM p_sb WHERE lead_time_days > 4 * review_period_days UNION ALL SELECT sku, 'eoq_over_order' FROM p_sb WHERE demand_mean > 0
AND round_even(sqrt(2 * demand_mean * 12 * 350 / (unit_cost * 0.22)), 0) >= 2 * daily_demand * review_period_days UNION ALL SELECT sku, 'moq_over_cycle' FROM p_sb WHERE min_order_qty > 1.5 * cycle_qty""")
def r21_constraints(spark, sf_dir):
    eoq = F.bround(R.economic_order_quantity(F.col("demand_mean") * 12, F.col("unit_cost"), 350.0, 0.22), 0)
    return P.constraints(shouldbe(spark, sf_dir).withColumn("eoq_qty", eoq))
