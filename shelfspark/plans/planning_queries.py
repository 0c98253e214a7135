"""Queries and oracles of period planning and stock health."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import planning as L
from shelfspark.operators import supply as S
from shelfspark.plans.demand_queries import lines, series
from shelfspark.plans.fixtures import ORACLE_VIEWS, once, query, tidy, view
from shelfspark.plans.forecast_queries import COMING, detail, spine, wide
from shelfspark.plans.service_queries import daily
from shelfspark.plans.supply_queries import at, lead_times, safety, stock

ORACLE_VIEWS["l_sup"] = """
SELECT sku, period, sum(open_qty) AS supply_qty FROM (SELECT *, greatest(coalesce(date_trunc('month', committed_delivery)::DATE, lo), lo) AS period FROM fx_open_po CROSS JOIN (SELECT min(period) AS lo, max(period) AS hi FROM f_det) WHERE open_qty > 0)
WHERE period <= hi GROUP BY sku, period"""
ORACLE_VIEWS["l_item"] = """
SELECT m.sku, qty_on_hand + qty_in_transit AS opening_qty, m.unit_cost, safety_stock, nullif(wma_lead_time_days, 0) AS lead_time_days
FROM fx_item_master m LEFT JOIN s_stock s ON s.sku = m.sku LEFT JOIN r_ss r ON r.sku = m.sku LEFT JOIN s_one o ON o.sku = m.sku"""
ORACLE_VIEWS["l_bal"] = """
SELECT *, demand_qty * unit_cost AS demand_cogs, supply_qty * unit_cost AS supply_value, greatest(closing_qty, 0) * unit_cost AS closing_value, greatest(0, safety_stock - closing_qty) AS gap_qty, greatest(0, safety_stock - closing_qty) * unit_cost AS gap_value, pos < lead_time_periods AS within_lead_time
FROM (SELECT sku, period, pos, demand_qty, supply_qty, unit_cost, coalesce(safety_stock, 0) AS safety_stock, lead_time_days, CASE WHEN lead_time_days IS NULL THEN 6 ELSE least(greatest(ceil(lead_time_days / 30.4375), 1), 6) END::INT AS lead_time_periods,
  coalesce(opening_qty, 0) + sum(supply_qty - demand_qty) OVER (PARTITION BY sku ORDER BY period) AS closing_qty
FROM (SELECT sku, m.period, m.pos, coalesce(forecast_qty, 0) AS demand_qty, coalesce(supply_qty, 0) AS supply_qty FROM (SELECT sku FROM f_det UNION SELECT sku FROM l_sup) k
  CROSS JOIN (SELECT period, row_number() OVER (ORDER BY period) - 1 AS pos FROM (SELECT DISTINCT period FROM f_det)) m LEFT JOIN f_det d USING (sku, period) LEFT JOIN l_sup u USING (sku, period)) LEFT JOIN l_item USING (sku))"""
ORACLE_VIEWS["l_idle"] = """
SELECT sku, l AS last_demand, (year(e) - year(l)) * 12 + month(e) - month(l) AS months_idle FROM (SELECT sku, max(period) FILTER (qty > 0) AS l, (SELECT max(period) FROM d_series) AS e FROM d_series GROUP BY sku)"""
ORACLE_VIEWS["l_age"] = """
SELECT s.sku, qty_on_hand, unit_cost, months_idle, daily_demand, coalesce(months_idle * 30.0, qty_on_hand / nullif(daily_demand, 0)) AS age_days,
  CASE WHEN months_idle IS NOT NULL THEN 'last_movement' WHEN qty_on_hand / nullif(daily_demand, 0) IS NOT NULL THEN 'cover' ELSE 'unknown' END AS age_basis
FROM s_stock s LEFT JOIN l_idle i ON i.sku = s.sku LEFT JOIN v_daily d ON d.sku = s.sku"""


def span(spark, sf_dir):
    return L.plan_span(detail(spark, sf_dir))


def supply(spark, sf_dir):
    return L.phase_supply(view(spark, sf_dir, "fx_open_po"), span(spark, sf_dir))


def plan_items(spark, sf_dir):
    floors = safety(spark, sf_dir).select("sku", "safety_stock")
    lead = S.one_supplier(lead_times(spark, sf_dir)).select("sku", F.col("wma_lead_time_days").alias("lead_time_days"))
    return opened(spark, sf_dir).join(floors, "sku", "left").join(lead, "sku", "left")


@once
def balance(spark, sf_dir):
    return L.period_balance(detail(spark, sf_dir), supply(spark, sf_dir), plan_items(spark, sf_dir), span(spark, sf_dir))


def opened(spark, sf_dir):
    have = stock(spark, sf_dir)
    return L.opening(have).join(L.unit_costs(view(spark, sf_dir, "fx_item_master"), have), "sku", "left")


def aged(spark, sf_dir):
    return L.stock_age(stock(spark, sf_dir), L.last_movement(series(spark, sf_dir)), daily(spark, sf_dir))


@query("SELECT * FROM l_sup")
def l01_phased_supply(spark, sf_dir):
    return supply(spark, sf_dir)


@query("SELECT s.sku, qty_on_hand + qty_in_transit AS opening_qty, m.unit_cost FROM s_stock s LEFT JOIN fx_item_master m ON m.sku = s.sku")
def l02_opening(spark, sf_dir):
    return opened(spark, sf_dir)


_MONEY = dict.fromkeys(("demand_cogs", "supply_value", "closing_value", "gap_value"), 2)


def _rounded(*names: str) -> str:
    return ", ".join(f"round({c}, {_MONEY.get(c, 6)}) AS {c}" for c in names)


@query(f"SELECT sku, period, {_rounded(*L.MEASURES)}, safety_stock, lead_time_days, lead_time_periods, within_lead_time FROM l_bal")
def l03_period_balance(spark, sf_dir):
    return tidy(balance(spark, sf_dir), **_MONEY)


@query(f"""SELECT period, {", ".join(f"round({c}, 2) AS {c}" for c in L.MEASURES)}, gap_skus, round(coalesce(lag(closing_value) OVER (ORDER BY period), (SELECT sum(opening_qty * unit_cost) FROM l_item WHERE sku IN (SELECT sku FROM f_det))), 2) AS opening_value
FROM (SELECT period, {", ".join(f"sum({c}) AS {c}" for c in L.MEASURES)}, count(*) FILTER (gap_qty > 0) AS gap_skus FROM l_bal GROUP BY period)""")
def l04_balance_by_period(spark, sf_dir):
    found = L.balance_by_period(balance(spark, sf_dir), detail(spark, sf_dir), opened(spark, sf_dir))
    return tidy(found, **dict.fromkeys((*L.MEASURES, "opening_value"), 2))


@query(f"""SELECT business_unit, product_family, period, {", ".join(f"round(sum({c}), 2) AS {c}" for c in _MONEY)} FROM l_bal LEFT JOIN fx_item_master USING (sku) GROUP BY ALL""")
def l04_balance_by_family(spark, sf_dir):
    return tidy(L.balance_by_family(balance(spark, sf_dir), view(spark, sf_dir, "fx_item_master")), **_MONEY)


_ITEM = """sku, min(period) FILTER (gap_qty > 0) AS first_short_period, count(*) FILTER (gap_qty > 0) AS short_periods, any_value(safety_stock) AS safety_stock, any_value(lead_time_days) AS lead_time_days, any_value(lead_time_periods) AS lead_time_periods,
round(coalesce(max(gap_qty) FILTER (within_lead_time), 0), 6) AS gap_qty_within_lead_time, round(coalesce(max(gap_value) FILTER (within_lead_time), 0), 2) AS gap_amt_within_lead_time, round(sum(demand_qty), 6) AS demand_qty_total, round(sum(supply_qty), 6) AS supply_qty_total,
round(sum(demand_cogs), 2) AS demand_amt_total, round(sum(supply_value), 2) AS supply_amt_total, round(max(gap_qty), 6) AS gap_qty_peak, round(max(gap_value), 2) AS gap_amt_peak"""
_AMOUNTS = dict.fromkeys(("gap_amt_within_lead_time", "demand_amt_total", "supply_amt_total", "gap_amt_peak"), 2)


@query(f"SELECT {_ITEM} FROM l_bal GROUP BY sku")
def l05_balance_by_item(spark, sf_dir):
    return tidy(L.balance_by_item(balance(spark, sf_dir)), **_AMOUNTS)


@query(f"SELECT {_ITEM}, {', '.join(wide(f'{m} {unit}', f'round({c}, 2)', COMING) for m, unit, c in L.PHASED)} FROM l_bal GROUP BY sku")
def l05_wide_plan(spark, sf_dir):
    found = L.balance_by_item(balance(spark, sf_dir), spine(spark, sf_dir)[1])
    return tidy(found, **_AMOUNTS, **{c: 2 for c in found.columns if " " in c})


@query("SELECT round(sum(gap), 2) AS gap_within_lead_time, count(*) FILTER (gap > 0) AS items FROM (SELECT max(gap_value) AS gap FROM l_bal WHERE within_lead_time GROUP BY sku)")
def l05_lead_time_exposure(spark, sf_dir):
    return tidy(L.lead_time_exposure(balance(spark, sf_dir)), gap_within_lead_time=2)


@query("""SELECT sku, round(CASE src WHEN 'trailing_12m' THEN p12 WHEN 'trailing_3m' THEN p3 WHEN 'all_history' THEN pa WHEN 'standard_cost' THEN unit_cost END, 2) AS price, src AS price_source FROM (
SELECT sku, p12, p3, pa, unit_cost, CASE WHEN p12 > 0 THEN 'trailing_12m' WHEN p3 > 0 THEN 'trailing_3m' WHEN pa > 0 THEN 'all_history' WHEN unit_cost > 0 THEN 'standard_cost' ELSE 'none' END AS src
FROM (SELECT sku, sum(amount::DECIMAL(24,6)) FILTER (demand_date > DATE '1999-01-01')::DOUBLE / sum(qty) FILTER (demand_date > DATE '1999-01-01') AS p12, sum(amount::DECIMAL(24,6)) FILTER (demand_date > DATE '1999-10-01')::DOUBLE / sum(qty) FILTER (demand_date > DATE '1999-10-01') AS p3,
  sum(amount::DECIMAL(24,6))::DOUBLE / sum(qty) AS pa FROM d_lines GROUP BY sku) FULL JOIN fx_item_master USING (sku))""")
def l06_selling_price(spark, sf_dir):
    return tidy(L.selling_price(lines(spark, sf_dir), view(spark, sf_dir, "fx_item_master"), at()), price=2)


@query("SELECT sku, date_trunc('month', demand_date)::DATE AS period, sum(amount::DECIMAL(24,6))::DOUBLE AS amount FROM d_lines GROUP BY ALL")
def l07_value_series(spark, sf_dir):
    return L.value_series(lines(spark, sf_dir))


@query("""SELECT sku, country, round((q + CASE WHEN place = 1 THEN t - sum(q) OVER (PARTITION BY sku) ELSE 0 END) / t, 6) AS share FROM (
SELECT *, row_number() OVER (PARTITION BY sku ORDER BY raw DESC, country) AS place FROM (SELECT sku, country, q, sum(q) OVER (PARTITION BY sku) AS t, q / sum(q) OVER (PARTITION BY sku) AS raw FROM (
  SELECT sku, country, CASE WHEN sum(r) OVER (PARTITION BY sku) > 0 THEN coalesce(r, 0) ELSE a END AS q FROM (
    SELECT sku, country, sum(qty) FILTER (demand_date > DATE '1999-01-01') AS r, sum(qty) AS a FROM d_lines GROUP BY ALL)))) WHERE raw >= 0.02 OR place = 1""")
def l08_country_shares(spark, sf_dir):
    return tidy(L.country_shares(lines(spark, sf_dir), at()))


@query("SELECT * FROM l_idle")
def l10_last_movement(spark, sf_dir):
    return L.last_movement(series(spark, sf_dir))


@query("SELECT sku, round(age_days, 6) AS age_days, age_basis FROM l_age")
def l11_stock_age(spark, sf_dir):
    return tidy(aged(spark, sf_dir).select("sku", "age_days", "age_basis"))


@query("""SELECT product_family, skus, round(stock_value, 2) AS stock_value, round(daily_cogs, 2) AS daily_cogs, slow_skus, round(slow_value, 2) AS slow_value, round(stock_value / nullif(daily_cogs, 0), 6) AS days_on_hand,
round(slow_value / nullif(stock_value, 0), 6) AS slow_share FROM (SELECT product_family, count(*) AS skus, sum(qty_on_hand * a.unit_cost) AS stock_value, sum(coalesce(daily_demand, 0) * a.unit_cost) AS daily_cogs,
count(*) FILTER (months_idle >= 6) AS slow_skus, coalesce(sum(qty_on_hand * a.unit_cost) FILTER (months_idle >= 6), 0) AS slow_value FROM l_age a LEFT JOIN fx_item_master m ON m.sku = a.sku GROUP BY product_family)""")
def l12_health_by_family(spark, sf_dir):
    return tidy(L.health_by_family(aged(spark, sf_dir), view(spark, sf_dir, "fx_item_master")), stock_value=2, daily_cogs=2, slow_value=2)


@query("SELECT sku, coalesce(months_idle >= 6, false) AS slow, coalesce(age_days > 365, false) AS old, round(age_days, 6) AS age_days, months_idle FROM l_age WHERE qty_on_hand > 0 AND (months_idle >= 6 OR age_days > 365)")
def l13_slow_or_old(spark, sf_dir):
    return tidy(L.slow_or_old(aged(spark, sf_dir)))
