"""Steps that must not grow faster than their input: what a plan computes twice, sorts or carries for nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import demand, forecast
from shelfspark.operators import planning as L
from shelfspark.operators import supply as S
from shelfspark.plans import QUERIES, planning_queries


@pytest.fixture
def plain(spark):
    """Plans as they run from start to end, not re-planned on the way."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


LINES = [("a", "2000-01-05", 1.0), ("a", "2000-03-05", 2.0), ("b", "2000-02-05", 4.0), ("b", "2000-02-06", 1.0), (None, "2000-05-05", 9.0)]


def test_series_sums_its_lines_once(plain):
    lines = plain.createDataFrame(LINES, "sku string, d string, qty double").select("sku", F.to_date("d").alias("demand_date"), "qty").repartition(3)
    found = demand.monthly_series(lines)
    assert "ReusedExchange" in plan_of(found)
    months = [dt.date(2000, m, 1) for m in (1, 2, 3)]
    want = [("a", m, q) for m, q in zip(months, (1.0, 0.0, 2.0), strict=True)] + [("b", m, q) for m, q in zip(months, (0.0, 5.0, 0.0), strict=True)]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_arrays_come_from_totals_in_order_of_months(plain):
    lines = plain.createDataFrame(LINES, "sku string, d string, qty double").select("sku", F.to_date("d").alias("demand_date"), "qty")
    totals = demand.month_totals(lines)
    found = sorted(tuple(r) for r in demand.arrays_of(totals).collect())
    assert found == [("a", [1.0, 0.0, 2.0]), ("b", [0.0, 5.0, 0.0])] == sorted(tuple(r) for r in forecast.as_arrays(demand.series_of(totals)).collect())


def test_sheet_is_sorted_for_no_grouping_and_adds_up_its_rows(plain):
    day = lambda m: dt.date(2000, m, 1)
    items = [("a", day(1), "history", 3.0, 10.0), ("a", day(2), "history", 0.0, None), ("a", day(3), "forecast", 5.0, None), ("b", day(3), "forecast", 1.5, None)]
    items = plain.createDataFrame(items, "sku string, period date, kind string, qty double, amount double")
    shares = plain.createDataFrame([("a", "PERU", 0.7), ("a", "CHINA", 0.3)], "sku string, country string, share double")
    prices = plain.createDataFrame([("a", 2.5, "all_history")], "sku string, price double, price_source string")
    detail = plain.createDataFrame([("a", True, "ets"), ("b", True, "tsb")], "sku string, is_next_period boolean, model string")
    attrs = plain.createDataFrame([("a", "pumps")], "sku string, product_family string")
    found = L.sop_sheet(items, shares, attrs, prices, detail, [day(1), day(2)], [day(3)])
    assert "SortAggregate" not in plan_of(found)
    got = {(r.sku, r.country): r for r in found.collect()}
    assert set(got) == {("a", "PERU"), ("a", "CHINA"), ("b", "(not stated)")}
    for r in L.sop_rows(items, prices, shares).collect():
        kind = {"history": "hist", "forecast": "fcst"}[r.kind]
        assert (got[r.sku, r.country][f"{kind} qty {r.period:%Y-%m}"], got[r.sku, r.country][f"{kind} amt {r.period:%Y-%m}"], got[r.sku, r.country].split_basis) == (r.qty, r.amount, r.split_basis)
    a, b = got["a", "PERU"], got["b", "(not stated)"]
    assert (a.history_qty_total, a.history_amount_total, a.forecast_qty_total, a.forecast_amount_total, a.price_basis, a.model) == (2.1, 7.0, 3.5, 8.75, "all_history", "ets")
    assert (b.history_qty_total, b.history_amount_total, b.forecast_qty_total, b.forecast_amount_total, b.price_basis, b.split_basis) == (None, None, 1.5, None, "none", "single country")


def test_sheet_query_sorts_for_no_grouping(plain):
    assert "SortAggregate" not in plan_of(QUERIES["l09_sop_sheet"](plain, "/root/testdata/sf0.001"))


def test_lead_times_carry_no_columns_for_ties_that_change_nothing(plain):
    rows = [("a", "v", "2000-01-01", "2000-01-11", 2), ("a", "v", "2000-01-01", "2000-01-11", 1), ("a", "v", "2000-01-01", "2000-01-05", 3), ("a", "v", "1999-01-01", "1999-03-01", 4), ("a", "v", "2000-02-01", None, 5), ("b", "v", "1998-01-01", "1998-01-21", 6)]
    po = plain.createDataFrame(rows, "sku string, supplier string, ordered string, received string, po_number int")
    po = po.select("sku", "supplier", F.to_date("ordered").alias("po_date"), F.to_date("received").alias("receive_date"), "po_number", *[F.lit(1).alias(c) for c in ("po_line_number", "part", "po_qty", "po_amount")], F.lit("FOB").alias("incoterm"))
    found = S.supplier_lead_times(S.sane_lead_times(po))
    assert not [line for line in plan_of(found).splitlines() if ("Sort" in line or "Exchange" in line or "Window" in line) and "po_number" in line]
    got = {r.sku: (r.wma_lead_time_days, r.sample_count, r.lt_source) for r in found.collect()}
    assert got == {"a": (9.0, 3, "measured"), "b": (20.0, 1, "measured_outside_window")}


def test_totals_by_month_ask_for_safety_stock_once(spark, monkeypatch):
    asked, safety = [], planning_queries.safety
    monkeypatch.setattr(planning_queries, "safety", lambda *a: asked.append(a) or safety(*a))
    assert QUERIES["l04_balance_by_period"](spark, "/root/testdata/sf0.001").count() == 6
    assert len(asked) == 1
