"""Folds, ordering rules and refusals on small hand-made tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import guarded
from shelfspark.operators import asof, conform, demand, feedback, forecast, policy, replenish, service, supply, target
from shelfspark.sources import files
from shelfspark.streaming import landing

D = dt.date


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in [" 1,234.5 ", "(12)", "n/a", "", None, "1e3", "abc", "-7", ".5"]], "t string")
    got = [r[0] for r in df.select(conform.parse_number(F.col("t"))).collect()]
    assert got == [1234.5, -12.0, None, None, None, 1000.0, None, -7.0, 0.5]
    assert spark.range(1).select(conform.parse_number(F.lit("1.234,5"), decimal_comma=True, flip_sign=True)).first()[0] == -1234.5


def test_material_numbers(spark):
    df = spark.createDataFrame([("000123",), ("0012A",), (" ab-1 ",), ("77.0",), ("nan",), ("000",)], "t string")
    assert [r[0] for r in df.select(conform.material_number(F.col("t"))).collect()] == ["123", "0012A", "AB-1", "77", None, "0"]


def test_supersession_chains_and_loops(spark):
    edges = spark.createDataFrame([("A", "B", 2.0), ("B", "C", 3.0), ("C", "D", 1.0), ("X", "Y", 1.0), ("Y", "X", 1.0), ("Z", "X", 1.0)], "old_sku string, new_sku string, ratio double")
    assert rows(conform.resolve_chains(edges), "old_sku", "final_sku", "ratio") == [("A", "D", 6.0), ("B", "D", 3.0), ("C", "D", 1.0)]


def test_currency_rules(spark):
    quotes = spark.createDataFrame([("USD", D(2020, 1, 1), 0.9), ("USD", D(2021, 1, 1), 0.8)], "currency string, effective_from date, rate double")
    df = spark.createDataFrame(
        [(1, "usd", D(2019, 1, 1), None, 10.0), (2, "USD", D(2020, 6, 1), None, 10.0), (3, "USD", None, None, 10.0), (4, "EUR", D(2020, 1, 1), 5.0, 10.0), (5, "USD", D(2020, 1, 1), 1.1, 10.0), (6, "USD", D(2020, 1, 1), 50.0, 10.0), (7, "GBP", D(2020, 1, 1), None, 10.0)],
        "id int, currency string, at date, fx_rate double, amount double",
    )
    got = {r.id: (r.fx_basis, r.amount) for r in conform.convert_currency(df, quotes, ["amount"], "at", "EUR").collect()}
    assert got == {1: ("table", 9.0), 2: ("table", 9.0), 3: ("table", 8.0), 4: ("domestic", 10.0), 5: ("own", 11.0), 6: ("table", 9.0), 7: ("unrated", None)}


def plain_croston(v, a=0.2):
    hit = [i for i, x in enumerate(v) if x > 0]
    if not hit:
        return sum(v) / len(v)
    z = sum(v[i] for i in hit) / len(hit)
    gaps = [b - a_ for a_, b in zip(hit, hit[1:])]
    p, last = (sum(gaps) / len(gaps) if gaps else float(len(v))), hit[0]
    for t in range(hit[0] + 1, len(v)):
        if v[t] > 0:
            z, p, last = a * v[t] + (1 - a) * z, a * (t - last) + (1 - a) * p, t
    return z / p


def plain_tsb(v, a=0.2):
    hit = [i for i, x in enumerate(v) if x > 0]
    if not hit:
        return sum(v) / len(v)
    z, p = sum(v[i] for i in hit) / len(hit), len(hit) / len(v)
    for t in range(hit[0] + 1, len(v)):
        z, p = (a * v[t] + (1 - a) * z, a + (1 - a) * p) if v[t] > 0 else (z, (1 - a) * p)
    return z * p


def test_croston_and_tsb_folds(spark):
    series = [[0.0, 5, 0, 0, 8, 2, 0], [3.0], [0.0, 0, 0], [0.0, 0, 4, 0], [1.0, 2, 3, 4]]
    df = spark.createDataFrame([(i, [float(x) for x in s]) for i, s in enumerate(series)], "i int, q array<double>")
    got = df.select("i", forecast.croston(F.col("q"))["value"].alias("c"), forecast.tsb(F.col("q"))["value"].alias("t")).orderBy("i").collect()
    for r, s in zip(got, series):
        assert r.c == pytest.approx(plain_croston(s)) and r.t == pytest.approx(plain_tsb(s))


def test_allocation_skips_what_does_not_fit(spark):
    lines = spark.createDataFrame(
        [("A", D(2020, 1, 1), 1, 60.0), ("A", D(2020, 1, 2), 2, 50.0), ("A", D(2020, 1, 3), 3, 40.0), ("A", None, 4, 1.0), ("B", D(2020, 1, 1), 5, 1.0)], "sku string, customer_request_date date, line_order int, open_qty double"
    )
    stock = spark.createDataFrame([("A", 100.0), ("B", 0.0)], "sku string, qty_on_hand double")
    assert rows(replenish.allocate(lines, stock), "line_order", "fillable") == [(1, True), (2, False), (3, True), (4, False), (5, False)]


def test_longest_runs(spark):
    balance = [-5, -5, 1, -5, -5, -5, 9, 9, 0, 9, 9, 9]
    data, last = [], 0
    for m, b in enumerate(balance):
        data.append(("A", D(2020, m + 1, 1), float(b - last if b > last else 0), float(last - b if b < last else 0), float(b)))
        last = b
    matrix = spark.createDataFrame(data, "sku string, month date, po_qty double, demand_qty double, balance double")
    orders = spark.createDataFrame([("A", 100)], "sku string, order_count int")
    r = service.cadence_metrics(matrix, orders).first()
    assert (r.longest_deficit_run, r.longest_surplus_run, r.deficit_months, r.surplus_months) == (3, 3, 5, 6)  # the tolerance is 20 / 12 / 2, so the balance of 1 is a surplus, too


def test_persistent_tail(spark):
    loss = spark.createDataFrame([("A", f"2020-0{m}", float(g)) for m, g in enumerate([1, 0, 2, 3, 4], 1)] + [("B", "2020-01", 1.0), ("B", "2020-05", 1.0), ("B", "2020-03", 1.0)], "sku string, month string, supply_gap double")
    assert rows(feedback.persistent_gaps(loss, "supply_gap"), "sku", "months_in_a_row", "cumulative_gap") == [("A", 3, 10.0), ("B", 3, 3.0)]


def test_classes_and_z(spark):
    items = spark.createDataFrame([("a", 80.0), ("b", 15.0), ("c", 4.0), ("d", 1.0), ("e", None)], "sku string, annual_value double")
    assert dict(rows(policy.abc_classes(items), "sku", "abc_class")) == {"a": "A", "b": "B", "c": "C", "d": "C", "e": "C"}
    assert dict(rows(policy.abc_classes(items.where("sku = 'a'")), "sku", "abc_class")) == {"a": "C"}  # alone it crosses both lines
    z = spark.createDataFrame([(0.4,), (0.95,), (0.925,), (0.9995,), (None,)], "s double").select(policy.z_of(F.col("s"))).collect()
    assert [round(r[0], 4) for r in z] == [0.0, 1.645, 1.4405, 3.09, 0.0]


def test_refusals(spark):
    twice = spark.createDataFrame([("A",), ("A",)], "sku string")
    with pytest.raises(Exception, match="repeat a sku: A"):
        replenish.require_unique(twice).collect()
    assert replenish.require_unique(twice.distinct()).collect() == [("A",)]
    with pytest.raises(ValueError, match="natural key"):
        asof.current(twice, twice, ["absent"], [])
    with pytest.raises(ValueError, match="no column"):
        asof.where_values(twice, {"absent": 1})
    with pytest.raises(ValueError, match="layers differ"):
        asof.require_one_layer(spark.createDataFrame([("raw", "1"), ("converted", "2")], "frame_layer string, valid_time string"))
    with pytest.raises(Exception, match="no demand"):
        feedback.actuals_after(spark.createDataFrame([], "sku string, demand_date date, qty double"), twice.withColumn("qty_on_hand", F.lit(1.0)), F.lit("2020-01-01").cast("date")).collect()


def test_files_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("0012", "1,5")], "sku string, qty string")
    files.write_csv(df, f"{tmp_path}/csv")
    assert rows(files.read_delimited(spark, f"{tmp_path}/csv"), "sku", "qty") == [("0012", "1,5")]
    df.write.parquet(f"{tmp_path}/in")
    landing.land_files(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/ck", "sales").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "sku", "batch_id") == [("0012", "stream-0")]


def test_guarded_functions(spark):
    df = spark.createDataFrame([(1.0, None, "Abc")], "a double, b double, t string")
    r = df.select(guarded.greatest(F.col("a"), F.col("b")), guarded.least(F.col("a"), F.lit(3.0)), guarded.startswith(F.col("t"), F.lit("aB")), guarded.contains(F.lit(None).cast("string"), F.lit("x")), guarded.divide(F.lit(1.0), F.lit(0.0)), guarded.true(F.col("b") > 1)).first()
    assert tuple(r) == (None, 1.0, True, False, None, False)


def test_series_spine_and_patterns(spark):
    lines = spark.createDataFrame([("A", D(2020, 1, 5), 2.0), ("B", D(2020, 3, 5), 4.0), ("A", D(2020, 1, 9), 1.0), (None, D(2020, 1, 1), 9.0)], "sku string, demand_date date, qty double")
    got = rows(demand.monthly_series(lines), "sku", "period", "qty")
    assert got == [("A", D(2020, 1, 1), 3.0), ("A", D(2020, 3, 1), 0.0), ("B", D(2020, 1, 1), 0.0), ("B", D(2020, 3, 1), 4.0)]
    assert supply.one_unit([spark.createDataFrame([("A", "KG")], "sku string, uom string"), spark.createDataFrame([("A", "PC"), ("B", "PC")], "sku string, uom string")]).count() == 2


def test_stock_by_status_refuses_what_nobody_declared(spark):
    rows = spark.createDataFrame([("a", " w1", 5.0, 2.0, 50.0), ("a", "Q", 3.0, 1.0, 30.0), ("b", None, 4.0, 0.0, None)], "sku string, location_id string, qty_on_hand double, qty_in_transit double, inventory_value double")
    with pytest.raises(Exception, match="declared status, for example Q"):
        supply.split_by_status(rows, {"W1": "sellable"}).collect()
    found = {(r.sku, r.location_id): r for r in supply.split_by_status(rows, {"w1": "sellable"}, wildcard="blocked").collect()}
    held = found["a", "Q"]
    assert (held.qty_on_hand, held.inventory_value, held.qty_in_transit, held.qty_not_sellable, held.value_not_sellable, held.qty_blocked, held.stock_locations_excluded) == (0, 0, 1, 3, 30, 3, "Q")
    assert (found["a", " w1"].qty_on_hand, found["a", " w1"].qty_blocked, found["b", None].qty_on_hand) == (5, 0, 4)
    # a single code needs no declaration: the snapshot is the position
    assert supply.split_by_status(rows.where("location_id = 'Q'"), {}).first().qty_on_hand == 3


def test_short_series_go_by_their_hints(spark):
    rows = [("mto", [1.0, 0.0, 2.0, 0.0, 3.0]), ("arima", [float(i) for i in range(1, 10)]), ("mean", [3.0, 4.0, 5.0, 6.0, 7.0]), ("none", [0.0] * 6), ("tiny", [1.0, 2.0, 3.0])]
    arrays = spark.createDataFrame(rows, "sku string, q array<double>")
    hints = spark.createDataFrame([("mto", "MTO", "smooth"), ("arima", "MTS", "smooth"), ("mean", "MTS", "variable")], "sku string, stocking_policy string, demand_pattern string")
    scores = forecast.backtest(arrays)
    assert scores.count() == 0
    found = {}
    for r in forecast.forecast(arrays, forecast.choose_model(scores), hints, horizon=2).orderBy("h").collect():
        found.setdefault(r.sku, (r.model, []))[1].append(r.forecast_qty)
    assert found["mean"] == ("moving_average", [6.0, 6.0]) and found["mto"][0] == "tsb"
    assert found["arima"][0] == "arima" and set(found) == {"mto", "arima", "mean"}
    best = []
    for phi in forecast.PHIS:
        for theta in forecast.THETAS:
            e = sse = 0.0
            for _ in range(7):  # all eight differences are 1
                e = 1 - phi - theta * e
                sse += e * e
            best.append((round(sse, 6), phi + theta * e, phi))
    _, step, phi = min(best, key=lambda x: x[0])
    assert found["arima"][1] == pytest.approx([9 + step, 9 + step + phi * step], abs=0.051)


def test_a_quiet_window_goes_to_the_decaying_model(spark):
    quiet = [5.0, 0.0] * 4 + [0.0] * 8
    climbing = [10.0 + 2 * i for i in range(24)]
    arrays = spark.createDataFrame([("quiet", quiet), ("climbing", climbing)], "sku string, q array<double>")
    chosen = {r.sku: r for r in forecast.choose_model(forecast.backtest(arrays)).collect()}
    assert (chosen["quiet"].model, chosen["quiet"].score) == ("tsb", None)
    assert chosen["climbing"].model == "ets_trend" and chosen["climbing"].ratio_to_naive < 0.01
    ahead = [r.forecast_qty for r in forecast.forecast(arrays, forecast.choose_model(forecast.backtest(arrays)), horizon=3).where("sku = 'climbing'").orderBy("h").collect()]
    assert ahead == [58.0, 60.0, 62.0]


def test_a_season_is_fitted_where_it_is_found():
    wave = np.array([[20.0, 5.0, 11.0, 8.0] * 6, [20.0, 5.0, 11.0, 8.0] * 6])
    wave[1] *= 1 + np.arange(24) // 4 / 10
    assert forecast.cycles(wave).tolist() == [4, 4]
    values, rmse = forecast.smoothed(wave[:1], 6, cycle=4)
    assert np.allclose(values, [[20, 5, 11, 8, 20, 5]]) and rmse[0] < 1e-9
    found = forecast.candidates(wave, 3, forecast.density_of(wave))
    assert {"ets_seasonal4", "ets_mul_seasonal4"} <= set(found) and "croston" not in found


def test_target_frontier_orders_by_pain_and_marks_what_suffices(spark):
    items = spark.createDataFrame([("a", 1000.0, 50.0, 500.0, 30.0, 10.0), ("b", 400.0, 20.0, 200.0, 0.0, 10.0), ("c", 50.0, -10.0, -100.0, 60.0, 10.0)], "sku string, actual_value double, gap_qty double, gap_value double, demand_mean double, unit_cost double")
    po = spark.createDataFrame([("a", 80.0), ("c", 9.0)], "sku string, open_qty double")
    levers = spark.createDataFrame([("a", "lt_speed", 70.0, 15.0, 0.0), ("a", "lt_reliability", 90.0, 20.0, 0.0), ("a", "review_weekly", 10.0, -5.0, 7.0), ("a", "service_level_down", 900.0, 9.0, 0.0)], "sku string, lever string, stock_saving double, net_annual double, ordering_cost double")
    goal = spark.createDataFrame([(500.0,)], "target_value double")
    rows = {r.kind: r for r in target.target_frontier(items, po, levers, goal, days_left=60).collect()}
    assert [r.kind for r in sorted((x for x in rows.values() if x.state == "planned"), key=lambda x: x.place)] == ["stop_buying", "push_out_po", "lever:lt_speed", "lever:service_level_down"]
    assert rows["stop_buying"].released == 500 and rows["stop_buying"].theoretical == 700  # b has no demand to draw it down
    assert rows["push_out_po"].released == 500 and rows["push_out_po"].hits_target and rows["push_out_po"].needed and not rows["lever:lt_speed"].needed
    assert (rows["lever:review_weekly"].annual_cost, rows["lever:lt_speed"].annual_cost, rows["stop_buying"].annual_cost) == (7.0, None, 0.0)
    assert not rows["cut_below_policy"].reversible and rows["push_out_po"].reversible
    assert rows["lever:lt_reliability"].state == "too_slow" and rows["lever:review_weekly"].state == rows["cut_below_policy"].state == "excluded"
    assert target.target_frontier(items, po, levers, spark.createDataFrame([(5000.0,)], "target_value double")).count() == 0
