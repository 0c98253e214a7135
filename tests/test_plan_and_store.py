"""The period plan, stock allocation, forecast choice, written batches and joined outputs on small hand-made tables."""

import datetime as dt
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import asof, conform, feedback, forecast, planning, quality, replenish
from shelfspark.sources import files

D = dt.date


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# R-11


def walk(item, need, stock, share):
    left, out = list(stock), []
    for i, n in zip(item, need):
        ok = n > 0 and left[i] >= n * share
        out.append(ok)
        left[i] = max(left[i] - n, 0.0) if ok else left[i]
    return out, left


@pytest.mark.parametrize("seed", range(30))
def test_stock_is_dealt_as_by_a_plain_walk(seed):
    rng = random.Random(seed)
    item = sorted(rng.randrange(1 + seed % 7) for _ in range(300))
    item = np.searchsorted(np.unique(item), item)
    need = np.array([rng.choice([0, 1, 2, 3, 5, 8, 64, 65, 1000]) * rng.choice([1, 1, 7]) for _ in item], float)
    stock = np.array([rng.choice([0, 1, 4, 64, 500, 3000, 10**6]) for _ in range(item.max() + 1)], float)
    want, left = walk(item, need, stock, 0.95)
    have = stock.copy()
    assert replenish.fill_in_order(item, need, have, 0.95).tolist() == want and have.tolist() == left


def test_a_million_lines_of_one_item_take_few_passes():
    n = 10**6
    rng = np.random.default_rng(5)
    for need in (rng.integers(1, 1000, n).astype(float), np.where(np.arange(n) % 2, 1.0, np.arange(n, 0, -1.0)), np.full(n, 2.0)):
        stock = np.array([float(n)])
        want, left = walk(np.zeros(n, int), need, stock, 1.0)
        start = time.process_time()
        got = replenish.fill_in_order(np.zeros(n, int), need, stock, 1.0)
        assert time.process_time() - start < 5
        assert got.tolist() == want and stock.tolist() == left


def test_stock_is_handed_from_batch_to_batch(spark):
    rng = random.Random(3)
    data = [("hot", D(2020, 1, 1) + dt.timedelta(i // 40), i, float(rng.choice([1, 2, 9, 400]))) for i in range(3000)] + [(None, None, 1, 5.0), ("b", None, 7, 3.0), ("none", D(2020, 1, 1), 9, 1.0), ("b", D(2020, 1, 1), 8, None)]
    lines = spark.createDataFrame(data, "sku string, customer_request_date date, line_order int, open_qty double")
    stock = spark.createDataFrame([("hot", 5000.0), ("b", 3.0)], "sku string, qty_on_hand double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = {(r.sku, r.line_order): r.fillable for r in replenish.allocate(lines, stock).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    hot = [x for x in data if x[0] == "hot"]
    want, _ = walk([0] * len(hot), [x[3] for x in hot], [5000.0], 0.95)
    assert [got["hot", x[2]] for x in hot] == want
    assert (got[None, 1], got["b", 7], got["none", 9], got["b", 8]) == (False, True, False, False)


# D-23, D-24, D-25


def test_a_winner_that_the_whole_series_does_not_admit_gives_way_to_the_next(spark):
    score = lambda m, i, rmse, ok: ("a", i, m, rmse, rmse / 10, rmse / 5, False, False, ok)
    data = [score("ets_trend", 1, 1.0, False), score("ets_seasonal4", 3, 2.0, False), score("smoothing", 14, 3.0, True), score("ets", 0, 4.0, True), score("naive", 15, 6.0, True)]
    scores = spark.createDataFrame(data, "sku string, ord int, model string, rmse double, mape double, mase double, has_zero boolean, all_zero boolean, admitted boolean")
    best = forecast.choose_model(scores).first()
    assert (best.model, best.metric, best.rmse, round(best.ratio_to_naive, 3)) == ("smoothing", "mape", 3.0, 0.5)
    assert forecast.choose_model(scores.where("not admitted")).first().model == "ets_trend"


def test_the_whole_series_says_what_is_admitted(spark):
    rng = np.random.default_rng(0)
    found = False
    for seed in range(200):  # a climb that ends: the first origins see a trend, the whole series doesn't
        rng = np.random.default_rng(seed)
        q = np.concatenate([np.linspace(10, 60, 14), rng.normal(30, 14, 6).clip(1)]).round()
        if forecast.trending(q[None, :15])[0] and not forecast.trending(q[None])[0]:
            found = True
            break
    assert found
    scores = forecast.backtest(spark.createDataFrame([("a", q.tolist())], "sku string, q array<double>"))
    by = {r.model: r.admitted for r in scores.collect()}
    assert by["ets_trend"] is False and by["ets"] and by["naive"]
    chosen = forecast.choose_model(scores)
    assert chosen.first().model != "ets_trend"


def test_a_forecast_carries_what_it_rests_on(spark):
    lumpy = [0.0, 0.0, 30.0] * 6
    arrays = spark.createDataFrame([("lumpy", lumpy), ("short", [1.0, 0.0, 2.0, 0.0, 3.0])], "sku string, q array<double>")
    hints = spark.createDataFrame([("short", "MTO", "lumpy")], "sku string, stocking_policy string, demand_pattern string")
    made = {r.sku: r for r in forecast.forecast(arrays, forecast.choose_model(forecast.backtest(arrays)), hints, horizon=2).where("h = 1").collect()}
    r = made["lumpy"]
    assert (r.expected_order_size, r.expected_interval, r.selected_by, r.seasonal_detected) == (30.0, 3.0, "backtest:mase", True)
    assert r.vs_naive is not None and r.backtest_mape is None and r.backtest_rmse is not None
    assert (made["short"].model, made["short"].selected_by, made["short"].vs_naive) == ("tsb", "policy:MTO", None)


def test_summary_of_a_reviewed_forecast_holds_both_values(spark):
    detail = spark.createDataFrame([("a", D(2020, 1, 1), 10.0, "ets", 1.0, True), ("a", D(2020, 2, 1), 20.5, "ets", 1.0, False)], "sku string, period date, forecast_qty double, model string, forecast_rmse double, is_next_period boolean")
    plan = spark.createDataFrame([("a", D(2020, 1, 1), 14.0)], "sku string, period date, reviewed_qty double")
    r = forecast.forecast_summary(forecast.apply_review(detail, plan)).first()
    assert (r.forecast_next_period, r.statistical_next_period, r.forecast_source, r.forecast_total, r.statistical_total, r.forecast_avg_monthly) == (14.0, 10.0, "reviewed", 34.5, 30.5, 17.2)


def test_wide_history_and_forecast_needs_no_pass_for_its_columns(spark):
    series = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 2, 1), 2.0), ("b", D(2020, 2, 1), 3.0)], "sku string, period date, qty double")
    detail = spark.createDataFrame([("a", D(2020, 3, 1), 4.0, True, "ets")], "sku string, period date, forecast_qty double, is_next_period boolean, model string")
    wide = forecast.history_and_forecast(series, detail, forecast.months_of(series, 1), [D(2020, 3, 1), D(2020, 4, 1)])
    assert wide.columns == ["sku", "model", "hist 2020-02", "fcst 2020-03", "fcst 2020-04"]
    assert [tuple(r) for r in wide.collect()] == [("a", "ets", 2.0, 4.0, None)]


# L-03 to L-05


def plan(spark):
    detail = spark.createDataFrame([("a", D(2020, m, 1), q) for m, q in ((1, 60.0), (2, 50.0), (3, 10.0))] + [("b", D(2020, 1, 1), 5.0)], "sku string, period date, forecast_qty double")
    po = spark.createDataFrame(
        [("a", 5.0, D(2019, 12, 3)), ("a", 6.0, None), ("a", 20.0, D(2020, 3, 20)), ("a", 999.0, D(2020, 4, 1)), ("c", 7.0, D(2020, 2, 2)), ("a", 0.0, D(2020, 1, 2))], "sku string, open_qty double, committed_delivery date"
    )
    items = spark.createDataFrame([("a", 100.0, 2.0, 30.0, 40.0), ("b", None, None, None, None), ("d", 9.0, 9.0, 9.0, 9.0)], "sku string, opening_qty double, unit_cost double, safety_stock double, lead_time_days double")
    span = planning.plan_span(detail)
    return planning.period_balance(detail, planning.phase_supply(po, span), items, span), detail, items


def test_the_plan_rolls_each_month_of_the_forecast(spark):
    found, detail, items = plan(spark)
    got = rows(found.where("sku = 'a'"), "period", "demand_qty", "supply_qty", "closing_qty", "gap_qty", "gap_value", "demand_cogs", "supply_value", "closing_value", "within_lead_time")
    assert got == [
        (D(2020, 1, 1), 60.0, 11.0, 51.0, 0.0, 0.0, 120.0, 22.0, 102.0, True),
        (D(2020, 2, 1), 50.0, 0.0, 1.0, 29.0, 58.0, 100.0, 0.0, 2.0, True),
        (D(2020, 3, 1), 10.0, 20.0, 11.0, 19.0, 38.0, 20.0, 40.0, 22.0, False),
    ]
    # supply without a forecast has its months, too; without cost and lead time nothing is worth anything, all is in reach
    assert rows(found.where("sku <> 'a'"), "sku", "closing_qty", "closing_value", "within_lead_time", "lead_time_periods") == [("b", -5.0, 0.0, True, 3)] * 3 + [("c", 0.0, 0.0, True, 3), ("c", 7.0, 0.0, True, 3), ("c", 7.0, 0.0, True, 3)]
    by = rows(planning.balance_by_period(found, detail, items), "period", "opening_value", "closing_value", "gap_skus")
    assert by == [(D(2020, 1, 1), 200.0, 102.0, 1), (D(2020, 2, 1), 102.0, 2.0, 2), (D(2020, 3, 1), 2.0, 22.0, 2)]  # b is short without a floor: it owes 5


def test_the_plan_of_an_item_is_one_row(spark):
    found, _, _ = plan(spark)
    wide = planning.balance_by_item(found, [D(2020, 1, 1), D(2020, 3, 1)])
    r = wide.where("sku = 'a'").first()
    assert (r.first_short_period, r.short_periods, r.gap_qty_peak, r.gap_qty_within_lead_time, r.gap_amt_within_lead_time, r.demand_qty_total) == (D(2020, 2, 1), 2, 29.0, 29.0, 58.0, 120.0)
    assert (r["closing qty 2020-01"], r["gap amt 2020-03"], len([c for c in wide.columns if " 2020-" in c])) == (51.0, 38.0, 16)
    assert tuple(planning.lead_time_exposure(found).first()) == (58.0, 1)


# Written batches


STAMP = {"doc_type": "sales", "valid_time": "2020-01", "transaction_time": "2020-02-01"}


def test_batches_land_once(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = spark.createDataFrame([("A", 1.0), ("B", None)], "sku string, qty double")
    first = asof.append_batch(df, root, **STAMP)
    assert first and asof.append_batch(df.orderBy(F.desc("sku")), root, **STAMP) is None  # the order of rows is nothing new
    other = asof.append_batch(df, root, **{**STAMP, "valid_time": "2020-02"})
    assert other not in (None, first) and asof.append_batch(df, root, settings="fx2", **STAMP) not in (None, first, other)
    assert asof.append_batch(df.where("false"), root, **STAMP) is None
    with pytest.raises(ValueError, match="time"):
        asof.append_batch(df, root, **{**STAMP, "valid_time": ""})
    assert asof.read_batches(spark, root, "sales").groupBy("batch_id").count().count() == 3
    assert asof.read_log(spark, root).where("record = 'add'").count() == 3


def test_two_writers_land_one_batch(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(f"s{i}", float(i)) for i in range(50)], "sku string, qty double").repartition(3)
    ids, errors = [], []
    gate = threading.Barrier(2)

    def write(t):
        gate.wait()
        try:
            ids.append(asof.append_batch(df, root, **{**STAMP, "transaction_time": f"2020-02-0{t}"}))
        except Exception as error:  # a writer that loses the race may fail, but must not leave a second copy
            errors.append(error)

    both = [threading.Thread(target=write, args=(t,)) for t in (1, 2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert len(errors) < 2 and len({i for i in ids if i}) <= 1
    asof.append_batch(df, root, **STAMP)
    assert asof.read_batches(spark, root, "sales").count() == 50
    assert asof.read_log(spark, root).where("record = 'add'").count() == 1


def test_a_read_as_of_opens_only_the_batches_it_needs(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    ids = []
    for i in range(4):
        df = spark.createDataFrame([(f"s{i}", float(i), "x")], f"sku string, qty double, {'note' if i < 2 else 'country'} string")
        ids.append(asof.append_batch(df, root, doc_type="sales", valid_time=f"2020-0{i + 1}", transaction_time=f"2020-0{i + 2}-01", source_name=f"f{i}"))
    asof.amend_batch(spark, root, "sales", ids[0], "void", 1, "2020-09-01")
    asof.amend_batch(spark, root, "sales", ids[3], "restate", 1, "2020-09-01", "2020-01")
    facts = asof.read_batches(spark, root, "sales")
    chosen = asof.select_batches(asof.effective_batches(asof.read_log(spark, root)), as_of="2020-02")
    got = asof.history(facts, chosen)
    assert rows(got, "sku", "batch_source", "batch_valid_time", "note", "country") == [("s1", "f1", "2020-02", "x", None), ("s3", "f3", "2020-01", None, "x")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    with pytest.raises(ValueError, match="voided, or restated"):
        asof.amend_batch(spark, root, "sales", ids[0], "void", 2, "2020-09-01", "2020-01")


def test_a_fingerprint_confuses_nothing(spark):
    make = lambda data, names="a string, b string": asof.fingerprint(spark.createDataFrame(data, names)).first().fingerprint
    seen = [make(x) for x in ([("ab", "c")], [("a", "bc")], [(None, "abc")], [("", "abc")], [("N", "abc")], [("ab", "c"), ("ab", "c")], [("1:a", "")], [])]
    assert len(set(seen)) == len(seen)
    assert make([("ab", "c")], "a string, c string") != seen[0]
    assert make([("x", "y"), ("u", None)]) == make([("u", None), ("x", "y")])


# Outputs


def test_joined_outputs_keep_one_value_of_a_column_and_one_row_of_an_item(spark):
    first = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sku string, unit_cost double")
    other = spark.createDataFrame([("a", 9.0, 5), ("a", 8.0, 4), ("c", 7.0, 3)], "sku string, unit_cost double, days int")
    out = files.joined_output(first, [("_x", other), ("_y", first)])
    assert out.columns == ["sku", "unit_cost", "days_x"]
    assert rows(out, "sku", "unit_cost", "days_x") == [("a", 1.0, 4), ("b", 2.0, None)]


def test_profiles_list_the_values_of_narrow_columns(spark):
    data = [(f"c{i % 25}", f"d{i % 26}", "y" if i % 2 else "no", str(i % 3), None) for i in range(200)]
    found = {r.column_name: r for r in quality.profile(spark.createDataFrame(data, "narrow string, wide string, flag string, number string, empty string")).collect()}
    assert found["narrow"].categories == sorted(f"c{i}" for i in range(25)) and found["wide"].categories is None
    assert (found["flag"].inferred_type, found["flag"].categories) == ("boolean", ["no", "y"])
    assert (found["number"].inferred_type, found["number"].categories, found["number"].distinct_values) == ("number", None, 3)
    assert (found["empty"].non_null, found["empty"].rows, found["empty"].distinct_values) == (0, 200, 0)


def test_a_plan_that_is_published_again_is_read_once(spark, tmp_path):
    detail = spark.createDataFrame([("a", D(2020, 1, 1), 10.0), ("a", D(2020, 2, 1), 12.0)], "sku string, period date, forecast_qty double")
    root = f"file://{tmp_path}/plans"
    for run, scale, reviewed in (("r1", 1, False), ("r2", 1, False), ("r2", 2, True)):
        made = feedback.published_plan(detail.withColumn("forecast_qty", F.col("forecast_qty") * scale), run, "2020-01", "2020-01-01", reviewed)
        feedback.save_snapshot(made, root)
    got = rows(feedback.read_snapshots(made, root), "run_at", "period", "forecast_qty", "reviewed")
    assert got == [("r1", D(2020, 1, 1), 10.0, False), ("r1", D(2020, 2, 1), 12.0, False), ("r2", D(2020, 1, 1), 20.0, True), ("r2", D(2020, 2, 1), 24.0, True)]


def test_parameters_stand_beside_the_suggested_ones(spark):
    df = spark.createDataFrame([("a", 0.9, 0.95, "x")], "sku string, level double, suggested_level double, suggested_method string")
    assert rows(feedback.parameter_pairs(df), "parameter", "in_force", "suggested", "agrees") == [("level", "0.9", "0.95", False), ("method", None, "x", False)]
    assert feedback.parameter_pairs(df, "b").count() == 0


def test_a_matrix_has_a_row_for_each_item(spark):
    series = spark.createDataFrame([("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 1), 2.0), ("b", D(2020, 2, 1), 3.0)], "sku string, period date, qty double")
    out = conform.period_matrix(series, forecast.months_of(series))
    assert rows(out, "sku", "2020-01", "2020-02") == [("a", 3.0, None), ("b", None, 3.0)]


def test_fits_read_off_one_pass_are_the_fits_of_each_prefix():
    rng = np.random.default_rng(2)
    q = rng.integers(0, 40, (40, 20)).astype(float)
    q[:10] = np.linspace(5, 60, 20) + rng.integers(0, 4, (10, 20))
    q[10:20] = np.tile([30.0, 5.0, 12.0, 8.0], 5) + rng.integers(0, 3, (10, 20))
    density = forecast.density_of(q)
    ends = [9, 15, 16, 17]
    shared = forecast.candidates_at(q, ends, 3, density)
    for end in ends:
        alone = forecast.candidates(q[:, :end], 3, density)
        assert set(alone) == set(shared[end])
        for m, (at, values) in alone.items():
            assert shared[end][m][0].tolist() == at.tolist() and np.allclose(shared[end][m][1], values)
    assert {"ets_trend", "ets_seasonal4", "ets_mul_seasonal4"} <= set(shared[17])
