"""Replenishment: lot sizes, safety stock, projection, requirement, order quantity and action."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.rounding import half_even


def economic_order_quantity(annual: Column, unit_cost: Column, order_cost: float, holding_rate: float) -> Column:
    """Square root of 2 D S / (c h); null unless demand and cost are positive. (R-01)"""
    ok = (annual > 0) & (unit_cost > 0)
    return F.when(ok, F.sqrt(2 * annual * order_cost / (unit_cost * holding_rate)))


def round_to_lot(qty: Column, moq: Column, multiple: Column) -> Column:
    """Up to the minimum and then to the multiple; nothing stays nothing. (R-02)"""
    m = F.when(multiple > 0, multiple).otherwise(F.lit(1.0))
    least = F.greatest(qty, F.coalesce(moq, F.lit(0.0)))
    return F.when(qty > 0, F.ceil(least / m) * m).when(qty.isNotNull(), F.lit(0.0)).cast("double")


def safety_stock(classified: DataFrame, lead_time: DataFrame, rmse: DataFrame | None = None, review_days: float | None = 30.0) -> DataFrame:
    """Safety stock, demand over lead time and exposure, reorder point and cover. (R-03)

    k * sqrt(exposure * sigma^2 + mean^2 * lead time deviation^2) in months of 30 days; sigma is the forecast's error
    where it is positive, else the demand's deviation. Items without a lead time have none; non-stocking items get 0.
    """
    rows = classified.join(lead_time.select("sku", "wma_lead_time_days", "lt_std_days"), "sku", "left")
    rows = rows.fillna(0.0, ["wma_lead_time_days", "lt_std_days"])
    rows = rows.join(rmse.select("sku", "forecast_rmse"), "sku", "left") if rmse is not None else rows.withColumn("forecast_rmse", F.lit(None).cast("double"))
    measured = F.coalesce(F.col("forecast_rmse") > 0, F.lit(False))
    exposure = F.col("wma_lead_time_days") + (F.lit(review_days) if review_days is not None else F.lit(0.0))
    rows = rows.withColumn("ss_exposure_days", exposure.cast("double"))
    rows = rows.withColumn("ss_exposure_basis", F.lit("lt_only" if review_days is None else "review_plus_lt"))
    rows = rows.withColumn("sigma_source", F.when(measured, "forecast_rmse").otherwise("demand_std"))
    sigma = F.when(measured, F.col("forecast_rmse")).otherwise(F.coalesce("demand_std_rolling", F.lit(0.0)))
    months, lt_std, mean = F.col("ss_exposure_days") / 30.0, F.col("lt_std_days") / 30.0, F.col("demand_mean_rolling")
    variance = F.greatest(months * sigma * sigma + mean * mean * lt_std * lt_std, F.lit(0.0))
    stocked = (F.col("stocking_class") != "non-stocking") & F.col("z_score").isNotNull()
    rows = rows.withColumn("safety_stock", F.when(stocked, half_even(F.col("z_score") * F.sqrt(variance), 1)).otherwise(0.0))
    rows = rows.withColumn("demand_during_lt", half_even(mean * F.col("wma_lead_time_days") / 30.0, 1))
    rows = rows.withColumn("demand_during_exposure", half_even(mean * months, 1))
    rows = rows.withColumn("reorder_point", half_even(F.col("demand_during_exposure") + F.col("safety_stock"), 1))
    return rows.withColumn("ss_coverage_days", half_even(F.try_divide("safety_stock", mean / 30.0), 0))


def require_unique(rows: DataFrame, key: str = "sku") -> DataFrame:
    """The rows; the job fails where a key repeats, as quantities joined on it would count twice. No job runs before."""
    said = F.raise_error(F.concat(F.lit(f"rows repeat a {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("; consolidate first"))).cast("boolean")
    counted = rows.withColumn("_times", F.count("*").over(W.partitionBy(key)))
    return counted.where(F.when(F.col("_times") > 1, said).otherwise(True)).drop("_times")


def project(stock: DataFrame, position: DataFrame, inbound: DataFrame, *, excess_days: float = 90, horizon_days: float = 30) -> DataFrame:
    """Position against reorder point, days of supply, status, supply gap and what can be pushed out. (R-09, R-10)"""
    rows = stock.join(require_unique(position), "sku", "left")
    rows = rows.join(inbound.select("sku", "inbound_past_due_qty", "inbound_due_qty", "days_to_next_arrival"), "sku", "left")
    rows = rows.fillna(0.0, ["inbound_past_due_qty", "inbound_due_qty"])
    daily = F.when(F.col("demand_mean_rolling") != 0, F.col("demand_mean_rolling") / 30.0)
    rows = rows.withColumn("should_be_inventory", F.col("demand_during_exposure") + F.col("safety_stock"))
    rows = rows.withColumn("surplus_deficit", F.col("effective_position") - F.col("should_be_inventory"))
    rows = rows.withColumn("days_of_supply", half_even(F.col("effective_position") / daily, 0))
    over = F.col("surplus_deficit") > 0
    status = (
        F.when(F.col("stocking_class") == "non-stocking", "non-stocking")
        .when(F.col("effective_position").isNull(), "no-data")
        .when(F.col("surplus_deficit") < -0.5 * F.col("safety_stock"), "SHORTAGE-RISK")
        .when(over & (F.col("days_of_supply") > excess_days), "EXCESS")
        .when(over, "slightly-over")
        .otherwise("OK")
    )
    rows = rows.withColumn("inventory_status", status)
    shelf = F.coalesce("qty_on_hand", F.lit(0.0)) + F.coalesce("qty_in_transit_adj", F.lit(0.0))
    rows = rows.withColumn("on_hand_cover_days", half_even(shelf / daily, 1))
    cover = F.col("on_hand_cover_days")
    runs_out = F.coalesce(cover < F.col("days_to_next_arrival"), F.lit(False))
    late = F.coalesce((F.col("inbound_past_due_qty") > 0) & (cover < horizon_days), F.lit(False))
    gap = (runs_out | late) & (F.col("stocking_class") != "non-stocking") & F.col("effective_position").isNotNull()
    rows = rows.withColumn("supply_gap", gap)
    wait = F.coalesce("days_to_next_arrival", F.lit(float(horizon_days)))
    rows = rows.withColumn("supply_gap_days", F.when(F.col("supply_gap"), half_even(F.greatest(wait - cover, F.lit(0.0)), 1)).otherwise(0.0))
    push = (F.col("inventory_status") == "EXCESS") & (F.coalesce("total_open_po_qty", F.lit(0.0)) > 0) & ~F.col("supply_gap")
    rows = rows.withColumn("pushout_candidate", push)
    most = half_even(F.greatest(F.least("surplus_deficit", "total_open_po_qty"), F.lit(0.0)), 1)
    return rows.withColumn("pushout_open_po_qty", F.when(F.col("pushout_candidate"), most).otherwise(0.0))


def attach_policy(projection: DataFrame, parameters: DataFrame | None, horizon_days: float = 30) -> DataFrame:
    """Review period, method, lot limits and cost from resolved parameters, and the days an order must cover. (R-13)"""
    defaults = {"replenishment_method": ("string", "periodic"), "min_order_qty": ("double", 0.0), "order_multiple": ("double", 1.0), "unit_cost": ("double", None)}
    rows = projection
    names = ["review_period_days", *defaults]
    if parameters is not None:
        rows = rows.drop(*names).join(parameters.select("sku", *[c for c in names if c in parameters.columns]), "sku", "left")
    for c, (kind, value) in defaults.items():
        have = F.col(c) if c in rows.columns else F.lit(None)
        rows = rows.withColumn(c, F.coalesce(have.cast(kind), F.lit(value).cast(kind)))
    review = F.col("review_period_days").cast("double") if "review_period_days" in rows.columns else F.lit(None).cast("double")
    rows = rows.withColumn("policy_source", F.when(review.isNotNull(), "rules").otherwise("default"))
    rows = rows.withColumn("review_period_days", F.coalesce(review, F.lit(float(horizon_days))))
    exposed = F.coalesce(F.col("ss_exposure_days") > 0, F.lit(False))
    derived = F.col("review_period_days") + F.coalesce("wma_lead_time_days", F.lit(0.0))
    rows = rows.withColumn("coverage_days", F.when(exposed, F.col("ss_exposure_days")).otherwise(derived))
    return rows.withColumn("coverage_basis", F.when(exposed, "safety_stock_exposure").otherwise("review_plus_lt"))


def period_demand(rows: DataFrame, forecast: DataFrame | None, backlog: DataFrame, realization: DataFrame | None = None, basis: str = "forecast_consumption") -> DataFrame:
    """Demand that an order must survive: the forecast over the covered days or the firm backlog, whichever is more. (R-15)"""
    if forecast is not None:
        rows = rows.join(forecast.select("sku", "forecast_next_period", "forecast_avg_monthly"), "sku", "left")
    else:
        rows = rows.withColumn("forecast_next_period", F.col("demand_mean_rolling")).withColumn("forecast_avg_monthly", F.col("demand_mean_rolling"))
    rows = rows.withColumn("next_period_demand", F.coalesce("forecast_next_period", "forecast_avg_monthly", "demand_mean_rolling"))
    rows = rows.withColumn("forecast_horizon_qty", half_even(F.col("next_period_demand") * F.col("coverage_days") / 30.0, 1))
    rows = rows.join(backlog.select("sku", "backlog_qty", "backlog_due_qty", "backlog_past_due_qty"), "sku", "left")
    rows = rows.fillna(0.0, ["backlog_qty", "backlog_due_qty", "backlog_past_due_qty"])
    if realization is not None:
        rows = rows.join(realization.select("sku", "realization_rate"), "sku", "left").withColumnRenamed("realization_rate", "backlog_realization_rate")
        rows = rows.fillna(1.0, ["backlog_realization_rate"])
    else:
        rows = rows.withColumn("backlog_realization_rate", F.lit(1.0))
    rows = rows.withColumn("firm_demand_qty", half_even(F.col("backlog_due_qty") * F.col("backlog_realization_rate"), 1))
    if basis == "forecast_plus_backlog":
        wanted, driver = F.col("forecast_horizon_qty") + F.col("backlog_qty"), F.lit("forecast+backlog")
    else:
        firm = F.col("backlog_due_qty" if basis == "max_forecast_backlog" else "firm_demand_qty")
        wanted = F.greatest("forecast_horizon_qty", firm)
        driver = F.when(firm > F.col("forecast_horizon_qty"), "backlog").otherwise("forecast")
    return rows.withColumn("period_demand", half_even(wanted, 1)).withColumn("demand_driver", driver).withColumn("demand_basis", F.lit(basis))


def requirement(rows: DataFrame, order_cost: float = 350.0, holding_rate: float = 0.22) -> DataFrame:
    """Reorder point, lot, order-up-to level and net requirement. (R-16)"""
    rows = rows.withColumn("gross_requirement", half_even(F.col("period_demand") + F.col("safety_stock"), 1))
    rows = rows.withColumn("reorder_point", F.col("gross_requirement")).withColumn("available_supply", F.col("effective_position"))
    rows = rows.withColumn("net_requirement", F.when(F.col("available_supply").isNotNull(), half_even(F.greatest(F.col("gross_requirement") - F.col("available_supply"), F.lit(0.0)), 1)))
    eoq = economic_order_quantity(F.coalesce("next_period_demand", F.lit(0.0)) * 12, F.col("unit_cost"), order_cost, holding_rate)
    rows = rows.withColumn("eoq_qty", half_even(eoq, 0))
    lot = round_to_lot(F.coalesce("eoq_qty", "min_order_qty"), F.col("min_order_qty"), F.col("order_multiple"))
    rows = rows.withColumn("order_lot", half_even(lot, 1))
    return rows.withColumn("order_up_to", half_even(F.col("reorder_point") + F.col("order_lot"), 1))


def order_quantity(rows: DataFrame) -> DataFrame:
    """How much to buy below the reorder point: gap and lot, whole lots, or nothing to order. (R-17)"""
    gap, lot = F.greatest("net_requirement", F.lit(0.0)), F.coalesce("order_lot", F.lit(0.0))
    lots = half_even(F.ceil(F.try_divide(gap, lot)) * lot, 1)
    method = F.col("replenishment_method")
    quantity = F.when(method == "make_to_order", 0.0).when((method == "reorder_point") & (lot > 0), lots).otherwise(half_even(gap + lot, 1))
    return rows.withColumn("order_quantity", half_even(F.when(F.col("net_requirement") > 0, quantity).otherwise(0.0), 1))


def order_status(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    """What the order-by dates say: order-past-due, order-now, scheduled, none, or unscoped without a schedule. (R-14)"""
    rows = rows.join(schedule, "sku", "left")
    status = (
        F.when(F.col("mto_actionable_qty").isNull(), "unscoped")
        .when(F.col("mto_order_past_due_qty") > 0, "order-past-due")
        .when(F.col("mto_actionable_qty") > 0, "order-now")
        .when(F.col("backlog_qty") > 0, "scheduled")
        .otherwise("none")
    )
    rows = rows.withColumn("mto_order_status", status)
    wanted = F.coalesce("mto_actionable_qty", "backlog_due_qty") * F.col("backlog_realization_rate")
    rows = rows.withColumn("mto_demand_qty", half_even(wanted, 1))
    short = F.greatest(F.col("mto_demand_qty") - F.coalesce("available_supply", F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("backlog_shortfall", half_even(short, 1))


def recommend(rows: DataFrame) -> DataFrame:
    """One action for each item, first match wins, and the quantity to order. (R-18)"""
    short = F.coalesce(F.col("backlog_shortfall") > 0, F.lit(False))
    action = (
        F.when(F.col("stocking_class") == "non-stocking", F.when(short, "ORDER-FOR-BACKLOG").otherwise("NO-ACTION"))
        .when(F.col("supply_gap"), F.when(F.col("total_open_po_qty") > 0, "EXPEDITE-INBOUND").otherwise("PURCHASE-REQUEST"))
        .when(F.col("pushout_candidate"), "PUSH-OUT-OPEN-PO")
        .when(F.col("net_requirement") > 0, "PURCHASE-REQUEST")
        .when(F.col("inventory_status") == "EXCESS", "HOLD-EXCESS")
        .otherwise("HOLD-OK")
    )
    rows = rows.withColumn("recommended_action", action)
    quantity = F.when(F.col("recommended_action") == "PURCHASE-REQUEST", F.col("order_quantity")).when(F.col("recommended_action") == "ORDER-FOR-BACKLOG", F.col("backlog_shortfall"))
    return rows.withColumn("suggested_po_qty", F.coalesce(quantity, F.lit(0.0)))


def fill_in_order(item: np.ndarray, need: np.ndarray, left: np.ndarray, share: float) -> np.ndarray:
    """Marks the lines that stock can fill, item by item in order of rows, and lowers `left`, the items' stock, by them.

    item: rising item numbers from 0; a line is filled when at least `share` of its need is left, and takes all of it.
    All items advance together. While an item's stock stays above a power of two, all lines that need no more than that
    are filled: a prefix sum says how far. A phase ends with the line that takes the stock below the power, or with the
    first larger line that still fits; either halves the stock, so there are few phases, however many lines.
    """
    filled = np.zeros(len(need), bool)
    rows = np.flatnonzero(need > 0)
    while len(rows):
        own, want = item[rows], need[rows]
        have = left[own]
        floor = np.ldexp(1.0, np.frexp(have)[1] - 1)
        light = (have > 0) & (want * share <= floor)
        taken = np.cumsum(np.where(light, want, 0.0))
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.append(first, len(rows)))
        before = taken - np.where(light, want, 0.0)
        rest = have - (before - np.repeat(before[first], size))
        ends = (have > 0) & np.where(light, rest - want < floor, want * share <= rest)
        at = np.arange(len(rows))
        end = np.minimum.reduceat(np.where(ends, at, len(rows)), first)
        upto = np.repeat(end, size)
        filled[rows[(light & (at < upto)) | (ends & (at == upto))]] = True
        over = end == len(rows)
        last = first + size - 1
        stop = np.where(over, last, np.minimum(end, len(rows) - 1))
        took = np.where(over & ~light[stop], 0.0, want[stop])
        left[own[first]] = np.maximum(rest[stop] - took, 0.0)
        rows = rows[(at > upto) & (left[own] > 0)]
    return filled


def allocate(lines: DataFrame, on_hand: DataFrame, share: float = 0.95) -> DataFrame:
    """Which open lines stock can fill, by request date; lines that don't fit are skipped, and later ones may. (R-11)

    Lines are dealt by sku and sorted; a task passes over them batch by batch and hands the stock that is left from one to
    the next, so a sku's lines are never held together. Items without stock need none: their lines are short. Every line
    keeps its row; `line_order` settles ties of dates (undated lines come last).
    """
    rows = lines.join(on_hand.where("qty_on_hand > 0").select("sku", F.col("qty_on_hand").alias("_stock")), "sku", "left")
    columns = lines.columns
    # dealt by a hash: dealt by the sku itself, the shuffle is dropped where the join's serves, which adaptive execution may then read by halves
    dealt = rows.repartition(F.xxhash64("sku")).sortWithinPartitions("sku", F.col("customer_request_date").isNull(), "customer_request_date", "line_order")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rest = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            sku = batch.column("sku")
            number = lambda c: pc.fill_null(pc.cast(batch.column(c), pa.float64()), 0.0).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            new = pc.fill_null(pc.not_equal(sku.slice(1), sku.slice(0, len(sku) - 1)), True).to_numpy(zero_copy_only=False)
            item = np.concatenate(([0], np.cumsum(new)))
            left = number("_stock")[np.concatenate(([True], new))]
            if last is not None and last == sku[0].as_py():
                left[0] = rest
            filled = fill_in_order(item, np.where(sku.is_valid().to_numpy(zero_copy_only=False), number("open_qty"), 0.0), left, share)
            last, rest = sku[-1].as_py(), left[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(filled)], [*columns, "fillable"])

    schema = T.StructType([*lines.schema, T.StructField("fillable", T.BooleanType())])
    return dealt.select(*columns, "_stock").mapInArrow(take, schema)


def realization(lines: DataFrame, as_of: Column, floor: float = 0.25, weight: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Share of the backlog that will be collected: past-due lines that stock could fill were not. (R-12)

    lines come from `allocate`. Returns a row per sku, shrunk to the portfolio's rate by n / (n + weight), and the
    portfolio's row.
    """
    due = F.col("customer_request_date") < as_of
    judged = lines.where(due)
    idle = F.when(F.col("fillable"), F.col("open_qty")).otherwise(0.0)
    whole = judged.agg((1 - F.try_divide(F.sum(idle), F.sum("open_qty"))).alias("rate"), F.count("*").alias("lines"))
    whole = whole.select(F.greatest(F.least(F.coalesce("rate", F.lit(1.0)), F.lit(1.0)), F.lit(floor)).alias("portfolio_rate"), F.col("lines").alias("judged_lines"))
    by_sku = judged.groupBy("sku").agg((1 - F.try_divide(F.sum(idle), F.sum("open_qty"))).alias("own"), F.count("*").alias("n"))
    rows = by_sku.crossJoin(F.broadcast(whole))  # one row
    mixed = (F.col("n") * F.coalesce("own", "portfolio_rate") + weight * F.col("portfolio_rate")) / (F.col("n") + weight)
    rate = half_even(F.greatest(F.least(mixed, F.lit(1.0)), F.lit(floor)), 3)
    return rows.select("sku", F.col("n").alias("lines"), rate.alias("realization_rate")), whole
