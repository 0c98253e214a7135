"""Service: delivery states and rates, ordering cadence, forward risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.shares import running_share

#: The six states of a line.
STATES = (
    ("on_time", "shipped by the requested date"),
    ("shipped_late", "shipped after the requested date"),
    ("not_yet_due", "open, requested later"),
    ("past_due_available", "open and past due, stock could fill it"),
    ("past_due_short", "open and past due, stock is short"),
    ("unjudgeable", "no requested date"),
)


def shipped_lines(sales: DataFrame) -> DataFrame:
    """State, days late and value of shipped lines. (V-01)"""
    late = F.datediff("ship_date", "customer_request_date")
    state = F.when(late.isNull(), "unjudgeable").when(late <= 0, "on_time").otherwise("shipped_late")
    value = F.col("amount") if "unit_price" not in sales.columns else F.coalesce("amount", F.col("unit_price") * F.col("qty"))
    return sales.select("sku", "customer", "order_date", "customer_request_date", "qty", value.alias("value"), state.alias("state"), F.when(late.isNotNull(), F.greatest(late, F.lit(0))).alias("days_late"))


def open_lines(allocated: DataFrame, as_of: Column) -> DataFrame:
    """State of open lines whose `fillable` flag is known. (V-02)"""
    due = F.col("customer_request_date")
    state = F.when(due.isNull(), "unjudgeable").when(due >= as_of, "not_yet_due").when(F.col("fillable"), "past_due_available").otherwise("past_due_short")
    late = F.greatest(F.datediff(as_of, due), F.lit(0))
    return allocated.select("sku", "customer", "order_date", "customer_request_date", F.col("open_qty").alias("qty"), F.col("open_amount").alias("value"), state.alias("state"), late.alias("days_late"))


def _n(*states: str) -> Column:
    return F.count_if(F.col("state").isin(*states))


def _v(*states: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("state").isin(*states), F.col("value"))), F.lit(0.0))


def service_rates(lines: DataFrame) -> DataFrame:
    """On-time rates: of shipped lines, with uncollected and short lines in the denominator, on clean dates, by value. (V-03)"""
    clean = F.col("customer_request_date") > F.col("order_date")
    shipped, failed = ("on_time", "shipped_late"), ("past_due_available", "past_due_short")
    return lines.agg(
        F.try_divide(_n("on_time"), _n(*shipped, "past_due_short")).alias("line_rate"),
        F.try_divide(_n("on_time"), _n(*shipped, *failed)).alias("harsh_rate"),
        F.try_divide(F.count_if(clean & (F.col("state") == "on_time")), F.count_if(clean & F.col("state").isin(*shipped, "past_due_short"))).alias("clean_rate"),
        F.try_divide(_v("on_time"), _v(*shipped, "past_due_short")).alias("value_rate"),
        _n(*failed).alias("past_due_lines"),
        _v(*failed).alias("past_due_value"),
    )


def state_counts(lines: DataFrame) -> DataFrame:
    """Lines of each of the six states, with share and label. (V-04)"""
    spark = lines.sparkSession
    names = spark.createDataFrame(STATES, "state string, label string")
    counted = lines.groupBy("state").agg(F.count("*").alias("lines"))
    rows = F.broadcast(names).join(counted, "state", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return rows.withColumn("share", F.try_divide(F.col("lines"), F.sum("lines").over(W.partitionBy())))


def request_date_quality(lines: DataFrame, trust: float = 0.7) -> DataFrame:
    """Request dates that are missing, equal to the order date or before it; whether the rest is enough. (V-05)"""
    r, o = F.col("customer_request_date"), F.col("order_date")
    out = lines.agg(F.count("*").alias("lines"), F.count_if(r.isNull()).alias("missing"), F.count_if(r == o).alias("same_as_order"), F.count_if(r < o).alias("before_order"), F.count_if(r > o).alias("clean"))
    out = out.withColumn("clean_rate", F.try_divide("clean", "lines"))
    return out.withColumn("trusted", F.coalesce(F.col("clean_rate") >= trust, F.lit(False)))


def monthly_on_time(lines: DataFrame, as_of: Column, thin: int = 5) -> DataFrame:
    """On-time rate by request month, over every month between the first and the last. (V-06)"""
    judged = lines.where("state <> 'unjudgeable' and state <> 'not_yet_due'").withColumn("month", F.trunc("customer_request_date", "MM"))
    counted = judged.groupBy("month").agg(F.count("*").alias("lines"), _n("on_time").alias("on_time"))
    ends = counted.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    rows = spine.join(counted, "month", "left").fillna(0, ["lines", "on_time"])
    return rows.select(
        "month", "lines", "on_time", F.try_divide("on_time", "lines").alias("rate"), (F.col("lines") < thin).alias("thin"), (F.last_day("month") >= as_of).alias("partial")
    )


def failures_by(lines: DataFrame, key: str) -> DataFrame:
    """Late and short lines by item or customer, with delay, rate and cumulative share of value, worst first. (V-07)"""
    bad = F.col("state").isin("shipped_late", "past_due_short")
    out = lines.where("state not in ('unjudgeable', 'not_yet_due')").groupBy(key).agg(
        F.count_if(bad).alias("failures"),
        F.count("*").alias("judged"),
        F.coalesce(F.sum(F.when(bad, F.col("value"))), F.lit(0.0)).alias("value"),
        F.avg(F.when(bad, F.col("days_late"))).alias("avg_days_late"),
        F.max(F.when(bad, F.col("days_late"))).alias("max_days_late"),
    )
    out = out.where("failures > 0").withColumn("rate", F.col("failures") / F.col("judged"))
    return running_share(out, "value", key, "cumulative_share", "_total").drop("_total")


def uncollected(lines: DataFrame) -> DataFrame:
    """Past-due lines that stock could fill, by item. (V-08)"""
    return lines.where("state = 'past_due_available'").groupBy("sku").agg(
        F.count("*").alias("lines"), F.sum("qty").alias("qty"), F.sum("value").alias("value"), F.max("days_late").alias("oldest_days")
    )


def measured_window(lines: DataFrame) -> DataFrame:
    """First and last request month of settled lines. (V-09)"""
    month = F.trunc("customer_request_date", "MM")
    return lines.where("state in ('on_time', 'shipped_late', 'past_due_short')").agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))


def cadence_matrix(po: DataFrame, sales: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """Ordered and sold quantity of each item bought and sold in the window, by month, and the running balance. (V-10)"""
    last = F.trunc(as_of, "MM")
    first = F.add_months(last, 1 - months)

    def monthly(rows: DataFrame, date: str, qty: str, name: str) -> DataFrame:
        rows = rows.withColumn("month", F.trunc(date, "MM")).where(F.col("month").between(first, last) & F.col("sku").isNotNull())
        return rows.groupBy("sku", "month").agg(F.sum(qty).alias(name))

    bought, sold = monthly(po, "po_date", "po_qty", "po_qty"), monthly(sales, "demand_date", "qty", "demand_qty")
    skus = bought.select("sku").distinct().join(sold.select("sku").distinct(), "sku")
    spine = skus.withColumn("month", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    rows = spine.join(bought, ["sku", "month"], "left").join(sold, ["sku", "month"], "left").fillna(0.0, ["po_qty", "demand_qty"])
    running = W.partitionBy("sku").orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("balance", F.sum(F.col("po_qty") - F.col("demand_qty")).over(running))


def cadence_metrics(matrix: DataFrame, orders: DataFrame, tolerance_months: float = 0.5) -> DataFrame:
    """Totals, closing balance, months and longest runs outside the tolerance, extremes. orders: (sku, order_count). (V-11)"""
    whole = W.partitionBy("sku")
    rows = matrix.join(orders, "sku", "left").fillna(0, ["order_count"])
    mean = F.avg("demand_qty").over(whole)
    lot = F.coalesce(F.try_divide(F.sum("po_qty").over(whole), F.col("order_count")), F.lit(0.0))
    rows = rows.withColumn("tol", F.greatest(mean * tolerance_months, lot))
    side = F.when(F.col("balance") < -F.col("tol"), -1).when(F.col("balance") > F.col("tol"), 1).otherwise(0)
    rows = rows.withColumn("side", side).withColumn("i", F.row_number().over(whole.orderBy("month")))
    # months of one side in a row share the difference of the two row numbers
    rows = rows.withColumn("island", F.col("i") - F.row_number().over(W.partitionBy("sku", "side").orderBy("month")))
    rows = rows.withColumn("run", F.count("*").over(W.partitionBy("sku", "side", "island")))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("side") == s, F.col("run"))), F.lit(0))
    out = rows.groupBy("sku").agg(
        F.count("*").alias("months"),
        F.sum("po_qty").alias("po_qty"),
        F.sum("demand_qty").alias("demand_qty"),
        F.max("order_count").alias("order_count"),
        F.count_if(F.col("po_qty") > 0).alias("order_months"),
        F.max_by("balance", "month").alias("closing_balance"),
        F.count_if(F.col("side") == -1).alias("deficit_months"),
        F.count_if(F.col("side") == 1).alias("surplus_months"),
        longest(-1).alias("longest_deficit_run"),
        longest(1).alias("longest_surplus_run"),
        F.greatest(-F.min("balance"), F.lit(0.0)).alias("max_deficit"),
        F.greatest(F.max("balance"), F.lit(0.0)).alias("max_surplus"),
        F.max("tol").alias("tolerance_qty"),
    )
    return out.withColumn("imbalance_pct", F.when(F.col("demand_qty") > 0, F.col("closing_balance") / F.col("demand_qty")))


def order_counts(po: DataFrame, as_of: Column, months: int = 12) -> DataFrame:
    """Distinct orders of each item in the window."""
    last = F.trunc(as_of, "MM")
    rows = po.where(F.trunc("po_date", "MM").between(F.add_months(last, 1 - months), last))
    return rows.groupBy("sku").agg(F.count_distinct("po_number").alias("order_count"))


def cadence_verdict(metrics: DataFrame, attrs: DataFrame, *, review_days: float = 30.0, order_cost: float = 350.0, min_orders: int = 2, critical: tuple[str, ...] = ("A",)) -> DataFrame:
    """One verdict an item, most expensive failure first, and the money behind it. attrs: sku, unit_cost, abc_class. (V-12)

    Orders beyond the cadence cost nothing where the item's class is critical: such items earn their frequency.
    """
    rows = metrics.join(attrs.select("sku", "unit_cost", "abc_class"), "sku", "left").where(F.col("order_count") >= min_orders)
    expected = F.greatest(F.bround(F.col("months") / (F.lit(review_days) / 30.44)), F.lit(1.0))
    rows = rows.withColumn("expected_orders", expected).withColumn("orders_vs_expected", F.col("order_count") / F.col("expected_orders"))
    down, up, close, tol = (F.col(c) for c in ("longest_deficit_run", "longest_surplus_run", "closing_balance", "tolerance_qty"))
    short = (down >= 2) | (F.col("deficit_months") >= F.col("months") / 3)
    over = (up >= 3) | ((F.coalesce("imbalance_pct", F.lit(0.0)) > 0.25) & (close > tol))
    even = (F.abs(close) <= tol) & (F.col("deficit_months") == 0)
    verdict = (
        F.when((down >= 2) & (up >= 2), "oscillating")
        .when(short & (close < -tol) & (F.col("orders_vs_expected") < 1 / 1.25), "under_ordered")
        .when(short, "chasing")
        .when(over, "losing_control")
        .when(even & (F.col("orders_vs_expected") > 1.5), "unearned_frequency")
        .otherwise("controlled")
    )
    cost = F.coalesce("unit_cost", F.lit(0.0))
    rows = rows.withColumn("verdict", verdict)
    rows = rows.withColumn("excess_value", F.bround(F.col("max_surplus") * cost, 2)).withColumn("shortfall_value", F.bround(F.col("max_deficit") * cost, 2))
    rows = rows.withColumn("frequency_earned", F.coalesce(F.col("abc_class").isin(*critical), F.lit(False)))
    beyond = F.bround(F.greatest(F.col("order_count") - F.col("expected_orders"), F.lit(0.0)) * order_cost, 2)
    rows = rows.withColumn("avoidable_order_cost", F.when(F.col("frequency_earned"), 0.0).otherwise(beyond))
    return rows.withColumn("exposure_value", F.bround(F.col("excess_value") + F.col("shortfall_value") + F.col("avoidable_order_cost"), 2))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Items and exposure of each verdict, and the share of items under control. (V-13)"""
    out = verdicts.groupBy("verdict").agg(F.count("*").alias("items"), F.sum("exposure_value").alias("exposure_value"))
    return out.withColumn("share", F.col("items") / F.sum("items").over(W.partitionBy()))


def over_ordering(po: DataFrame, demand: DataFrame, as_of: Column) -> DataFrame:
    """Purchases of twelve months that cover more than a year of demand. demand: sku, daily_demand, unit_cost. (V-14)"""
    bought = po.where(F.col("po_date") > F.add_months(as_of, -12)).groupBy("sku").agg(F.sum("po_qty").alias("bought"))
    rows = bought.join(demand, "sku").withColumn("days_bought", F.try_divide("bought", "daily_demand"))
    excess = (F.col("bought") - 365 * F.col("daily_demand")) * F.coalesce("unit_cost", F.lit(0.0))
    return rows.where("daily_demand = 0 or days_bought > 365").select("sku", "bought", "days_bought", excess.alias("excess_value"))


def erratic_lots(po: DataFrame, least_orders: int = 4, cv: float = 0.6) -> DataFrame:
    """Items whose order sizes vary a lot. (V-15)"""
    out = po.where("po_qty > 0").groupBy("sku").agg(F.count("*").alias("orders"), F.avg("po_qty").alias("mean_lot"), (F.stddev_samp("po_qty") / F.avg("po_qty")).alias("lot_cv"))
    return out.where((F.col("orders") >= least_orders) & (F.col("lot_cv") > cv))


def air_freight(po: DataFrame, least_orders: int = 3, share: float = 0.3) -> DataFrame:
    """Items that often come by air, and what those orders cost. (V-16)"""
    air = F.upper("transport_mode") == "AIR"
    out = po.groupBy("sku").agg(F.count("*").alias("orders"), F.count_if(air).alias("air_orders"), F.sum(F.when(air, F.col("po_amount"))).alias("air_spend"))
    out = out.withColumn("air_share", F.col("air_orders") / F.col("orders"))
    return out.where((F.col("orders") >= least_orders) & (F.col("air_share") >= share))


def stockout_forecast(stock: DataFrame, daily: DataFrame, open_po: DataFrame, lead: DataFrame, as_of: Column) -> DataFrame:
    """When available stock runs out within its horizon, counting only inbound that arrives before; what is at risk. (V-17)"""
    rows = stock.select("sku", "qty_on_hand", "unit_cost").join(daily, "sku").where("daily_demand > 0").join(lead, "sku", "left")
    rows = rows.withColumn("horizon", F.coalesce(F.when(F.col("lead_days") > 0, F.col("lead_days")), F.lit(180.0)))
    rows = rows.withColumn("days_left", F.floor(F.col("qty_on_hand") / F.col("daily_demand")))
    runs_out = F.date_add(as_of, F.col("days_left").cast("int"))
    arrivals = open_po.where("committed_delivery is not null").select("sku", "committed_delivery", "open_qty")
    rows = rows.withColumn("runs_out", runs_out)
    inbound = rows.select("sku", "runs_out").join(arrivals, "sku").where((F.col("committed_delivery") >= as_of) & (F.col("committed_delivery") <= F.col("runs_out")))
    inbound = inbound.groupBy("sku").agg(F.sum("open_qty").alias("inbound_before"))
    rows = rows.join(inbound, "sku", "left").fillna(0.0, ["inbound_before"])
    rows = rows.withColumn("days_left", F.floor((F.col("qty_on_hand") + F.col("inbound_before")) / F.col("daily_demand")))
    risk = F.greatest(F.col("horizon") * F.col("daily_demand") - F.col("qty_on_hand") - F.col("inbound_before"), F.lit(0.0))
    rows = rows.where(F.col("days_left") < F.col("horizon")).withColumn("qty_at_risk", risk)
    return rows.select("sku", "days_left", "horizon", "inbound_before", "qty_at_risk", (F.col("qty_at_risk") * F.coalesce("unit_cost", F.lit(0.0))).alias("value_at_risk"), (F.col("days_left") <= 30).alias("urgent"))


def slow_burn(stock: DataFrame, daily: DataFrame) -> DataFrame:
    """Stock that lasts more than a year; no demand counts as forever. (V-18)"""
    rows = stock.where("qty_on_hand > 0").join(daily, "sku", "left").fillna(0.0, ["daily_demand"])
    cover = F.try_divide("qty_on_hand", "daily_demand")
    rows = rows.withColumn("cover_days", cover).where("daily_demand = 0 or cover_days > 365")
    return rows.select("sku", "qty_on_hand", "cover_days", (F.col("qty_on_hand") * F.coalesce("unit_cost", F.lit(0.0))).alias("stock_value"))


def headline(rates: DataFrame, portfolio: DataFrame, risk: DataFrame) -> DataFrame:
    """One row: on-time rates, stock against should-be, excess, shortfall, value at risk and items out within a month. (V-20)"""
    at_risk = risk.agg(F.coalesce(F.sum("value_at_risk"), F.lit(0.0)).alias("value_at_risk"), F.count_if("urgent").alias("skus_out_30_days"))
    rows = rates.select("line_rate", "harsh_rate").crossJoin(portfolio).crossJoin(at_risk)  # one row each
    return rows.withColumn("stock_ratio", F.try_divide("actual_value", "should_be_value"))


def score(rates: DataFrame, dates: DataFrame, health: DataFrame, on_time_target: float, days_target: float) -> DataFrame:
    """On-time rate and days on hand against targets; the rate is not scored on untrusted request dates. (V-21)"""
    days = health.agg(F.try_divide(F.sum("stock_value"), F.sum("daily_cogs")).alias("days_on_hand"), (F.sum("daily_cogs") * days_target).alias("implied_balance"))
    rows = rates.select("clean_rate").crossJoin(dates.select("trusted")).crossJoin(days)  # one row each
    verdict = F.when(~F.col("trusted"), "not scored").when(F.col("clean_rate") >= on_time_target, "met").otherwise("missed")
    return rows.withColumn("on_time", verdict).withColumn("stock", F.when(F.col("days_on_hand") <= days_target, "met").otherwise("missed"))
