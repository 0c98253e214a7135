"""Period planning: phased supply, balance, prices, shares, stock health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.operators.forecast import month_columns


def plan_span(detail: DataFrame) -> DataFrame:
    """One row, the first and the last month of a forecast: the horizon of the plan. (L-03)"""
    return detail.agg(F.min("period").alias("first"), F.max("period").alias("last"))


def phase_supply(open_po: DataFrame, span: DataFrame) -> DataFrame:
    """Open orders by plan month; undated and late ones fall in the first, those after the last drop out. (L-01)

    span: one row (first, last) as of `plan_span`.
    """
    rows = open_po.where("open_qty > 0").crossJoin(F.broadcast(span))  # one row
    month = F.greatest(F.coalesce(F.trunc("committed_delivery", "MM"), "first"), "first")
    return rows.withColumn("period", month).where("period <= last").groupBy("sku", "period").agg(F.sum("open_qty").alias("supply_qty"))


def opening(stock: DataFrame) -> DataFrame:
    """Opening quantity of each item: on hand and in transit. (L-02)"""
    quantity = F.coalesce("qty_on_hand", F.lit(0.0)) + F.coalesce("qty_in_transit", F.lit(0.0))
    return stock.groupBy("sku").agg(F.sum(quantity).alias("opening_qty"))


def unit_costs(*sources: DataFrame) -> DataFrame:
    """Cost of each item from the first source that has any positive cost at all; the least of an item's several. (L-02)"""
    ranked = [s.where("unit_cost > 0").select(F.lit(i).alias("rank"), "sku", "unit_cost") for i, s in enumerate(sources)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more)
    first = rows.agg(F.min("rank").alias("rank"))
    return rows.join(F.broadcast(first), "rank").groupBy("sku").agg(F.min("unit_cost").alias("unit_cost"))  # one row


DAYS_A_MONTH = 30.4375


def period_balance(detail: DataFrame, supply: DataFrame, items: DataFrame, span: DataFrame) -> DataFrame:
    """What each item needs, gets and has left in each month of the forecast, in units and at cost. (L-03)

    detail: sku, period, forecast_qty; supply: sku, period, supply_qty; items: sku, opening_qty, unit_cost, safety_stock,
    lead_time_days, each of them null where unknown. Every item with a forecast or supply has all months: demand and
    supply are merged in one grouping, months are spread from its rows, and one running sum carries the balance. A negative
    balance is a backlog, worth 0. An order placed today cannot reach the first `lead_time_periods` months: at least one,
    all of them where no lead time is known.
    """
    need = detail.groupBy("sku", "period").agg(F.sum("forecast_qty").alias("demand_qty"), F.lit(0.0).alias("supply_qty"))
    both = need.unionByName(supply.select("sku", "period", F.lit(0.0).alias("demand_qty"), F.col("supply_qty").cast("double")))
    rows = both.groupBy("sku").agg(F.collect_list(F.struct("period", "demand_qty", "supply_qty")).alias("flows"))  # at most two a month
    rows = rows.crossJoin(F.broadcast(span)).join(items, "sku", "left")  # one row
    months = F.sequence("first", "last", F.expr("interval 1 month"))
    rows = rows.select("*", F.size(months).alias("horizon"), F.posexplode(months).alias("pos", "period"))
    flow = lambda c: F.aggregate(F.filter("flows", lambda f: f.period == F.col("period")), F.lit(0.0), lambda n, f: n + f[c])
    cost, floor = F.coalesce("unit_cost", F.lit(0.0)), F.coalesce("safety_stock", F.lit(0.0))
    days = F.when(F.col("lead_time_days") > 0, F.col("lead_time_days"))
    periods = F.when(days.isNull(), F.col("horizon")).otherwise(F.least(F.greatest(F.ceil(days / DAYS_A_MONTH), F.lit(1)), "horizon")).cast("int")
    running = W.partitionBy("sku").orderBy("period").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("demand_qty", flow("demand_qty")).withColumn("supply_qty", flow("supply_qty"))
    closing = F.coalesce("opening_qty", F.lit(0.0)) + F.sum(F.col("supply_qty") - F.col("demand_qty")).over(running)
    rows = rows.withColumn("closing_qty", closing).withColumn("gap_qty", F.greatest(F.lit(0.0), floor - F.col("closing_qty")))
    return rows.select(
        "sku", "period", "demand_qty", (F.col("demand_qty") * cost).alias("demand_cogs"), "supply_qty", (F.col("supply_qty") * cost).alias("supply_value"), "closing_qty",
        (F.greatest(F.col("closing_qty"), F.lit(0.0)) * cost).alias("closing_value"), "gap_qty", (F.col("gap_qty") * cost).alias("gap_value"), floor.alias("safety_stock"), days.alias("lead_time_days"), periods.alias("lead_time_periods"),
        (F.col("pos") < periods).alias("within_lead_time"),
    )


MEASURES = ("demand_qty", "demand_cogs", "supply_qty", "supply_value", "closing_qty", "closing_value", "gap_qty", "gap_value")


def balance_by_period(balance: DataFrame, detail: DataFrame, items: DataFrame) -> DataFrame:
    """Totals of each month, items short, and the value it opens with: the month before's close. (L-04)

    The first month opens with the stock of the items with a forecast, at cost. items: sku, opening_qty, unit_cost.
    """
    out = balance.groupBy("period").agg(*[F.sum(c).alias(c) for c in MEASURES], F.count_if(F.col("gap_qty") > 0).alias("gap_skus"))
    held = items.join(detail.select("sku").distinct(), "sku", "left_semi").agg(F.coalesce(F.sum(F.col("opening_qty") * F.col("unit_cost")), F.lit(0.0)).alias("held"))
    out = out.crossJoin(F.broadcast(held))  # one row
    return out.withColumn("opening_value", F.coalesce(F.lag("closing_value").over(W.orderBy("period")), "held")).drop("held")  # a row a month


def balance_by_family(balance: DataFrame, families: DataFrame) -> DataFrame:
    """Money of each business unit, family and month. families: sku, business_unit, product_family. (L-04)"""
    rows = balance.join(families.select("sku", "business_unit", "product_family"), "sku", "left")
    return rows.groupBy("business_unit", "product_family", "period").agg(*[F.sum(c).alias(c) for c in ("demand_cogs", "supply_value", "closing_value", "gap_value")])


def balance_by_item(balance: DataFrame, months: list | None = None) -> DataFrame:
    """A row an item: first short month, months short, floor, gap inside the lead time, totals of flows, peaks of the gap. (L-05)

    With months (as of `months_of`), a column for each measure and month follows: one grouping, no pass to find the months.
    """
    short, inside = F.col("gap_qty") > 0, F.col("within_lead_time")
    reach = lambda c: F.coalesce(F.max(F.when(inside, F.col(c))), F.lit(0.0))
    wide = [] if months is None else month_columns(months, **{f"{m}_{unit}": c for m, unit, c in PHASED})
    return balance.groupBy("sku").agg(
        F.min(F.when(short, F.col("period"))).alias("first_short_period"), F.count_if(short).alias("short_periods"), F.first("safety_stock").alias("safety_stock"), F.first("lead_time_days").alias("lead_time_days"), F.first("lead_time_periods").alias("lead_time_periods"),
        reach("gap_qty").alias("gap_qty_within_lead_time"), reach("gap_value").alias("gap_amt_within_lead_time"), F.sum("demand_qty").alias("demand_qty_total"), F.sum("supply_qty").alias("supply_qty_total"),
        F.sum("demand_cogs").alias("demand_amt_total"), F.sum("supply_value").alias("supply_amt_total"), F.max("gap_qty").alias("gap_qty_peak"), F.max("gap_value").alias("gap_amt_peak"), *wide,
    )


#: Measures that the wide table spreads, by name and unit.
PHASED = (
    ("demand", "qty", "demand_qty"), ("supply", "qty", "supply_qty"), ("closing", "qty", "closing_qty"), ("gap", "qty", "gap_qty"),
    ("demand", "amt", "demand_cogs"), ("supply", "amt", "supply_value"), ("closing", "amt", "closing_value"), ("gap", "amt", "gap_value"),
)


def lead_time_exposure(balance: DataFrame) -> DataFrame:
    """One row: the worth of the gaps that an order placed today cannot close, an item's deepest one each, and items with one. (L-05)"""
    worst = balance.where("within_lead_time").groupBy("sku").agg(F.max("gap_value").alias("gap"))
    return worst.agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_within_lead_time"), F.count_if(F.col("gap") > 0).alias("items"))


#: Amounts and quantities are added exactly, to six digits.
EXACT = "decimal(24,6)"


def selling_price(lines: DataFrame, cost: DataFrame, as_of: Column) -> DataFrame:
    """Average price of twelve months, three months or the whole history, else the standard cost; the first positive. (L-06)"""

    def price(months: int | None) -> Column:
        inside = F.lit(True) if months is None else F.col("demand_date") > F.add_months(as_of, -months)
        total = lambda c: F.sum(F.when(inside, F.col(c))).cast("double")
        return F.try_divide(total("amount"), total("qty"))

    exact = lines.select("sku", "demand_date", *[F.col(c).cast(EXACT).alias(c) for c in ("amount", "qty")])  # cast once a line, not once a sum
    rows = exact.groupBy("sku").agg(price(12).alias("p12"), price(3).alias("p3"), price(None).alias("p_all"))
    rows = rows.join(cost.select("sku", "unit_cost"), "sku", "full")
    order = [("p12", "trailing_12m"), ("p3", "trailing_3m"), ("p_all", "all_history"), ("unit_cost", "standard_cost")]
    best = F.coalesce(*[F.when(F.col(c) > 0, F.struct(F.col(c).alias("price"), F.lit(label).alias("source"))) for c, label in order], F.struct(F.lit(None).cast("double").alias("price"), F.lit("none").alias("source")))
    return rows.withColumn("_b", best).select("sku", F.col("_b.price").alias("price"), F.col("_b.source").alias("price_source"))


def value_series(lines: DataFrame) -> DataFrame:
    """Money of each item and month; summed exactly, so the order of addition has no bearing. (L-07)"""
    return lines.groupBy("sku", F.trunc("demand_date", "MM").alias("period")).agg(F.sum(F.col("amount").cast(EXACT)).cast("double").alias("amount"))


def country_shares(lines: DataFrame, as_of: Column, least: float = 0.02) -> DataFrame:
    """Share of countries in an item's last twelve months (or its whole history); small ones go to the largest. (L-08)"""
    recent = F.col("demand_date") > F.add_months(as_of, -12)
    exact = lines.where("country is not null").select("sku", "country", recent.alias("is_recent"), F.col("qty").cast(EXACT).alias("qty"))  # cast once a line
    rows = exact.groupBy("sku", "country").agg(F.sum(F.when(F.col("is_recent"), F.col("qty"))).cast("double").alias("recent"), F.sum("qty").cast("double").alias("all"))
    whole = W.partitionBy("sku")
    rows = rows.withColumn("qty", F.when(F.sum("recent").over(whole) > 0, F.coalesce("recent", F.lit(0.0))).otherwise(F.col("all")))
    rows = rows.withColumn("total", F.sum("qty").over(whole)).withColumn("raw", F.try_divide("qty", "total"))
    rows = rows.withColumn("place", F.row_number().over(whole.orderBy(F.desc("raw"), "country")))
    rows = rows.where((F.col("raw") >= least) | (F.col("place") == 1))
    rest = F.when(F.col("place") == 1, F.col("total") - F.sum("qty").over(whole)).otherwise(0.0)
    return rows.select("sku", "country", F.try_divide(F.col("qty") + rest, F.col("total")).alias("share"))


def sop_items(history: DataFrame, detail: DataFrame, values: DataFrame, past: list) -> DataFrame:
    """History and forecast of each item with a forecast, before any country, a row a period: qty, and past amount. (L-09)

    history: sku, period, qty; detail: sku, period, forecast_qty; values: sku, period, amount; past: the months of history.
    """
    before = history.where(F.col("period").isin(past)).join(values.where(F.col("period").isin(past)), ["sku", "period"], "left")
    before = before.join(detail.select("sku").distinct(), "sku", "left_semi").select("sku", "period", F.lit("history").alias("kind"), "qty", "amount")
    coming = detail.select("sku", "period", F.lit("forecast").alias("kind"), F.col("forecast_qty").alias("qty"), F.lit(None).cast("double").alias("amount"))
    return before.unionByName(coming)


def _by_country() -> tuple[Column, Column, Column]:
    """The country, its share and what the split rests on, after a left join of shares."""
    share = F.coalesce("share", F.lit(1.0))
    return F.coalesce("country", F.lit("(not stated)")).alias("country"), share, F.when(share < 1, "top-down by share").otherwise("single country").alias("split_basis")


def sop_rows(items: DataFrame, prices: DataFrame, shares: DataFrame) -> DataFrame:
    """History and forecast of each item and country, in units and money, a row a period. (L-09)

    items: as of `sop_items`. Quantities and past money are split by country share; future money is the split quantity at
    the item's price. Items without a country keep one row: `(not stated)`.
    """
    rows = items.join(prices.select("sku", "price"), "sku", "left").join(shares, "sku", "left")
    country, share, basis = _by_country()
    qty = F.col("qty") * share
    amount = F.when(F.col("kind") == "history", F.col("amount") * share).otherwise(qty * F.col("price"))
    return rows.select("sku", country, "period", "kind", qty.alias("qty"), amount.alias("amount"), basis)


def sop_sheet(items: DataFrame, shares: DataFrame, attrs: DataFrame, prices: DataFrame, detail: DataFrame, past: list, coming: list, spread: bool = True) -> DataFrame:
    """The sheet as a reviewer reads it: a line an item and country. (L-09)

    Dimensions of the item (attrs: sku and any columns), totals over the given months, what the forecast and the price rest
    on, then, with `spread`, columns `hist qty yyyy-MM`, `hist amt`, `fcst qty` and `fcst amt`. Months become columns a row
    an item (items: as of `sop_items`), and only then, as one array a measure, meet the countries, so no row an item,
    country and month is made. Totals are null where all of a line's values are; they add up whole ten-thousandths.
    """
    wide = items.groupBy("sku").agg(*month_columns(past, hist_qty="qty", hist_amt="amount"), *month_columns(coming, fcst_qty="qty"))
    months = {"hist qty": past, "hist amt": past, "fcst qty": coming, "fcst amt": coming}
    wide = wide.select("sku", *[F.array(*[F.col(f"`{c} {m:%Y-%m}`") for m in months[c]]).alias(c) for c in ("hist qty", "hist amt", "fcst qty")])
    country, share, split = _by_country()
    price = prices.select("sku", F.col("price").alias("asp"), F.col("price_source").alias("price_basis"))
    basis = [c for c in ("model", "selected_by", "vs_naive", "backtest_mape") if c in detail.columns]
    meta = detail.where("is_next_period").select("sku", *basis)
    of_item = wide.join(attrs, "sku", "left").join(meta, "sku", "left").join(price, "sku", "left").withColumn("price_basis", F.coalesce("price_basis", F.lit("none")))
    of_line = {c: F.transform(c, lambda v: v * share) for c in ("hist qty", "hist amt", "fcst qty")} | {"fcst amt": F.transform("fcst qty", lambda v: v * share * F.col("asp"))}
    named = [c for c in attrs.columns if c != "sku"]
    lines = of_item.join(shares, "sku", "left").select("sku", *named, country, *basis, "asp", "price_basis", split, *[v.alias(c) for c, v in of_line.items()])

    def total(cells: str) -> Column:
        whole = F.transform(cells, lambda v: F.floor(v * 10_000 + 0.5))
        return F.when(F.exists(cells, lambda v: v.isNotNull()), F.aggregate(whole, F.lit(0).cast("long"), lambda n, v: n + F.coalesce(v, F.lit(0)))).cast("double") / 10_000

    names = {"hist qty": "history_qty_total", "hist amt": "history_amount_total", "fcst qty": "forecast_qty_total", "fcst amt": "forecast_amount_total"}
    shown = [F.get(c, F.lit(i)).alias(f"{c} {m:%Y-%m}") for c in names for i, m in enumerate(months[c])] if spread else []
    return lines.select("sku", *named, "country", *[total(c).alias(name) for c, name in names.items()], *basis, "asp", "price_basis", "split_basis", *shown)


def last_movement(series: DataFrame) -> DataFrame:
    """Months between the series' end and an item's last demand. (L-10)"""
    end = series.agg(F.max("period").alias("_end"))
    last = series.groupBy("sku").agg(F.max(F.when(F.col("qty") > 0, F.col("period"))).alias("last_demand"))
    rows = last.crossJoin(F.broadcast(end))  # one row
    return rows.select("sku", "last_demand", F.months_between("_end", "last_demand").cast("int").alias("months_idle"))


def stock_age(stock: DataFrame, idle: DataFrame, daily: DataFrame) -> DataFrame:
    """Measured age, else days since the last movement, else days of cover. (L-11)"""
    rows = stock.join(idle.select("sku", "months_idle"), "sku", "left").join(daily, "sku", "left")
    measured = F.col("age_days") if "age_days" in stock.columns else F.lit(None).cast("double")
    cover = F.try_divide("qty_on_hand", "daily_demand")
    age = F.coalesce(measured, F.col("months_idle") * 30.0, cover)
    basis = F.when(measured.isNotNull(), "measured").when(F.col("months_idle").isNotNull(), "last_movement").when(cover.isNotNull(), "cover").otherwise("unknown")
    return rows.select("sku", "qty_on_hand", "unit_cost", "months_idle", "daily_demand", age.cast("double").alias("age_days"), basis.alias("age_basis"))


def health_by_family(detail: DataFrame, families: DataFrame, slow_months: int = 6) -> DataFrame:
    """Items, value, daily cost of sales, days on hand and slow stock of each family. (L-12)"""
    rows = detail.join(families.select("sku", "product_family"), "sku", "left")
    value = F.col("qty_on_hand") * F.coalesce("unit_cost", F.lit(0.0))
    daily = F.coalesce("daily_demand", F.lit(0.0)) * F.coalesce("unit_cost", F.lit(0.0))
    slow = F.coalesce(F.col("months_idle") >= slow_months, F.lit(False))
    out = rows.groupBy("product_family").agg(
        F.count("*").alias("skus"), F.sum(value).alias("stock_value"), F.sum(daily).alias("daily_cogs"), F.count_if(slow).alias("slow_skus"), F.coalesce(F.sum(F.when(slow, value)), F.lit(0.0)).alias("slow_value")
    )
    return out.withColumn("days_on_hand", F.try_divide("stock_value", "daily_cogs")).withColumn("slow_share", F.try_divide("slow_value", "stock_value"))


def slow_or_old(detail: DataFrame, slow_months: int = 6, old_days: float = 365) -> DataFrame:
    """Items with stock that have not moved for months, or are old. (L-13)"""
    slow = F.coalesce(F.col("months_idle") >= slow_months, F.lit(False))
    old = F.coalesce(F.col("age_days") > old_days, F.lit(False))
    rows = detail.where("qty_on_hand > 0").withColumn("slow", slow).withColumn("old", old).where("slow or old")
    return rows.select("sku", "slow", "old", "age_days", "months_idle")
