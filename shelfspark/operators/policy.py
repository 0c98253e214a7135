"""Policy: item classes, planning rules, should-be inventory, levers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.functions.rounding import half_even
from shelfspark.functions.shares import running_share

from shelfspark.operators.supply import BUYER_OWNED

#: Cycle service level and standard normal z.
Z_TABLE = (
    (0.50, 0.000), (0.75, 0.674), (0.80, 0.842), (0.85, 1.036), (0.90, 1.282), (0.91, 1.341), (0.92, 1.405), (0.93, 1.476),
    (0.94, 1.555), (0.95, 1.645), (0.96, 1.751), (0.97, 1.881), (0.98, 2.054), (0.99, 2.326), (0.995, 2.576), (0.999, 3.090),
)


def z_of(service_level: Column) -> Column:
    """z by straight lines between the table's points; 0 at a half and below, capped at the last point. (P-12)"""
    sl = F.coalesce(service_level, F.lit(0.0))
    out = F.when(sl <= 0.5, 0.0)
    for (a, za), (b, zb) in zip(Z_TABLE, Z_TABLE[1:], strict=False):
        out = out.when(sl < b, za + (sl - a) / (b - a) * (zb - za))
    return out.otherwise(Z_TABLE[-1][1])


def product_family(attrs: DataFrame) -> DataFrame:
    """The master's family, else the description's first word (if there are several), else the letters that begin the sku. (P-05)"""
    word = F.upper(F.split(F.trim("description"), r"\s+")[0])
    kinds = attrs.agg((F.count_distinct(word) > 1).alias("_several"))
    rows = attrs.crossJoin(F.broadcast(kinds))  # one row
    word = F.when(F.col("_several") & (F.length(word) > 0), word)
    prefix = F.regexp_extract("sku", r"^([A-Za-z]+)", 1)
    source = F.when(F.col("product_family").isNotNull(), "master").when(word.isNotNull(), "description").when(F.length(prefix) > 0, "sku_prefix").otherwise("none")
    family = F.coalesce("product_family", word, F.when(F.length(prefix) > 0, prefix))
    return rows.withColumn("family_source", source).withColumn("product_family", family).drop("_several")


def abc_classes(items: DataFrame, value: str = "annual_value", a: float = 0.8, b: float = 0.95) -> DataFrame:
    """A up to 80 % and B up to 95 % of the running share of value, largest first; the row that crosses is in the lower class. (P-06)"""
    rows = running_share(items, value, "sku", "cumulative_share", "_total")
    name = F.when(F.col("_total") <= 0, "C").when(F.col("cumulative_share") <= a, "A").when(F.col("cumulative_share") <= b, "B").otherwise("C")
    return rows.withColumn("abc_class", name).drop("_total")


def volatility_class(cv: Column) -> Column:
    """(P-07)"""
    return F.when(cv <= 0.5, "stable").when(cv <= 1.0, "variable").otherwise("erratic")


def resolve_rules(attrs: DataFrame, defaults: dict[str, object], rules: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Defaults fill nulls, then scoped rules override in order, the last match winning. (P-08, P-09)

    A rule: {"id", "scope" (SQL predicate), "needs" (columns), "set" (parameter -> value)}. One whose columns are not all
    there is skipped; a scope that is null does not match. Returns the resolved items with a trace of the rules that still
    decide something, and an audit: matched items and items where a value of the rule stands.
    """
    usable = [r for r in rules if set(r["needs"]) <= set(attrs.columns)]
    rows = attrs
    for i, r in enumerate(usable):
        rows = rows.withColumn(f"_m{i}", F.coalesce(F.expr(r["scope"]), F.lit(False)))
    names = list(dict.fromkeys([*defaults, *[p for r in usable for p in r["set"]]]))
    winners = []
    for p in names:
        have = F.col(p) if p in attrs.columns else F.lit(None)
        value, winner = F.coalesce(have, F.lit(defaults.get(p))), F.lit(None).cast("string")
        for i, r in enumerate(usable):  # a later rule wraps the earlier ones, so the last match decides
            if p in r["set"]:
                value = F.when(F.col(f"_m{i}"), F.lit(r["set"][p])).otherwise(value)
                winner = F.when(F.col(f"_m{i}"), F.lit(r["id"])).otherwise(winner)
        rows = rows.withColumn(p, value)
        winners.append(winner)
    trace = F.array_sort(F.array_distinct(F.filter(F.array(*winners), lambda w: w.isNotNull())))
    rows = rows.withColumn("_trace", trace)
    packed = F.array(*[F.struct(F.lit(r["id"]).alias("rule_id"), F.col(f"_m{i}").alias("m"), F.array_contains("_trace", r["id"]).alias("s")) for i, r in enumerate(usable)])
    audit = rows.select(F.explode(packed).alias("r")).groupBy("r.rule_id").agg(F.count_if(F.col("r.m")).alias("matched"), F.count_if(F.col("r.s")).alias("standing"))
    out = rows.withColumn("applied_rules", F.array_join("_trace", ",")).drop("_trace", *[f"_m{i}" for i in range(len(usable))])
    return out, audit


def should_be(params: DataFrame, actual: DataFrame, committed: DataFrame | None = None, *, transit_share: float = 0.45) -> DataFrame:
    """Cycle, safety and pipeline stock that policy asks for, priced, against what is there. (R-04 to R-07)

    params: sku, demand_mean, demand_sigma, lead_time_days, lt_sigma_days, review_period_days, replenishment_method,
    order_qty, service_level, incoterm, unit_cost, stocking_class. Review adds to the exposure of periodic and min-max
    items only. Non-stocking items hold no cycle or safety stock but at least what is committed.
    """
    rows = params.fillna(0.0, ["demand_mean", "demand_sigma", "lead_time_days", "lt_sigma_days"])
    rows = rows.withColumn("daily_demand", F.col("demand_mean") / 30.0)
    method = F.col("replenishment_method")
    by_lot = method.isin("min_max", "reorder_point") & F.col("order_qty").isNotNull()
    cycle = F.when(by_lot, F.col("order_qty")).otherwise(F.col("daily_demand") * F.col("review_period_days"))
    exposure = (F.col("lead_time_days") + F.when(method.isin("periodic", "min_max"), F.col("review_period_days")).otherwise(0.0)) / 30.0
    lt_sigma = F.col("lt_sigma_days") / 30.0
    variance = exposure * F.col("demand_sigma") * F.col("demand_sigma") + F.col("demand_mean") * F.col("demand_mean") * lt_sigma * lt_sigma
    held = F.coalesce(F.lower("stocking_class") != "non-stocking", F.lit(True))
    transit = F.when(F.upper(F.trim("incoterm")).isin(*BUYER_OWNED), F.col("lead_time_days") * transit_share).otherwise(0.0)
    rows = rows.withColumn("cycle_qty", F.when(held, half_even(F.greatest(cycle, F.lit(0.0)), 1)).otherwise(0.0))
    rows = rows.withColumn("safety_qty", F.when(held, half_even(z_of(F.col("service_level")) * F.sqrt(F.greatest(variance, F.lit(0.0))), 1)).otherwise(0.0))
    rows = rows.withColumn("pipeline_qty", half_even(F.greatest(F.col("daily_demand") * transit, F.lit(0.0)), 1))
    if committed is not None:
        rows = rows.join(committed.groupBy("sku").agg(F.sum("mto_actionable_qty").alias("_c")), "sku", "left")
        rows = rows.withColumn("committed_qty", half_even(F.greatest(F.coalesce("_c", F.lit(0.0)), F.lit(0.0)), 1)).drop("_c")
    else:
        rows = rows.withColumn("committed_qty", F.lit(0.0))
    parts = F.col("cycle_qty") + F.col("safety_qty") + F.col("pipeline_qty")
    rows = rows.withColumn("should_be_qty", F.when(held, parts).otherwise(F.greatest(parts, F.col("committed_qty"))))
    rows = rows.join(actual.select("sku", F.col("qty").alias("actual_qty")), "sku", "left").fillna(0.0, ["actual_qty"])
    cost = F.coalesce("unit_cost", F.lit(0.0))
    rows = rows.withColumn("should_be_value", F.col("should_be_qty") * cost).withColumn("actual_value", F.col("actual_qty") * cost)
    rows = rows.withColumn("gap_qty", F.col("actual_qty") - F.col("should_be_qty")).withColumn("gap_value", F.col("actual_value") - F.col("should_be_value"))
    rows = rows.withColumn("coverage_ratio", F.when(F.col("should_be_qty") > 0, F.col("actual_qty") / F.col("should_be_qty")))
    year = F.col("demand_mean") * 12 / 365
    return rows.withColumn("should_be_dioh", F.when(year > 0, F.col("should_be_qty") / year)).withColumn("actual_dioh", F.when(year > 0, F.col("actual_qty") / year))


def portfolio(items: DataFrame) -> DataFrame:
    """Should-be and actual value, excess and shortfall apart, daily cost of sales. (R-08)"""
    gap = F.col("gap_value")
    return items.agg(
        F.sum("should_be_value").alias("should_be_value"), F.sum("actual_value").alias("actual_value"), F.sum(gap).alias("net_gap_value"),
        F.sum(F.greatest(gap, F.lit(0.0))).alias("excess_value"), F.sum(F.greatest(-gap, F.lit(0.0))).alias("shortfall_value"),
        F.sum(F.col("daily_demand") * F.coalesce("unit_cost", F.lit(0.0))).alias("daily_cogs"), F.count_if(F.col("unit_cost").isNull()).alias("unpriced_skus"),
    )


def stated_target(totals: DataFrame, days: float) -> DataFrame:
    """A target in days as money, through the daily cost of sales. (R-23)"""
    return totals.select(F.lit(days).alias("target_days"), (F.col("daily_cogs") * days).alias("target_value"), (F.col("actual_value") - F.col("daily_cogs") * days).alias("to_release"))


#: Levers as (key, parameter, factor, ceiling or floor).
LEVERS = ("review_weekly", "lt_reliability", "forecast_accuracy", "lt_speed", "service_level_down")


def lever_params(params: DataFrame) -> DataFrame:
    """Every item under each of the five levers. (R-19) Five rows an item, from a literal table."""
    rows = params.withColumn("lever", F.explode(F.array(*[F.lit(x) for x in LEVERS])))
    on = lambda name: F.col("lever") == name
    changes = {
        "review_period_days": F.when(on("review_weekly"), F.least("review_period_days", F.lit(7.0))),
        "lt_sigma_days": F.when(on("lt_reliability"), F.col("lt_sigma_days") * 0.5),
        "demand_sigma": F.when(on("forecast_accuracy"), F.col("demand_sigma") * 0.75),
        "lead_time_days": F.when(on("lt_speed"), F.col("lead_time_days") * 2 / 3),
        "service_level": F.when(on("service_level_down"), F.greatest(F.col("service_level") - 0.05, F.lit(0.5))),
    }
    return reduce(lambda df, c: df.withColumn(c, F.coalesce(changes[c], F.col(c))), changes, rows)


def levers(params: DataFrame, actual: DataFrame, *, holding_rate: float = 0.22, order_cost: float = 350.0) -> DataFrame:
    """Stock each lever releases for each item, its yearly saving and what more orders cost. (R-19)"""
    base = should_be(params, actual).select("sku", F.col("should_be_value").alias("base_value"), F.col("review_period_days").alias("base_review"))
    rows = should_be(lever_params(params), actual).join(base, "sku")
    saved = F.col("base_value") - F.col("should_be_value")
    ordering = F.when(F.col("lever") == "review_weekly", F.greatest(365 / F.col("review_period_days") - 365 / F.col("base_review"), F.lit(0.0)) * order_cost).otherwise(0.0)
    rows = rows.withColumn("stock_saving", saved).withColumn("annual_saving", saved * holding_rate).withColumn("ordering_cost", ordering)
    return rows.select("sku", "lever", "stock_saving", "annual_saving", "ordering_cost", (F.col("annual_saving") - F.col("ordering_cost")).alias("net_annual"))


def lever_ranking(results: DataFrame) -> DataFrame:
    """Levers by what they net over all items; sums are exact over amounts of four digits, in any order of addition. (R-20)"""
    total = lambda c: F.sum(F.round(c, 4).cast("decimal(20,4)")).cast("double").alias(c)
    return results.groupBy("lever").agg(total("stock_saving"), total("net_annual"), F.count_if(F.col("net_annual") > 0).alias("items_that_pay"))


def best_lever(results: DataFrame) -> DataFrame:
    """The lever that nets most for each item; ties by name. (R-20)"""
    place = F.row_number().over(W.partitionBy("sku").orderBy(F.desc(F.round("net_annual", 6)), "lever"))
    return results.withColumn("_n", place).where("_n = 1").drop("_n")


def constraints(params: DataFrame) -> DataFrame:
    """Settings that shape the stock by themselves: long lead times, large economic lots, large minimum lots. (R-21)"""
    hits = F.array(
        F.when(F.col("lead_time_days") > 4 * F.col("review_period_days"), F.lit("lead_time_over_review")),
        F.when(F.col("eoq_qty") >= 2 * F.col("daily_demand") * F.col("review_period_days"), F.lit("eoq_over_order")),
        F.when(F.col("min_order_qty") > 1.5 * F.col("cycle_qty"), F.lit("moq_over_cycle")),
    )
    return params.select("sku", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("finding"))
