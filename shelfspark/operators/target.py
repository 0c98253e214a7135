"""A hard stock target: which moves release how much, in what order, and which come too late or cost more than they free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How much each service risk hurts.
PAIN = {"none": 0, "low": 1, "medium": 2, "high": 3}
#: The levers' service risk, days until they show in stock, and whether their cost is known.
LEVER_FACTS = {
    "review_weekly": ("none", 30, True),
    "lt_reliability": ("none", 180, False),
    "forecast_accuracy": ("none", 90, False),
    "lt_speed": ("low", 60, False),
    "service_level_down": ("high", 30, False),
}


def exact_sum(c: Column) -> Column:
    """Sum of amounts of four digits, the same in any order of addition."""
    return F.coalesce(F.sum(F.round(c, 4).cast("decimal(20,4)")), F.lit(0).cast("decimal(30,4)"))


def _moves(rows: DataFrame, kind: Column, skus: Column, released: Column, theoretical: Column, risk: Column, days: Column, state: Column, by: list[str] | None = None) -> DataFrame:
    out = rows.groupBy(*(by or [])).agg(skus.alias("skus"), released.alias("released"), theoretical.alias("theoretical"), *([F.sum("net_annual").alias("net"), exact_sum(F.col("ordering_cost")).alias("cost")] if by else []))
    cost = F.lit(0).cast("decimal(30,4)") if by is None else F.when(_fact(2), F.col("cost"))
    return out.select(kind.alias("kind"), "skus", "released", "theoretical", cost.alias("annual_cost"), risk.alias("service_risk"), days.alias("days_to_effect"), state.alias("state"))


def _fact(i: int) -> Column:
    """A fixed fact of the row's lever."""
    return F.create_map(*[x for k, v in LEVER_FACTS.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("lever")]


def target_frontier(items: DataFrame, open_po: DataFrame, levers: DataFrame, target: DataFrame, days_left: int | None = None) -> DataFrame:
    """Moves towards the target in order of pain, reversibility and value, with the balance after each. (R-22)

    items: sku, actual_value, gap_qty, gap_value, demand_mean, unit_cost (should-be result); levers: a row an item and
    lever; target: one row, target_value. Stopping to buy frees what demand can draw down in the days left; inbound
    orders are put off up to an item's excess; levers count when they save stock and don't cost more than that. A move
    that takes longer than the days left is `too_slow`; cutting items below policy and levers that lose money are
    `excluded`. `needed` marks the first moves that suffice. `annual_cost` is what
    a move costs a year to run; null where nobody knows. Nothing is returned when the stock is within the target.
    """
    over = items.where("gap_value > 0").withColumn("cost", F.coalesce("unit_cost", F.lit(0.0)))
    drawn = F.col("gap_value") if days_left is None else F.least("gap_qty", F.col("demand_mean") / 30.0 * days_left) * F.col("cost")
    now, none = F.lit(0), F.lit("none")
    stop = _moves(over, F.lit("stop_buying"), F.count("*"), exact_sum(drawn), exact_sum(F.col("gap_value")), none, now, F.lit("planned"))
    due = open_po.groupBy("sku").agg(F.sum("open_qty").alias("open_qty"))
    push = over.join(due, "sku").withColumn("value", F.greatest(F.least("open_qty", "gap_qty"), F.lit(0.0)) * F.col("cost")).where("value > 0")
    push = _moves(push, F.lit("push_out_po"), F.count("*"), exact_sum(F.col("value")), exact_sum(F.col("value")), F.lit("low"), now, F.lit("planned"))
    loses = _fact(2) & (F.col("net") < 0)
    saved = exact_sum(F.col("stock_saving"))
    state = F.when(loses, "excluded").when(F.lit(days_left).isNotNull() & (_fact(1) > F.lit(days_left)), "too_slow").otherwise("planned")
    moved = _moves(levers, F.concat(F.lit("lever:"), "lever"), F.count_if(F.col("stock_saving") > 0), saved, saved, _fact(0), _fact(1), state, ["lever"])
    under = items.where("gap_value < 0")
    cut = _moves(under, F.lit("cut_below_policy"), F.count("*"), F.lit(0).cast("decimal(30,4)"), exact_sum(-F.col("gap_value")), F.lit("high"), now, F.lit("excluded"))
    rows = stop.unionByName(push).unionByName(moved.where("state = 'excluded' or released > 0")).unionByName(cut.where("skus > 0"))
    rows = rows.where("state = 'excluded' or released > 0")
    sums = items.agg(exact_sum(F.col("actual_value")).alias("current")).crossJoin(target.select(F.col("target_value").cast("decimal(20,4)").alias("target_value")))  # one row each
    rows = rows.crossJoin(F.broadcast(sums.where("current > target_value")))  # at most one row
    pain = F.create_map(*[x for k, v in PAIN.items() for x in (F.lit(k), F.lit(v))])[F.col("service_risk")]
    rows = rows.withColumn("reversible", F.col("kind") != "cut_below_policy")
    order = W.partitionBy("state").orderBy(pain, F.desc("reversible"), F.desc("released"), "kind")  # a row a move: eight at most
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("_sum", F.sum("released").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    planned, left = F.col("state") == "planned", F.col("current") - F.col("_sum")
    return rows.select(
        "state", "place", "kind", "skus", F.when(F.col("state") == "excluded", 0.0).otherwise(F.col("released").cast("double")).alias("released"), F.col("theoretical").cast("double").alias("theoretical"), F.col("annual_cost").cast("double").alias("annual_cost"), "service_risk", "reversible", "days_to_effect",
        F.when(planned, left.cast("double")).alias("running_balance"), (planned & (left <= F.col("target_value"))).alias("hits_target"), (planned & (left + F.col("released") > F.col("target_value"))).alias("needed"),
    )
