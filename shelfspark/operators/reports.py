"""Report tables: the first rows of what needs a decision, ranked. Each keeps `top` rows, as the report shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _first(rows: DataFrame, top: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order, "sku").limit(top)


def policy_to_review(attrs: DataFrame, top: int = 12) -> DataFrame:
    """Items planned one way whose demand argues for the other, each direction by annual value. (V-19)

    attrs: sku, abc_class, stocking_policy, suggested_policy, annual_value. Items without a value come last.
    """
    pair = F.when((F.col("stocking_policy") == "MTO") & (F.col("suggested_policy") == "MTS"), "recurs").when((F.col("stocking_policy") == "MTS") & (F.col("suggested_policy") == "MTO"), "sporadic")
    rows = attrs.withColumn("finding", pair).where("finding is not null")
    place = F.row_number().over(W.partitionBy("finding").orderBy(F.desc_nulls_last("annual_value"), "sku"))
    whole = W.partitionBy("finding")
    rows = rows.withColumn("place", place).withColumn("items", F.count("*").over(whole)).withColumn("value", F.sum("annual_value").over(whole))
    return rows.where(F.col("place") <= top).select("finding", "place", "sku", "abc_class", "annual_value", "items", "value")


def supply_gaps(recommendations: DataFrame, attrs: DataFrame, top: int = 12) -> DataFrame:
    """Items whose shelf is bare before the next delivery, longest first, whatever they cost. (V-19)"""
    rows = recommendations.where("supply_gap").join(attrs.select("sku", "stocking_policy", "annual_value"), "sku", "left")
    columns = ["sku", "stocking_policy", "on_hand_cover_days", "supply_gap_days", "days_to_next_arrival", "inbound_past_due_qty", "period_demand", "annual_value"]
    return _first(rows.select(*columns), top, F.desc_nulls_last("supply_gap_days"))


def materials_to_act(recommendations: DataFrame, attrs: DataFrame, top: int = 12) -> DataFrame:
    """Actions other than holding, by the money that they move. (V-19)"""
    rows = recommendations.drop("unit_cost", "stocking_policy").where("not startswith(upper(recommended_action), 'HOLD')")
    rows = rows.join(attrs.select("sku", "unit_cost", "stocking_policy"), "sku", "left")
    buy, push = F.coalesce("suggested_po_qty", F.lit(0.0)), F.coalesce("pushout_open_po_qty", F.lit(0.0))
    rows = rows.withColumn("action_qty", F.when(buy > 0, buy).otherwise(push)).withColumn("action_value", F.col("action_qty") * F.coalesce("unit_cost", F.lit(0.0)))
    return _first(rows.select("sku", "stocking_policy", "recommended_action", "action_qty", "action_value", "days_of_supply", "net_requirement"), top, F.desc("action_value"))


def orders_to_change(open_po: DataFrame, slow: DataFrame, risk: DataFrame, inbound: DataFrame, attrs: DataFrame, top: int = 12) -> DataFrame:
    """Open orders that land in years of cover, or after the shelf is empty, by value. (V-19)

    slow: sku, cover_days (null for stock without demand); risk: sku, days_left; inbound: sku, days_to_next_arrival.
    """
    late = risk.join(inbound.select("sku", "days_to_next_arrival"), "sku").where("days_to_next_arrival > days_left").select("sku", F.col("days_left").alias("out_on_day"))
    rows = open_po.where("open_qty > 0").join(slow.select("sku", F.col("cover_days").alias("days_of_cover"), F.lit(True).alias("slow")), "sku", "left").join(late, "sku", "left")
    action = F.when(F.col("slow") & F.col("days_of_cover").isNotNull(), "push out or cancel").when(F.col("out_on_day").isNotNull(), "pull in")
    rows = rows.withColumn("action", action).where("action is not null").join(attrs.select("sku", "stocking_policy"), "sku", "left")
    rows = rows.select("sku", "po_number", "po_line_number", "stocking_policy", "action", "open_qty", F.coalesce("open_amount", F.lit(0.0)).alias("po_value"), F.col("committed_delivery").alias("eta"), "days_of_cover")
    return _first(rows, top, F.desc("po_value"), "po_number", "po_line_number")
