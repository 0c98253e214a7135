"""Feedback over time: plans against what happened, drift, decisions, run comparison, item review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def publish(recommended: DataFrame, lead_times: DataFrame, run_at: str, planning_month: str) -> DataFrame:
    """Snapshot rows of a run: recommendation, position, projection, class, and the lead time it planned on. (F-01)"""
    lt = lead_times.select("sku", F.col("wma_lead_time_days").alias("lead_time_days"), F.col("lt_std_days").alias("lt_sigma_days"), F.col("sample_count").alias("lt_samples"), "lt_source", "supplier")
    rows = recommended.select(
        "sku", "stocking_class", "demand_pattern", "demand_cv", "recommended_action", "suggested_po_qty", "available_supply", "net_requirement", "safety_stock", "days_of_supply", "inventory_status", F.col("next_period_demand").alias("forecast_qty"),
    )
    return rows.join(lt, "sku", "left").withColumn("run_at", F.lit(run_at)).withColumn("planning_month", F.lit(planning_month))


def published_plan(detail: DataFrame, run_at: str, planning_month: str, as_of: str, reviewed: bool) -> DataFrame:
    """The plan of each item and month as a run published it, with the statistical value where a review changed it. (F-01)

    detail: sku, period, forecast_qty and, once reviewed, statistical_qty and forecast_source. `reviewed` says whether
    the run as a whole went through a review: only such plans were committed to.
    """
    more = [c for c in ("statistical_qty", "forecast_source") if c in detail.columns]
    rows = detail.select("sku", "period", "forecast_qty", *more)
    return rows.withColumns({"run_at": F.lit(run_at), "planning_month": F.lit(planning_month), "as_of": F.lit(as_of), "reviewed": F.lit(reviewed)})


def save_snapshot(rows: DataFrame, root: str) -> None:
    """Writes a run's rows to a table of snapshots; a run that is published again overwrites its own rows only. (F-01)"""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("planning_month", "run_at").parquet(root)


def read_snapshots(like: DataFrame, root: str) -> DataFrame:
    """All runs' rows, with the columns of `like`."""
    return like.sparkSession.read.schema(like.schema).parquet(root).select(*like.columns)


def actuals_after(lines: DataFrame, stock: DataFrame, as_of: Column, po: DataFrame | None = None) -> DataFrame:
    """Demand of the month after a plan, closing stock and receipts (of `po`), a row an item; the job fails for an empty month. (F-02, F-03)"""
    inside = lines.where((F.col("demand_date") > as_of) & (F.col("demand_date") <= F.add_months(as_of, 1)))
    none = F.when(F.count("*") == 0, F.raise_error(F.lit("no demand lines in the month after the plan")).cast("boolean")).otherwise(True)
    demand = inside.groupBy("sku").agg(F.sum("qty").alias("actual_demand"))
    stock = stock.crossJoin(F.broadcast(inside.agg(none.alias("_ok")))).where("_ok")  # one row
    rows = demand.join(stock.groupBy("sku").agg(F.sum("qty_on_hand").alias("actual_eom_inv")), "sku", "full")
    if po is None:
        return rows.fillna(0.0, ["actual_demand"])
    came = po.where((F.col("receive_date") > as_of) & (F.col("receive_date") <= F.add_months(as_of, 1))).groupBy("sku").agg(F.sum("po_qty").alias("actual_receipts"))
    return rows.join(came, "sku", "full").fillna(0.0, ["actual_demand", "actual_receipts"])


def monthly_loss(plans: DataFrame) -> DataFrame:
    """Forecast error, share of it, under-bought and short quantities, realised days of supply. (F-04)

    plans: sku, month, forecast, suggested, available, actual_demand, receipts, eom_inv; rows without actuals go.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    d = F.col("actual_demand")
    rows = plans.where("actual_demand is not null")
    days = F.when((z("eom_inv") != 0) & (d > 0), F.bround(F.col("eom_inv") / d * 30, 1))
    return rows.select(
        "sku", "month", F.bround(z("forecast") - d, 2).alias("forecast_error"), F.when(d > 0, F.bround(F.abs((z("forecast") - d) / d), 4)).alias("ape"),
        F.bround(F.when(z("suggested") > 0, z("suggested") - z("receipts")).otherwise(0.0), 1).alias("supply_gap"), F.bround(F.greatest(F.lit(0.0), d - z("available")), 1).alias("demand_gap"), days.alias("dos_realized"),
    )


def loss_summary(loss: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and absolute deviation, mean share, direction of the bias, days of supply and share of excess. (F-05)"""
    e = F.col("forecast_error")
    out = loss.groupBy(*keys).agg(
        F.count("*").alias("skus"), F.avg(e).alias("md"), F.avg(F.abs(e)).alias("mad"), F.avg("ape").alias("mape"), F.avg("dos_realized").alias("avg_dos"), F.avg(F.when(F.col("dos_realized").isNotNull(), (F.col("dos_realized") > 90).cast("double"))).alias("excess_rate"),
    )
    ratio = F.try_divide(F.col("md"), F.col("mad"))
    return out.withColumn("bias", F.when(ratio > 0.2, "over-forecast").when(ratio < -0.2, "under-forecast").otherwise("neutral"))


def persistent_gaps(loss: DataFrame, gap: str, least: int = 3) -> DataFrame:
    """Items whose gap was positive in each of their last months, `least` or more; months without a row don't break it. (F-06)"""
    newest = W.partitionBy("sku").orderBy(F.desc("month"))
    rows = loss.withColumn("r", F.row_number().over(newest))
    out = rows.groupBy("sku").agg(F.min(F.when(~(F.col(gap) > 0), F.col("r"))).alias("stop"), F.max("r").alias("n"), F.coalesce(F.sum(F.when(F.col(gap) > 0, F.col(gap))), F.lit(0.0)).alias("cumulative_gap"))
    run = F.coalesce(F.col("stop") - 1, F.col("n"))
    return out.withColumn("months_in_a_row", run).where(F.col("months_in_a_row") >= least).select("sku", "months_in_a_row", F.bround("cumulative_gap", 1).alias("cumulative_gap"))


def attribution(loss: DataFrame, deviations: DataFrame, risks: DataFrame) -> DataFrame:
    """How much of the problem execution explains, and whether the model should change. (F-07)"""
    both = deviations.select("sku", F.lit(1).alias("d")).join(risks.select("sku", F.lit(1).alias("r")), "sku", "full")
    marked = both.agg(F.count("d").alias("deviations"), F.count("r").alias("risks"), F.count_if(F.col("d").isNotNull() & F.col("r").isNotNull()).alias("overlap"))
    rows = loss_summary(loss, []).select("bias").crossJoin(marked)  # one row each
    share = F.coalesce(F.try_divide("overlap", "risks"), F.lit(0.0))
    return rows.withColumn("explained", share).withColumn("change_model", (F.col("bias") != "neutral") & (F.col("explained") < 0.5))


def lead_time_drift(history: DataFrame, days: float = 5, share: float = 0.2) -> DataFrame:
    """First against last month of each item's recorded lead time. (F-08)

    The newest run of a month counts. `kind`: source_change where the sources differ, move where a measured lead time
    changed by at least `days` and `share`, else steady. Items seen in one month only are left out.
    """
    newest = W.partitionBy("sku", "planning_month").orderBy(F.desc("run_at"))
    rows = history.where("lead_time_days is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    m = F.struct("lead_time_days", F.coalesce("lt_source", F.lit("measured")).alias("src"))
    out = rows.groupBy("sku").agg(F.count("*").alias("months"), F.min("planning_month").alias("first_month"), F.max("planning_month").alias("last_month"), F.min_by(m, "planning_month").alias("a"), F.max_by(m, "planning_month").alias("b"))
    change = F.col("b.lead_time_days") - F.col("a.lead_time_days")
    moved = (F.col("a.src") == "measured") & (F.abs(change) >= days) & (F.coalesce(F.try_divide(F.abs(change), F.col("a.lead_time_days")), F.lit(0.0)) >= share)
    kind = F.when(F.col("a.src") != F.col("b.src"), "source_change").when(moved, "move").otherwise("steady")
    return out.where("months > 1").select("sku", "months", "first_month", "last_month", F.col("a.lead_time_days").alias("first_lt"), F.col("b.lead_time_days").alias("last_lt"), change.alias("change"), kind.alias("kind"))


def recurring_refusals(decisions: DataFrame, attrs: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Rejected and deferred actions that recur for a supplier, family, class or term, or for all items. (F-09)"""
    refused = decisions.where("decision in ('rejected', 'deferred')").join(attrs.select("sku", *by), "sku", "left")
    rows = refused.unpivot(["sku", "reason_code", "action_kind", "value_at_stake"], by, "attribute", "value").where("value is not null")
    facts = [F.count("*").alias("occurrences"), F.count_distinct("sku").alias("skus"), F.sum("value_at_stake").alias("value_at_stake")]
    scoped = rows.groupBy("attribute", "value", "reason_code", "action_kind").agg(*facts).where(F.col("occurrences") >= least)
    whole = refused.groupBy("reason_code", "action_kind").agg(*facts).where(F.col("occurrences") >= 2 * least)
    return scoped.unionByName(whole.withColumn("attribute", F.lit("all")).withColumn("value", F.lit("all")))


def acceptance_rate(decisions: DataFrame, by: str = "action_kind") -> DataFrame:
    """How often each kind of recommendation is taken. (F-10)"""
    out = decisions.groupBy(by).agg(F.count("*").alias("proposed"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.sum("value_at_stake").alias("value_at_stake"))
    return out.withColumn("acceptance_rate", F.col("accepted") / F.col("proposed"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """What two runs have in common, from fingerprints of inputs, settings and code: one row each. (X-01)"""
    rows = a.select(*[F.col(c).alias(f"a_{c}") for c in ("inputs", "settings", "code")]).crossJoin(b.select(*[F.col(c).alias(f"b_{c}") for c in ("inputs", "settings", "code")]))
    i, s, c = (F.col(f"a_{x}").eqNullSafe(F.col(f"b_{x}")) for x in ("inputs", "settings", "code"))
    basis = F.when(i & s & c, "identical").when(i & c & ~s, "scenario").when(s & c & ~i, "new_data").otherwise("mixed")
    return rows.select(i.alias("same_inputs"), s.alias("same_settings"), c.alias("same_code"), basis.alias("basis"))


def review_list(items: DataFrame, flags: dict[str, Column], value: str, top: int = 20) -> DataFrame:
    """The `top` items of each kind of disagreement, by absolute value, with totals. (X-02) A top-k report."""
    marks = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]), lambda x: x.isNotNull())
    rows = items.select("sku", F.col(value).alias("value"), F.explode(marks).alias("flag"))
    order = W.partitionBy("flag").orderBy(F.desc(F.abs("value")), "sku")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("flagged", F.count("*").over(W.partitionBy("flag")))
    return rows.where(F.col("place") <= top)


def item_detail(series: DataFrame, forecast: DataFrame, sku: str) -> DataFrame:
    """History and forecast of one item as (period, kind, value). (X-03)"""
    past = series.where(F.col("sku") == sku).select("period", F.lit("history").alias("kind"), F.col("qty").alias("value"))
    return past.unionByName(forecast.where(F.col("sku") == sku).select("period", F.lit("forecast").alias("kind"), F.col("forecast_qty").alias("value")))


def parameter_pairs(rows: DataFrame, sku: str | None = None) -> DataFrame:
    """(sku, parameter, in_force, suggested): each suggested parameter beside the one in force, as text, and whether they agree. (X-03)

    rows: sku and, for each parameter p, columns `p` and `suggested_p`; a parameter without a present value has null there.
    """
    names = [c.removeprefix("suggested_") for c in rows.columns if c.startswith("suggested_")]
    rows = rows if sku is None else rows.where(F.col("sku") == sku)
    pair = lambda p: F.struct(F.lit(p).alias("parameter"), (F.col(p) if p in rows.columns else F.lit(None)).cast("string").alias("in_force"), F.col(f"suggested_{p}").cast("string").alias("suggested"))
    pairs = rows.select("sku", F.explode(F.array(*[pair(p) for p in names])).alias("p")).select("sku", "p.*")
    return pairs.withColumn("agrees", F.col("in_force").eqNullSafe(F.col("suggested")))
