"""Policy profile of items, the policy it implies, and suggested parameters with their effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.policy import z_of
from shelfspark.operators.replenish import economic_order_quantity

#: Review periods that a suggestion may name.
LADDER = (7, 14, 30, 60, 90)

#: Suggestion rules in order, later ones win: (id, predicate, what they set).
RULES = (
    ("S-001", "abc_class in ('A', 'B', 'C')", {"service_level": 0.95}),
    ("S-002", "abc_class = 'A'", {"service_level": 0.98}),
    ("S-003", "abc_class = 'C'", {"service_level": 0.90}),
    ("S-004", "demand_pattern in ('erratic', 'lumpy') and stocking_class <> 'non-stocking'", {"replenishment_method": "reorder_point"}),
    ("S-005", "abc_class = 'C' and unit_cost < 20 and stocking_class <> 'non-stocking'", {"replenishment_method": "min_max", "review_period_days": 90.0}),
    ("S-006", "lead_time_days > 90", {"review_period_days": 30.0}),
    ("S-007", "lt_sigma_days > 0.5 * lead_time_days and lead_time_days > 0", {"review_period_days": 14.0}),
    ("S-008", "stocking_class = 'non-stocking'", {"replenishment_method": "make_to_order", "service_level": 0.0}),
)


def canonical_policy(c: Column) -> Column:
    """Method names in one spelling; none is periodic. min_max is the older name of reorder_point."""
    t = F.lower(F.trim(c))
    return F.when(t.isNull(), "periodic").when(t == "min_max", "reorder_point").otherwise(t)


def policy_profile(params: DataFrame, backlog: DataFrame | None = None) -> DataFrame:
    """Ten axes that describe how an item behaves and is planned, with evidence where it is measured. (P-10)

    params: sku, demand_cv, total_cycles, active_cycles, demand_pattern, demand_mean, lead_time_days, lt_sigma_days,
    lt_samples, review_period_days, min_order_qty, order_multiple, stock_locations, applied_rules. Without a backlog the
    axes that need one say so.
    """
    rows = params
    if backlog is not None:
        rows = rows.join(backlog.select("sku", F.col("backlog_due_qty").alias("_due")), "sku", "left").fillna(0.0, ["_due"])
    else:
        rows = rows.withColumn("_due", F.lit(None).cast("double"))
    cv, lt, sigma, samples = F.col("demand_cv"), F.col("lead_time_days"), F.coalesce("lt_sigma_days", F.lit(0.0)), F.coalesce("lt_samples", F.lit(0))
    covered = F.coalesce(F.try_divide("_due", "demand_mean"), F.lit(0.0))
    booked = F.coalesce(F.col("_due") > 0, F.lit(False))
    no_lt = lt.isNull() | (lt <= 0)
    many = F.coalesce(F.size(F.split("stock_locations", ",")), F.lit(1)) > 1
    lots = (F.coalesce("min_order_qty", F.lit(0.0)) > 0) | (F.coalesce("order_multiple", F.lit(1.0)) > 1)
    return rows.select(
        "sku",
        F.when(cv.isNull(), "unknown").when(cv <= 0.1, "constant").otherwise("variable").alias("demand_variability"),
        F.when(covered >= 1, "known").when(booked, "mixed").otherwise("random").alias("demand_certainty"),
        F.when(booked, F.format_string("order book covers %.0f%% of a cycle", F.bround(covered * 100, 0))).when(F.lit(backlog is not None), "no firm orders on the book").otherwise("no order book supplied").alias("demand_certainty_evidence"),
        F.coalesce("demand_pattern", F.lit("unknown")).alias("demand_continuity"),
        F.format_string("demand in %d/%d cycles", "active_cycles", "total_cycles").alias("demand_continuity_evidence"),
        F.when(no_lt, "unknown").when(samples < 3, "thinly-sampled").when(F.coalesce(F.try_divide(sigma, lt), F.lit(0.0)) >= 0.2, "variable").otherwise("constant").alias("lead_time_behaviour"),
        F.when(no_lt, "no lead time observed or stated").otherwise(F.format_string("%d receipts", samples)).alias("lead_time_evidence"),
        F.lit("independent").alias("item_dependence"),
        F.lit("periodic").alias("review_mode"),
        F.when(F.length(F.coalesce("applied_rules", F.lit(""))) > 0, F.concat(F.lit("set by "), "applied_rules")).otherwise("parameter default").alias("review_evidence"),
        F.when(many, "merged-multi").otherwise("single").alias("location_scope"),
        F.when(lots, "lot-constrained").otherwise("unconstrained").alias("capacity"),
        F.lit("backordered" if backlog is not None else "unknown").alias("excess_demand"),
        F.lit("rolling").alias("planning_horizon"),
    )


def implied_policy(params: DataFrame) -> DataFrame:
    """The policy that class, value and demand imply, why, and whether it is the one in force. (P-11)"""
    to_order = F.coalesce(F.col("stocking_class") == "non-stocking", F.lit(False))
    cheap = F.coalesce((F.col("abc_class") == "C") & (F.col("unit_cost") < 20), F.lit(False))
    implied = F.when(to_order, "make_to_order").when(cheap, "reorder_point").otherwise("periodic")
    why = F.when(to_order, "too few demand cycles to hold stock against").when(cheap, "cheap C item: ordering costs more than holding").otherwise("variable demand, uncertain lead time, periodic review")
    in_force = canonical_policy(F.col("replenishment_method"))
    return params.select("sku", in_force.alias("policy_in_force"), implied.alias("policy_implied"), why.alias("because"), (in_force == implied).alias("agrees"))


def snapped(days: Column) -> Column:
    """The nearest step of the ladder by the logarithm; the shorter of two."""
    steps = F.array(*[F.struct(F.round(F.abs(F.log(days) - F.log(F.lit(float(x)))), 9).alias("d"), F.lit(float(x)).alias("x")) for x in LADDER])
    return F.when(days > 0, F.array_min(steps).x)


def suggest(params: DataFrame, order_cost: float = 350.0, holding_rate: float = 0.22) -> DataFrame:
    """Economic lot, the review period it implies, and what the rules make of it. (P-13)"""
    annual = F.greatest(F.coalesce("demand_mean", F.lit(0.0)) * 12, F.lit(0.0))
    eoq = economic_order_quantity(annual, F.col("unit_cost"), order_cost, holding_rate)
    rows = params.withColumn("eoq_qty", F.bround(eoq, 0)).withColumn("eoq_review_days", F.bround(F.try_divide(eoq, annual / 365), 0))
    values = {"review_period_days": F.coalesce(snapped(F.col("eoq_review_days")), F.col("review_period_days")), "replenishment_method": F.col("replenishment_method"), "service_level": F.col("service_level")}
    hits = []
    for name, scope, sets in RULES:  # a later rule wraps the earlier ones
        hit = F.coalesce(F.expr(scope), F.lit(False))
        hits.append(F.when(hit, F.lit(name)))
        for p, v in sets.items():
            values[p] = F.when(hit, F.lit(v)).otherwise(values[p])
    for p, v in values.items():
        rows = rows.withColumn(f"suggested_{p}", v)
    return rows.withColumn("applied_suggestions", F.concat_ws(",", *hits))


def _safety(service: Column, review: Column, method: Column) -> Column:
    exposure = (F.col("lead_time_days") + F.when(method.isin("periodic", "min_max"), review).otherwise(0.0)) / 30.0
    sigma = F.col("lt_sigma_days") / 30.0
    variance = exposure * F.col("demand_sigma") * F.col("demand_sigma") + F.col("demand_mean") * F.col("demand_mean") * sigma * sigma
    held = F.coalesce(F.col("stocking_class") != "non-stocking", F.lit(True))
    return F.when(held, F.bround(z_of(service) * F.sqrt(F.greatest(variance, F.lit(0.0))), 1)).otherwise(0.0)


def suggested_safety(rows: DataFrame) -> DataFrame:
    """Safety stock under the suggested parameters and the present ones, and the difference in units and money. (P-14)"""
    rows = rows.withColumn("suggested_safety_stock", _safety(F.col("suggested_service_level"), F.col("suggested_review_period_days"), F.col("suggested_replenishment_method")))
    rows = rows.withColumn("current_safety_stock", _safety(F.col("service_level"), F.col("review_period_days"), F.col("replenishment_method")))
    rows = rows.withColumn("ss_delta_qty", F.bround(F.col("suggested_safety_stock") - F.col("current_safety_stock"), 1))
    rows = rows.withColumn("suggested_ss_days", F.bround(F.try_divide("suggested_safety_stock", F.col("demand_mean") / 30.0), 0))
    return rows.withColumn("ss_delta_value", F.bround(F.col("ss_delta_qty") * F.coalesce("unit_cost", F.lit(0.0)), 2))


def against_planner(rows: DataFrame, planner: DataFrame, band: float = 0.1) -> DataFrame:
    """The suggestion beside the planner's own safety stock: difference, share and verdict. (P-15)"""
    both = rows.join(planner.select("sku", "planner_safety_stock"), "sku").where("planner_safety_stock is not null")
    delta = F.col("suggested_safety_stock") - F.col("planner_safety_stock")
    share = F.try_divide(delta, "planner_safety_stock")
    verdict = F.when(F.abs(delta) <= band * F.col("planner_safety_stock"), "agrees").when(delta > 0, "planner holds less").otherwise("planner holds more")
    return both.select("sku", "suggested_safety_stock", "planner_safety_stock", F.bround(delta, 1).alias("delta_qty"), share.alias("delta_share"), verdict.alias("verdict"))


def change_list(rows: DataFrame) -> DataFrame:
    """What a planner would change, as text. (P-16)"""
    def change(label: str, c: str) -> Column:
        new, old = F.col(f"suggested_{c}"), F.col(c)
        return F.when(~new.eqNullSafe(old), F.concat(F.lit(f"{label}: "), F.coalesce(old.cast("string"), F.lit("none")), F.lit(" to "), F.coalesce(new.cast("string"), F.lit("none"))))

    text = F.concat_ws("; ", change("service level", "service_level"), change("method", "replenishment_method"), change("review days", "review_period_days"))
    return rows.select("sku", F.when(F.length(text) > 0, text).otherwise("no change").alias("changes"))


def rule_hits(rows: DataFrame) -> DataFrame:
    """How many items each suggestion rule matched. (P-16)"""
    return rows.select(F.explode(F.filter(F.split("applied_suggestions", ","), lambda x: x != "")).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("items"))
