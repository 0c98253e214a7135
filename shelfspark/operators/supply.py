"""Supply: lead time, inbound schedule, order backlog, position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Terms under which goods in transit belong to the buyer.
BUYER_OWNED = ("EXW", "FCA", "FOB", "FAS", "CFR", "CIF", "CPT", "CIP")


def mode_of(column: str) -> Column:
    """Most frequent value; the smallest of several."""
    return F.expr(f"mode() within group (order by {column})")


def sane_lead_times(po: DataFrame, drop: bool = False, most: int = 730) -> DataFrame:
    """Lead time in days from order to receipt; outside (0, most] it is null, or the row goes. (C-24, S-01)"""
    rows = po.where("sku is not null and supplier is not null and po_date is not null")
    days = F.datediff("receive_date", "po_date").cast("double")
    rows = rows.withColumn("lead_time_days", F.when((days > 0) & (days <= most), days))
    return rows.where("lead_time_days is not null") if drop else rows


def line_lead_times(po: DataFrame, transit: Column) -> DataFrame:
    """Lead time by the best clock: stated if most rows have a valid one, else receipt, else confirmed dispatch plus transit. (S-01)"""
    ok = lambda c: (c > 0) & (c <= 730)
    share = po.agg((F.count_if(ok(F.col("stated_days"))) / F.count("*") > 0.5).alias("use_stated"))
    rows = po.crossJoin(F.broadcast(share))  # one row
    receipt = F.datediff("receive_date", "po_date").cast("double")
    dispatch = F.datediff("confirmed_date", "po_date") + transit
    stated = F.when(F.col("use_stated") & ok(F.col("stated_days")), F.col("stated_days"))
    best = F.coalesce(stated, F.when(ok(receipt), receipt), F.when(ok(dispatch), dispatch))
    basis = F.when(stated.isNotNull(), "stated").when(ok(receipt), "receipt").when(ok(dispatch), "dispatch_plus_transit")
    return rows.withColumn("lead_time_days", best).withColumn("lt_basis", basis).drop("use_stated")


def transit_by_prefix(suppliers: DataFrame, table: DataFrame) -> DataFrame:
    """Transit days and mode of the longest matching name prefix, else of `*`. (S-02) The table has a row for each prefix."""
    starts = (F.col("prefix") == "*") | F.startswith("supplier", "prefix")
    size = F.when(F.col("prefix") == "*", 0).otherwise(F.length("prefix"))
    best = suppliers.select("supplier").distinct().join(table, starts, "left")
    return best.groupBy("supplier").agg(F.max_by(F.struct("prefix", "days", "mode"), size).alias("t")).select("supplier", "t.*")


def supplier_lead_times(po: DataFrame, months: int = 6) -> DataFrame:
    """Lead time of each sku and supplier. (S-03)

    po: as of `sane_lead_times`. Receipts ordered in the last `months` before the newest order count, or all of a pair that
    has none there. The mean weighs receipts 1, 2, 3 ... by order date, then by receipt; what ties on both has the same lead
    time, so no order or line number is carried to settle it. The deviation is over the population.
    """
    newest = po.agg(F.add_months(F.max("po_date"), -months).alias("cutoff"))
    rows = po.where("lead_time_days is not null").crossJoin(F.broadcast(newest)).withColumn("recent", F.col("po_date") >= F.col("cutoff"))  # one row
    pair = W.partitionBy("sku", "supplier")
    rows = rows.withColumn("has_recent", F.max(F.col("recent").cast("int")).over(pair) == 1).where("recent or not has_recent")
    rows = rows.withColumn("w", F.row_number().over(pair.orderBy("po_date", "lead_time_days")))
    return rows.groupBy("sku", "supplier").agg(
        F.bround(F.sum(F.col("w") * F.col("lead_time_days")) / F.sum("w"), 1).alias("wma_lead_time_days"),
        F.bround(F.stddev_pop("lead_time_days"), 1).alias("lt_std_days"),
        F.count("*").alias("sample_count"),
        F.min("lead_time_days").alias("min_lt_days"),
        F.max("lead_time_days").alias("max_lt_days"),
        mode_of("incoterm").alias("incoterm"),
        F.when(F.max("has_recent"), "measured").otherwise("measured_outside_window").alias("lt_source"),
    )


def fill_lead_times(measured: DataFrame, masters: list[tuple[str, DataFrame]]) -> DataFrame:
    """Stated lead times for items without receipts, from the first master that has one. (S-04)"""
    out = measured.select("sku", "supplier", "wma_lead_time_days", "lt_std_days", F.col("sample_count"), "lt_source")
    for name, master in masters:
        new = master.where("sku is not null and lead_time_days > 0").join(out.select("sku").distinct(), "sku", "left_anti")
        new = new.select("sku", "supplier", F.col("lead_time_days").alias("wma_lead_time_days"), F.lit(0.0).alias("lt_std_days"), F.lit(0).cast("long").alias("sample_count"), F.lit(name).alias("lt_source"))
        out = out.unionByName(new)
    return out


def one_supplier(lead_times: DataFrame, by: str = "samples") -> DataFrame:
    """One row a sku: the supplier with most samples, or the one with the shortest lead time; then by name. (S-05)"""
    first = [F.desc("sample_count"), "wma_lead_time_days"] if by == "samples" else ["wma_lead_time_days", F.desc("sample_count")]
    order = W.partitionBy("sku").orderBy(*first, "supplier")
    return lead_times.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def estimate_deliveries(open_po: DataFrame, lead_times: DataFrame) -> DataFrame:
    """Delivery of undated orders: order date plus the sku's shortest lead time, else the median of all skus. (S-06)"""
    shortest = lead_times.groupBy("sku").agg(F.min("wma_lead_time_days").alias("lt"))
    middle = shortest.agg(F.median("lt").alias("mid"))
    rows = open_po.join(shortest, "sku", "left").crossJoin(F.broadcast(middle))  # one row
    guess = F.date_add("order_date", F.bround(F.coalesce("lt", "mid")).cast("int"))
    return rows.withColumn("estimated", F.col("committed_delivery").isNull()).withColumn("delivery", F.coalesce("committed_delivery", guess)).drop("lt", "mid")


def inbound_schedule(open_po: DataFrame, as_of: Column, horizon: int = 30) -> DataFrame:
    """Open purchase orders of each sku, past due, due in the horizon and beyond it. (S-07)"""
    due, q = F.col("committed_delivery"), F.col("open_qty")
    end = F.date_add(as_of, horizon)
    part = lambda cond: F.coalesce(F.sum(F.when(cond, q)), F.lit(0.0))
    ahead = F.min(F.when(due >= as_of, due))
    return open_po.where("sku is not null and open_qty > 0").groupBy("sku").agg(
        F.sum(q).alias("total_open_po_qty"),
        F.sum("open_amount").alias("open_po_amount"),
        F.count("*").alias("open_po_lines"),
        F.min(due).alias("earliest_delivery"),
        F.max(due).alias("latest_delivery"),
        part(due < as_of).alias("inbound_past_due_qty"),
        part((due >= as_of) & (due <= end)).alias("inbound_due_qty"),
        part(due > end).alias("inbound_beyond_qty"),
        F.datediff(ahead, as_of).cast("double").alias("days_to_next_arrival"),
        mode_of("incoterm").alias("incoterm"),
    )


def backlog(open_so: DataFrame, as_of: Column, horizon: int = 30) -> DataFrame:
    """Open sales orders of each sku; undated lines count as due. (S-08)"""
    due, q = F.col("customer_request_date"), F.col("open_qty")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, q)), F.lit(0.0))
    return open_so.where("sku is not null and open_qty > 0").groupBy("sku").agg(
        F.sum(q).alias("backlog_qty"),
        F.sum("open_amount").alias("backlog_amount"),
        F.count("*").alias("backlog_lines"),
        F.min(due).alias("earliest_request"),
        F.max(due).alias("latest_request"),
        part(due.isNull() | (due <= F.date_add(as_of, horizon))).alias("backlog_due_qty"),
        part(due < as_of).alias("backlog_past_due_qty"),
    )


def order_by_schedule(open_so: DataFrame, lead_times: DataFrame, as_of: Column, review_days: int = 30) -> DataFrame:
    """When open lines must be ordered: request date less lead time. (S-09)"""
    rows = open_so.where("open_qty > 0").join(lead_times.select("sku", "wma_lead_time_days"), "sku", "left")
    order_by = F.date_sub("customer_request_date", F.ceil(F.coalesce("wma_lead_time_days", F.lit(0.0))).cast("int"))
    rows = rows.withColumn("order_by", order_by)
    q = F.col("open_qty")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, q)), F.lit(0.0))
    now = F.col("order_by").isNull() | (F.col("order_by") <= F.date_add(as_of, review_days))
    return rows.groupBy("sku").agg(
        part(now).alias("mto_actionable_qty"),
        part(F.col("order_by") < as_of).alias("mto_order_past_due_qty"),
        F.min("order_by").alias("mto_order_by"),
        F.min("customer_request_date").alias("mto_next_request"),
    )


def effective_position(inventory: DataFrame, inbound: DataFrame, lead_times: DataFrame) -> DataFrame:
    """Stock on hand, goods in transit that are the buyer's, and open purchase orders. (S-10)

    The term is the inbound orders' most frequent one, else the lead time's. Inventory has one row a sku.
    """
    terms = lead_times.groupBy("sku").agg(mode_of("incoterm").alias("lt_term"))
    rows = inventory.join(inbound.select("sku", "total_open_po_qty", F.col("incoterm").alias("po_term")), "sku", "left").join(terms, "sku", "left")
    mine = F.coalesce("po_term", "lt_term").isin(*BUYER_OWNED)
    rows = rows.withColumn("qty_in_transit_adj", F.when(mine, F.coalesce("qty_in_transit", F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("total_open_po_qty", F.coalesce("total_open_po_qty", F.lit(0.0)))
    position = F.coalesce("qty_on_hand", F.lit(0.0)) + F.col("qty_in_transit_adj") + F.col("total_open_po_qty")
    return rows.select("sku", "qty_on_hand", "qty_in_transit_adj", "total_open_po_qty", position.alias("effective_position"))


def one_unit(sources: list[DataFrame]) -> DataFrame:
    """One unit of measure a sku, from the first source that has one. (S-11)"""
    rows = None
    for i, s in enumerate(sources):
        part = s.where("sku is not null and uom is not null").select("sku", "uom", F.lit(i).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("sku").agg(F.min(F.struct("rank", "uom")).alias("x")).select("sku", "x.uom")


def rounded_quantity(qty: Column, uom: Column, continuous: tuple[str, ...] = ("KG", "M", "L", "M2", "M3", "T")) -> Column:
    """Whole units, half to even, unless the unit is a continuous measure: then one digit. (S-12)"""
    return F.when(F.upper(F.trim(uom)).isin(*continuous), F.bround(qty, 1)).otherwise(F.bround(qty, 0))


def consolidate(inventory: DataFrame) -> DataFrame:
    """One row a sku: additive measures summed, others from the first location, locations listed. (C-32)"""
    return inventory.where("sku is not null").groupBy("sku").agg(
        F.sum("qty_on_hand").alias("qty_on_hand"),
        F.sum("qty_in_transit").alias("qty_in_transit"),
        F.min_by("unit_cost", "location_id").alias("unit_cost"),
        F.max("snapshot_date").alias("snapshot_date"),
        F.array_join(F.array_sort(F.collect_set("location_id")), ",").alias("location_id"),
    )


#: Measures of a bin's contents: what is withheld from the position with the bin.
BIN_CONTENTS = ("qty_on_hand", "inventory_value")


def split_by_status(inventory: DataFrame, statuses: dict[str, str], wildcard: str | None = None) -> DataFrame:
    """Stock in places that may not be sold moves from the netting measures to reported ones; goods in transit stay. (C-31)

    statuses: location code -> status; only `sellable` nets. The wildcard answers for codes that are not declared.
    The job fails where several codes are in use and one of them is undeclared: stock of unknown status must not be summed.
    """
    code = F.upper(F.trim(F.coalesce(F.col("location_id").cast("string"), F.lit(""))))
    declared = {k.strip().upper(): v for k, v in statuses.items()}
    if wildcard is None:
        used = inventory.select(code.alias("code")).where("code <> ''")
        facts = used.agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.min(F.when(~F.col("code").isin(*declared), F.col("code"))).alias("unknown"))
        said = F.raise_error(F.concat(F.lit("stock locations without a declared status, for example "), "unknown")).cast("boolean")
        ok = facts.select(F.when((F.col("lo") < F.col("hi")) & F.col("unknown").isNotNull(), said).otherwise(True).alias("_ok"))
        columns = inventory.columns
        inventory = inventory.crossJoin(F.broadcast(ok)).where("_ok").select(*columns)  # one row
    known = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv]) if declared else F.create_map().cast("map<string,string>")
    status = F.when(code == "", F.lit("sellable")).otherwise(F.coalesce(known[code], F.lit(wildcard), F.lit("sellable")))
    held = status != "sellable"
    measure = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in inventory.columns else F.lit(0.0)
    kinds = sorted(({*declared.values()} | ({wildcard} if wildcard else set())) - {"sellable"})
    return inventory.select(
        *[F.when(held, 0.0).otherwise(F.col(c)).alias(c) if c in BIN_CONTENTS else F.col(c) for c in inventory.columns],
        F.when(held, measure("qty_on_hand")).otherwise(0.0).alias("qty_not_sellable"), F.when(held, measure("inventory_value")).otherwise(0.0).alias("value_not_sellable"),
        F.when(held, code).otherwise("").alias("stock_locations_excluded"), *[F.when(status == k, measure("qty_on_hand")).otherwise(0.0).alias(f"qty_{k}") for k in kinds],
    )
