"""Item attributes: one row an item from all sources, which source wins, where sources disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_table(classified: DataFrame, suppliers: DataFrame, master: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Demand, chosen supplier, costs and masters of each item; sigma is the forecast's error, else the deviation. (P-01)"""
    rows = classified.join(suppliers.select("sku", "supplier", "wma_lead_time_days", "lt_std_days", "sample_count"), "sku", "left")
    extra = [c for c in master.columns if c not in rows.columns and c != "sku"]
    rows = rows.join(master.select("sku", *extra), "sku", "left")
    if summary is not None:
        rows = rows.join(summary.select("sku", "forecast_rmse"), "sku", "left")
        sigma = F.coalesce(F.when(F.col("forecast_rmse") > 0, F.col("forecast_rmse")), F.col("demand_std_rolling"))
    else:
        sigma = F.col("demand_std_rolling")
    return rows.withColumn("demand_sigma", sigma)


def purchase_cost(po: DataFrame, months: int = 24) -> DataFrame:
    """Median of positive purchase costs of the last months, or of an item's whole history if it has none there. (P-02)"""
    cost = F.try_divide("po_amount", "po_qty")
    newest = po.agg(F.add_months(F.max("po_date"), -months).alias("_cut"))
    rows = po.crossJoin(F.broadcast(newest)).withColumn("_c", cost).where("_c > 0")  # one row
    return rows.groupBy("sku").agg(F.coalesce(F.median(F.when(F.col("po_date") >= F.col("_cut"), F.col("_c"))), F.median("_c")).alias("purchase_cost"))


def resolve_source(rows: DataFrame, out: str, sources: list[tuple[str, Column]], samples: Column, least: int = 3) -> DataFrame:
    """The first source that has a value; one measured on few samples yields to stated ones but is better than nothing. (P-03)

    sources: (label, value) in order of authority; the first is the measured one.
    """
    (first, measured), stated = sources[0], sources[1:]
    order = [F.when((samples >= least) & measured.isNotNull(), F.struct(measured.alias("v"), F.lit(first).alias("s")))]
    order += [F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(s).alias("s"))) for s, v in stated]
    order.append(F.when(measured.isNotNull(), F.struct(measured.alias("v"), F.lit(f"{first}_thin").alias("s"))))
    return rows.withColumn("_r", F.coalesce(*order)).withColumn(out, F.col("_r.v")).withColumn(f"{out}_source", F.coalesce("_r.s", F.lit("none"))).drop("_r")


def disagreements(rows: DataFrame, chosen: str, sources: dict[str, str], share: float = 0.25) -> DataFrame:
    """Sources whose value is more than `share` away from the chosen one. (P-04) sources: label -> column."""
    cells = rows.select("sku", F.col(chosen).alias("chosen"), F.col(f"{chosen}_source").alias("source"), *[F.col(c).cast("double").alias(s) for s, c in sources.items()])
    long = cells.unpivot(["sku", "chosen", "source"], list(sources), "other", "value")
    far = F.abs(F.col("value") - F.col("chosen")) > share * F.abs("chosen")
    return long.where(F.col("value").isNotNull() & (F.col("other") != F.col("source")) & far)


def disagreement_counts(rows: DataFrame, chosen: str, sources: dict[str, str], share: float = 0.25) -> DataFrame:
    """How many values could be compared with the chosen one, and how many differ. (P-04)"""
    cells = rows.select("sku", F.col(chosen).alias("chosen"), F.col(f"{chosen}_source").alias("source"), *[F.col(c).cast("double").alias(s) for s, c in sources.items()])
    long = cells.unpivot(["sku", "chosen", "source"], list(sources), "other", "value").where(F.col("value").isNotNull() & F.col("chosen").isNotNull() & (F.col("other") != F.col("source")))
    out = long.groupBy("other").agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("value") - F.col("chosen")) > share * F.abs("chosen")).alias("differ"))
    return out.withColumn("rate", F.try_divide("differ", "compared"))
