"""Demand: line preparation, monthly series, summaries, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Stocking tiers as (name, least active months of the last twelve, service level, z).
TIERS = (("stocking-high", 9, 0.95, 1.645), ("stocking-med", 6, 0.90, 1.282), ("non-stocking", 0, None, None))


def demand_lines(sales: DataFrame) -> DataFrame:
    """Lines that count as demand: dated by shipment, else by order; undated, returned and zero lines go. (D-01)"""
    dated = sales.withColumn("demand_date", F.coalesce("ship_date", "order_date"))
    return dated.where("demand_date is not null and qty > 0")


def demand_line_counts(sales: DataFrame) -> DataFrame:
    """How many lines D-01 drops, by cause."""
    undated = F.coalesce("ship_date", "order_date").isNull()
    return sales.agg(
        F.count("*").alias("lines"),
        F.count_if(undated).alias("undated"),
        F.count_if(~undated & (F.col("qty") < 0)).alias("returns"),
        F.count_if(~undated & (F.col("qty") == 0)).alias("zero"),
    )


def monthly_series(lines: DataFrame, key: str = "sku") -> DataFrame:
    """(sku, period, qty) for every sku and every month that occurs anywhere in the lines; missing months are 0. (D-02)"""
    return series_of(month_totals(lines, key))


def month_totals(lines: DataFrame, key: str = "sku") -> DataFrame:
    """A row a sku: its quantities by month (`held`), months without lines left out. The series in its smallest form. (D-02)"""
    summed = lines.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("sku"), F.trunc("demand_date", "MM").alias("period")).agg(F.sum("qty").alias("qty"))
    return summed.groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct("period", "qty"))).alias("held"))


def months_in(totals: DataFrame) -> DataFrame:
    """One row, the months that occur anywhere, in order. They come from the totals, so that a plan of both sums the lines once."""
    return totals.select(F.explode(F.map_keys("held")).alias("period")).agg(F.array_sort(F.collect_set("period")).alias("periods"))


def series_of(totals: DataFrame) -> DataFrame:
    """`month_totals` as a row a sku and month of the spine."""
    spine = totals.crossJoin(F.broadcast(months_in(totals))).select("sku", "held", F.explode("periods").alias("period"))  # one row
    return spine.select("sku", "period", F.coalesce(F.element_at("held", F.col("period")), F.lit(0.0)).alias("qty"))


def arrays_of(totals: DataFrame) -> DataFrame:
    """(sku, q): each item's quantities in order of period, as `forecast.as_arrays` of the series, without a shuffle."""
    rows = totals.crossJoin(F.broadcast(months_in(totals)))  # one row
    empty = F.map_from_arrays("periods", F.array_repeat(F.lit(0.0), F.size("periods")))
    filled = F.map_zip_with(empty, "held", lambda _, none, qty: F.coalesce(qty, none))  # in the order of the first map
    return rows.select("sku", F.map_values(filled).alias("q"))


def demand_summary(series: DataFrame, lines: DataFrame) -> DataFrame:
    """Mean of months with demand, sample deviation over all months, their ratio to the mean over all months, dates and totals. (D-03)"""
    by_sku = series.groupBy("sku").agg(
        F.avg(F.when(F.col("qty") > 0, F.col("qty"))).alias("demand_mean"),
        F.stddev_samp("qty").alias("demand_std"),
        F.avg("qty").alias("mean_all"),
        F.count_if(F.col("qty") > 0).alias("active_cycles"),
        F.count("*").alias("total_cycles"),
        F.sum("qty").alias("total_qty"),
    )
    dates = lines.groupBy("sku").agg(F.min("demand_date").alias("first_sale"), F.max("demand_date").alias("last_sale"))
    cv = F.when(F.col("mean_all") > 0, F.col("demand_std") / F.col("mean_all"))
    return by_sku.join(dates, "sku", "left").withColumn("demand_cv", cv).drop("mean_all")


def matrix_summary(series: DataFrame) -> DataFrame:
    """The same from a ready series: the ratio is to the mean of months with demand. (D-04)"""
    out = series.groupBy("sku").agg(
        F.coalesce(F.avg(F.when(F.col("qty") > 0, F.col("qty"))), F.lit(0.0)).alias("demand_mean"),
        F.stddev_samp("qty").alias("demand_std"),
        F.count_if(F.col("qty") > 0).alias("active_cycles"),
        F.count("*").alias("total_cycles"),
        F.sum("qty").alias("total_qty"),
    )
    return out.withColumn("demand_cv", F.when(F.col("demand_mean") > 0, F.col("demand_std") / F.col("demand_mean")))


def extend_population(summary: DataFrame, masters: list[tuple[str, DataFrame]]) -> DataFrame:
    """Items that only a master knows, added at zero demand and labelled by the first master that has them. (D-05)"""
    out = summary.select("sku", F.col("demand_mean"), F.lit("demand_history").alias("demand_source"))
    for name, master in masters:
        new = master.where("sku is not null").select("sku").distinct().join(out.select("sku"), "sku", "left_anti")
        out = out.unionByName(new.select("sku", F.lit(0.0).alias("demand_mean"), F.lit(name).alias("demand_source")))
    return out


def newest_date(tables: list[tuple[DataFrame, str]], today: Column) -> DataFrame:
    """Newest date over backward-looking columns, and its age on a given day. (D-06)"""
    parts = [t.agg(F.max(F.when(F.col(c) <= today, F.col(c))).alias("d")) for t, c in tables]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.max("d").alias("as_of")).withColumn("stale_days", F.datediff(today, "as_of"))


def last_periods(series: DataFrame, n: int) -> DataFrame:
    """The newest n months of the series' spine. The spine is the same for every item, so months are ranked once."""
    newest = series.select("period").distinct().orderBy(F.desc("period")).limit(n)
    return series.join(F.broadcast(newest), "period", "left_semi")


def pattern(stocking: Column, active: Column, total: Column, cv: Column) -> Column:
    """Name of the demand's shape: gaps first, then how much sizes vary. (D-08)"""
    steady = F.when(cv <= 0.5, "smooth").when(cv < 1.0, "variable").otherwise("erratic")
    return (
        F.when(stocking == "non-stocking", "non-stocking")
        .when(cv.isNull(), "unknown")
        .when(active / total >= 0.75, steady)
        .when(cv >= 1.0, "lumpy")
        .otherwise("intermittent")
    )


def classify(series: DataFrame, tiers=TIERS, cycles: int = 12) -> DataFrame:
    """Activity, means, deviation, tier, service level and pattern over the last `cycles` months. (D-07, D-08)"""
    by_sku = last_periods(series, cycles).groupBy("sku").agg(
        F.count_if(F.col("qty") > 0).alias("active"),
        F.count("*").alias("total"),
        F.avg("qty").alias("mean"),
        F.avg(F.when(F.col("qty") > 0, F.col("qty"))).alias("mean_active"),
        F.stddev_samp("qty").alias("std"),
    )
    tier = F.coalesce(*[F.when(F.col("active") >= least, F.struct(F.lit(name).alias("name"), F.lit(sl).cast("double").alias("sl"), F.lit(z).cast("double").alias("z"))) for name, least, sl, z in tiers])
    cv = F.when(F.col("mean") > 0, F.bround(F.col("std") / F.col("mean"), 3))
    out = by_sku.withColumn("tier", tier).withColumn("demand_cv", cv)
    return out.select(
        "sku",
        F.col("active").alias("active_cycles"),
        F.col("total").alias("total_cycles"),
        F.bround("mean", 2).alias("demand_mean_rolling"),
        F.bround(F.coalesce("mean_active", F.lit(0.0)), 2).alias("demand_mean_conditional"),
        F.bround("std", 2).alias("demand_std_rolling"),
        "demand_cv",
        F.col("tier.name").alias("stocking_class"),
        F.col("tier.sl").alias("service_level"),
        F.col("tier.z").alias("z_score"),
        pattern(F.col("tier.name"), F.col("active"), F.col("total"), F.col("demand_cv")).alias("demand_pattern"),
    )


def suggest_policy(classified: DataFrame) -> DataFrame:
    """Make to stock or to order by how demand behaved, with the evidence; null where there is no series. (D-09)"""
    share = F.col("active_cycles") / F.col("total_cycles")
    cv = F.when(F.col("demand_cv").isNotNull(), F.format_string(", CV %.2f", F.floor(F.col("demand_cv") * 100 + 0.5) / 100)).otherwise(", no CV (no demand)")
    evidence = F.concat(F.format_string("demand in %d/%d months", "active_cycles", "total_cycles"), cv)
    sporadic = F.col("stocking_class") == "non-stocking"
    has = F.col("total_cycles") > 0
    recurs = F.concat(evidence, F.format_string(" - recurs in %.0f%% of months", share * 100))
    return classified.withColumn("suggested_policy", F.when(has, F.when(sporadic, "MTO").otherwise("MTS"))).withColumn(
        "policy_basis", F.when(has, F.when(sporadic, F.concat(evidence, F.lit(" - too sporadic to hold"))).otherwise(recurs))
    )


def policy_conflicts(classified: DataFrame, master: DataFrame) -> DataFrame:
    """How many items are held to order but recur, or held to stock but sporadic. (D-10)"""
    both = classified.join(master.select("sku", "stocking_policy"), "sku")
    sporadic = F.col("stocking_class") == "non-stocking"
    kind = F.when((F.col("stocking_policy") == "MTO") & ~sporadic, "held MTO, recurs").when((F.col("stocking_policy") == "MTS") & sporadic, "held MTS, sporadic").otherwise("agrees")
    return both.groupBy(kind.alias("finding")).agg(F.count("*").alias("items"))


def _numbered(series: DataFrame) -> DataFrame:
    return series.withColumn("i", F.row_number().over(W.partitionBy("sku").orderBy("period")))


def demand_shape(series: DataFrame) -> DataFrame:
    """Mean size of months with demand, and mean gap between them, the gap after the last one included; at least 1. (D-11)"""
    rows = _numbered(series).withColumn("n", F.count("*").over(W.partitionBy("sku")))
    hit = rows.where("qty > 0")
    before = F.lag("i").over(W.partitionBy("sku").orderBy("i"))
    gaps = hit.withColumn("gap", F.col("i") - before)
    out = gaps.groupBy("sku").agg(F.avg("qty").alias("mean_size"), F.sum("gap").alias("gaps"), F.count("gap").alias("k"), (F.max("n") - F.max("i")).alias("trailing"))
    total, count = F.coalesce("gaps", F.lit(0)) + F.col("trailing"), F.col("k") + F.when(F.col("trailing") > 0, 1).otherwise(0)
    return out.select("sku", "mean_size", F.greatest(F.lit(1.0), F.coalesce(F.try_divide(total, count), F.lit(1.0))).alias("mean_gap"))


def density_since_first(series: DataFrame) -> DataFrame:
    """Share of months with demand since the first such month; null for items without any. (D-12)"""
    first = F.min(F.when(F.col("qty") > 0, F.col("period"))).over(W.partitionBy("sku"))
    rows = series.withColumn("first", first)
    alive = F.when(F.col("period") >= F.col("first"), (F.col("qty") > 0).cast("double"))
    return rows.groupBy("sku").agg(F.avg(alive).alias("density"))


def trend_test(series: DataFrame, drift: float = 0.2, t_least: float = 2.0) -> DataFrame:
    """Least-squares slope; a trend moves the mean by `drift` over the window and stands out of the noise. (D-13)"""
    rows = _numbered(series).withColumn("x", F.col("i").cast("double"))
    out = rows.groupBy("sku").agg(
        F.count("*").alias("n"),
        F.avg("qty").alias("mean"),
        F.regr_slope("qty", "x").alias("slope"),
        F.regr_sxx("qty", "x").alias("sxx"),
        F.regr_syy("qty", "x").alias("syy"),
        F.regr_sxy("qty", "x").alias("sxy"),
    )
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    error = F.sqrt(F.try_divide(rest, F.col("n") - 2) / F.col("sxx"))
    t = F.when(error > 1e-12, F.abs(F.col("slope")) / error)
    moved = F.abs(F.col("slope")) * (F.col("n") - 1) >= drift * F.abs(F.col("mean"))
    is_trend = (F.col("n") >= 3) & (F.abs(F.col("slope")) > 1e-12) & moved & (t.isNull() | (t >= t_least))
    return out.select("sku", "slope", F.coalesce(is_trend, F.lit(False)).alias("has_trend"))


def season_test(series: DataFrame, lags: tuple[int, ...] = (3, 4, 6, 12), least: float = 0.3, z: float = 2.5) -> DataFrame:
    """The first lag whose autocorrelation of month-to-month changes is high enough; null for none. (D-14)"""
    by_sku = W.partitionBy("sku").orderBy("period")
    rows = series.withColumn("d", F.col("qty") - F.lag("qty").over(by_sku)).where("d is not null")
    rows = rows.withColumn("e", F.col("d") - F.avg("d").over(W.partitionBy("sku")))
    for m in lags:
        rows = rows.withColumn(f"e{m}", F.col("e") * F.lag("e", m).over(by_sku))
    out = rows.groupBy("sku").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("ee"), *[F.sum(f"e{m}").alias(f"s{m}") for m in lags])
    bound = F.greatest(F.lit(least), z / F.sqrt("n"))
    hit = [F.when((F.col("n") + 1 >= 2 * m) & (F.try_divide(F.col(f"s{m}"), F.col("ee")) >= bound), m) for m in lags]
    return out.select("sku", F.coalesce(*hit).alias("season"))
