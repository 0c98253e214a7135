"""Ties of half-even rounding, how stock is dealt to tasks, and codes of more than six digits."""

from pyspark.sql import functions as F

from shelfspark.operators import policy, quality, replenish
from shelfspark.plans import attribute_queries, oracles


def tie(mean, days):
    """Whether a mean of two digits over days of one digit is an odd twentieth."""
    hundredths, tenths = round(mean * 100), round(days * 10)
    return hundredths * tenths % 1500 == 0 and hundredths * tenths // 1500 % 2 == 1


def nearest_even(mean, days):
    low = round(mean * 100) * round(days * 10) // 3000
    return (low + low % 2) / 10


TIES = [(m / 100, d / 10) for m in range(25, 3000, 25) for d in range(301, 1200, 7) if tie(m / 100, d / 10)]


def test_demand_over_exposure_rounds_ties_to_even(spark):
    items = spark.createDataFrame([(f"{i}", m, d - 30, 0.0, 0.0, "non-stocking", None) for i, (m, d) in enumerate(TIES)], "sku string, demand_mean_rolling double, wma_lead_time_days double, lt_std_days double, demand_std_rolling double, stocking_class string, z_score double")
    lead = items.select("sku", "wma_lead_time_days", "lt_std_days")
    found = replenish.safety_stock(items.drop("wma_lead_time_days", "lt_std_days"), lead).select("sku", "demand_during_exposure")
    got = {r[0]: r[1] for r in found.collect()}
    assert TIES and [got[f"{i}"] for i in range(len(TIES))] == [nearest_even(m, d) for m, d in TIES]


def test_pipeline_stock_rounds_ties_to_even(spark):
    few = [(m, d) for m in (4.0, 8.0, 12.0, 15.0, 20.0, 60.0) for d in (x / 10 for x in range(1, 900)) if round(m * 10) * round(d * 10) * 45 % 15000 == 0 and round(m * 10) * round(d * 10) * 45 // 15000 % 2 == 1]
    rows = [(f"{i}", m, 0.0, d, 0.0, 30.0, "periodic", None, 0.9, "FOB", 1.0, "non-stocking") for i, (m, d) in enumerate(few)]
    params = spark.createDataFrame(rows, "sku string, demand_mean double, demand_sigma double, lead_time_days double, lt_sigma_days double, review_period_days double, replenishment_method string, order_qty double, service_level double, incoterm string, unit_cost double, stocking_class string")
    none = spark.createDataFrame([], "sku string, qty double")
    got = {r.sku: r.pipeline_qty for r in policy.should_be(params, none).collect()}
    low = lambda m, d: round(m * 10) * round(d * 10) * 45 // 30000
    assert few and [got[f"{i}"] for i in range(len(few))] == [(low(m, d) + low(m, d) % 2) / 10 for m, d in few]


def test_an_item_meets_its_lines_in_one_task_after_any_join(spark):
    lines = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("S"), F.col("id") % 500).alias("sku"), F.lit("2000-01-01").cast("date").alias("customer_request_date"), F.format_string("%06d", "id").alias("line_order"), F.lit(10.0).alias("open_qty"))
    stock = spark.range(500).select(F.concat(F.lit("S"), "id").alias("sku"), F.lit(20.0).alias("qty_on_hand")).groupBy("sku").agg(F.max("qty_on_hand").alias("qty_on_hand"))
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        dealt = replenish.allocate(lines, stock)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        found = dealt.where("fillable").groupBy("sku").count().select("count").distinct().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [r[0] for r in found] == [2] and "REPARTITION_BY_COL" in plan


def test_part_numbers_of_seven_digits_stay_apart(spark, monkeypatch):
    rows = spark.range(1_000_000, 1_000_040).select(F.lit("S1-0").alias("sku"), F.col("id").alias("part"), F.lit("PERU").alias("country"))
    monkeypatch.setattr(attribute_queries, "view", lambda *_: rows)
    assert attribute_queries._codes(spark, "").select("erp_code").distinct().count() == 40


def test_the_detail_of_a_forecast_names_no_helper_column():
    import duckdb

    from shelfspark.plans.fixtures import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    assert "last" not in [c[0] for c in con.execute("DESCRIBE " + oracles()["d25_forecast_detail"]).fetchall()]


def test_order_evidence_reads_each_text_once(spark):
    texts = ["13.01.2000", "01/13/2000", "1.234,5", "1,234.5", "2000-01-01", "x", None, " 13.01.2000 "] * 3
    found = quality.order_evidence(spark.createDataFrame([(t,) for t in texts], "t string"))
    assert [tuple(r) for r in found.collect()] == [("t", 6, 3, 3, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
