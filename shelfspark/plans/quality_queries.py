"""Queries and oracles of the quality section."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import quality as Q
from shelfspark.plans.conform_queries import raw
from shelfspark.plans.demand_queries import series
from shelfspark.plans.fixtures import ORACLE_VIEWS, query, tidy, view
from shelfspark.plans.supply_queries import AT, at

ORACLE_VIEWS["q_cells"] = """
SELECT 'sku' AS column_name, sku AS value FROM fx_po_history UNION ALL SELECT 'po_qty', po_qty::VARCHAR FROM fx_po_history UNION ALL SELECT 'receive_date', receive_date::VARCHAR FROM fx_po_history
UNION ALL SELECT 'incoterm', incoterm FROM fx_po_history"""
ORACLE_VIEWS["q_text"] = """
SELECT 'qty_text' AS column_name, qty_text AS value FROM c_raw UNION ALL SELECT 'date_text', date_text FROM c_raw UNION ALL SELECT 'code_text', code_text FROM c_raw"""


def po(spark, sf_dir):
    return view(spark, sf_dir, "fx_po_history")


def texts(spark, sf_dir):
    return raw(spark, sf_dir).select("qty_text", "date_text", "code_text")


@query("""SELECT column_name, rows, non_null, round(1 - non_null / rows, 6) AS null_rate, distinct_values, round(distinct_values / non_null, 6) AS distinct_rate,
  CASE WHEN numbers / non_null >= 0.9 THEN 'number' WHEN dates / non_null >= 0.8 THEN 'date' ELSE 'text' END AS inferred_type, lo AS min_number, hi AS max_number,
  round(neg / non_null, 6) AS negative_rate, round(zero / non_null, 6) AS zero_rate, CASE WHEN distinct_values <= 25 AND NOT numbers / non_null >= 0.9 AND NOT dates / non_null >= 0.8 THEN cats END AS categories
FROM (SELECT column_name, string_agg(DISTINCT trim(value), ', ' ORDER BY trim(value)) AS cats, count(*) AS rows, count(value) AS non_null, count(DISTINCT value) AS distinct_values, count(n) AS numbers, count(d) AS dates, min(n) AS lo, max(n) AS hi, count(*) FILTER (n < 0) AS neg,
  count(*) FILTER (n = 0) AS zero FROM (SELECT *, try_cast(value AS DOUBLE) AS n, try_cast(value AS DATE) AS d FROM q_cells) GROUP BY column_name)""")
def q01_profile(spark, sf_dir):
    found = Q.profile(po(spark, sf_dir).select("sku", "po_qty", "receive_date", "incoterm"))
    return tidy(found.withColumn("categories", F.array_join("categories", ", ")))


@query("""SELECT column_name, count(*) AS n, count(*) FILTER (f = 'iso_date') AS iso_date, count(*) FILTER (f = 'delimited_date') AS delimited_date, count(*) FILTER (f = 'eu_number') AS eu_number,
  count(*) FILTER (f = 'us_number') AS us_number, count(*) FILTER (f = 'plain_number') AS plain_number, count(*) FILTER (f = 'text') AS text, false AS mixed_dates, false AS mixed_numbers
FROM (SELECT column_name, CASE WHEN regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}') THEN 'iso_date' WHEN regexp_matches(t, '^\\d{1,2}[/.]\\d{1,2}[/.]\\d{2,4}$') THEN 'delimited_date'
  WHEN regexp_matches(t, '^[+-]?\\d{1,3}(\\.\\d{3})*,\\d+$') THEN 'eu_number' WHEN regexp_matches(t, '^[+-]?\\d{1,3}(,\\d{3})+(\\.\\d+)?$') THEN 'us_number' WHEN regexp_matches(t, '^[+-]?\\d+(\\.\\d+)?$') THEN 'plain_number'
  ELSE 'text' END AS f FROM (SELECT column_name, trim(value) AS t FROM q_text WHERE value IS NOT NULL)) GROUP BY column_name""")
def q02_representation_mix(spark, sf_dir):
    return Q.representation_mix(texts(spark, sf_dir))


@query("""SELECT column_name, count(*) FILTER (try_cast(regexp_extract(t, '^(\\d{1,2})[/.](\\d{1,2})[/.]\\d{2,4}$', 1) AS INT) > 12) AS day_first,
  count(*) FILTER (try_cast(regexp_extract(t, '^(\\d{1,2})[/.](\\d{1,2})[/.]\\d{2,4}$', 2) AS INT) > 12) AS month_first,
  count(*) FILTER (regexp_matches(t, '^[+-]?\\d{1,3}(\\.\\d{3})*,\\d+$')) AS decimal_comma, count(*) FILTER (regexp_matches(t, '^[+-]?\\d{1,3}(,\\d{3})+(\\.\\d+)?$')
    AND NOT regexp_matches(t, '^[+-]?\\d{1,3}(\\.\\d{3})*,\\d+$')) AS decimal_point FROM (SELECT column_name, trim(value) AS t FROM q_text WHERE value IS NOT NULL) GROUP BY column_name""")
def q03_order_evidence(spark, sf_dir):
    return Q.order_evidence(texts(spark, sf_dir))


@query("""SELECT column_name, mask, n, place FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, mask) AS place FROM (
SELECT column_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[[:alpha:]]', 'A', 'g'), '[0-9]', '9', 'g'), 'AA+', 'A+', 'g'), '99+', '9+', 'g') AS mask, count(*) AS n
FROM (SELECT 'sku' AS column_name, sku AS value FROM fx_sales UNION ALL SELECT 'country', country FROM fx_sales) GROUP BY ALL)) WHERE place <= 3""")
def q04_top_masks(spark, sf_dir):
    return Q.top_masks(view(spark, sf_dir, "fx_sales").select("sku", "country"))


@query("SELECT count(*) AS n, count(DISTINCT so_line_number) AS kinds, true AS line_number_like FROM fx_sales")
def q05_line_number_like(spark, sf_dir):
    return Q.line_number_like(view(spark, sf_dir, "fx_sales"), "so_line_number")


@query("SELECT round(avg(CASE WHEN regexp_matches(c, '^0{2,}\\d+$') AND length(c) >= 8 THEN 1.0 ELSE 0 END), 6) AS share, avg(CASE WHEN regexp_matches(c, '^0{2,}\\d+$') AND length(c) >= 8 THEN 1.0 ELSE 0 END) >= 0.8 AS zero_padded FROM (SELECT lpad(part::VARCHAR, 9, '0') AS c FROM fx_sales)")
def q06_zero_padded(spark, sf_dir):
    return tidy(Q.zero_padded(view(spark, sf_dir, "fx_sales").select(F.lpad(F.col("part").cast("string"), 9, "0").alias("c")), "c"))


@query("SELECT 2 AS size, 'sku+location_id' AS key")
def q07_candidate_keys(spark, sf_dir):
    return Q.candidate_keys(view(spark, sf_dir, "fx_inventory"), ["sku", "location_id", "qty_in_transit"])


@query("SELECT count(*) FILTER (so_line_number = 3) AS total_rows, count(*) AS rows FROM fx_sales")
def q08_total_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_sales").withColumn("name", F.when(F.col("so_line_number") == 3, "Grand Total").otherwise("totality"))
    return Q.total_rows(rows, ["sku", "name"])


@query("""SELECT n AS rows, k AS keys, round(n / k, 6) AS rows_per_key, CASE WHEN a >= b THEN 'part' ELSE 'qty' END AS discriminator FROM (SELECT count(*) AS n, count(DISTINCT (so_number, so_line_number)) AS k,
count(DISTINCT (so_number, so_line_number, part)) AS a, count(DISTINCT (so_number, so_line_number, qty)) AS b FROM fx_sales)""")
def q09_grain(spark, sf_dir):
    return tidy(Q.grain(view(spark, sf_dir, "fx_sales"), ["so_number", "so_line_number"], ["part", "qty"]))


@query("""SELECT 'non_empty' AS test, '' AS field, count(*) AS rows, 'pass' AS severity FROM fx_po_history UNION ALL SELECT 'required', 'supplier', 0, 'pass'
UNION ALL SELECT 'required', 'receive_date', count(*) FILTER (receive_date IS NULL), CASE WHEN count(*) FILTER (receive_date IS NULL) > 0.05 * count(*) THEN 'warn' ELSE 'pass' END FROM fx_po_history
UNION ALL SELECT 'required', 'moq', 0, 'block' UNION ALL SELECT 'unique_key', 'po_number+po_line_number', count(*) - count(DISTINCT (po_number, po_line_number)),
CASE WHEN count(*) > count(DISTINCT (po_number, po_line_number)) THEN 'warn' ELSE 'pass' END FROM fx_po_history""")
def q10_contract_tests(spark, sf_dir):
    return Q.contract_tests(po(spark, sf_dir), ["supplier", "receive_date", "moq"], ["po_number", "po_line_number"])


RULES = {"qty_positive": (["po_qty"], "po_qty >= 2"), "received_after_order": (["receive_date", "po_date"], "receive_date >= po_date"), "absent": (["nothing"], "nothing > 0")}
ORACLE_VIEWS["q_assert"] = """
SELECT 'qty_positive' AS assertion, count(*) AS judged, count(*) FILTER (po_qty < 2) AS failed FROM fx_po_history
UNION ALL SELECT 'received_after_order', count(receive_date), count(*) FILTER (receive_date < po_date) FROM fx_po_history"""


@query("SELECT assertion, judged, failed, round(failed / judged, 6) AS fail_rate FROM q_assert")
def q11_assertions(spark, sf_dir):
    return tidy(Q.assertions(po(spark, sf_dir), RULES))


@query("""SELECT measure, round(before, 6) AS before, round(after, 6) AS after, round((after - before) / abs(before), 6) AS change,
CASE WHEN abs((after - before) / before) > CASE WHEN measure = 'rows' THEN 0.5 ELSE 0.35 END THEN 'warn' ELSE 'pass' END AS severity FROM (
SELECT unnest(['rows', 'qty', 'amount']) AS measure, unnest([a, b, c]) AS before, unnest([d, e, f]) AS after FROM
(SELECT count(*)::DOUBLE AS a, avg(qty) AS b, avg(amount) AS c FROM fx_sales WHERE ship_date < DATE '1998-01-01'), (SELECT count(*)::DOUBLE AS d, avg(qty) AS e, avg(amount) AS f FROM fx_sales WHERE ship_date >= DATE '1998-01-01'))""")
def q12_load_drift(spark, sf_dir):
    s = view(spark, sf_dir, "fx_sales")
    return tidy(Q.load_drift(s.where("ship_date < date'1998-01-01'"), s.where("ship_date >= date'1998-01-01'"), ["qty", "amount"]))


@query("""SELECT document, count(*) AS items, round(avg(CASE WHEN seen > 1 THEN 1.0 ELSE 0 END), 6) AS share_known, CASE WHEN avg(CASE WHEN seen > 1 THEN 1.0 ELSE 0 END) < 0.2 THEN 'block' ELSE 'pass' END AS severity
FROM (SELECT *, count(*) OVER (PARTITION BY sku) AS seen FROM (SELECT DISTINCT 'sales' AS document, sku FROM fx_sales UNION ALL SELECT DISTINCT 'open_po', sku FROM fx_open_po UNION ALL SELECT DISTINCT 'master', sku FROM fx_item_master)) GROUP BY document""")
def q13_sku_agreement(spark, sf_dir):
    v = lambda n: view(spark, sf_dir, n)
    return tidy(Q.sku_agreement({"sales": v("fx_sales"), "open_po": v("fx_open_po"), "master": v("fx_item_master")}))


@query("""SELECT supplier, lines, undated, first_order, last_order, round(undated / lines, 6) AS share, CASE WHEN undated / lines > 0.1 THEN 'warn' ELSE 'pass' END AS severity FROM (SELECT supplier, count(*) AS lines,
count(*) FILTER (receive_date IS NULL) AS undated, min(po_date) AS first_order, max(po_date) AS last_order FROM fx_po_history GROUP BY supplier)""")
def q15_receipt_completeness(spark, sf_dir):
    return tidy(Q.receipt_completeness(po(spark, sf_dir)))


@query("SELECT 'semantics' AS stage, assertion AS check, 'block' AS severity, concat(failed, ' of ', judged, ' rows fail') AS evidence FROM q_assert WHERE failed / judged >= 0.01")
def q16_failing_assertions(spark, sf_dir):
    return Q.failing_assertions(Q.assertions(po(spark, sf_dir), RULES), 0.01)


@query(f"""SELECT count(*) AS items, median(active) AS median_active, {AT} - max(newest) AS age_days, CASE WHEN median(active) < 6 OR {AT} - max(newest) > 120 THEN 'warn' ELSE 'pass' END AS severity
FROM (SELECT sku, count(*) FILTER (qty > 0) AS active, max(period) AS newest FROM d_series GROUP BY sku)""")
def q18_demand_gate(spark, sf_dir):
    return Q.demand_gate(series(spark, sf_dir), at())


@query("""SELECT w AS wanted, c AS covered, round(c / w, 6) AS share, CASE WHEN c / w < 0.8 THEN 'severe' ELSE 'pass' END AS severity FROM (SELECT count(*) AS w, count(*) FILTER (sku IN (SELECT sku FROM fx_open_po)) AS c FROM (SELECT DISTINCT sku FROM fx_sales))""")
def q19_coverage(spark, sf_dir):
    return tidy(Q.coverage(view(spark, sf_dir, "fx_sales"), view(spark, sf_dir, "fx_open_po")))


@query("""SELECT 'qty' AS column_name, round(sum(qty), 2) AS total, round(median(qty), 2) AS median, max(qty) AS largest, 1.0::DOUBLE AS whole_share, NULL::DATE AS earliest, NULL::DATE AS latest, NULL::BIGINT AS ahead FROM fx_sales
UNION ALL SELECT 'amount', round(sum(amount), 2), round(median(amount), 2), max(amount), round(avg(CASE WHEN amount = floor(amount) THEN 1.0 ELSE 0 END), 6), NULL, NULL, NULL FROM fx_sales
UNION ALL SELECT 'customer_request_date', NULL, NULL, NULL, NULL, min(customer_request_date), max(customer_request_date), count(*) FILTER (customer_request_date > DATE '2000-01-01') FROM fx_sales""")
def q21_column_facts(spark, sf_dir):
    return tidy(Q.column_facts(view(spark, sf_dir, "fx_sales"), ["qty", "amount"], ["customer_request_date"], at()), total=2, median=2)


@query("SELECT a AS first, b AS shared, round(b / a, 6) AS share FROM (SELECT count(*) AS a, count(*) FILTER (po_number IN (SELECT po_number FROM fx_po_history)) AS b FROM (SELECT DISTINCT po_number FROM fx_open_po))")
def q23_shared_numbers(spark, sf_dir):
    return tidy(Q.shared_numbers(view(spark, sf_dir, "fx_open_po"), po(spark, sf_dir), "po_number"))


@query("""SELECT 'sku' AS field, count(sku) AS filled, 1.0::DOUBLE AS fill_rate FROM fx_po_history UNION ALL SELECT 'receive_date', count(receive_date), round(count(receive_date) / count(*), 6) FROM fx_po_history UNION ALL SELECT 'moq', 0, 0.0""")
def q24_field_fill(spark, sf_dir):
    return tidy(Q.field_fill(po(spark, sf_dir), ["sku", "receive_date", "moq"]))


@query("""SELECT 'sku' AS column_name, 0 AS nulls, 0.0::DOUBLE AS null_share, true AS required, 0 AS negatives UNION ALL SELECT 'po_qty', 0, 0.0, false, 0
UNION ALL SELECT 'receive_date', count(*) FILTER (receive_date IS NULL), round(count(*) FILTER (receive_date IS NULL) / count(*), 6), false, 0 FROM fx_po_history""")
def q27_reader_report(spark, sf_dir):
    return tidy(Q.reader_report(po(spark, sf_dir).select("sku", "po_qty", "receive_date"), ["sku"], ["po_qty"]))


@query(f"""SELECT count(*) AS rows, count(DISTINCT part) AS keys, min(ship_date) AS first_load, max(ship_date) AS last_load, ({AT} - max(ship_date)) * 24 AS hours_stale, count(DISTINCT ship_date) AS load_days,
min(length(part::VARCHAR)) AS min_length, max(length(part::VARCHAR)) AS max_length, 0 AS leading_zero, 0 AS untrimmed FROM fx_sales WHERE part > 0""")
def q28_table_probe(spark, sf_dir):
    return Q.table_probe(view(spark, sf_dir, "fx_sales").where("part > 0"), "part", "ship_date", at())


@query("""SELECT 'rows' AS measure, a.n AS first, b.n AS second, b.n - a.n AS difference FROM (SELECT count(*)::DOUBLE AS n FROM fx_sales) a, (SELECT count(*)::DOUBLE AS n FROM fx_sales WHERE qty > 3) b
UNION ALL SELECT 'qty', a.n, b.n, b.n - a.n FROM (SELECT sum(qty) AS n FROM fx_sales) a, (SELECT sum(qty) AS n FROM fx_sales WHERE qty > 3) b""")
def q29_compared_totals(spark, sf_dir):
    s = view(spark, sf_dir, "fx_sales")
    return Q.compare_totals(s, s.where("qty > 3"), ["qty"])


@query("""SELECT 'structure' AS stage, false AS passed, 'block' AS worst, 5 AS findings""")
def q26_gate(spark, sf_dir):
    tests = Q.contract_tests(po(spark, sf_dir), ["supplier", "receive_date", "moq"], ["po_number", "po_line_number"])
    return Q.gate(tests.select(F.lit("structure").alias("stage"), F.col("test").alias("check"), "severity"))


@query("SELECT count(*) AS n, count(DISTINCT so_line_number) AS kinds, true AS line_number_like, count(DISTINCT so_line_number) AS unknown, 'warn' AS severity FROM fx_sales")
def q14_ordinal_keys(spark, sf_dir):
    return Q.ordinal_keys(view(spark, sf_dir, "fx_sales"), "so_line_number", view(spark, sf_dir, "fx_item_master"))


@query("""SELECT n AS items, m AS missing, nf AS no_family, wf AS with_family, round(wf / n, 6) AS coverage, CASE WHEN wf = 0 THEN 'severe' WHEN wf / n < 0.8 THEN 'warn' ELSE 'pass' END AS severity FROM (
SELECT count(*) AS n, count(*) FILTER (m.sku IS NULL) AS m, count(*) FILTER (m.sku IS NOT NULL AND f IS NULL) AS nf, count(f) AS wf FROM (SELECT DISTINCT sku FROM fx_sales) s
LEFT JOIN (SELECT sku, CASE WHEN product_family <> 'pumps' THEN product_family END AS f FROM fx_item_master WHERE sku NOT LIKE 'S2-%') m ON m.sku = s.sku)""")
def q17_product_dimension(spark, sf_dir):
    master = view(spark, sf_dir, "fx_item_master").where("sku not like 'S2-%'").withColumn("product_family", F.when(F.col("product_family") != "pumps", F.col("product_family")))
    return tidy(Q.product_dimension(view(spark, sf_dir, "fx_sales"), master))


@query("SELECT 'no request date' AS assumption, count(*) FILTER (customer_request_date IS NULL) AS rows, round(count(*) FILTER (customer_request_date IS NULL) / count(*), 6) AS share, round(sum(amount) FILTER (customer_request_date IS NULL), 2) AS money, sum(qty) FILTER (customer_request_date IS NULL) AS qty FROM fx_sales")
def q22_exposure(spark, sf_dir):
    return tidy(Q.exposure(view(spark, sf_dir, "fx_sales"), "no request date", "customer_request_date is null", "amount", "qty"), money=2)


@query("SELECT * FROM (VALUES ('service', true), ('lead_time', true), ('ageing', false)) v(question, supported)")
def q25_capabilities(spark, sf_dir):
    fills = {"sales": Q.field_fill(view(spark, sf_dir, "fx_sales"), ["customer_request_date", "qty"]), "po": Q.field_fill(po(spark, sf_dir), ["receive_date", "po_date"]), "stock": Q.field_fill(view(spark, sf_dir, "fx_inventory"), ["inventory_age_days"])}
    return Q.capabilities(fills, {"service": {"sales": ["customer_request_date"]}, "lead_time": {"po": ["receive_date"]}, "ageing": {"stock": ["inventory_age_days"]}})
