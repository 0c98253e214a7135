"""Queries and oracles of the conforming section: text made from line items, small literal tables beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import conform as C
from shelfspark.plans.fixtures import ORACLE_VIEWS, query, tidy, view

#: Raw text as an extract would hold it, in SQL for both sides.
RAW = """
SELECT so_number, so_line_number, part, qty AS true_qty, amount AS true_amount, ship_date,
  CASE so_line_number WHEN 1 THEN concat(' ', CAST(CAST(qty AS INT) AS STRING), ' ') WHEN 2 THEN concat('1,', lpad(CAST(CAST(qty AS INT) AS STRING), 3, '0')) WHEN 3 THEN concat('(', CAST(CAST(qty AS INT) AS STRING), ')')
    WHEN 4 THEN 'n/a' WHEN 5 THEN concat(CAST(CAST(qty AS INT) AS STRING), 'x') ELSE CAST(CAST(qty AS INT) AS STRING) END AS qty_text,
  CASE WHEN so_line_number = 5 THEN 'no date' WHEN so_line_number % 2 = 0 THEN concat(CAST(day(ship_date) AS STRING), '/', CAST(month(ship_date) AS STRING), '/', CAST(year(ship_date) AS STRING))
    ELSE concat(CAST(day(ship_date) AS STRING), '.', CAST(month(ship_date) AS STRING), '.', CAST(year(ship_date) AS STRING)) END AS date_text,
  CASE WHEN so_line_number % 3 = 0 THEN concat('000', CAST(part AS STRING)) WHEN so_line_number % 3 = 1 THEN concat(' ab-', CAST(part AS STRING), ' ') ELSE concat(CAST(part AS STRING), '.0') END AS code_text,
  CASE customer % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'usd ' WHEN 2 THEN 'JPY' ELSE 'XXX' END AS currency,
  CASE WHEN so_line_number = 2 THEN 1.08 WHEN so_line_number = 4 THEN 55.0 END AS fx_rate,
  CASE so_line_number % 4 WHEN 0 THEN 'Open' WHEN 1 THEN ' CLOSED' WHEN 2 THEN 'part' ELSE 'odd' END AS status_text,
  CASE so_line_number % 5 WHEN 0 THEN 'Acme Ltd' WHEN 1 THEN 'ACME' WHEN 2 THEN 'acme inc.' WHEN 3 THEN 'Bolt & Co' ELSE 'bolt co' END AS maker, sku, customer
FROM fx_sales"""
ORACLE_VIEWS["c_raw"] = RAW.replace("STRING", "VARCHAR")
ORACLE_VIEWS["c_quotes"] = "SELECT * FROM (VALUES ('USD', DATE '1996-01-01', 0.9::DOUBLE), ('USD', DATE '1998-01-01', 0.8), ('JPY', DATE '1997-06-01', 0.007)) q(currency, effective_from, rate)"
ORACLE_VIEWS["c_conv"] = """
SELECT so_number, so_line_number, part, code, CASE WHEN code = 'EUR' THEN 1.0 WHEN plausible THEN fx_rate ELSE rate END AS fx_rate_applied,
  CASE WHEN code = 'EUR' THEN 'domestic' WHEN plausible THEN 'own' WHEN rate IS NOT NULL THEN 'table' ELSE 'unrated' END AS fx_basis, true_amount
FROM (SELECT *, coalesce(fx_rate > 0 AND fx_rate <> 1 AND (rate IS NULL OR (fx_rate <= 10 * rate AND fx_rate >= rate / 10)), false) AS plausible FROM (
  SELECT r.*, upper(trim(r.currency)) AS code, q.rate FROM c_raw r LEFT JOIN (
    SELECT currency, CASE WHEN row_number() OVER w = 1 THEN DATE '0001-01-01' ELSE effective_from END AS lo, coalesce(lead(effective_from) OVER w, DATE '9999-12-31') AS hi, rate
    FROM c_quotes WINDOW w AS (PARTITION BY currency ORDER BY effective_from)) q ON q.currency = upper(trim(r.currency)) AND r.ship_date >= q.lo AND r.ship_date < q.hi))"""


def raw(spark, sf_dir):
    return spark.sql(RAW.replace("FROM fx_sales", "FROM {s}"), s=view(spark, sf_dir, "fx_sales"))


KEY = ("so_number", "so_line_number", "part")


@query("SELECT so_number AS order_no, so_line_number AS line_no, qty_text AS qty FROM c_raw")
def c09_mapped_columns(spark, sf_dir):
    return C.map_columns(raw(spark, sf_dir), {"so_number": "order_no", "so_line_number": "line_no", "qty_text": "qty", "absent": "absent"})[0]


@query("""SELECT so_number, so_line_number, part, true_qty, CASE so_line_number WHEN 2 THEN 1000 + true_qty WHEN 3 THEN -true_qty WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE true_qty END AS qty FROM c_raw""")
def c10_parsed_numbers(spark, sf_dir):
    return raw(spark, sf_dir).select(*KEY, "true_qty", C.parse_number(F.col("qty_text")).alias("qty"))


@query("SELECT so_number, so_line_number, part, CASE WHEN so_line_number <> 5 THEN ship_date END AS parsed FROM c_raw")
def c11_parsed_dates(spark, sf_dir):
    return C.parse_dates(raw(spark, sf_dir), "date_text", "parsed").select(*KEY, "parsed")


@query("""SELECT so_number, so_line_number, part, CASE WHEN so_line_number <> 5 THEN ship_date END AS fixed FROM c_raw""")
def c12_mixed_dates(spark, sf_dir):
    # every third line went through a spreadsheet that read day and month the wrong way round where it could
    swapped = F.when(F.day("ship_date") <= 12, F.make_date(F.year("ship_date"), F.day("ship_date"), F.month("ship_date")))
    went = (F.col("so_line_number") == 3) & swapped.isNotNull()
    rows = raw(spark, sf_dir).withColumn("mixed", F.when(went, swapped.cast("string")).otherwise(F.col("date_text")))
    return C.repair_mixed_dates(rows, "mixed", "fixed").select(*KEY, "fixed")


@query("""SELECT so_number, so_line_number, part, CASE WHEN so_line_number % 3 = 1 THEN concat('AB-', part) ELSE part::VARCHAR END AS code FROM c_raw""")
def c13_material_numbers(spark, sf_dir):
    return raw(spark, sf_dir).select(*KEY, C.material_number(F.col("code_text")).alias("code"))


@query("""SELECT so_number, so_line_number, sum(true_qty) AS true_qty, round(sum(true_amount), 2) AS true_amount, round(sum(price * true_qty) / sum(true_qty), 7) AS price, min(part) AS part
FROM (SELECT *, true_amount / true_qty AS price FROM c_raw) GROUP BY so_number, so_line_number""")
def c14_rolled_up(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("price", F.col("true_amount") / F.col("true_qty"))
    rows = rows.select("so_number", "so_line_number", "true_qty", "true_amount", "price", "part")
    return tidy(C.roll_up(rows, ["so_number", "so_line_number"], ["true_qty", "true_amount"], {"price": "true_qty"}, ["part"]), true_amount=2, price=7)


@query("SELECT so_number, so_line_number, min(part) AS part FROM c_raw GROUP BY so_number, so_line_number")
def c15_collapsed(spark, sf_dir):
    return C.collapse(raw(spark, sf_dir).select(*KEY), ["part"])


def _domain(spark, sf_dir):
    codes = spark.createDataFrame([("open", "open"), ("closed", "closed"), ("part", "open")], "code string, canonical string")
    return C.map_domain(raw(spark, sf_dir), "status_text", F.broadcast(codes), "unknown")


@query("SELECT so_number, so_line_number, part, CASE so_line_number % 4 WHEN 1 THEN 'closed' WHEN 3 THEN 'unknown' ELSE 'open' END AS status_text FROM c_raw")
def c16_mapped_codes(spark, sf_dir):
    return _domain(spark, sf_dir)[0].select(*KEY, "status_text")


@query("SELECT 'odd' AS code, count(*) AS rows FROM c_raw WHERE so_line_number % 4 = 3")
def c16_unmapped_codes(spark, sf_dir):
    return _domain(spark, sf_dir)[1]


@query("SELECT so_number, so_line_number, part, coalesce(fx_rate, true_qty * 2) AS fx_rate FROM c_raw")
def c17_derived_column(spark, sf_dir):
    found = C.first_derivation(raw(spark, sf_dir), "fx_rate", [(["absent"], "absent"), (["true_qty"], "true_qty * 2")])
    return found.select(*KEY, F.col("fx_rate").cast("double").alias("fx_rate"))


@query("SELECT so_number, so_line_number, part FROM c_raw WHERE fx_rate > 2 AND true_qty > 10")
def c18_filtered(spark, sf_dir):
    return C.apply_filters(raw(spark, sf_dir), [(["fx_rate"], "fx_rate > 2"), (["true_qty"], "true_qty > 10"), (["absent"], "absent > 0")])[0].select(*KEY)


@query("SELECT count(*) FILTER (NOT coalesce(fx_rate > 2, false)) AS removed_0, count(*) FILTER (NOT true_qty > 10) AS removed_1, count(*) AS rows FROM c_raw")
def c18_removed_counts(spark, sf_dir):
    return C.apply_filters(raw(spark, sf_dir), [(["fx_rate"], "fx_rate > 2"), (["true_qty"], "true_qty > 10")])[1]


@query("""SELECT sku, unnest([DATE '1999-10-01', DATE '1999-11-01', DATE '1999-12-01']) AS period, unnest([a, b, coalesce(c, 0)]) AS qty FROM (
SELECT sku, sum(qty) AS a, max(qty) AS b, CASE WHEN count(*) > 70 THEN min(qty) END AS c FROM fx_sales GROUP BY sku)""")
def c19_melted_periods(spark, sf_dir):
    wide = view(spark, sf_dir, "fx_sales").groupBy("sku").agg(F.sum("qty").alias("2999-10"), F.max("qty").alias("Nov-99"), F.when(F.count("*") > 70, F.min("qty")).alias("99M12"))
    return C.melt_periods(wide, ["sku"], {"2999-10": "1999-10-01", "Nov-99": "1999-11-01", "99M12": "1999-12-01"})


@query("SELECT so_number, so_line_number, part, CASE WHEN so_line_number % 2 = 0 THEN 'DC1' ELSE 'X' END AS location_id FROM c_raw")
def c23_default_location(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("location_id", F.when(F.col("so_line_number") % 2 == 1, "X"))
    return C.default_location(rows, "DC1").select(*KEY, "location_id")


@query("SELECT so_number, so_line_number, part, true_qty - 20 AS open_qty, fx_rate IS NULL AS undated FROM c_raw WHERE so_line_number % 4 <> 1 AND true_qty > 20")
def c25_open_purchase_lines(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("po_status", F.when(F.col("so_line_number") % 4 == 1, "Closed")).withColumn("order_qty", F.col("true_qty"))
    rows = rows.withColumn("delivered_qty", F.lit(20.0)).withColumn("committed_delivery", F.when(F.col("fx_rate").isNotNull(), F.col("ship_date")))
    return C.open_purchase_lines(rows).select(*KEY, "open_qty", "undated")


@query("SELECT so_number, so_line_number, sku, open_qty FROM fx_open_so WHERE sku IS NOT NULL AND open_qty > 0")
def c26_open_sales_lines(spark, sf_dir):
    return C.open_sales_lines(view(spark, sf_dir, "fx_open_so")).select("so_number", "so_line_number", "sku", "open_qty")


@query("""SELECT po_number, po_line_number, sku, part, receive_date FROM (SELECT *, bool_or(receive_date IS NOT NULL) OVER (PARTITION BY po_number, sku) AS a FROM fx_po_history) WHERE NOT a OR receive_date IS NOT NULL""")
def c27_confirmed_receipts(spark, sf_dir):
    return C.confirmed_receipts(view(spark, sf_dir, "fx_po_history"), ["po_number", "sku"]).select("po_number", "po_line_number", "sku", "part", "receive_date")


def _converted(spark, sf_dir):
    quotes = spark.sql("SELECT * FROM VALUES ('USD', DATE '1996-01-01', 0.9D), ('USD', DATE '1998-01-01', 0.8D), ('JPY', DATE '1997-06-01', 0.007D) AS q(currency, effective_from, rate)")
    rows = raw(spark, sf_dir).withColumn("fx_rate", F.col("fx_rate").cast("double")).withColumn("amount", F.col("true_amount"))
    return C.convert_currency(rows, quotes, ["amount"], "ship_date", "EUR")


@query("SELECT so_number, so_line_number, part, code AS currency_original, fx_basis, round(fx_rate_applied, 6) AS fx_rate_applied, round(true_amount * fx_rate_applied, 5) AS amount FROM c_conv")
def c28_converted_money(spark, sf_dir):
    return tidy(_converted(spark, sf_dir).select(*KEY, "currency_original", "fx_basis", "fx_rate_applied", "amount"), amount=5)


@query("""SELECT code AS currency, count(*) AS rows, count(*) FILTER (fx_basis = 'domestic') AS domestic, count(*) FILTER (fx_basis = 'own') AS own_rate, count(*) FILTER (fx_basis = 'table') AS table_rate,
count(*) FILTER (fx_basis = 'unrated') AS unrated, round(sum(true_amount * fx_rate_applied), 1) AS total_after FROM c_conv GROUP BY code""")
def c29_conversion_report(spark, sf_dir):
    return tidy(C.conversion_report(_converted(spark, sf_dir), "amount"), total_after=1)


@query("""SELECT maker, count(*) AS rows FROM (SELECT CASE WHEN so_line_number % 5 < 3 THEN a.best ELSE b.best END AS maker FROM c_raw
CROSS JOIN (SELECT arg_min(maker, (-n, length(maker), maker)) AS best FROM (SELECT maker, count(*) AS n FROM c_raw WHERE so_line_number % 5 < 3 GROUP BY maker)) a
CROSS JOIN (SELECT arg_min(maker, (-n, length(maker), maker)) AS best FROM (SELECT maker, count(*) AS n FROM c_raw WHERE so_line_number % 5 >= 3 GROUP BY maker)) b) GROUP BY maker""")
def c30_folded_spellings(spark, sf_dir):
    rows = raw(spark, sf_dir)
    return C.fold_spellings(rows, "maker").groupBy("maker").agg(F.count("*").alias("rows"))


def _pairs(spark, sf_dir):
    master = view(spark, sf_dir, "fx_item_master").select("sku").where("sku like '%-0'")
    n = F.regexp_extract("sku", r"S(\d+)-", 1).cast("int")
    rows = master.withColumn("n", n).where("n % 3 = 0")
    kind = F.when(F.col("n") % 12 == 0, "phase").otherwise("supersede")
    return rows.select(F.col("sku").alias("old_sku"), F.concat(F.lit("S"), F.col("n"), F.when(F.col("n") % 9 == 0, "-0").otherwise("-1")).alias("new_sku"), kind.alias("relation"), F.lit(2.0).alias("ratio"), F.lit("1997-01-01").cast("date").alias("effective_date"))


ORACLE_VIEWS["c_pairs"] = """
SELECT sku AS old_sku, concat('S', n, CASE WHEN n % 9 = 0 THEN '-0' ELSE '-1' END) AS new_sku, CASE WHEN n % 12 = 0 THEN 'phase' ELSE 'supersede' END AS relation, n
FROM (SELECT sku, regexp_extract(sku, 'S(\\d+)-', 1)::INT AS n FROM fx_item_master WHERE sku LIKE '%-0') WHERE n % 3 = 0"""


@query("SELECT old_sku, new_sku, 2.0::DOUBLE AS ratio FROM c_pairs WHERE relation = 'supersede' AND old_sku <> new_sku")
def c33_supersession_edges(spark, sf_dir):
    return C.supersession_edges(_pairs(spark, sf_dir))[0]


@query("SELECT CASE WHEN relation = 'phase' THEN 'phase' ELSE 'self' END AS cause, count(*) AS pairs FROM c_pairs WHERE relation = 'phase' OR old_sku = new_sku GROUP BY 1")
def c33_dropped_pairs(spark, sf_dir):
    return C.supersession_edges(_pairs(spark, sf_dir))[1]


def _chain_edges(spark, sf_dir):
    m = view(spark, sf_dir, "fx_item_master").where("sku like '%-2'").withColumn("n", F.regexp_extract("sku", r"S(\d+)-", 1).cast("int"))
    return m.where("n % 10 <> 0").select(F.col("sku").alias("old_sku"), F.concat(F.lit("S"), F.col("n") + 1, F.lit("-2")).alias("new_sku"), F.lit(1.5).alias("ratio"))


@query("""SELECT concat('S', n, '-2') AS old_sku, concat('S', n - n % 10 + 10, '-2') AS final_sku, round(pow(1.5, 10 - n % 10), 6) AS ratio
FROM (SELECT regexp_extract(sku, 'S(\\d+)-', 1)::INT AS n FROM fx_item_master WHERE sku LIKE '%-2') WHERE n % 10 <> 0""")
def c34_resolved_chains(spark, sf_dir):
    return tidy(C.resolve_chains(_chain_edges(spark, sf_dir)))


@query("""SELECT CASE WHEN p.old_sku IS NOT NULL THEN p.new_sku ELSE s.sku END AS sku, sum(CASE WHEN p.old_sku IS NOT NULL THEN 2 * qty ELSE qty END) AS qty, count(*) AS rows
FROM fx_sales s LEFT JOIN (SELECT * FROM c_pairs WHERE relation = 'supersede' AND old_sku <> new_sku) p ON p.old_sku = s.sku GROUP BY 1""")
def c35_superseded_demand(spark, sf_dir):
    chains = C.resolve_chains(C.supersession_edges(_pairs(spark, sf_dir))[0])
    return C.apply_supersession(view(spark, sf_dir, "fx_sales"), chains, ["qty"], []).groupBy("sku").agg(F.sum("qty").alias("qty"), F.count("*").alias("rows"))


@query("""SELECT sku, count(*) AS rows, max(ship_date) AS latest, 'sales' AS document FROM fx_sales JOIN c_pairs ON sku = old_sku WHERE ship_date > DATE '1997-01-01' GROUP BY sku
UNION ALL SELECT sku, count(*), max(po_date), 'purchases' FROM fx_po_history JOIN c_pairs ON sku = old_sku WHERE po_date > DATE '1997-01-01' GROUP BY sku""")
def c36_late_old_numbers(spark, sf_dir):
    return C.late_old_numbers({"sales": (view(spark, sf_dir, "fx_sales"), "ship_date"), "purchases": (view(spark, sf_dir, "fx_po_history"), "po_date")}, _pairs(spark, sf_dir))


@query("SELECT so_number, so_line_number, part, upper(sku) AS sku, trim(currency) AS currency, CASE so_line_number WHEN 2 THEN 1000 + true_qty WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE true_qty END AS qty_text FROM c_raw")
def c39_cleaned_by_name(spark, sf_dir):
    return C.clean_by_name(raw(spark, sf_dir).select(*KEY, "sku", "currency", "qty_text"))
