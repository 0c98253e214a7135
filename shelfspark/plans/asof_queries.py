"""Queries and oracles of the as-of section: sales lines written as six batches, by line number, and read back."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import functions as F

from shelfspark.operators import asof as A
from shelfspark.operators.shared import shared_dir
from shelfspark.plans.fixtures import ORACLE_VIEWS, once, query, tidy, view
from shelfspark.sources.files import read_delimited, write_csv

#: Batches by line number: valid time, when they were known, layer.
BATCHES = (
    (1, "1999-01", "1999-02-01", "raw"), (2, "1999-02", "1999-03-01", "raw"), (3, "1999-03", "1999-04-01", "raw"),
    (4, "1999-04", "1999-05-01", "converted"), (5, "1999-05", "1999-06-01", "converted"), (0, "1999-06", "1999-07-01", "converted"),
)
#: Later: one batch is void, one restated twice.
AMENDED = ((3, "void", 7, None, "1999-08-01"), (2, "restate", 8, "1999-12", "1999-09-01"), (2, "restate", 9, "1998-12", "1999-10-01"))
_VALUES = [f"('b{n}', 'add', {i}, '{v}', '{t}', '{layer}')" for i, (n, v, t, layer) in enumerate(BATCHES, 1)] + [f"('b{n}', '{r}', {i}, {repr(v) if v else 'NULL'}, '{t}', NULL)" for n, r, i, v, t in AMENDED]
ORACLE_VIEWS["t_log"] = f"SELECT * FROM (VALUES {', '.join(_VALUES)}) AS t(batch_id, record, seq, valid_time, transaction_time, frame_layer)"
ORACLE_VIEWS["t_facts"] = """
SELECT sku, customer, so_number, part, qty, CASE WHEN so_line_number % 6 IN (1, 2, 3) THEN amount END AS amount, CASE WHEN so_line_number % 6 NOT IN (1, 2, 3) THEN country END AS country, concat('b', so_line_number % 6) AS batch_id FROM fx_sales"""
ORACLE_VIEWS["t_eff"] = """
SELECT a.batch_id, coalesce(r.v, a.valid_time) AS valid_time, a.transaction_time, a.frame_layer FROM t_log a LEFT JOIN (SELECT batch_id, arg_max(valid_time, seq) AS v FROM t_log WHERE record = 'restate' GROUP BY batch_id) r
ON r.batch_id = a.batch_id WHERE record = 'add' AND a.batch_id NOT IN (SELECT batch_id FROM t_log WHERE record = 'void')"""
ORACLE_VIEWS["t_sel"] = "SELECT *, row_number() OVER (ORDER BY valid_time, transaction_time, batch_id) AS batch_rank FROM t_eff WHERE valid_time <= '1999-05'"
ORACLE_VIEWS["t_cur"] = """
SELECT * FROM (SELECT f.*, batch_rank, valid_time AS batch_valid_time, row_number() OVER (PARTITION BY sku, customer ORDER BY batch_rank DESC, so_number, part, qty, amount) AS n FROM t_facts f JOIN t_sel s ON s.batch_id = f.batch_id) WHERE n = 1"""


def batch(spark, sf_dir, n):
    """The sales lines of one batch; later exports know the country instead of the amount."""
    rows = sales(spark, sf_dir).where(F.col("so_line_number") % 6 == n)
    return rows.select("sku", "customer", "so_number", "part", "qty", "amount" if n in (1, 2, 3) else "country")


@once
def sales(spark, sf_dir):
    return view(spark, sf_dir, "fx_sales").select("sku", "customer", "so_number", "so_line_number", "part", "qty", "amount", "country")


def land_all(spark, sf_dir, root):
    stamps = ((n, {"doc_type": "sales", "valid_time": v, "transaction_time": t, "layer": layer, "source_name": f"b{n}"}) for n, v, t, layer in BATCHES)
    return {n: A.append_batch(batch(spark, sf_dir, n), root, **stamp) for n, stamp in stamps}


_stores: dict[tuple[str, str], str] = {}
_writing = threading.Lock()


def store(spark, sf_dir):
    """A store of six written batches and three amendments; a session writes it once, as stores outlive queries."""
    name = (spark.sparkContext.applicationId, sf_dir)
    with _writing:
        if name not in _stores:
            root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
            ids = land_all(spark, sf_dir, root)
            for n, record, seq, valid, known in AMENDED:
                if ids[n] is not None:  # an empty batch isn't stored
                    A.amend_batch(spark, root, "sales", ids[n], record, seq, known, valid)
            _stores[name] = root
    return _stores[name]


def log(spark, sf_dir):
    return A.read_log(spark, store(spark, sf_dir))


def facts(spark, sf_dir):
    return A.read_batches(spark, store(spark, sf_dir), "sales")


def selected(spark, sf_dir):
    return A.select_batches(A.effective_batches(log(spark, sf_dir)), as_of="1999-05")


def now(spark, sf_dir):
    return A.current(facts(spark, sf_dir), selected(spark, sf_dir), ["sku", "customer"], ["so_number", "part", "qty", "amount"])


@query("""SELECT count(*) AS rows, sha256(concat_ws('|', '3:sku8:customer9:so_number4:part3:qty6:amount', count(*), sum(('0x' || h[1:16])::UBIGINT), sum(('0x' || h[17:32])::UBIGINT))) AS fingerprint FROM (SELECT md5(concat(
length(sku), ':', sku, length(customer::VARCHAR), ':', customer, length(so_number::VARCHAR), ':', so_number, length(part::VARCHAR), ':', part, length(qty::VARCHAR), ':', qty, CASE WHEN amount IS NULL THEN 'N' ELSE concat(length(amount::VARCHAR), ':', amount) END)) AS h FROM t_facts)""")
def c04_fingerprint(spark, sf_dir):
    known = F.when((F.col("so_line_number") % 6).isin(1, 2, 3), F.col("amount")).alias("amount")
    return A.fingerprint(sales(spark, sf_dir).select("sku", "customer", "so_number", "part", "qty", known))


@query("SELECT batch_id AS source, count(*) AS rows, sum(qty) AS qty, count(amount) AS with_amount, count(country) AS with_country FROM t_facts GROUP BY batch_id")
def c02_united_batches(spark, sf_dir):
    names = log(spark, sf_dir).where("record = 'add'").select("batch_id", F.col("source_name").alias("source"))
    rows = facts(spark, sf_dir).join(names, "batch_id")
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("qty").alias("qty"), F.count("amount").alias("with_amount"), F.count("country").alias("with_country"))


@query("SELECT batch_id AS source, count(*) AS rows, count(*) AS logged, 1 AS records, false AS written_again FROM t_facts GROUP BY batch_id")
def c03_landed_twice(spark, sf_dir):
    again = land_all(spark, sf_dir, store(spark, sf_dir))
    added = log(spark, sf_dir).where("record = 'add'").groupBy("batch_id").agg(F.count("*").alias("records"), F.first("source_name").alias("source"), F.first("rows").alias("logged"))
    rows = facts(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("rows")).join(added, "batch_id")
    return rows.select("source", "rows", "logged", F.col("records").cast("int").alias("records"), F.lit(any(again.values())).alias("written_again"))


@query("SELECT so_number::VARCHAR AS so_number, so_line_number::VARCHAR AS so_line_number, sku, qty::VARCHAR AS qty, customer_request_date::VARCHAR AS customer_request_date, country FROM fx_sales")
def c01_text_extract(spark, sf_dir):
    place = f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    write_csv(view(spark, sf_dir, "fx_sales").select("so_number", "so_line_number", "sku", "qty", "customer_request_date", "country"), place)
    return read_delimited(spark, place)


@query("SELECT sku, count(*) AS lines, sum(qty)::VARCHAR AS qty FROM fx_sales GROUP BY sku")
def c07_written_result(spark, sf_dir):
    place = f"{shared_dir(spark)}/result-{uuid.uuid4().hex}"
    write_csv(view(spark, sf_dir, "fx_sales").groupBy("sku").agg(F.count("*").alias("lines"), F.sum("qty").alias("qty")), place)
    return read_delimited(spark, place).withColumn("lines", F.col("lines").cast("long"))


@query("SELECT so_number, part, qty::VARCHAR AS qty, qty::VARCHAR AS qty_2, CASE WHEN customer_request_date IS NOT NULL THEN customer_request_date::VARCHAR END AS due FROM (SELECT so_number::VARCHAR AS so_number, part::VARCHAR AS part, qty, customer_request_date FROM fx_sales)")
def c05_landed_round_trip(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_sales").select("so_number", "part", "qty", F.col("qty").alias("again"), "customer_request_date")
    return A.unland(A.land(rows), ["so_number", "part", "qty", "qty", "due"])


@query("""SELECT so_number, so_line_number, part, 'conform' AS stage, 'no_request' AS code, 'customer_request_date' AS field, NULL::VARCHAR AS detail FROM fx_sales WHERE customer_request_date IS NULL
UNION ALL SELECT so_number, so_line_number, part, 'conform', 'tiny', 'qty', qty::VARCHAR FROM fx_sales WHERE qty < 3""")
def c06_rejected_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_sales")
    rules = [("conform", "no_request", "customer_request_date", F.col("customer_request_date").isNull()), ("conform", "tiny", "qty", F.col("qty") < 3)]
    return A.rejects(rows, rules).select("so_number", "so_line_number", "part", "stage", "code", "field", "detail")


@query("SELECT batch_id, valid_time, transaction_time, frame_layer FROM t_eff")
def t01_effective_batches(spark, sf_dir):
    return A.effective_batches(log(spark, sf_dir)).select(F.col("source_name").alias("batch_id"), "valid_time", "transaction_time", "frame_layer")


@query("SELECT batch_id, valid_time, batch_rank, n AS rows FROM t_sel JOIN (SELECT batch_id, count(*) AS n FROM t_facts GROUP BY batch_id) USING (batch_id)")
def t02_selected_batches(spark, sf_dir):
    counts = facts(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n"))
    return selected(spark, sf_dir).join(counts, "batch_id").select(F.col("source_name").alias("batch_id"), "valid_time", "batch_rank", F.col("n").alias("rows"))


@query("SELECT sku, so_number, part, qty, amount, country, f.batch_id, valid_time AS batch_valid_time FROM t_facts f JOIN t_sel s ON s.batch_id = f.batch_id")
def t03_history(spark, sf_dir):
    return A.history(facts(spark, sf_dir), selected(spark, sf_dir)).select("sku", "so_number", "part", "qty", "amount", "country", F.col("batch_source").alias("batch_id"), "batch_valid_time")


@query("SELECT sku, customer, so_number, part, qty, batch_id FROM t_cur")
def t04_current(spark, sf_dir):
    return now(spark, sf_dir).select("sku", "customer", "so_number", "part", "qty", F.col("batch_source").alias("batch_id"))


@query("SELECT sku, customer, so_number, part, qty FROM t_facts WHERE batch_id = (SELECT batch_id FROM t_sel ORDER BY batch_rank DESC LIMIT 1)")
def t05_latest(spark, sf_dir):
    return A.latest(facts(spark, sf_dir), selected(spark, sf_dir)).select("sku", "customer", "so_number", "part", "qty")


@query("SELECT count(*) AS rows, count(*) FILTER (batch_rank < (SELECT max(batch_rank) FROM t_sel)) AS carried, round(count(*) FILTER (batch_rank < (SELECT max(batch_rank) FROM t_sel)) / count(*), 6) AS share FROM t_cur")
def t06_carried_forward(spark, sf_dir):
    return tidy(A.carried_forward(now(spark, sf_dir), selected(spark, sf_dir)))


@query("SELECT frame_layer, min(valid_time) AS first_valid, max(valid_time) AS last_valid, count(*) AS batches FROM t_eff GROUP BY frame_layer")
def t07_layer_spans(spark, sf_dir):
    return A.layer_spans(A.effective_batches(log(spark, sf_dir)))


@query("SELECT sku, qty, batch_id FROM t_cur WHERE batch_id IN ('b1', 'b5') AND qty = 7")
def t08_filtered(spark, sf_dir):
    return A.where_values(now(spark, sf_dir), {"batch_source": ["b1", "b5"], "qty": 7.0}, ["sku", "qty", "batch_source"]).withColumnRenamed("batch_source", "batch_id")
