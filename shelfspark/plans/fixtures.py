"""Business documents as projections of the driver tables, in SQL that Spark and the oracle share."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.shared import keep

AS_OF = "2000-01-01"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: Each view may read the driver tables and the views before it.
VIEWS: dict[str, str] = {
    "li": """
SELECT l.*, o_custkey, o_orderstatus, CAST(l_shipdate AS DATE) AS ship, CAST(o_orderdate AS DATE) AS ordered,
  concat('S', CAST(l_suppkey AS STRING), '-', CASE WHEN l_partkey % 6 = 0 THEN '0' WHEN l_partkey % 6 <= 2 THEN '1' ELSE '2' END) AS sku,
  concat('V', CAST((l_suppkey + l_linenumber % 2) % 10 AS STRING)) AS vendor,
  CASE l_suppkey % 4 WHEN 0 THEN 'FOB' WHEN 1 THEN 'EXW' WHEN 2 THEN 'DDP' ELSE 'CIF' END AS term
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "fx_sales": """
SELECT l_orderkey AS so_number, l_linenumber AS so_line_number, sku, l_partkey AS part, o_custkey AS customer, n_name AS country,
  ordered AS order_date, ship AS ship_date, CASE WHEN l_quantity = 50 THEN NULL ELSE ship + (l_linenumber % 5 - 2) END AS customer_request_date,
  l_quantity AS qty, floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / CAST(100 AS DOUBLE) AS amount
FROM li JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_linestatus = 'F' AND ship <= DATE '2000-01-01'""",
    "fx_po_history": """
SELECT l_orderkey AS po_number, l_linenumber AS po_line_number, sku, vendor AS supplier, ordered AS po_date,
  CASE WHEN l_linenumber = 3 THEN NULL WHEN l_quantity = 1 THEN ship ELSE ordered + CAST(10 + (l_suppkey * 7 + l_linenumber * 11) % 60 AS INT) END AS receive_date,
  l_quantity AS po_qty, l_extendedprice AS po_amount, term AS incoterm, CASE WHEN l_returnflag = 'R' THEN 'AIR' ELSE 'SEA' END AS transport_mode,
  l_partkey AS part
FROM li WHERE l_returnflag <> 'N' AND ordered <= DATE '2000-01-01'""",
    "fx_open": """
SELECT * FROM li WHERE l_linestatus = 'O' AND ordered <= DATE '2000-01-01' AND ship > DATE '1999-10-03' AND ship <= DATE '2000-06-29'""",
    "fx_open_so": """
SELECT l_orderkey AS so_number, l_linenumber AS so_line_number, sku, o_custkey AS customer, ordered AS order_date, l_quantity AS open_qty,
  l_extendedprice AS open_amount, ship AS customer_request_date, l_partkey AS part
FROM fx_open WHERE o_orderstatus = 'O'""",
    "fx_open_po": """
SELECT l_orderkey AS po_number, l_linenumber AS po_line_number, sku, vendor AS supplier, ordered AS order_date,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE ship END AS committed_delivery, l_quantity AS open_qty, l_extendedprice AS open_amount, term AS incoterm, l_partkey AS part
FROM fx_open WHERE o_orderstatus = 'P'""",
    "bs": "SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2",
    "fx_inventory": """
SELECT concat('S', CAST(s_suppkey AS STRING), '-', CAST(b AS STRING)) AS sku, CASE loc WHEN 0 THEN '01' ELSE '02' END AS location_id,
  CAST((s_suppkey * 37 + b * 53 + loc * 11) % 130 AS DOUBLE) AS qty_on_hand,
  CAST(CASE loc WHEN 0 THEN (s_suppkey * 13 + b) % 60 ELSE 0 END AS DOUBLE) AS qty_in_transit,
  CAST(50 + (s_suppkey * 7 + b * 13) % 200 AS DOUBLE) AS unit_cost, DATE '2000-01-01' AS snapshot_date
FROM supplier CROSS JOIN bs CROSS JOIN (SELECT 0 AS loc UNION ALL SELECT 1) l""",
    "fx_item_master": """
SELECT concat('S', CAST(s_suppkey AS STRING), '-', CAST(b AS STRING)) AS sku, concat('V', CAST(s_suppkey % 10 AS STRING)) AS supplier,
  CAST(20 + s_suppkey % 40 AS DOUBLE) AS lead_time_days, CAST(25 * b AS DOUBLE) AS min_order_qty, CAST(1 + 4 * (s_suppkey % 3) AS DOUBLE) AS order_multiple,
  CAST(50 + (s_suppkey * 7 + b * 13) % 200 AS DOUBLE) AS unit_cost,
  CASE s_nationkey % 5 WHEN 0 THEN 'valves' WHEN 1 THEN 'pumps' WHEN 2 THEN 'seals' WHEN 3 THEN 'motors' ELSE 'filters' END AS product_family,
  r_name AS business_unit, CASE WHEN s_suppkey % 4 = 0 THEN 'MTO' ELSE 'MTS' END AS stocking_policy
FROM supplier CROSS JOIN bs JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


#: What the documents take from the joined order lines.
_LINE = "l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_returnflag l_linestatus o_custkey o_orderstatus ship ordered sku vendor term".split()
#: Views that a query may keep a copy of, with the columns of the copy.
_KEPT = {"li": _LINE, "fx_sales": "sku country order_date ship_date qty amount".split()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in a folder; within a query that shares views, over its own copies of these.

    A query resolves each table and view once, however often it asks; only those that a view needs are looked at.
    """
    held = _held.get()
    made = {} if held is None else held.setdefault(("views", sf_dir), {})
    prefix = f"v{zlib.crc32(sf_dir.encode()):08x}"

    def find(n: str) -> DataFrame:
        if n in made:
            return made[n]
        if n in TABLES:
            made[n] = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        else:
            words = set(re.findall(r"\w+", VIEWS[n])) - {n}
            needs = [x for x in (*TABLES, *VIEWS) if x in words]
            for x in needs:
                find(x).createOrReplaceTempView(f"{prefix}_{x}")
            # named where they are read, not by WITH: what is joined to itself would define the same relations twice in one plan
            made[n] = spark.sql(re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(needs)})\b", rf"\1\2{prefix}_\3", VIEWS[n]) if needs else VIEWS[n])
        if held is not None and n in held.get("shared", ()):
            made[n] = keep(made[n].select(*_KEPT[n]), n)
        return made[n]

    return find(name)


#: Views that oracles build on; each is the plain SQL of one operator.
ORACLE_VIEWS: dict[str, str] = {}


def oracle(body: str) -> str:
    """Oracle text: the views that `body` needs, in order, then `body`."""
    every = {**VIEWS, **ORACLE_VIEWS}
    need: dict[str, str] = {}

    def add(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in every:
            if name in words and name not in need and text != every[name]:
                add(every[name])
                need[name] = every[name].strip()

    add(body)
    chain = ",\n".join(f"{name} AS ({text})" for name, text in need.items())
    return f"WITH RECURSIVE {chain}\n{body.strip()}" if chain else body.strip()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TEXTS: dict[str, str] = {}


def oracles() -> dict[str, str]:
    """Oracle text of every query that has one; put together when asked, when all views are known."""
    return {name: oracle(sql) for name, sql in _TEXTS.items()}


#: What the running query has made so far; a query has its own, so two at a time don't meet.
_held: ContextVar[dict | None] = ContextVar("held", default=None)


def query(sql: str | None = None, shared: bool | str = False):
    """Registers a query under its function's name, with its oracle. `shared`: a view that it keeps one copy of; True for the order lines."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            token = _held.set({"shared": ["li" if shared is True else shared] if shared else []})
            try:
                return f(spark, sf_dir)
            finally:
                _held.reset(token)

        QUERIES[f.__name__] = run
        if sql is not None:
            _TEXTS[f.__name__] = sql
        return f

    return add


def _once(name: str, sf_dir: str, make: Callable):
    held = _held.get()
    if held is None:
        return make()
    if (name, sf_dir) not in held:
        held[name, sf_dir] = make()
    return held[name, sf_dir]


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A table that several parts of one query read: made and written once a query, however often it is asked for."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _once(f.__qualname__, sf_dir, lambda: keep(f(spark, sf_dir), f.__name__))

    return run


def tidy(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded for comparison: six digits, or as given by column."""
    return df.select(*[_rounded(c, kind, digits.get(c, 6)) for c, kind in df.dtypes])


def _rounded(name: str, kind: str, digits: int) -> Column:
    return F.round(F.col(name), digits).alias(name) if kind == "double" else F.col(name)
