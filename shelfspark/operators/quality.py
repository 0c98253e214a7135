"""Profiles and checks of tables. Findings are rows: stage, check, severity, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Text forms of dates and numbers.
FORMS = (
    ("iso_date", r"^\d{4}-\d{2}-\d{2}"),
    ("delimited_date", r"^\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$"),
    ("eu_number", r"^[+-]?\d{1,3}(\.\d{3})*,\d+$"),
    ("us_number", r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"),
    ("plain_number", r"^[+-]?\d+(\.\d+)?$"),
)


def unpivoted(df: DataFrame) -> DataFrame:
    """(column_name, value): every cell as text."""
    cast = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return cast.unpivot([], df.columns, "column_name", "value")


#: The most distinct values of which a column's list is shown.
CATEGORIES = 25


def profile(df: DataFrame) -> DataFrame:
    """One row a column: fill, distinct values, inferred type, range, negatives, zeros, small list of values. (Q-01)

    Whole columns count. Cells are brought down to distinct values and their counts first, which both the figures and the
    lists of values start from; of a column with more than CATEGORIES values the lists' part sees so many and one.
    """
    cells = unpivoted(df).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    v, number = F.col("value"), F.col("value").try_cast("double")
    held = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    out = cells.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        held(v.isNotNull()).alias("non_null"),
        F.count(v).alias("distinct_values"),
        held(number.isNotNull()).alias("numbers"),
        held(F.try_to_date(v, "yyyy-MM-dd").isNotNull()).alias("dates"),
        held(F.lower(v).isin("true", "false", "yes", "no", "y", "n")).alias("booleans"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        held(number < 0).alias("negatives"),
        held(number == 0).alias("zeros"),
    )
    share = lambda c: F.try_divide(F.col(c), F.col("non_null"))
    kind = F.when(share("booleans") >= 0.95, "boolean").when(share("numbers") >= 0.9, "number").when(share("dates") >= 0.8, "date").otherwise("text")
    first = cells.where("value is not null").withColumn("place", F.row_number().over(W.partitionBy("column_name").orderBy("value"))).where(F.col("place") <= CATEGORIES + 1)
    lists = first.groupBy("column_name").agg(F.sort_array(F.collect_set(F.trim("value"))).alias("categories"), F.count("*").alias("seen")).where(F.col("seen") <= CATEGORIES)
    out = out.withColumn("inferred_type", kind).join(lists.select("column_name", "categories"), "column_name", "left")
    return out.select(
        "column_name", "rows", "non_null", (1 - F.col("non_null") / F.col("rows")).alias("null_rate"), "distinct_values", share("distinct_values").alias("distinct_rate"), "inferred_type", "min_number", "max_number",
        share("negatives").alias("negative_rate"), share("zeros").alias("zero_rate"), F.when(F.col("inferred_type").isin("text", "boolean"), F.col("categories")).alias("categories"),
    )


def form(c: Column) -> Column:
    out = None
    for name, pattern in FORMS:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise("text")


def representation_mix(df: DataFrame, least: int = 10, share: float = 0.02) -> DataFrame:
    """Counts of text forms a column, and whether two forms of dates or of numbers are mixed. (Q-02)"""
    rows = unpivoted(df).where("value is not null").withColumn("form", form(F.trim("value")))
    n = lambda name: F.count_if(F.col("form") == name)
    out = rows.groupBy("column_name").agg(F.count("*").alias("n"), *[n(name).alias(name) for name, _ in FORMS], n("text").alias("text"))
    big = lambda c: ((F.col(c) >= least) & (F.col(c) >= share * F.col("n"))).cast("int")
    return out.withColumn("mixed_dates", big("iso_date") + big("delimited_date") >= 2).withColumn("mixed_numbers", big("eu_number") + big("us_number") >= 2)


def order_evidence(df: DataFrame) -> DataFrame:
    """Votes a column: day first or month first, comma or point decimals. (Q-03)"""
    t = F.col("t")
    part = lambda i: F.when(t.rlike(r"[/.]"), F.regexp_extract(t, r"^(\d{1,2})[/.](\d{1,2})[/.]\d{2,4}$", i).try_cast("int"))
    number = F.when(t.contains(","), form(t))  # both forms that are counted have a comma
    rows = unpivoted(df).where("value is not null").select("column_name", F.trim("value").alias("t"))
    rows = rows.groupBy("column_name", "t").agg(F.count("*").alias("n"))  # a text is read once, however often it stands there
    votes = rows.select("column_name", "n", part(1).alias("a"), part(2).alias("b"), number.alias("f"))
    n = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long")
    return votes.groupBy("column_name").agg(
        n(F.col("a") > 12).alias("day_first"), n(F.col("b") > 12).alias("month_first"), n(F.col("f") == "eu_number").alias("decimal_comma"), n(F.col("f") == "us_number").alias("decimal_point")
    )


def mask(c: Column) -> Column:
    """Letters to A, digits to 9, runs to one. (Q-04)"""
    m = F.regexp_replace(F.regexp_replace(c, r"\p{L}", "A"), r"[0-9]", "9")
    return F.regexp_replace(m, r"(.)\1+", "$1+")


def top_masks(df: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent value masks of each column. (Q-04)"""
    counted = unpivoted(df).where("value is not null").groupBy("column_name", mask(F.col("value")).alias("mask")).agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("column_name").orderBy(F.desc("n"), "mask"))
    return counted.withColumn("place", place).where(F.col("place") <= k)


def line_number_like(df: DataFrame, column: str) -> DataFrame:
    """Whether a column looks like line numbers: small integers that repeat, tens or a dense run. (Q-05)"""
    v = F.col(column).cast("double")
    out = df.agg(F.count(v).alias("n"), F.count_distinct(v).alias("kinds"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.bool_and(v == F.floor(v)).alias("whole"), F.bool_and(v % 10 == 0).alias("tens"))
    dense = F.col("lo").isin(0.0, 1.0) & (F.col("hi") - F.col("lo") + 1 <= 1.5 * F.col("kinds"))
    ok = F.col("whole") & (F.col("hi") <= 999_999) & (F.col("kinds") <= 200) & (F.col("n") >= 3 * F.col("kinds")) & (F.col("tens") | dense)
    return out.select("n", "kinds", F.coalesce(ok, F.lit(False)).alias("line_number_like"))


def zero_padded(df: DataFrame, column: str) -> DataFrame:
    """Whether most values are long codes with leading zeros. (Q-06)"""
    hit = F.col(column).rlike(r"^0{2,}\d+$") & (F.length(column) >= 8)
    share = F.avg(F.when(F.col(column).isNotNull(), hit.cast("double")))
    return df.agg(share.alias("share")).withColumn("zero_padded", F.coalesce(F.col("share") >= 0.8, F.lit(False)))


def candidate_keys(df: DataFrame, columns: list[str], pairs: int = 3) -> DataFrame:
    """Columns that are unique over all rows, else unique pairs of them. (Q-07) One aggregate for all candidates."""
    two = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.count("*").alias("n"), *[F.count_distinct(F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)], *[F.count_distinct(F.struct(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(two)])
    found = F.array(*[F.struct(F.lit(1).alias("size"), F.lit(i).alias("ord"), F.lit(c).alias("key"), (F.col(f"s{i}") == F.col("n")).alias("ok")) for i, c in enumerate(columns)],
                    *[F.struct(F.lit(2).alias("size"), F.lit(i).alias("ord"), F.lit(f"{a}+{b}").alias("key"), (F.col(f"p{i}") == F.col("n")).alias("ok")) for i, (a, b) in enumerate(two)])
    good = F.filter(found, lambda x: x.ok)
    best = F.filter(good, lambda x: x["size"] == good[0]["size"])
    return row.select(F.explode(F.slice(best, 1, pairs)).alias("k")).select("k.size", "k.key")


def total_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are totals by the look of their first columns. (Q-08)"""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").rlike(r"(?i)\b(grand total|total|subtotal|sum)\b"), F.lit(False))
    return df.agg(F.count_if(hit).alias("total_rows"), F.count("*").alias("rows"))


def grain(df: DataFrame, key: list[str], candidates: list[str]) -> DataFrame:
    """Rows against distinct keys, and the column that makes the key unique if one does. (Q-09)"""
    row = df.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*key)).alias("keys"), *[F.count_distinct(F.struct(*key, c)).alias(f"c{i}") for i, c in enumerate(candidates)])
    best = F.array_max(F.array(*[F.struct(F.col(f"c{i}").alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("name")) for i, c in enumerate(candidates)]))
    return row.select("rows", "keys", F.try_divide("rows", "keys").alias("rows_per_key"), F.when((F.col("rows") > F.col("keys")) & (best.n > F.col("keys")), best["name"]).alias("discriminator"))


def contract_tests(df: DataFrame, required: list[str], key: list[str]) -> DataFrame:
    """Rows there, required columns there and filled, keys unique: one result row a test. (Q-10)"""
    there = [c for c in required if c in df.columns]
    row = df.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*key)).alias("k"), *[F.count(c).alias(f"f_{c}") for c in there])
    result = lambda test, field, n, bad: F.struct(F.lit(test).alias("test"), F.lit(field).alias("field"), n.cast("long").alias("rows"), bad.alias("severity"))
    tests = [result("non_empty", "", F.col("n"), F.when(F.col("n") == 0, "block").otherwise("pass"))]
    for c in required:
        if c not in there:
            tests.append(result("required", c, F.lit(0), F.lit("block")))
            continue
        nulls = F.col("n") - F.col(f"f_{c}")
        tests.append(result("required", c, nulls, F.when(F.col(f"f_{c}") == 0, "block").when(nulls > 0.05 * F.col("n"), "warn").otherwise("pass")))
    twice = F.col("n") - F.col("k")
    tests.append(result("unique_key", "+".join(key), twice, F.when(twice > 0, "warn").otherwise("pass")))
    return row.select(F.explode(F.array(*tests)).alias("t")).select("t.*")


def assertions(df: DataFrame, rules: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Failures of each assertion among the rows that can be judged, in one aggregate. (Q-11) rules: name -> (columns, predicate)."""
    usable = {n: (cols, text) for n, (cols, text) in rules.items() if set(cols) <= set(df.columns)}
    aggs = []
    for n, (cols, text) in usable.items():
        known = F.lit(True)
        for c in cols:
            known = known & F.col(c).isNotNull()
        aggs += [F.count_if(known).alias(f"{n}_j"), F.count_if(known & ~F.coalesce(F.expr(text), F.lit(False))).alias(f"{n}_f")]
    row = df.agg(*aggs)
    packed = F.array(*[F.struct(F.lit(n).alias("assertion"), F.col(f"{n}_j").alias("judged"), F.col(f"{n}_f").alias("failed")) for n in usable])
    out = row.select(F.explode(packed).alias("t")).select("t.*")
    return out.withColumn("fail_rate", F.try_divide("failed", "judged"))


def load_drift(baseline: DataFrame, now: DataFrame, measures: list[str], rows: float = 0.5, mean: float = 0.35) -> DataFrame:
    """Row count and means against the load before; outside the band is a warning. (Q-12)"""

    def facts(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(F.count("*").cast("double").alias("rows"), *[F.avg(m).alias(m) for m in measures])
        return row.unpivot([], ["rows", *measures], "measure", name)

    both = facts(baseline, "before").join(facts(now, "after"), "measure")
    change = F.try_divide(F.col("after") - F.col("before"), F.abs("before"))
    band = F.when(F.col("measure") == "rows", rows).otherwise(mean)
    return both.withColumn("change", change).withColumn("severity", F.when(F.abs("change") > band, "warn").otherwise("pass"))


def sku_agreement(tables: dict[str, DataFrame], least: float = 0.2) -> DataFrame:
    """Share of each document's items that any other document knows. (Q-13)"""
    rows = None
    for name, df in tables.items():
        part = df.where("sku is not null").select("sku").distinct().withColumn("document", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("seen", F.count("*").over(W.partitionBy("sku")))
    out = rows.groupBy("document").agg(F.count("*").alias("items"), F.avg((F.col("seen") > 1).cast("double")).alias("share_known"))
    return out.withColumn("severity", F.when(F.col("share_known") < least, "block").otherwise("pass"))


def receipt_completeness(po: DataFrame, most: float = 0.1) -> DataFrame:
    """Delivered lines without a receipt date, by supplier. (Q-15)"""
    out = po.groupBy("supplier").agg(F.count("*").alias("lines"), F.count_if(F.col("receive_date").isNull()).alias("undated"), F.min("po_date").alias("first_order"), F.max("po_date").alias("last_order"))
    share = F.col("undated") / F.col("lines")
    return out.withColumn("share", share).withColumn("severity", F.when(share > most, "warn").otherwise("pass"))


def failing_assertions(results: DataFrame, ceiling: float = 0.5) -> DataFrame:
    """Assertions that fail on so many rows that the data can't mean what it says. (Q-16)"""
    return results.where(F.col("fail_rate") >= ceiling).select(F.lit("semantics").alias("stage"), F.col("assertion").alias("check"), F.lit("block").alias("severity"), F.format_string("%d of %d rows fail", "failed", "judged").alias("evidence"))


def demand_gate(series: DataFrame, as_of: Column, least: float = 6, stale: int = 120) -> DataFrame:
    """Whether there is a series, how many months items are active in the middle, how old the newest month is. (Q-18)"""
    by_sku = series.groupBy("sku").agg(F.count_if(F.col("qty") > 0).alias("active"), F.max("period").alias("newest"))
    row = by_sku.agg(F.count("*").alias("items"), F.median("active").alias("median_active"), F.datediff(as_of, F.max("newest")).alias("age_days"))
    severity = F.when(F.col("items") == 0, "block").when((F.col("median_active") < least) | (F.col("age_days") > stale), "warn").otherwise("pass")
    return row.withColumn("severity", severity)


def coverage(wanted: DataFrame, there: DataFrame, floor: float = 0.8) -> DataFrame:
    """Share of wanted items that the other table has. (Q-19, Q-20)"""
    w = wanted.where("sku is not null").select("sku").distinct()
    row = w.join(there.select("sku").distinct().withColumn("_there", F.lit(1)), "sku", "left").agg(F.count("*").alias("wanted"), F.count("_there").alias("covered"))
    return row.withColumn("share", F.try_divide("covered", "wanted")).withColumn("severity", F.when(F.col("share") < floor, "severe").otherwise("pass"))


def column_facts(df: DataFrame, numbers: list[str], dates: list[str], anchor: Column) -> DataFrame:
    """Totals, median, maximum and whole-number share of quantities and money; span and future values of dates. (Q-21)"""
    cells = df.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "column_name", "v")
    a = cells.groupBy("column_name").agg(F.sum("v").alias("total"), F.median("v").alias("median"), F.max("v").alias("largest"), F.avg((F.col("v") == F.floor("v")).cast("double")).alias("whole_share"))
    days = df.select(*dates).unpivot([], dates, "column_name", "d")
    b = days.groupBy("column_name").agg(F.min("d").alias("earliest"), F.max("d").alias("latest"), F.count_if(F.col("d") > anchor).alias("ahead"))
    return a.unionByName(b, allowMissingColumns=True)


def shared_numbers(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """How many document numbers two extracts share. (Q-23)"""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    both = x.join(y.withColumn("_b", F.lit(1)), column, "left").agg(F.count("*").alias("first"), F.count("_b").alias("shared"))
    return both.withColumn("share", F.try_divide("shared", "first"))


def field_fill(df: DataFrame, fields: list[str]) -> DataFrame:
    """Filled values and fill rate of every field; absent fields are 0. (Q-24)"""
    row = df.agg(F.count("*").alias("n"), *[(F.count(f) if f in df.columns else F.lit(0).cast("long")).alias(f) for f in fields])
    return row.unpivot(["n"], fields, "field", "filled").select("field", "filled", F.try_divide("filled", "n").alias("fill_rate"))


def reader_report(df: DataFrame, required: list[str], quantities: list[str]) -> DataFrame:
    """Nulls of each column, negative quantities, and repeated items. (Q-27)"""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count("*").alias("_n"), *[F.count_if(F.col(q) < 0).alias(f"_neg_{q}") for q in quantities])
    nulls = row.unpivot(["_n"], df.columns, "column_name", "nulls")
    negative = row.unpivot(["_n"], [f"_neg_{q}" for q in quantities], "column_name", "negatives").select(F.substring_index("column_name", "_neg_", -1).alias("column_name"), "negatives")
    out = nulls.join(F.broadcast(negative), "column_name", "left")
    return out.select("column_name", "nulls", F.try_divide("nulls", "_n").alias("null_share"), F.col("column_name").isin(*required).alias("required"), F.coalesce("negatives", F.lit(0)).alias("negatives"))


def table_probe(df: DataFrame, key: str, loaded: str, now: Column) -> DataFrame:
    """Rows and keys, load dates and age, and the look of key texts. (Q-28)"""
    k = F.col(key).cast("string")
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(k).alias("keys"), F.min(loaded).alias("first_load"), F.max(loaded).alias("last_load"), (F.datediff(now, F.max(loaded)) * 24).alias("hours_stale"),
        F.count_distinct(F.to_date(loaded)).alias("load_days"), F.min(F.length(k)).alias("min_length"), F.max(F.length(k)).alias("max_length"), F.count_if(k.startswith("0")).alias("leading_zero"), F.count_if(k != F.trim(k)).alias("untrimmed"),
    )


def compare_totals(a: DataFrame, b: DataFrame, measures: list[str]) -> DataFrame:
    """Row count and totals of two versions of a table, side by side. (Q-29)"""

    def facts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").cast("double").alias("rows"), *[F.sum(m).alias(m) for m in measures]).unpivot([], ["rows", *measures], "measure", name)

    both = facts(a, "first").join(facts(b, "second"), "measure", "full")
    return both.withColumn("difference", F.col("second") - F.col("first"))


def order_findings(findings: DataFrame) -> DataFrame:
    """Findings worst first. (Q-26)"""
    rank = F.when(F.col("severity") == "block", 0).when(F.col("severity") == "severe", 1).when(F.col("severity") == "warn", 2).otherwise(3)
    return findings.withColumn("rank", rank).orderBy("rank", "stage", "check")


def gate(findings: DataFrame) -> DataFrame:
    """Whether each stage may go on, and its worst severity. (Q-26)"""
    rows = order_findings(findings)
    return rows.groupBy("stage").agg(F.bool_and(F.col("severity") != "block").alias("passed"), F.min_by("severity", "rank").alias("worst"), F.count("*").alias("findings"))


def ordinal_keys(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Whether a document's item key looks like line numbers, and how many of its values the other document lacks. (Q-14)"""
    lacks = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k")).distinct().join(other.select(F.col("sku").cast("string").alias("k")).distinct(), "k", "left_anti").agg(F.count("*").alias("unknown"))
    rows = line_number_like(df, key).crossJoin(lacks)  # one row each
    return rows.withColumn("severity", F.when(F.col("line_number_like") & (F.col("unknown") > 0), "warn").otherwise("pass"))


def product_dimension(demand: DataFrame, master: DataFrame, floor: float = 0.8) -> DataFrame:
    """Demand items the master lacks, master items without a family, and the share of demand items that have one. (Q-17)"""
    items = demand.where("sku is not null").select("sku").distinct()
    rows = items.join(master.select("sku", F.lit(True).alias("known"), "product_family"), "sku", "left")
    row = rows.agg(F.count("*").alias("items"), F.count_if(F.col("known").isNull()).alias("missing"), F.count_if(F.col("known") & F.col("product_family").isNull()).alias("no_family"), F.count("product_family").alias("with_family"))
    row = row.withColumn("coverage", F.try_divide("with_family", "items"))
    return row.withColumn("severity", F.when(F.col("with_family") == 0, "severe").when(F.col("coverage") < floor, "warn").otherwise("pass"))


def exposure(df: DataFrame, name: str, governed: str, money: str | None, qty: str, price: str | None = None) -> DataFrame:
    """Rows that an assumption governs, their share, the money behind them (else quantity times price) and the quantity. (Q-22)"""
    g = F.coalesce(F.expr(governed), F.lit(False))
    worth = F.col(money) if money in df.columns else F.col(qty) * F.col(price)
    row = df.agg(F.count("*").alias("n"), F.count_if(g).alias("rows"), F.sum(F.when(g, worth)).alias("money"), F.sum(F.when(g, F.col(qty))).alias("qty"))
    return row.select(F.lit(name).alias("assumption"), "rows", F.try_divide("rows", "n").alias("share"), "money", "qty")


def capabilities(fills: dict[str, DataFrame], needs: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Which questions the data supports: any of a document's columns that a question needs holds values. (Q-25)

    fills: document -> result of `field_fill`; needs: question -> document -> columns.
    """
    rows = None
    for document, fill in fills.items():
        part = fill.withColumn("document", F.lit(document))
        rows = part if rows is None else rows.unionByName(part)
    spark = rows.sparkSession
    table = [(q, d, c) for q, docs in needs.items() for d, cols in docs.items() for c in cols]
    wanted = spark.createDataFrame(table, "question string, document string, field string")
    found = F.broadcast(wanted).join(rows, ["document", "field"], "left")
    return found.groupBy("question").agg(F.coalesce(F.max(F.col("filled") > 0), F.lit(False)).alias("supported"))
