"""Conforming raw extracts: parsing, keys, grain, domains, currency, supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts that mean "no value".
NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none", "-", "--")


def map_columns(raw: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """Source columns under canonical names; returns the names that the source lacks, too. (C-09)"""
    have = {s: t for s, t in mapping.items() if s in raw.columns}
    return raw.select(*[F.col(f"`{s}`").alias(t) for s, t in have.items()]), [s for s in mapping if s not in have]


def blank_to_null(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def parse_number(c: Column, decimal_comma: bool = False, flip_sign: bool = False) -> Column:
    """Text to double: thousands marks, decimal comma, (x) for -x; what can't be read is null. (C-10)"""
    t = F.regexp_replace(blank_to_null(c), r"[\s']", "")
    negative = t.rlike(r"^\(.*\)$")
    t = F.regexp_replace(t, r"^\((.*)\)$", "$1")
    t = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), ",", ".") if decimal_comma else F.replace(t, F.lit(","), F.lit(""))
    v = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    v = F.when(negative, -v).otherwise(v)
    return -v if flip_sign else v


def parse_dates(df: DataFrame, column: str, out: str, day_first: bool = True, iso_share: float = 0.95) -> DataFrame:
    """Text to date: ISO where nearly the whole column is, else day first or month first; bad values are null. (C-11)

    The share of ISO values counts the whole column.
    """
    t = blank_to_null(F.col(column))
    iso = t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
    share = df.agg((F.count_if(iso) / F.greatest(F.count(t), F.lit(1)) > iso_share).alias("_iso"))
    as_iso = F.try_to_date(F.regexp_extract(t, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")
    parts = F.split(F.regexp_replace(t, r"[.\-]", "/"), "/")
    order = "d/M/yyyy" if day_first else "M/d/yyyy"
    other = F.when(F.size(parts) == 3, F.try_to_date(F.array_join(parts, "/"), order))
    rows = df.crossJoin(F.broadcast(share))  # one row
    return rows.withColumn(out, F.when(F.col("_iso"), as_iso).otherwise(F.coalesce(F.when(iso, as_iso), other))).drop("_iso")


def repair_mixed_dates(df: DataFrame, column: str, out: str) -> DataFrame:
    """A column half ISO, half delimited text: swaps month and day of the ISO half where the evidence says so. (C-12)

    The delimited half shows its order by values over 12. The ISO half is swapped if it has at least 20 values, no day
    over 12, and swapping leaves no fewer of them within 31 days of the delimited half's span.
    """
    t = blank_to_null(F.col(column))
    is_iso, is_text = t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.rlike(r"^\d{1,2}[/.]\d{1,2}[/.]\d{4}")
    parts = F.split(F.regexp_replace(t, r"[.]", "/"), "/")
    a, b = F.when(is_text, parts[0].try_cast("int")), F.when(is_text, parts[1].try_cast("int"))
    first = df.agg((F.count_if(a > 12) >= F.count_if(b > 12)).alias("_day_first"))
    rows = df.crossJoin(F.broadcast(first))  # one row
    year = F.when(is_text, parts[2].try_cast("int"))
    day, month = F.when(F.col("_day_first"), a).otherwise(b), F.when(F.col("_day_first"), b).otherwise(a)
    text_date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d")
    iso_date = F.when(is_iso, F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    swapped = F.when(F.day(iso_date) <= 12, F.make_date(F.year(iso_date), F.day(iso_date), F.month(iso_date)))
    rows = rows.withColumn("_text", F.when(is_text, text_date)).withColumn("_date", iso_date).withColumn("_swap", swapped)
    span = rows.agg(F.date_sub(F.min("_text"), 31).alias("_lo"), F.date_add(F.max("_text"), 31).alias("_hi"))
    rows = rows.crossJoin(F.broadcast(span))  # one row
    inside = lambda c: F.count_if(F.col(c).between(F.col("_lo"), F.col("_hi")))
    verdict = rows.agg(((F.count("_date") >= 20) & (F.count_if(F.day("_date") > 12) == 0) & (inside("_swap") >= inside("_date"))).alias("_do"))
    rows = rows.crossJoin(F.broadcast(verdict))  # one row
    fixed = F.coalesce("_text", F.when(F.col("_do"), F.col("_swap")).otherwise(F.col("_date")))
    return rows.withColumn(out, fixed).drop("_day_first", "_text", "_date", "_swap", "_lo", "_hi", "_do")


def material_number(c: Column) -> Column:
    """Trimmed upper-case code without `.0`; leading zeros go only where all characters are digits. (C-13)"""
    t = F.regexp_replace(F.upper(blank_to_null(c)), r"^(\d+)\.0+$", "$1")
    return F.when(t.rlike(r"^\d+$"), F.regexp_replace(t, r"^0+(?=\d)", "")).otherwise(t)


def roll_up(df: DataFrame, key: list[str], sums: list[str], prices: dict[str, str], order: list[str]) -> DataFrame:
    """One row a key: quantities and money summed, prices weighed by their quantity, the rest from the first row. (C-14)

    prices: price column -> quantity column. "First" is the first non-null value by `order`.
    """
    tie = F.struct(*order)
    rest = [c for c in df.columns if c not in {*key, *sums, *prices}]
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(p) * F.col(q)), F.sum(F.when(F.col(p).isNotNull(), F.col(q)))), F.min_by(p, tie)).alias(p) for p, q in prices.items()]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), tie)).alias(c) for c in rest]
    return df.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums], *weighted, *firsts)


def collapse(df: DataFrame, markers: list[str]) -> DataFrame:
    """Rows equal but for marker columns become one, with the smallest markers. (C-15)"""
    rest = [c for c in df.columns if c not in markers]
    return df.groupBy(*rest).agg(F.min(F.struct(*markers)).alias("_m")).select(*rest, "_m.*")


def map_domain(df: DataFrame, column: str, codes: DataFrame, default: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Coded values to canonical ones, and the codes that the table (code, canonical; a row a code) lacks. (C-16)"""
    name = F.lower(F.trim(F.col(column)))
    rows = df.withColumn("_code", name).join(codes.select(F.lower(F.trim("code")).alias("_code"), "canonical"), "_code", "left")
    unmapped = rows.where("canonical is null and _code is not null").groupBy(F.col("_code").alias("code")).agg(F.count("*").alias("rows"))
    return rows.withColumn(column, F.coalesce("canonical", F.lit(default))).drop("_code", "canonical"), unmapped


def first_derivation(df: DataFrame, field: str, expressions: list[tuple[list[str], str]]) -> DataFrame:
    """The first expression whose columns are all there fills a field that is absent or null. (C-17)"""
    for needs, text in expressions:
        if set(needs) <= set(df.columns):
            value = F.expr(text)
            return df.withColumn(field, F.coalesce(F.col(field), value) if field in df.columns else value)
    return df


def apply_filters(df: DataFrame, filters: list[tuple[list[str], str]]) -> tuple[DataFrame, DataFrame]:
    """Keeps rows for which every applicable predicate is true (null drops); and how many each one removes. (C-18)"""
    usable = [(needs, text) for needs, text in filters if set(needs) <= set(df.columns)]
    if not usable:
        return df, df.agg(F.count("*").alias("rows"))
    ok = [F.coalesce(F.expr(text), F.lit(False)) for _, text in usable]
    counts = df.agg(*[F.count_if(~k).alias(f"removed_{i}") for i, k in enumerate(ok)], F.count("*").alias("rows"))
    out = df
    for k in ok:
        out = out.where(k)
    return out, counts


def melt_periods(df: DataFrame, ids: list[str], periods: dict[str, str]) -> DataFrame:
    """Month columns to rows (ids, period, qty); blanks are 0, rows without ids go. periods: header -> first day. (C-19)"""
    rows = df.where(" and ".join(f"{c} is not null" for c in ids)).unpivot(ids, list(periods), "header", "qty")
    names = F.create_map(*[x for h, d in periods.items() for x in (F.lit(h), F.lit(d))])
    return rows.select(*ids, names[F.col("header")].cast("date").alias("period"), F.coalesce("qty", F.lit(0.0)).alias("qty"))


def period_matrix(series: DataFrame, months: list) -> DataFrame:
    """The matrix of items and months: a row an item, any number of them, a column `yyyy-MM` for each of the given months. (C-20)"""
    return series.groupBy("sku").agg(*[F.sum(F.when(F.col("period") == F.lit(m), F.col("qty"))).alias(f"{m:%Y-%m}") for m in months])


def stack(first: DataFrame, second: DataFrame, key: str, share: float = 0.2) -> DataFrame:
    """Two partitions of one document in one table if few keys are in both, else the larger one. (C-21)"""
    a, b = first.select(key).distinct(), second.select(key).distinct()
    na, nb, both = a.count(), b.count(), a.intersect(b).count()
    if both / max(1, min(na, nb)) < share:
        tagged = first.withColumn("source_sheet", F.lit("first"))
        return tagged.unionByName(second.withColumn("source_sheet", F.lit("second")), allowMissingColumns=True)
    return first.withColumn("source_sheet", F.lit("first")) if first.count() >= second.count() else second.withColumn("source_sheet", F.lit("second"))


def timeseries(wide_long: DataFrame, months: int) -> DataFrame:
    """Clips negatives, keeps the newest months and drops items without any demand. (C-22)"""
    rows = wide_long.withColumn("qty", F.greatest("qty", F.lit(0.0)))
    newest = rows.select("period").distinct().orderBy(F.desc("period")).limit(months)
    rows = rows.join(F.broadcast(newest), "period", "left_semi")
    return rows.withColumn("_t", F.sum("qty").over(W.partitionBy("sku"))).where("_t > 0").drop("_t")


def default_location(df: DataFrame, node: str) -> DataFrame:
    """The configured node where the location is missing. (C-23)"""
    have = F.col("location_id") if "location_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("location_id", F.coalesce(have, F.lit(node)))


def open_purchase_lines(df: DataFrame) -> DataFrame:
    """Lines that are not closed and still open, with a flag for a missing delivery date. (C-25)"""
    rows = df.where("lower(coalesce(po_status, 'open')) <> 'closed'")
    if "open_qty" not in df.columns:
        rows = rows.withColumn("open_qty", F.greatest(F.col("order_qty") - F.coalesce("delivered_qty", F.lit(0.0)), F.lit(0.0)))
    return rows.where("open_qty > 0").withColumn("undated", F.col("committed_delivery").isNull())


def open_sales_lines(df: DataFrame) -> DataFrame:
    """Lines with an item and something open. (C-26)"""
    return df.where("sku is not null and open_qty > 0")


def confirmed_receipts(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a receipt go where any row of the same line has one. (C-27)"""
    any_ = F.max(F.col("receive_date").isNotNull().cast("int")).over(W.partitionBy(*key))
    return df.withColumn("_any", any_).where("_any = 0 or receive_date is not null").drop("_any")


def convert_currency(df: DataFrame, quotes: DataFrame, money: list[str], date: str, domestic: str) -> DataFrame:
    """Money at the rate that held on the row's date. (C-28)

    Before the first quote the first one holds; without a date the newest. A foreign row's own plausible rate (positive,
    not 1, within ten times of the table) wins. Domestic rows have rate 1; without a rate, money is null.
    quotes: (currency, effective_from, rate), few rows for each currency.
    """
    by = W.partitionBy("currency").orderBy("effective_from")
    q = quotes.withColumn("_to", F.lead("effective_from").over(by)).withColumn("_first", F.row_number().over(by) == 1)
    lo = F.when(F.col("_first"), F.lit("0001-01-01").cast("date")).otherwise(F.col("effective_from"))
    q = q.select(F.col("currency").alias("_cur"), lo.alias("_lo"), F.coalesce("_to", F.lit("9999-12-31").cast("date")).alias("_hi"), F.col("rate").alias("_table"))
    rows = df.withColumn("_at", F.coalesce(F.col(date), F.lit("9999-12-30").cast("date"))).withColumn("_code", F.upper(F.trim("currency")))
    rows = rows.join(q, (F.col("_code") == F.col("_cur")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")), "left")
    own = F.col("fx_rate") if "fx_rate" in df.columns else F.lit(None).cast("double")
    plausible = (own > 0) & (own != 1) & (F.col("_table").isNull() | ((own <= 10 * F.col("_table")) & (own >= F.col("_table") / 10)))
    rate = F.when(F.col("_code") == domestic, 1.0).when(plausible, own).otherwise(F.col("_table"))
    basis = F.when(F.col("_code") == domestic, "domestic").when(plausible, "own").when(F.col("_table").isNotNull(), "table").otherwise("unrated")
    rows = rows.withColumn("fx_rate_applied", rate).withColumn("fx_basis", basis).withColumn("currency_original", F.col("_code"))
    for m in money:
        rows = rows.withColumn(m, F.col(m) * F.col("fx_rate_applied"))
    return rows.drop("_at", "_code", "_cur", "_lo", "_hi", "_table")


def conversion_report(converted: DataFrame, money: str) -> DataFrame:
    """Rows of each currency by how they were converted, and totals. (C-29)"""
    n = lambda b: F.count_if(F.col("fx_basis") == b)
    return converted.groupBy(F.col("currency_original").alias("currency")).agg(
        F.count("*").alias("rows"), n("domestic").alias("domestic"), n("own").alias("own_rate"), n("table").alias("table_rate"), n("unrated").alias("unrated"), F.sum(money).alias("total_after")
    )


def fold_spellings(df: DataFrame, column: str, noise: str = r"\s+(inc|ltd|gmbh|llc|co)\.?$") -> DataFrame:
    """Every spelling of a name becomes the most frequent one; ties: the shortest, then by alphabet. (C-30)"""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(column))), noise, ""), r"[^a-z0-9]+", "")
    counted = df.where(F.col(column).isNotNull()).groupBy(key.alias("_key"), F.col(column).alias("_raw")).agg(F.count("*").alias("n"))
    best = counted.groupBy("_key").agg(F.min_by("_raw", F.struct(-F.col("n"), F.length("_raw"), F.col("_raw"))).alias("_best"))
    return df.withColumn("_key", key).join(best, "_key", "left").withColumn(column, F.coalesce("_best", F.col(column))).drop("_key", "_best")


def supersession_edges(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable `supersede` pairs (old_sku, new_sku, ratio), and what was dropped, by cause. (C-33)"""
    rows = pairs.withColumn("old_sku", material_number(F.col("old_sku"))).withColumn("new_sku", material_number(F.col("new_sku"))).withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    targets = F.size(F.collect_set(F.struct("new_sku", F.round("ratio", 9))).over(W.partitionBy("old_sku")))
    cause = F.when(F.col("relation") == "phase", "phase").when(F.col("old_sku") == F.col("new_sku"), "self").when(F.col("_targets") > 1, "split")
    rows = rows.withColumn("_targets", F.when(F.col("relation") == "supersede", targets)).withColumn("cause", cause)
    edges = rows.where("cause is null").select("old_sku", "new_sku", "ratio").distinct()
    return edges, rows.where("cause is not null").groupBy("cause").agg(F.count("*").alias("pairs"))


def resolve_chains(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """(old_sku, final_sku, ratio): successors followed to the end by doubling steps; loops are dropped. (C-34)

    Each round doubles the steps a row has taken, so `rounds` of them follow chains of 2 ** rounds items; what still
    has a successor after that runs in a loop.
    """
    now = edges.select("old_sku", F.col("new_sku").alias("final_sku"), "ratio")
    for _ in range(rounds):
        step = now.select(F.col("old_sku").alias("final_sku"), F.col("final_sku").alias("_next"), F.col("ratio").alias("_r"))
        now = now.join(step, "final_sku", "left").select("old_sku", F.coalesce("_next", "final_sku").alias("final_sku"), (F.col("ratio") * F.coalesce("_r", F.lit(1.0))).alias("ratio"))
    return now.join(edges.select(F.col("old_sku").alias("final_sku")), "final_sku", "left_anti").select("old_sku", "final_sku", "ratio")


def apply_supersession(df: DataFrame, chains: DataFrame, quantities: list[str], prices: list[str]) -> DataFrame:
    """Old numbers become final ones; quantities are multiplied by the ratio and prices divided. (C-35)"""
    rows = df.join(chains.select(F.col("old_sku").alias("sku"), "final_sku", F.col("ratio").alias("_ratio")), "sku", "left")
    ratio = F.coalesce("_ratio", F.lit(1.0))
    for c in quantities:
        rows = rows.withColumn(c, F.col(c) * ratio)
    for c in prices:
        rows = rows.withColumn(c, F.col(c) / ratio)
    return rows.withColumn("sku_original", F.col("sku")).withColumn("sku", F.coalesce("final_sku", "sku")).drop("final_sku", "_ratio")


def late_old_numbers(tables: dict[str, tuple[DataFrame, str]], pairs: DataFrame) -> DataFrame:
    """Rows of a superseded number dated after its effective date, by document. (C-36)"""
    out = None
    for name, (df, date) in tables.items():
        rows = df.join(pairs.select(F.col("old_sku").alias("sku"), "effective_date"), "sku").where(F.col(date) > F.col("effective_date"))
        found = rows.groupBy("sku").agg(F.count("*").alias("rows"), F.max(date).alias("latest")).withColumn("document", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def clean_by_name(df: DataFrame) -> DataFrame:
    """Cleaning by column name: text trimmed, sku upper-cased, quantities and amounts to numbers, empty rows dropped. (C-39)"""
    out = []
    for c, kind in df.dtypes:
        v = F.trim(F.col(c)) if kind == "string" else F.col(c)
        name = c.lower()
        if kind == "string" and name == "sku":
            v = F.upper(v)
        elif kind == "string" and ("date" in name or name == "eta"):
            v = F.try_to_date(v, "yyyy-MM-dd")
        elif kind == "string" and any(x in name for x in ("qty", "amount", "value")):
            v = F.replace(v, F.lit(","), F.lit("")).try_cast("double")
        out.append(v.alias(c))
    return df.select(*out).dropna("all")
