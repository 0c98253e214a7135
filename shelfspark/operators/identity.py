"""Item identity: codes of different systems that stand in one row name one item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.shared import keep


def code_kind(c: Column) -> Column:
    """Digits of 4 to 18 places, a part number, or no code at all. (C-37)"""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(r"^\d{4,18}$"), "number").when(t.rlike(r"^(?=.*\d)(?=.*[A-Z])[A-Z0-9][A-Z0-9\-./]{2,}$"), "part")


def code_columns(df: DataFrame, columns: list[str], least: int = 10, share: float = 0.005) -> DataFrame:
    """Columns with enough distinct codes, and their kind. (C-37)"""
    cells = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value").where("value is not null")
    out = cells.groupBy("column_name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("kinds"), F.count_if(code_kind(F.col("value")) == "number").alias("numbers"), F.count_if(code_kind(F.col("value")) == "part").alias("parts"))
    ok = (F.col("kinds") >= least) & (F.col("kinds") >= share * F.col("n")) & (F.col("numbers") + F.col("parts") >= 0.9 * F.col("n"))
    return out.where(ok).select("column_name", "kinds", F.when(F.col("parts") >= F.col("numbers"), "part").otherwise("number").alias("kind"))


def alias_edges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct pairs of codes that stand in one row; codes carry their column's name. (C-37)"""
    first, rest = columns[0], columns[1:]
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.upper(F.trim(F.col(c).cast("string")))))
    pairs = F.array(*[F.struct(node(first).alias("a"), node(c).alias("b")) for c in rest])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("a is not null and b is not null").distinct()


def item_ids(edges: DataFrame) -> DataFrame:
    """(node, item_uid): the smallest code that each one reaches. (C-37)

    Labels pass to neighbours and then jump to their label's label, until none changes; every round is written to the
    shared folder, so lineage stays short.
    """
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "identity")
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "identity")
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, "a").select("a", F.least("l", "m").alias("n"), "l")
        jump = step.select(F.col("a").alias("n"), F.col("n").alias("j"))
        new = keep(step.join(jump, "n").select("a", F.least("n", "j").alias("l"), (F.least("n", "j") != F.col("l")).alias("moved")), "identity")
        labels = new.select("a", "l")
        if new.where("moved").isEmpty():
            return labels.select(F.col("a").alias("node"), F.col("l").alias("item_uid"))


def substitution_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Two codes of one kind that stand in one row: a renumbering to propose, never an alias to apply. (C-38)

    (kind, code_a, code_b), each pair once, the smaller code first.
    """
    code = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    pairs = [F.struct(code_kind(F.col(a).cast("string")).alias("kind"), code_kind(F.col(b).cast("string")).alias("other"), F.least(code(a), code(b)).alias("code_a"), F.greatest(code(a), code(b)).alias("code_b")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("kind = other and code_a <> code_b")
    return rows.select("kind", "code_a", "code_b").distinct()


def identity_conflicts(ids: DataFrame, anchor: str, most: int = 50) -> DataFrame:
    """Items with too many codes, or with several codes of the anchor system. (C-38)"""
    out = ids.groupBy("item_uid").agg(F.count("*").alias("codes"), F.count_if(F.startswith("node", F.lit(f"{anchor}:"))).alias("anchors"))
    return out.where((F.col("codes") > most) | (F.col("anchors") > 1))
