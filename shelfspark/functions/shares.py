"""Running shares over a whole table without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_share(items: DataFrame, value: str, tie: str, share: str, total: str) -> DataFrame:
    """Adds the running share of `value`, largest first (ties by `tie`), and its total.

    Rows fall in buckets of an eighth of a power of two, whose sums run over a bounded table; a window orders each bucket.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    bucket = F.when(v > 0, F.floor(F.log2(v) * 8)).otherwise(F.lit(-100_000)).cast("long")
    rows = items.withColumn("_v", v).withColumn("_b", bucket)
    sums = rows.groupBy("_b").agg(F.sum("_v").alias("_s"))  # at most 8 for each of a double's exponents
    above = W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sums = sums.select("_b", F.coalesce(F.sum("_s").over(above), F.lit(0.0)).alias("_above"), F.sum("_s").over(whole).alias(total))
    rows = rows.join(F.broadcast(sums), "_b")
    within = W.partitionBy("_b").orderBy(F.desc("_v"), tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(share, F.try_divide(F.col("_above") + F.sum("_v").over(within), F.col(total))).drop("_v", "_b", "_above")
