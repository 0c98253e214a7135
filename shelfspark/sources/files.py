"""Readers and writers of extracts and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str | list[str], *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited extract with every column as text; nothing is inferred. (C-01)"""
    return spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, multiLine=False)


def read_parquet_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet batches united by column name, with the file that each row came from. (C-02)"""
    return spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("source_file", F.col("_metadata.file_path"))


def write_csv(df: DataFrame, path: str) -> None:
    """Results as CSV with a header, a file for each task. (C-07)"""
    df.write.mode("overwrite").csv(path, header=True)


def joined_output(first: DataFrame, others: list[tuple[str, DataFrame]], key: str = "sku") -> DataFrame:
    """Per-item results side by side. (C-08)

    Of each other table (suffix, rows) only columns that are not there yet are added, named with the suffix; a second value
    of a column would ask which one is real. It gives one row an item: the one with the least values where there are more.
    """
    out = first
    for suffix, df in others:
        add = [c for c in df.columns if c != key and c not in out.columns]
        if add:
            least = df.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in add])).alias("_row"))
            out = out.join(least.select(key, *[F.col("_row")[c].alias(f"{c}{suffix}") for c in add]), key, "left")
    return out


def forecast_table(forecast: DataFrame, dims: DataFrame, accuracy: DataFrame, review: DataFrame) -> DataFrame:
    """The forecast beside how the last plan did and what the review changed. dims: sku and what every table shows. (C-08)"""
    return joined_output(forecast, [("_prior_plan", accuracy), ("_review", review), ("", dims)])


def parameters_table(should_be: DataFrame, dims: DataFrame, profile: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Parameters in force beside the profile and the suggested ones. (C-08)"""
    return joined_output(should_be, [("", dims), ("", profile), ("_suggested", suggestions)])


def purchase_table(recommended: DataFrame, dims: DataFrame, realization: DataFrame) -> DataFrame:
    """Recommendations beside the realisation of the backlog. (C-08)"""
    return joined_output(recommended, [("", dims), ("_realization", realization)])


def inventory_table(should_be: DataFrame, dims: DataFrame, projection: DataFrame) -> DataFrame:
    """The stock that should be beside what is projected. (C-08)"""
    return joined_output(should_be, [("", projection.select("sku", "days_of_supply", "on_hand_cover_days", "inventory_status", "effective_position")), ("", dims)])


def plan_table(plan: DataFrame, dims: DataFrame, recommended: DataFrame) -> DataFrame:
    """The period plan, a row an item, beside what was recommended. (C-08)"""
    return joined_output(plan, [("", dims), ("", recommended.select("sku", "recommended_action", "suggested_po_qty", "pushout_open_po_qty"))])
