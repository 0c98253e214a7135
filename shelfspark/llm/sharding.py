"""Sharding by vector bin packing: bytes, tokens and rows of groups of equal texts are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, keep, text_of

_GROUP = ["h", "crc", "size", "part"]
_PLACED = "h long, crc long, size long, part long, shard int, bytes double, tokens double, rows double"


def place(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Places items (n x d) in bins of residual capacity (bins x d), each where the dot product of the two is highest.

    Items come largest first by their first dimension; ties go to the bin with the lowest number. Capacities are soft:
    a bin may end below zero, and everything is placed.
    """
    out = np.zeros(len(sizes), np.int32)
    left = capacity.astype(float).copy()
    for i in np.lexsort((-sizes[:, 2], -sizes[:, 1], -sizes[:, 0])):
        b = int(np.argmax(left @ sizes[i]))
        left[b] -= sizes[i]
        out[i] = b
    return out


def pack_shards(
    docs: DataFrame,
    *,
    shards: int = 24,
    key: str = "doc_id",
    text: str = "text",
    cell_groups: int = 20_000,
    max_cells: int = 4096,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of `shards` shards of nearly equal bytes.

    Rows with equal texts are one group and stay together; a group of more than one shard's bytes is cut into seeded
    parts. Groups large for their cell (a number that the cells bound: at most 96 for each) are placed first, in one
    task; the others are dealt by text hash to cells of about `cell_groups` groups, and each cell fills its share of what
    every shard has left. Bytes weigh most in the dot product, so they come out nearly equal; tokens and rows follow as
    far as groups allow. A task holds one cell; beyond
    `max_cells` * `cell_groups` groups cells grow with the input.

    Null text counts as empty (size 8, one group with empty texts). Null or repeated ids are rows like others. An empty
    table gives an empty result. Extra columns are ignored.
    """
    t = text_of(text)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(t) + 8).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("crc"),
        F.xxhash64(t).alias("h"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("tokens"),
    )
    rows = keep(rows, "sized")
    groups = rows.groupBy("h", "crc", "size").agg(F.count("*").alias("rows"), F.first("tokens").alias("each"))
    groups = groups.withColumn("bytes", F.col("size") * F.col("rows")).withColumn("tokens", F.col("each") * F.col("rows"))
    total = groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows"), F.count("*")).first()
    all_bytes, all_tokens, all_rows, n_groups = (float(x or 0) for x in total)
    room = max(all_bytes, 1.0) / shards
    big = groups.where(F.col("bytes") > room).withColumn("parts", F.least("rows", F.ceil(F.col("bytes") * 4 / room)))
    big = F.broadcast(big.select("h", "crc", "size", "parts"))  # fewer than `shards` rows
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id", "h"), F.col("parts"))
    rows = rows.join(big, ["h", "crc", "size"], "left").withColumn("part", F.coalesce(part, F.lit(0)).cast("long")).drop("parts")
    pieces = rows.groupBy(*_GROUP).agg(F.count("*").cast("double").alias("rows"), F.sum("tokens").cast("double").alias("tokens"))
    pieces = keep(pieces.withColumn("bytes", (F.col("size") * F.col("rows")).cast("double")), "pieces")

    scale = np.array([4.0 / max(all_bytes, 1), 0.5 / max(all_tokens, 1), 0.5 / max(all_rows, 1)])
    cells = int(min(max_cells, max(1, -(-n_groups // cell_groups))))
    large = F.col("bytes") > all_bytes / (shards * 4 * cells)

    def fill(pdf: pd.DataFrame, capacity: np.ndarray) -> pd.DataFrame:
        items = pdf[["bytes", "tokens", "rows"]].to_numpy(float) * scale
        return pdf[[*_GROUP]].assign(shard=place(items, capacity * items.sum(0)), **{c: pdf[c] for c in ("bytes", "tokens", "rows")})

    def fill_large(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_GROUP, ignore_index=True)
        items = pdf[["bytes", "tokens", "rows"]].to_numpy(float) * scale
        whole = np.array([all_bytes, all_tokens, all_rows]) * scale
        return pdf[[*_GROUP]].assign(shard=place(items, np.tile(whole / shards, (shards, 1))), **{c: pdf[c] for c in ("bytes", "tokens", "rows")})

    first = keep(pieces.where(large).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fill_large, _PLACED), "large")
    used = np.zeros((shards, 3))
    for r in first.groupBy("shard").agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).collect():  # a row for each shard
        used[r[0]] = r[1:]
    left = np.maximum(np.array([all_bytes, all_tokens, all_rows]) / shards - used, 0)
    left = left / np.maximum(left.sum(0), 1e-9)

    def fill_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        return fill(pdf.sort_values(_GROUP, ignore_index=True), left)

    cell = F.pmod(F.xxhash64(F.lit(6), "h"), F.lit(cells))
    second = pieces.where(~large).withColumn("cell", cell).groupBy("cell").applyInPandas(fill_cell, _PLACED)
    placed = keep(first.unionByName(second), "placed")

    hot = max(all_rows / 1000, 1000)  # at most 1000 pieces have so many rows
    few = F.broadcast(placed.where(F.col("rows") >= hot).select(*_GROUP, "shard"))
    many = placed.where(F.col("rows") < hot).select(*_GROUP, "shard")
    found = rows.join(few, _GROUP, "left")
    out = found.where("shard is not null").unionByName(found.where("shard is null").drop("shard").join(many, _GROUP), allowMissingColumns=True)

    buckets = int(min(4096, max(16, -(-all_rows // (shards * 64)))))
    out = out.withColumn("bucket", F.pmod(F.xxhash64(F.lit(7), "doc_id", "h"), F.lit(buckets)))
    out = keep(out.select("doc_id", "size", "crc", "shard", "bucket"), "sharded")
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.select("shard", "bucket", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "crc", "size")
    out = out.withColumn("place", F.row_number().over(within) - 1).join(F.broadcast(counts), ["shard", "bucket"])  # shards x buckets rows at most
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))
