"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.llm.common import WORD, keep


def apportion(rows: DataFrame, group: list[str], key: str, weight: str, seats: str) -> DataFrame:
    """Adds `won`: the seats of its group that a row wins by highest quotients weight / (2 s - 1).

    Each row starts with its rounded share; the few seats that are then missing (or too many) go to the highest (are
    taken from the lowest) quotients, so only as many quotients are listed as seats are open.
    """
    whole = W.partitionBy(*group)
    share = F.col(seats) * F.col(weight) / F.sum(weight).over(whole)
    rows = rows.withColumn("base", F.coalesce(F.floor(share + 0.5), F.lit(0)).cast("long"))
    rows = rows.withColumn("open", F.when(F.sum(weight).over(whole) > 0, F.col(seats) - F.sum("base").over(whole)).otherwise(0))
    listed = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.abs("open"))))
    seat = F.when(F.col("open") > 0, F.col("base") + F.col("i")).otherwise(F.col("base") - F.col("i") + 1)
    listed = listed.withColumn("seat", seat)
    stands = (F.col("i") > 0) & (F.col("seat") > 0) & (F.col(weight) > 0)
    quotient = F.when(stands, F.col(weight) / (2 * F.col("seat") - 1) * F.signum("open"))
    listed = listed.withColumn("quotient", quotient)
    best = W.partitionBy(*group).orderBy(F.col("quotient").desc_nulls_last(), key)
    listed = listed.withColumn("place", F.row_number().over(best))
    wins = F.col("quotient").isNotNull() & (F.col("place") <= F.abs("open"))
    kept = [c for c in rows.columns if c not in {*group, key, "base", "open"}]
    found = listed.groupBy(*group, key).agg(
        *[F.first(c).alias(c) for c in kept],
        (F.first("base") + F.sum(F.when(wins, F.signum("open")).otherwise(0))).cast("long").alias("won"),
    )
    return found


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source_key, source, source_size, n) -> plus weight and target.

    Targets are least(cap * size, level * weight) with one level for all; it is the largest of the levels that arise
    when sources are capped one after another in order of size / weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "source_key")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))


def mix_sources(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: int = 17,
    blocks: int = 1 << 20,
    shard_rows: int = 256,
    max_shards: int = 1024,
) -> DataFrame:
    """How many words the mix takes of each document: (doc_id, source, size, source_size, target, taken, start).

    Sources in code point order (null last) weigh `weights` in turn and share all words; no target exceeds `cap` times
    its source. The words are dealt as about `blocks` blocks of equal size to sources, and each source's blocks to its
    shards, by highest quotients. A shard is a seeded part of a source (`shard_rows` documents, `max_shards` parts at
    most), so a hot source is spread. In a shard, documents stand in seeded order end to end; the quota takes whole
    passes and then blocks from the front, so a document gives `taken` words: whole copies and a leading part.

    Null or empty text: size 0, nothing taken. Null source is a source. Repeated rows are documents of their own. An
    empty table gives an empty result. Extra columns are ignored. The tables of sources and of quotas hold a row for
    each source and shard; no text is shuffled.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"))
    sized = keep(sized.withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "sizes")
    by_source = sized.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n")
    )
    targets = source_targets(by_source, weights, cap)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    targets = targets.withColumn("block", F.greatest(F.lit(1).cast("long"), F.floor(total / blocks)))
    targets = targets.withColumn("seats", F.floor(total / F.col("block"))).withColumn("one", F.lit(1))
    targets = targets.withColumn("shards", F.least(F.lit(max_shards), F.ceil(F.col("n") / shard_rows)).cast("long"))
    targets = targets.select("one", "source_key", "source_size", "target", "seats", "block", "shards")
    targets = keep(apportion(targets, ["one"], "source_key", "target", "seats"), "targets")

    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards"))
    rows = sized.join(targets.select("source_key", "source_size", "target", "shards"), "source_key").withColumn("shard", spread)
    shards = rows.groupBy("source_key", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(targets.select("source_key", F.col("won").alias("seats"), "block"), "source_key")
    shards = shards.withColumn("weight", F.col("shard_size").cast("double"))
    quotas = apportion(shards, ["source_key"], "shard", "weight", "seats")
    quotas = quotas.select("source_key", "shard", "shard_size", F.least(F.col("won") * F.col("block"), cap * F.col("shard_size")).alias("quota"))
    rows = rows.join(quotas, ["source_key", "shard"])
    seeded = W.partitionBy("source_key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "doc_id", "size")
    rows = rows.withColumn("start", F.sum("size").over(seeded.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.greatest("shard_size", F.lit(1).cast("long")))).otherwise(0)
    rest = F.col("quota") - passes * F.col("shard_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("start")))
    rows = rows.withColumn("taken", (passes * F.col("size") + part).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "shard", "start")
