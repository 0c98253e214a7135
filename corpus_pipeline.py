"""A corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, source mixing, retrieval packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import bound_batches, keep, release, row_key
from shelfspark.llm.jaccard import jaccard_components, keep_one
from shelfspark.llm.langid import identify, train_language_model
from shelfspark.llm.mixing import mix_sources
from shelfspark.llm.packing import pack
from shelfspark.llm.suffix import remove_repeats


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; the others (null or empty text, no letter, below the calibrated score) go.

    Whole texts are judged, whatever their length; equal texts fare alike, repeated rows stay repeated. Rows without a
    language teach nothing. Columns of any name stay as they are; an empty table gives an empty one.
    """
    bound_batches(spark)
    model = train_language_model(docs, F.lit(True))
    return identify(docs, model).where("lang_pred <> 'und'").select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more.

    Of a group, and of repeated rows, the row of the smallest doc_id stays. Null texts and texts without words are linked
    with nothing and stay; whole texts count, whatever their length. An empty table gives an empty one; columns of any name
    stay as they are.
    """
    bound_batches(spark)
    return keep_one(docs, jaccard_components(docs, words=5, num=80, den=100)).select(*docs.columns)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated 400-byte strings and repeated passages of over 50 words; documents of which nothing stays go.

    Every copy of a repeated string or passage goes. Where a cut splits a character its bytes become a replacement character.
    """
    bound_batches(spark)
    found = remove_repeats(docs.select("doc_id", "text", F.struct(*docs.columns).alias("own")), words=51)
    clean = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    return found.where(F.octet_length("kept") > 0).select(*_columns(docs, clean, lambda c: F.col("own").getField(c)))


def _columns(docs: DataFrame, text: Column, other: Callable[[str], Column]) -> list[Column]:
    """The columns of documents with a new text, and its length where they have one."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return [new.get(c, other(c)).alias(c) for c in docs.columns]


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows for the words the mix takes: whole copies of a document, and a row with its leading words for the rest.

    Rows that repeat share evenly what is taken of them. Null texts hold no words and go. The caller's columns travel in
    one struct, so none of their names can clash.
    """
    row = row_key("doc_id", "text")
    taken = mix_sources(docs.select(row.alias("row"), "text", "source"), key="row").where("taken > 0").groupBy(F.col("doc_id").alias("row"))
    taken = taken.agg(F.first("size").alias("size"), F.floor(F.avg("taken")).alias("taken"))
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    out = docs.select(F.struct(*docs.columns).alias("own"), row.alias("row")).join(taken, "row")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), whole + F.when(part > 0, 1).otherwise(0))))
    text = F.when(F.col("copy") <= whole, F.col("own.text")).otherwise(first_words("own.text", part))
    return out.select(*_columns(docs, text, lambda c: F.col("own").getField(c)))


def first_words(text: str, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, as op3 returns them: every token of every row in exactly one piece.

    Null texts are empty and hold their end token only; repeated rows are packed each; long texts are cut. An empty table
    gives no pieces.
    """
    bound_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), shard_bytes=4 << 20, remember=50_000)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("suffix_dedup", remove_repeated_strings),
    ("source_mix", mix),
    ("retrieval_packing", pack_windows),
]
#: No stage but the mix can be said in SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if last is not None:  # what the stage before kept is read no more
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
