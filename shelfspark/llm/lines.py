"""Line dedup: levelled sorted runs of line keys, which each batch of documents merge-anti-joins before it adds its own.

A run holds (key, n), bucketed and sorted by the key: n documents of its batches hold the line. Runs of a level are
compacted to one of the next level when there are `fanout` of them. As all runs have the same buckets, neither
compaction nor the anti-join moves a run's rows: only the new batch is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import fresh, keep, may_hold, release, row_key, trim
from shelfspark.operators.shared import shared_dir

SPACE = b" \t\n\x0b\x0c\r"
#: So many of the commonest keys, 16 bytes each, are sent to every task: a fixed number, whatever the input.
HEAD = 1 << 16
_PENDING = 1 << 17


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line without outer ASCII white space, in ASCII lower case; None below `least` code points."""
    line = line.strip(SPACE).lower()
    if len(line) < least or (least > 1 and len(line.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(line)


def _keys(text: bytes | None, least: int) -> set[bytes]:
    found = {line_key(line, least) for line in (text or b"").split(b"\n")}
    found.discard(None)
    return found


def line_counts(docs: DataFrame, least: int = 1) -> DataFrame:
    """(key, n): in how many rows of docs a line stands, however often in each. Null texts hold one empty line."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for key in _keys(text.as_py(), least):
                    found[key] = found.get(key, 0) + 1
                if len(found) > _PENDING:
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["key", "n"])
                    found = {}
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["key", "n"])
        trim()

    return docs.select(F.col("text").cast("binary")).mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


class LineRuns:
    """Levels of sorted runs in the shared folder; lines of batches that came before stay known to those that follow.

    A level is a bucketed table to which each of its runs is appended, so a level is compacted without a shuffle.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.runs: list[int] = []

    def _table(self, level: int) -> str:
        return f"{self.name}_{level}"

    def _append(self, counts: DataFrame, level: int) -> None:
        if level == len(self.runs):
            self.runs.append(0)
        table = self._table(level)
        writer = counts.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet")
        writer.mode("append").option("path", f"{shared_dir(self.spark)}/{table}").saveAsTable(table)
        self.runs[level] += 1

    def _drop(self, level: int) -> None:
        if self.runs[level]:
            kept = self.spark.table(self._table(level))
            kept.kept_at = f"{shared_dir(self.spark)}/{self._table(level)}"
            self.spark.sql(f"DROP TABLE {self._table(level)}")
            release(kept)
            self.runs[level] = 0

    def levels(self) -> list[DataFrame]:
        return [self.spark.table(self._table(level)) for level, n in enumerate(self.runs) if n]

    def compact(self, level: int) -> None:
        """Merges the runs of a level to one of the next."""
        self._append(self.spark.table(self._table(level)).groupBy("key").agg(F.sum("n").alias("n")), level + 1)
        self._drop(level)

    def unseen(self, counts: DataFrame, at_least: int = 1) -> DataFrame:
        """Rows of (key, n) whose key no run counts `at_least` times: merge joins, for which no run is shuffled."""
        for level in self.levels():
            counts = counts.join(level.where(F.col("n") >= at_least).hint("merge"), "key", "left_anti")
        return counts

    def add(self, counts: DataFrame, at_least: int) -> None:
        """Adds a batch's keys as a run. Keys that a run counts `at_least` times are settled and don't come in again."""
        self._append(self.unseen(counts, at_least), 0)
        for level in range(len(self.runs)):
            if self.runs[level] >= self.fanout:
                self.compact(level)

    def counted(self, at_least: int) -> DataFrame:
        """Keys found at least so often over all runs; n is exact unless the key was settled before its last batch."""
        if not self.runs:
            return self.spark.createDataFrame([], "key binary, n long")
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self.compact(level)
        return self.levels()[0].groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)

    def close(self) -> None:
        for level in range(len(self.runs)):
            self._drop(level)
        self.runs = []


def batches_of(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The files of a table dealt to so many parts, each read by itself; one part where a table has one file or none."""
    parts = min(batches, len(docs.inputFiles()))
    path = F.xxhash64("_metadata.file_path")
    return [docs] if parts < 2 else [docs.where(F.pmod(path, F.lit(parts)) == part) for part in range(parts)]


def shared_lines(spark: SparkSession, batches: Iterable[DataFrame], min_docs: int = 10, least: int = 1) -> DataFrame:
    """(key, n) of lines that stand in at least `min_docs` rows over all batches, which come one after the other."""
    runs = LineRuns(spark)
    try:
        for batch in batches:
            runs.add(line_counts(batch, least), min_docs)
        return keep(runs.counted(min_docs), "shared_lines")
    finally:
        runs.close()


def drop_lines(docs: DataFrame, keys: DataFrame, least: int = 1) -> DataFrame:
    """docs with `n_lines`, `n_dropped` and `kept`: the text without the lines whose key is among `keys` (key, n).

    docs: text (null: one empty line) and any other columns; columns named like the results are replaced. Equal texts fare
    alike. An empty table gives an empty one. The commonest keys, HEAD of them, are matched where the text stands, so
    no key is hot in the join of the others; only texts that may hold one of those travel, once.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept")
    row, drop, flag = fresh(docs, "_row"), fresh(docs, "_drop"), fresh(docs, "_flag")
    names = docs.columns
    docs = docs.withColumn(row, row_key("text"))  # a collision only adds keys, all of them to be dropped
    common = keep(keys.orderBy(F.desc("n"), "key").limit(HEAD).select("key"), "common_lines")
    head = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.key) for r in common.collect()))  # HEAD keys
    tail = keep(keys.join(F.broadcast(common), "key", "left_anti").select("key", F.xxhash64("key").alias("code")), "rarer_lines")  # HEAD rows
    release(common)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _keys(text.as_py(), least) - head.value
                rows += [at] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.binary())], ["at", "key"])
        trim()

    lines = docs.select(F.col(row).alias("at"), F.col("text").cast("binary")).mapInArrow(pairs, "at long, key binary")
    lines = may_hold(lines.withColumn("code", F.xxhash64("key")), "code", tail, "rare").where("rare").select("at", "key")
    hits = keep(lines.join(tail, "key", "left_semi").groupBy("at").agg(F.collect_set("key").alias(drop)), "dropped_lines")
    docs = may_hold(docs, row, hits.select(F.col("at").alias(row)), flag)
    some = docs.where(flag).join(hits.withColumnRenamed("at", row), row, "left").select(*names, drop)
    rest = docs.where(~F.col(flag)).select(*names, F.lit(None).cast("array<binary>").alias(drop))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, rare in zip(batch.column("text"), batch.column(drop)):
                lines, own = (text.as_py() or "").encode().split(b"\n"), set(rare.as_py() or ())
                stay = []
                for line in lines:
                    key = line_key(line, least)
                    if key not in head.value and key not in own:
                        stay.append(line)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode())
            added = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *added], [*names, "n_lines", "n_dropped", "kept"])
        trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return some.unionByName(rest).mapInArrow(cut, f"{fields}, n_lines long, n_dropped long, kept string")
