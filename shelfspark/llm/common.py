"""Shared folder, materialised tables and word hashing used by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.shared import keep as keep

#: ASCII white space of the contracts; words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
SEGMENT = 1 << 20


def release(kept: DataFrame) -> None:
    """Deletes a table that `keep` wrote, once nothing lazy reads it any more."""
    jvm = kept.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a key filter, of 64 bits each: a constant, so it may be broadcast whatever the number of keys.
FILTER_ROWS = 1 << 17


def may_hold(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """Adds `flag`: false only where the long `key` is certainly not among the keys (column `key`, materialised).

    A bit for each hashed key, in at most FILTER_ROWS rows; more keys only make more rows come out true.
    """
    at = F.pmod(F.xxhash64(F.lit(5), key), F.lit(64 * FILTER_ROWS))
    bits = keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_bits"))
    out = df.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(bits), "_word", "left")
    return out.withColumn(flag, F.coalesce(F.expr("bit_get(_bits, cast(_at & 63 as int)) = 1"), F.lit(False))).drop("_at", "_word", "_bits")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batches to so many rows: texts are long, and both sides of a Python task hold a batch whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "0"))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def trim() -> None:
    """Gives memory that this Python process has freed back to the machine: workers are reused, and idle ones hold it."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def remainder(column: str, of: int) -> Column:
    """crc32 of an id as text, modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def row_key(*columns: str) -> Column:
    """Content key of a row; rows that are equal in these columns share it."""
    return F.xxhash64(F.lit(20), *[F.col(c) for c in columns])


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_MUL**i and its inverse modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _MUL), ("down", _INV)):
            row = np.full(max(n, SEGMENT), base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of byte values times rising powers, with a leading zero: the hash of data[s:e] is (out[e]-out[s]) * down[s]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _segments(texts: Iterable[bytes]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Joins texts to buffers of about SEGMENT bytes; a longer text is cut where white space stands."""
    parts, owners, starts, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            room = max(SEGMENT - size, 1)
            end = len(t)
            if end - at > room:
                if size and end - at <= SEGMENT:
                    yield b"\n".join(parts), owners, starts
                    parts, owners, starts, size = [], [], [], 0
                    continue
                end = at + room
                while end < len(t) and t[end] not in b" \t\n\r\x0b\x0c":
                    end += 1
            parts.append(t[at:end])
            owners.append(i)
            starts.append(size)
            size += end - at + 1
            at = end
            if size >= SEGMENT:
                yield b"\n".join(parts), owners, starts
                parts, owners, starts, size = [], [], [], 0
    if parts:
        yield b"\n".join(parts), owners, starts


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and offsets of each text's words."""
    hashes, owners = [], []
    for buf, own, starts in _segments(texts):
        data = np.frombuffer(buf.lower() if lower else buf, np.uint8)
        edge = np.diff(np.concatenate(([1], is_space(data).view(np.int8), [1])))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = prefix_hash(data)
        down = powers(len(data) + 1)[1]
        hashes.append(mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        owners.append(np.asarray(own, np.int64)[np.searchsorted(starts, s, "right") - 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    counts = np.bincount(np.concatenate(owners), minlength=len(texts))
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(counts)))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles; a shorter text with words is one shingle."""
    if len(words) < k:
        return shingle_hashes(words, len(words)) if len(words) else words
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mix64(out * np.uint64(_MUL) + words[j : j + n])
    return out


def fill_from(batches: Iterable, limit_bytes: int, size_of) -> Iterator[list]:
    """Collects rows of Arrow or pandas batches into lists of about `limit_bytes`."""
    rows, size = [], 0
    for row in batches:
        rows.append(row)
        size += size_of(row)
        if size >= limit_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows
