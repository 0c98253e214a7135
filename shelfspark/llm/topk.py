"""Exact top-k inner products over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.llm.common import keep
from shelfspark.llm.vectors import is_usable, matrix

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Components below it are exact in the index and its sums.
WIDE = 1 << 24


def pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (.. x rows) -> uint64 bitmaps, padded with zeros."""
    flat = np.packbits(bits, axis=-1, bitorder="little")
    pad = -flat.shape[-1] % 8
    if pad:
        flat = np.concatenate([flat, np.zeros((*flat.shape[:-1], pad), np.uint8)], -1)
    return np.ascontiguousarray(flat).view(np.uint64)


def unpack(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n].astype(bool)


class BitSlicedIndex:
    """Bitmaps of the high bits of each integer attribute of a block of rows, and the exact attributes beside them."""

    def __init__(self, values: np.ndarray, drop_bits: int):
        self.values, self.n = values, len(values)
        self.low = values.min(0) if self.n else np.zeros(values.shape[1], np.int64)
        span = values - self.low
        top = int(span.max()) if span.size else 0
        self.drop = max(0, min(drop_bits, top.bit_length() - 1))
        coarse = span >> self.drop
        self.bits = max(1, int(coarse.max()).bit_length() if coarse.size else 1)
        shifts = np.arange(self.bits)[:, None]
        self.slices = pack(((coarse.T[:, None, :] >> shifts) & 1).astype(bool))  # attribute x bit x words
        self.flipped = self.slices ^ ONES
        self.full = pack(np.ones(self.n, bool))
        middle = ((1 << self.drop) - 1) / 2
        rest = (span & ((1 << self.drop) - 1)) - middle
        self.rest_norm = float(np.sqrt((rest * rest).sum(1).max())) if self.n else 0.0

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of sum(|weight| * coarse attribute), flipped where the weight is negative.

        Columns of equal place value are added three at a time (a full adder of five bitmap operations), lowest place
        first, so carries move up until each place has one slice.
        """
        columns: list[list[np.ndarray]] = []
        for w, up, down in zip(weights.tolist(), self.slices, self.flipped, strict=True):
            source, w = (up, w) if w >= 0 else (down, -w)
            place = 0
            while w:
                if w & 1:
                    while len(columns) < place + self.bits:
                        columns.append([])
                    for b in range(self.bits):
                        columns[place + b].append(source[b])
                w >>= 1
                place += 1
        out, place = [], 0
        while place < len(columns):
            column = columns[place]
            if place + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.append(x ^ c)
                columns[place + 1].append((a & b) | (x & c))
            if len(column) == 2:
                a, b = column
                out.append(a ^ b)
                columns[place + 1].append(a & b)
            else:
                out.append(column[0] if column else np.zeros_like(self.full))
            place += 1
        return out

    def candidates(self, weights: np.ndarray, drop_weight: int, k: int) -> np.ndarray:
        """Rows that can be among the k best: all whose coarse sum comes within the error bound of the k-th best."""
        if self.n <= 4 * k:
            return np.arange(self.n)
        coarse = np.where(weights >= 0, weights >> drop_weight, -((-weights) >> drop_weight))
        slices = self.sums(coarse)
        above, equal, kth = np.zeros_like(self.full), self.full.copy(), 0
        for i in range(len(slices) - 1, -1, -1):  # the k-th largest sum, most significant slice first
            both = above | (equal & slices[i])
            if int(np.bitwise_count(both).sum()) >= k:
                equal &= slices[i]
                kth |= 1 << i
            else:
                above = both
                equal &= ~slices[i]
        # exact score = 2**(dw+d) * coarse sum + constant of the block + error of at most `error` either way
        part = weights - (coarse << drop_weight)
        scale = 1 << (self.drop + drop_weight)
        error = float(np.linalg.norm(weights)) * self.rest_norm
        if drop_weight:
            reach = (self.values - self.low).max(0) if self.n else 0
            centre = (self.values - self.low) - reach / 2
            coarse_err = float(np.linalg.norm(part)) * float(np.sqrt((centre * centre).sum(1).max()))
            error += coarse_err + float(np.abs(part).sum()) * (1 << self.drop)
        limit = max(0, kth - int(2 * error / scale) - 1)
        if limit == 0:
            return np.arange(self.n)
        above, equal = np.zeros_like(self.full), self.full.copy()
        for i in range(max(len(slices), limit.bit_length()) - 1, -1, -1):
            s = slices[i] if i < len(slices) else np.zeros_like(self.full)
            if limit >> i & 1:
                equal &= s
            else:
                above |= equal & s
                equal &= ~s
        return np.flatnonzero(unpack(above | equal, self.n))


def _search(index: BitSlicedIndex, ids: np.ndarray, query: np.ndarray, own: int, k: int, drop_weight: int):
    rows = index.candidates(query, drop_weight, k + 1)  # one more, for the query's own row
    scores = index.values[rows] @ query
    other = ids[rows] != own
    rows, scores = rows[other], scores[other]
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[best]], scores[best]


def _search_wide(values: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int):
    """As _search, for integers of any size held in doubles: rows whose rounded score can reach the k-th best are scored in Python's integers."""
    values, ids = values[ids != own], ids[ids != own]
    with np.errstate(over="ignore", invalid="ignore"):
        about, error = values @ query, 2.0**-52 * (len(query) + 2) * (np.abs(values) @ np.abs(query))
        least = np.where(np.isfinite(about - error), about - error, -np.inf)
        kth = np.partition(least, len(least) - k)[len(least) - k] if len(least) > k else -np.inf
        rows = np.flatnonzero(~(about + error < kth))  # an infinite or undefined sum rules nothing out
    weights = [int(x) for x in query]
    scored = sorted((-sum(int(x) * w for x, w in zip(values[r], weights, strict=True)), int(ids[r])) for r in rows)[:k]
    return [i for _, i in scored], [-s for s, _ in scored]


def search(found: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int, drop_bits: int = 3, drop_weight: int = 2):
    """(query's id, ids, scores) of the k best rows for each query; whole numbers in doubles.

    Rows and queries within 24 bits meet in the bit-sliced index; only wider rows, and wider queries, take the other way.
    """
    wide = np.abs(found).max(1, initial=0) >= WIDE
    index, narrow_ids = BitSlicedIndex(found[~wide].astype(np.int64), drop_bits), ids[~wide]
    for own, query in zip(asked_ids.tolist(), asked, strict=True):
        if np.abs(query).max(initial=0) >= WIDE:
            best, scores = _search_wide(found, ids, query, own, k)
        else:
            best, scores = (x.tolist() for x in _search(index, narrow_ids, query.astype(np.int64), own, k, drop_weight))
            if wide.any():
                more = _search_wide(found[wide], ids[wide], query, own, k)
                both = sorted(zip([-s for s in scores + more[1]], best + more[0], strict=True))[:k]
                best, scores = [i for _, i in both], [-s for s, _ in both]
        if any(abs(s) >= 1 << 63 for s in scores):
            raise ValueError("an inner product does not fit in a long")
        yield own, best, scores


def top_k(
    rows: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    block_rows: int = 16_384,
    query_rows: int = 4096,
    drop_bits: int = 3,
    drop_weight: int = 2,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k rows with the highest integer inner product.

    Components become floor(scale * x). Rows are dealt by key hash to blocks of about `block_rows`, queries to blocks
    of about `query_rows`; every pair of blocks meets in one task, which builds the block's bit-sliced index and keeps k
    rows for each query. Coarse sums come from bitmap additions of the high bits; rows within their error bound of the
    k-th best are scored exactly. Ties go to the smaller key; a row is never its own result.

    Vectors that are null or hold null or non-finite components take no part; nor do rows with a null key. Vectors of
    different lengths are not compared. Rows that repeat a key are candidates one by one. Rows with quantised
    components beyond 24 bits stand beside the index: those that can be among the k best are scored in integers of any
    size; ValueError only where one of the k best scores of a pair of blocks doesn't fit in a long. Keys are whole numbers. An empty table gives an empty result.
    """
    used = rows.where(is_usable(vector) & F.col(key).isNotNull())
    used = used.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    used = keep(used.withColumn("d", F.size("v")), "vectors")
    n, asking = used.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-asking // query_rows))
    own = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(blocks))
    mine = F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(query_blocks))
    spots = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    left = used.select("id", "v", "d", own.alias("b")).withColumn("q", spots(query_blocks))
    right = used.where("asks").select("id", "v", "d", mine.alias("q")).withColumn("b", spots(blocks))

    def meet(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found) and len(asked):
            whole = [np.floor(matrix(x.v) * scale) for x in (found, asked)]
            for own_id, best, scores in search(whole[0], found.id.to_numpy(), whole[1], asked.id.to_numpy(), k, drop_bits, drop_weight):
                out.append(pd.DataFrame({"query_id": own_id, "vec_id": best, "score": scores}, dtype="int64"))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    pairs = left.groupBy("b", "q", "d").cogroup(right.groupBy("b", "q", "d"))
    found = pairs.applyInPandas(meet, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
