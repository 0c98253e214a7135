"""Spelling variants: words over a reduced alphabet meet through their full one-edit neighbourhoods.

Letters are hashed to a few symbols. A word publishes its reduced form and asks for every reduced form one insertion,
deletion or replacement away, and for its own. Two words one edit apart always meet so; the join's pairs are verified on
the original words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from re import compile as pattern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import keep, may_hold, mix64, release, trim

RUN = pattern("[a-zÀ-ÿ]+")
_PENDING = 1 << 17
#: Neighbours that a task makes at a time.
_ASKED = 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_counts(docs: DataFrame, every: int = 199, least: int = 6, key: str = "doc_id") -> DataFrame:
    """(word, n): letter runs of the texts in ASCII lower case, of at least `least` letters.

    A run whose hash with the document's id is divisible by `every` lacks one letter: a planted misspelling.
    Null texts have none; a null id counts as the empty text. Equal rows count each. No run is cut, whatever its length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32((doc.as_py() or "").encode() + b":")
                for run, n in Counter(RUN.findall((text.as_py() or b"").lower().decode("utf-8", "replace"))).items():
                    if len(run) < least:
                        continue
                    h = zlib.crc32(run.encode(), start)
                    if not h % every:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    found[run] = found.get(run, 0) + n
                if len(found) > _PENDING:
                    yield out()
                    found.clear()
        yield out()
        trim()

    return docs.select(F.col(key).cast("string"), F.col("text").cast("binary")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def reduced(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols from 1 up) of the words of each length, a row a word; letters are hashed by their code point."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        letters = np.frombuffer("".join(words[i] for i in places).encode("utf-32-le"), np.uint32).reshape(len(places), size)
        yield places, (letters % np.uint32(symbols) + 1).astype(np.uint64)


def _sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier, and prefix sums of symbols times powers with a leading zero."""
    powers = np.full(s.shape[1] + 1, _MUL, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.zeros((len(s), s.shape[1] + 1), np.uint64)
    np.cumsum(s * powers[:-1], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return powers, sums


def own_keys(words: list[str], symbols: int) -> np.ndarray:
    """64-bit hashes of the reduced words."""
    out = np.zeros(len(words), np.uint64)
    for places, s in reduced(words, symbols):
        out[places] = _sums(s)[1][:, -1]
    return mix64(out)


def neighbour_keys(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of every reduced word at most one edit from a reduced word, each of a word's once."""
    for places, s in reduced(words, symbols):
        step = max(1, _ASKED // (s.shape[1] * symbols))
        for lo in range(0, len(places), step):
            yield from _neighbours(places[lo : lo + step], s[lo : lo + step], symbols)


def _neighbours(places: np.ndarray, s: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    powers, sums = _sums(s)
    size, total = s.shape[1], sums[:, -1:]
    before = np.concatenate((np.zeros((len(s), 1), np.uint64), s), axis=1)
    after = total - sums
    yield places, mix64(total[:, 0])
    width = max(1, _ASKED // (symbols * len(s)))
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    for lo in range(0, size + 1, width):
        hi = min(lo + width, size)
        # A letter of a run of equal ones is deleted once, and inserted once beside it.
        gone = sums[:, lo:hi] + after[:, lo + 1 : hi + 1] * _INV
        at, place = np.nonzero(s[:, lo:hi] != before[:, lo:hi])
        yield places[at], mix64(gone[at, place])
        other = (total[:, :, None] + (every - s[:, lo:hi, None]) * powers[None, lo:hi, None]).reshape(len(s), -1)
        at, place = np.nonzero((every != s[:, lo:hi, None]).reshape(len(s), -1))
        yield places[at], mix64(other[at, place])
        hi = min(lo + width, size + 1)
        more = (sums[:, lo:hi, None] + every * powers[None, lo:hi, None] + (after[:, lo:hi] * _MUL)[:, :, None]).reshape(len(s), -1)
        at, place = np.nonzero((every != before[:, lo:hi, None]).reshape(len(s), -1))
        yield places[at], mix64(more[at, place])


def near_words(words: DataFrame, symbols: int = 8) -> DataFrame:
    """(word, other, other_n): all pairs of words (distinct, with counts n) exactly one edit apart, either way round."""

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = own_keys(batch.column(0).to_pylist(), symbols).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0), batch.column(1)], ["key", "other", "other_n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, keys in neighbour_keys(batch.column(0).to_pylist(), symbols):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(places))], ["key", "word"])

    own = keep(words.select("word", "n").mapInArrow(publish, "key long, other string, other_n long"), "reduced_words")
    asked = may_hold(words.select("word", "n").mapInArrow(ask, "key long, word string"), "key", own, "held").where("held").select("key", "word")
    pairs = asked.join(own, "key").where("word <> other and abs(length(word) - length(other)) <= 1")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "other", "other_n")


def spelling_forms(counts: DataFrame, least_n: int = 5, times: int = 5, symbols: int = 8) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of counts (word, n) with n >= least_n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least `times` times
    its own; else null. Roots follow forms to their end; a form has at least `times` times the count, so there are few
    steps. Without words the result is empty.
    """
    words = keep(counts.where(F.col("n") >= least_n), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("order"), "other"))
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("fits", -F.col("best.order") >= times * F.col("n"))
    form, form_n = F.when(F.col("fits"), F.col("best.other")), F.when(F.col("fits"), -F.col("best.order"))
    found = keep(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), form_n.alias("form_n")), "forms")
    release(words)
    roots = roots_of(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles: each round follows all links so far, so lengths double."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = keep(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")
        now.kept_at = after.kept_at
