"""Toxicity by nearest labelled examples: exact cosine over a block-max inverted index, distance-weighted votes.

The weights are TF-IDF times a factor that the labels of the examples give (`term_factors`); with it the vectors are not
those of plain TF-IDF, under which long texts with a few insults stay far from all toxic examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import fresh, keep, remainder, text_of, word_hashes

#: Terms for each piece of the document counts: a row of the sum that Spark deals out.
PIECE = 4096


def word_counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each whole text the hashes of its words, rising, and how often each stands there."""
    words, at = word_hashes(texts)
    return [np.unique(words[a:b], return_counts=True) for a, b in zip(at, at[1:], strict=False)]


def places(terms: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in the sorted terms, and which words have one."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(len(words), bool)
    spot = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
    hit = terms[spot] == words
    return spot[hit], hit


@dataclass
class BlockMaxIndex:
    """Inverted lists of unit vectors of examples over all their words, and the largest weight of frequent words in each block.

    A word's weight in a text is (1 + log count) * factor. Frequent words stand in a dense table, others in lists.
    """

    terms: np.ndarray
    factor: np.ndarray
    ids: list
    toxic: np.ndarray
    prior: float
    block: int = 64
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    knots: tuple[np.ndarray, np.ndarray] | None = None
    opened: int = 0
    _table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Takes (term numbers, counts) of the examples, in order of their numbers."""
        unit = [self.weigh(t, n) for t, n in vectors]
        rows = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors])
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = rows[order], np.concatenate(unit)[order]
        size = np.bincount(term, minlength=len(self.terms))
        self.cut = np.concatenate(([0], np.cumsum(size)))
        self.often = np.flatnonzero(size > max(64, len(vectors) // 16))  # under 16 times the words of a mean example

    def weigh(self, terms: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.factor[terms]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm > 0 else w

    def table(self) -> np.ndarray:
        """Weights of the frequent words, a column an example, filled up to whole blocks."""
        if self._table is None:
            self._table = np.zeros((len(self.often), -(-len(self.ids) // self.block) * self.block))
            for i, t in enumerate(self.often):
                self._table[i, self.rows[self.cut[t] : self.cut[t + 1]]] = self.weights[self.cut[t] : self.cut[t + 1]]
        return self._table

    def known(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that the examples hold, and how often each stands in the text."""
        spot, hit = places(self.terms, words)
        return spot, n[hit]

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text's (terms, counts) the k examples of highest cosine (above 0; ties: smaller number), exactly.

        Lists give the rare words' part of all cosines. The frequent words' part of a block is at most their product
        with the block's largest weights; blocks where this bound stays below the k-th cosine are never opened.
        """
        table = self.table()
        blocks = table.shape[1] // self.block
        asked, scores = np.zeros((len(texts), len(self.often))), np.zeros((len(texts), table.shape[1]))
        for i, (t, n) in enumerate(texts):
            w = self.weigh(t, n)
            spot, dense = places(self.often, t)
            asked[i, spot] = w[dense]
            t, w = t[~dense], w[~dense]
            size = self.cut[t + 1] - self.cut[t]
            ends = np.cumsum(size)
            at = np.repeat(self.cut[t] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            scores[i] = np.bincount(self.rows[at], self.weights[at] * np.repeat(w, size), table.shape[1])
        most = table.reshape(len(self.often), blocks, self.block).max(2) if len(self.often) else np.zeros((0, blocks))
        bound = asked @ most + scores.reshape(len(texts), blocks, self.block).max(2)
        done = np.zeros(bound.shape, bool)

        def open_(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                q = np.flatnonzero(wanted[:, b])
                lo = b * self.block
                scores[q, lo : lo + self.block] += asked[q] @ table[:, lo : lo + self.block]
            done[wanted] = True
            self.opened += int(wanted.sum())

        def best() -> np.ndarray:
            seen = np.where(np.repeat(done, self.block, axis=1), scores, -1.0)
            if but is not None:
                seen[np.arange(len(texts)), but] = -1.0
            return seen

        lead = np.argsort(-bound, axis=1, kind="stable")[:, : max(2, -(-2 * k // self.block))]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, lead, True, axis=1)
        open_(first)
        k = min(k, len(self.ids))
        seen = best()
        kth = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
        open_((bound >= np.maximum(kth, 0)[:, None] - 1e-9) & ~done)
        out = []
        for row in best():
            least = np.partition(row, len(row) - k)[len(row) - k]
            found = np.flatnonzero((row >= least) & (row > 0))
            found = found[np.lexsort((found, -row[found]))[:k]]
            out.append((found, row[found]))
        return out

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic examples, weighed by inverse distance, with the prior as one weak vote."""
        w = 1 / (1.02 - np.minimum(cosines, 1.0))
        return float((w @ self.toxic[rows] + self.prior) / (w.sum() + 1))

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, *self.knots)) if self.knots is not None else raw


def isotonic(x: np.ndarray, y: np.ndarray, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Rising calibration points: means of equally full bins, pooled where they fall (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for part in np.array_split(order, min(bins, len(order))):
        pools.append([float(x[part].sum()), float(y[part].sum()), len(part)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    points = np.array([[sx / n, (sy + 0.02) / (n + 0.04)] for sx, sy, n in pools])
    return points[:, 0], points[:, 1]


def term_factors(idf: np.ndarray, n: np.ndarray, toxic: np.ndarray, share: float, floor: float, chance: float) -> np.ndarray:
    """idf, times how far a word's toxic share stands above the base: every word counts, the telling ones more.

    n, toxic: examples, and toxic ones, that hold the word. The excess is the log-likelihood ratio beyond `chance`.
    """
    s = toxic / n
    other = np.where(s < 1, (1 - s) * np.log(np.where(s < 1, 1 - s, 1) / (1 - share)), 0.0)
    apart = np.where(s > share, n * (s * np.log(np.where(s > 0, s, 1) / share) + other), 0.0)
    return idf * (floor + np.sqrt(np.maximum(apart - chance, 0)))


def document_counts(docs: DataFrame, text: str, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those that hold each of the terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(-(-len(terms) // PIECE) * PIECE, np.int64), 0
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = [bytes(x) for x in pdf.text.iloc[lo : lo + 512]]
                n += len(part)
                held = [w for w, _ in word_counts(part)]
                df += np.bincount(places(shared.value, np.concatenate(held))[0], minlength=len(df))
        yield pd.DataFrame({"piece": range(-1, len(df) // PIECE), "n": [n] + [0] * (len(df) // PIECE), "df": [b""] + [x.tobytes() for x in df.reshape(-1, PIECE)]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.int64) for b in pdf.df)
        return pd.DataFrame({"piece": pdf.piece.iloc[:1], "n": [pdf.n.sum()], "df": [total.tobytes()]})

    rows = docs.select(text_of(text).cast("binary").alias("text")).mapInPandas(count, "piece int, n long, df binary")
    got = sorted(rows.groupBy("piece").applyInPandas(added, "piece int, n long, df binary").collect())  # 8 bytes a term of the examples
    return (got[0].n if got else 0), np.concatenate([np.frombuffer(r.df, np.int64) for r in got] or [np.zeros(0, np.int64)])[: len(terms)]


def fit_index(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    examples: int = 8192,
    k: int = 24,
    floor: float = 0.02,
    chance: float = 4.0,
) -> BlockMaxIndex:
    """Index over every word of labelled documents: at most `examples` rows are drawn, by hash of their keys.

    A quarter of these rows calibrates the votes and takes no part in them. Document frequencies count all documents.
    Rows with a null key or a label other than 0 and 1 teach nothing; of rows with one key the smallest text counts, and
    its largest label. Without both labels there is no index, and every score is the share of toxic rows (0 of none).
    """
    held = labels.where(learn & F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    order = F.xxhash64(F.lit(3), key)
    share = min(1.0, 1.1 * examples / max(held.count(), 1))
    held = held.where(order <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))).orderBy(order, key).limit(examples)
    held = held.select(F.col(key).alias("key"), "y", order.alias("place"))
    chosen = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text")).join(F.broadcast(held), "key")  # `examples` rows
    chosen = keep(chosen.groupBy("key").agg(F.min("text").alias("text"), F.max("y").alias("y"), F.max("place").alias("place")), "examples")
    form = f"key {docs.schema[key].dataType.simpleString()}, y long, place long, words binary, counts binary"

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [r for lo in range(0, len(pdf), 512) for r in word_counts([bytes(x) for x in pdf.text.iloc[lo : lo + 512]])]
            yield pd.DataFrame({"key": pdf.key, "y": pdf.y, "place": pdf.place, "words": [w.tobytes() for w, _ in found], "counts": [n.astype(np.int32).tobytes() for _, n in found]})

    got = chosen.mapInPandas(vectors, form).toPandas()
    got = got.iloc[np.lexsort((got.key.astype(str), got.place))].reset_index(drop=True)
    y = got.y.to_numpy(float)
    nothing = BlockMaxIndex(np.zeros(0, np.uint64), np.zeros(0), [], np.zeros(0), prior=float(y.mean()) if len(y) else 0.0)
    late = np.arange(len(got)) % 4 == 3 if len(got) >= 80 else np.zeros(len(got), bool)
    if not len(got) or not 0 < y[~late].mean() < 1:
        return nothing
    words = [(np.frombuffer(w, np.uint64), np.frombuffer(n, np.int32)) for w, n in zip(got.words, got.counts, strict=True)]
    voters = np.flatnonzero(~late)
    which = np.repeat(voters, [len(words[i][0]) for i in voters])
    terms, term = np.unique(np.concatenate([words[i][0] for i in voters]), return_inverse=True)
    if not len(terms):
        return nothing
    n, df = document_counts(docs, text, terms)
    factor = term_factors(np.log((n + 1) / (df + 1)) + 1, np.bincount(term), np.bincount(term, y[which]), float(y[voters].mean()), floor, chance)
    lead = np.array([factor_lead(words[i][0], terms, factor) for i in voters])
    voters = voters[np.lexsort((voters, lead, -y[voters]))]  # examples that share their heaviest word lie in one block
    index = BlockMaxIndex(terms, factor, [got.key.iloc[i] for i in voters], y[voters], prior=float(y[voters].mean()))
    index.build([index.known(*words[i]) for i in voters])
    # votes outside the index; where rows are too few for that, each example without itself
    asked, but = (np.flatnonzero(late), None) if late.any() else (voters, np.arange(len(voters)))
    known = [index.known(*words[i]) for i in asked]
    some = np.array([i for i, (t, _) in enumerate(known) if len(t)], np.int64)
    raw = [index.vote(*r) for lo in range(0, len(some), 256) for r in index.nearest([known[i] for i in some[lo : lo + 256]], k, None if but is None else but[some[lo : lo + 256]])]
    if len(raw) >= 20:
        index.knots = isotonic(np.array(raw), y[asked[some]])
    return index


def factor_lead(words: np.ndarray, terms: np.ndarray, factor: np.ndarray) -> int:
    """Number of a text's heaviest term; -1 of none."""
    spot, _ = places(terms, words)
    return int(spot[np.argmax(factor[spot])]) if len(spot) else -1


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, *, key: str = "doc_id", text: str = "text", k: int = 24, evidence: int = 3) -> DataFrame:
    """Adds tox_score (0 to 1) and tox_evidence, the nearest examples with their cosines and labels, to every row.

    All words of the whole text count that any example holds. Texts without such a word (null and empty ones, too) get
    the share of toxic examples and no evidence. Repeated rows are scored alike; ties go to the example that comes first.
    Columns of those two names are replaced; other columns, whatever their names, stay. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[key].dataType.simpleString()

    @F.pandas_udf(f"score double, evidence array<struct<doc_id: {kind}, cosine: double, toxic: int>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index, held = shared.value, {}
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 256):
                names, wanted = [], {}
                for w, n in word_counts([bytes(x) for x in batch.iloc[lo : lo + 256]]):
                    t, n = index.known(w, n)
                    names.append(blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest() if len(t) else b"")
                    if len(t) and names[-1] not in held:
                        wanted[names[-1]] = (t, n)
                for name, (rows, cos) in zip(wanted, index.nearest(list(wanted.values()), k) if wanted else [], strict=True):
                    near = [{"doc_id": index.ids[r], "cosine": float(c), "toxic": int(index.toxic[r])} for r, c in zip(rows[:evidence], cos[:evidence], strict=True)]
                    held[name] = (index.calibrated(index.vote(rows, cos)), near)
                out += [held[x] if x else (index.prior, []) for x in names]
                if len(held) > 20_000:
                    held.clear()
            yield pd.DataFrame(out, columns=["score", "evidence"])

    docs = docs.drop("tox_score", "tox_evidence")
    found = fresh(docs, "found")
    out = docs.withColumn(found, score(text_of(text).cast("binary")))
    return out.withColumn("tox_score", F.col(f"{found}.score")).withColumn("tox_evidence", F.col(f"{found}.evidence")).drop(found)


def held_out(key: str = "doc_id", of: int = 4, rest: int = 2) -> Column:
    return remainder(key, of) == rest
