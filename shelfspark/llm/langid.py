"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import fresh, mix64, text_of, trim

BUCKETS = 1 << 13
#: Bytes of text whose subwords are hashed at once; longer texts go piece by piece.
PIECE = 1 << 20
#: Lengths in bytes of the subwords.
GRAMS = (2, 3, 4)


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Hash buckets of all n-byte subwords, by start."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    code = np.zeros(len(data) - n + 1, np.uint32)
    for j in range(n):
        code = (code << np.uint32(8)) | data[j : len(data) - n + 1 + j]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
    return ((code ^ (code >> np.uint32(16))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def histogram(text: bytes) -> np.ndarray:
    """Counts of subword buckets of a whole text, with a space before and after it."""
    out = np.zeros(BUCKETS, np.int64)
    lowered = b" " + text.lower() + b" "
    for at in range(0, len(lowered), PIECE):
        for n in GRAMS:
            data = np.frombuffer(lowered[at : at + PIECE + n - 1], np.uint8)
            out += np.bincount(buckets(data, n), minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    """Embeddings, softmax weights, the temperature that calibrates scores and the score below which texts are rejected."""

    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def table(self) -> np.ndarray:
        return self.embeddings @ self.weights

    def scores(self, means: np.ndarray) -> np.ndarray:
        z = (means @ self.table() + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], *, dim: int = 16, epochs: int = 12, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """SGD over shuffled mini-batches; every tenth row is held back to set the temperature and the rejection score."""
    rng = np.random.default_rng(seed)
    model = LanguageModel(languages, rng.normal(0, 0.3, (BUCKETS, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    back = np.arange(len(y)) % 10 == 9
    train = np.flatnonzero(~back)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(train)
        for at in range(0, len(train), 32):
            rows = train[at : at + 32]
            hidden = x[rows] @ model.embeddings
            z = hidden @ model.weights + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            up = x[rows].T @ (p @ model.weights.T)
            model.weights -= step * (hidden.T @ p)
            model.bias -= step * p.sum(0)
            model.embeddings -= step * 20 * up
    held = np.flatnonzero(back) if back.any() else np.arange(len(y))
    if len(held):
        def loss(t: float) -> float:
            model.temperature = t
            return -float(np.log(np.maximum(model.scores(x[held])[np.arange(len(held)), y[held]], 1e-12)).mean())

        model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        right = model.scores(x[held])[np.arange(len(held)), y[held]]
        # a clean text scores far above an even guess; half the lowest held-back score of a true language, at most an even guess and a tenth
        model.reject_below = float(min(np.quantile(right, 0.002) / 2, 1.1 / max(len(languages), 1)))
    return model


def train_language_model(docs: DataFrame, learn: Column, *, text: str = "text", lang: str = "lang", per_language: int = 500) -> LanguageModel:
    """Fits the model on at most `per_language` documents of each language.

    The sample is drawn by hash of the text among rows where `learn` holds, lang is not null and the text has a letter,
    equal texts once. One task fits the model on the subword counts of the sampled texts, at most BUCKETS for each; the
    driver gets a row a language, and the model.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & has_letter(text)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = known.withColumn("order", F.xxhash64(F.lit(31), "text"))
    totals = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r.lang for r in totals)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    # rows whose hash lies under a bound that leaves about twice the wanted number, then the first of those
    pick = F.lit(False)
    for r in totals:
        share = min(1.0, 2.0 * per_language / r.n)
        pick = pick | ((F.col("lang") == r.lang) & (F.col("order") <= F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))))
    chosen = known.where(pick)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counted = [histogram(t.encode()) for t in pdf.text]
            kinds = [np.flatnonzero(c).astype(np.uint16) for c in counted]
            yield pd.DataFrame({"lang": pdf.lang, "order": pdf.order, "kinds": [k.tobytes() for k in kinds], "n": [c[k].astype(np.float32).tobytes() for c, k in zip(counted, kinds, strict=True)]})

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"lang": [], "order": [], "kinds": [], "n": []})])
        rows = rows.sort_values(["order", "lang"]).groupby("lang").head(per_language)
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (kinds, n) in enumerate(zip(rows.kinds, rows.n, strict=True)):
            n = np.frombuffer(n, np.float32)
            x[i, np.frombuffer(kinds, np.uint16)] = n / max(n.sum(), 1)
        model = fit(x, rows.lang.map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64), languages)
        yield pd.DataFrame({"e": [model.embeddings.tobytes()], "w": [model.weights.tobytes()], "b": [model.bias.tobytes()], "t": [model.temperature], "r": [model.reject_below]})
        trim()

    counted = chosen.dropDuplicates(["lang", "order"]).mapInPandas(count, "lang string, order long, kinds binary, n binary")
    got = counted.repartition(1).mapInPandas(learned, "e binary, w binary, b binary, t double, r double").first()  # `per_language` rows a language
    e, w, b = (np.frombuffer(x, np.float32) for x in (got.e, got.w, got.b))
    return LanguageModel(languages, e.reshape(BUCKETS, -1), w.reshape(-1, len(languages)), b, got.t, got.r)


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", reject: bool = True) -> DataFrame:
    """Adds lang_pred and lang_score to every row; `und` where the text is null or has no letter, or (with `reject`) scores
    below the model's calibrated bound.

    The whole text counts. Null and letterless texts score 0. Rows, ties and repeated rows are independent of each
    other. A model without languages answers `und`. Columns of those two names are replaced; others, whatever their names, stay.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.table().astype(np.float64), model.bias, model.temperature))

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        languages, table, bias, temperature = shared.value
        for batch in texts:
            names, scores = [], []
            for t in batch:
                if not t or not languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                counts = histogram(bytes(t))
                z = (counts @ table / max(counts.sum(), 1) + bias) / temperature
                z = np.exp(z - z.max())
                names.append(languages[int(z.argmax())])
                scores.append(float(z.max() / z.sum()))
            yield pd.DataFrame({"lang": names, "score": scores})

    found = predict(F.when(has_letter(text), F.col(text).cast("binary")))
    docs = docs.drop("lang_pred", "lang_score")
    own = fresh(docs, "found")
    out = docs.withColumn(own, found)
    low = F.col(f"{own}.score") < model.reject_below if reject else F.lit(False)
    out = out.withColumn("lang_pred", F.when(low, "und").otherwise(F.col(f"{own}.lang")))
    return out.withColumn("lang_score", F.col(f"{own}.score")).drop(own)
