"""Log-bilinear language model trained by noise-contrastive estimation, over corpus-wide token counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import fill_from, keep, mix64, row_key, text_of, word_hashes

#: Hash of the token that ends every text.
END = np.uint64(0x5851F42D4C957F2D)
FLUSH = 8 << 20


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words and one end, and the offsets of texts."""
    words, at = word_hashes(texts)
    out = np.insert(words, at[1:], END)
    return out, at + np.arange(len(at))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


def _deal(part: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    for p in np.flatnonzero(np.diff(cut)):
        yield int(p), [c[cut[p] : cut[p + 1]].tobytes() for c in columns]


def _groups(batches: Iterator[pd.DataFrame], names: list[str], limit: int = FLUSH) -> Iterator[pd.DataFrame]:
    rows = (r for pdf in batches for r in pdf[names].itertuples(index=False, name=None))
    for got in fill_from(rows, limit, lambda r: len(r[0]) + 64):
        yield pd.DataFrame(got, columns=names)


def token_counts(texts: DataFrame, parts: int) -> DataFrame:
    """(part, keys, n, total): packed token hashes in rising order and their counts over all texts, by part."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(batches, ["text"], 4 * FLUSH):
            keys, n = np.unique(tokens([bytes(t) for t in pdf.text])[0], return_counts=True)
            yield pd.DataFrame([(p, *b) for p, b in _deal(_part(keys, parts), parts, keys, n.astype(np.int64))], columns=["part", "keys", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["keys"]])
        n = np.concatenate([np.frombuffer(b, np.int64) for b in pdf.n])
        keys, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "keys": [keys.tobytes()], "n": [n.tobytes()], "total": [int(n.sum())], "kinds": [len(keys)]})

    counted = texts.mapInPandas(count, "part int, keys binary, n binary")
    return keep(counted.groupBy("part").applyInPandas(add, "part int, keys binary, n binary, total long, kinds long"), "counts")


@dataclass
class LogBilinear:
    """Head tokens in order of frequency (the last id is any other token), and the model's parameters."""

    head: np.ndarray
    context: np.ndarray
    first: np.ndarray
    second: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @property
    def size(self) -> int:
        return len(self.head) + 1

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in (self.context, self.first, self.second, self.output, self.bias)])

    def load(self, flat: np.ndarray) -> LogBilinear:
        parts, at = [], 0
        for p in (self.context, self.first, self.second, self.output, self.bias):
            parts.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return LogBilinear(self.head, *parts)

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Head ids of tokens; others get the last id."""
        order = np.argsort(self.head)
        at = np.minimum(np.searchsorted(self.head[order], keys), len(order) - 1)
        return np.where(self.head[order][at] == keys, order[at], len(order)).astype(np.int64)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each output after each last and last-but-one token, and the log normaliser of each pair of those.

        Matrix products over batches of contexts; the normaliser sums over all outputs, so probabilities add up to 1.
        """
        near = self.context @ self.first @ self.output.T + self.bias
        far = self.context @ self.second @ self.output.T
        norm = np.empty((self.size, self.size), np.float32)
        for i in range(self.size):
            z = near[i] + far
            top = z.max(1, keepdims=True)
            norm[i] = (np.log(np.exp(z - top).sum(1)) + top[:, 0])
        return near, far, norm


def new_model(head: np.ndarray, counts: np.ndarray, rest: int, dim: int, seed: int) -> LogBilinear:
    rng = np.random.default_rng(seed)
    v = len(head) + 1
    n = np.append(counts, max(rest, 1)).astype(float)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    eye = np.eye(dim, dtype=np.float32)
    return LogBilinear(head, draw(v, dim), eye + draw(dim, dim), eye * 0.5 + draw(dim, dim), draw(v, dim), np.log(n / n.sum()).astype(np.float32))


def nce_steps(model: LogBilinear, ids: np.ndarray, noise: np.ndarray, rng: np.random.Generator, state: list, *, batch: int = 4096, samples: int = 24, rate: float = 0.1) -> None:
    """One pass of AdaGrad steps on rows (last-but-one, last, next) of `ids`; each batch shares `samples` noise tokens."""
    if not state:
        state += [np.full_like(p, 1e-3) for p in (model.context, model.first, model.second, model.output, model.bias)]
    log_noise = np.log(noise * samples).astype(np.float32)
    v, d = model.context.shape

    def scatter(at: np.ndarray, grad: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(at, grad[:, k], v) for k in range(d)], 1).astype(np.float32)

    for lo in range(0, len(ids), batch):
        far, near, target = ids[lo : lo + batch].T
        n = len(target)
        drawn = rng.choice(v, samples, p=noise)
        cn, cf = model.context[near], model.context[far]
        q = cn @ model.first + cf @ model.second
        true = (q * model.output[target]).sum(1) + model.bias[target] - log_noise[target]
        false = q @ model.output[drawn].T + model.bias[drawn] - log_noise[drawn]
        up = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # 1 - sigmoid
        down = -1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dq = up[:, None] * model.output[target] + down @ model.output[drawn]
        out = scatter(target, up[:, None] * q)
        np.add.at(out, drawn, down.T @ q)
        bias = np.bincount(target, up, v).astype(np.float32)
        np.add.at(bias, drawn, down.sum(0))
        ctx = scatter(near, dq @ model.first.T) + scatter(far, dq @ model.second.T)
        grads = (ctx, cn.T @ dq, cf.T @ dq, out, bias)
        for p, g, s in zip((model.context, model.first, model.second, model.output, model.bias), grads, state, strict=True):
            g = g / n * 64
            s += g * g
            p += rate * g / np.sqrt(s)


def _windows(model: LogBilinear, texts: list[bytes]) -> np.ndarray:
    """Rows (last-but-one, last, next) of all tokens; texts begin after two ends."""
    keys, at = tokens(texts)
    ids = model.ids(keys)
    end = int(model.ids(np.array([END]))[0])
    last = np.concatenate(([end], ids[:-1]))
    far = np.concatenate(([end, end], ids))[: len(ids)]
    second = at[:-1] + 1
    far[second[second < len(far)]] = end
    return np.stack([far, last, ids], 1)


def train(texts: DataFrame, model: LogBilinear, noise: np.ndarray, seed: int, rate: float = 0.1, blocks: int = 16) -> LogBilinear:
    """Every task runs NCE over all of its texts from the same start; parameters are averaged, weighed by tokens.

    A task returns its parameters in `blocks` pieces, which Spark adds up by piece.
    """
    shared = texts.sparkSession.sparkContext.broadcast((model, noise))
    zero = np.zeros(model.flat().size, np.float32)
    cuts = np.linspace(0, zero.size, blocks + 1).astype(int)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, q = shared.value
        own, rng, state, n = start.load(start.flat().copy()), np.random.default_rng(seed), [], 0
        for pdf in _groups(batches, ["text"]):
            rows = _windows(own, [bytes(t) for t in pdf.text])
            nce_steps(own, rows, q, rng, state, rate=rate)
            n += len(rows)
        if n:
            flat = own.flat().astype(np.float64) * n
            yield pd.DataFrame({"block": np.arange(blocks, dtype=np.int32), "p": [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], "n": n})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float64) for b in pdf.p) / pdf.n.sum()
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "p": [total.astype(np.float32).tobytes()]})

    rows = texts.mapInPandas(work, "block int, p binary, n long").groupBy("block").applyInPandas(add, "block int, p binary").collect()
    if not rows:
        return model
    return model.load(np.concatenate([np.frombuffer(r.p, np.float32) for r in sorted(rows, key=lambda r: r.block)]))


def score_texts(
    docs: DataFrame,
    learn: Column,
    *,
    key: str = "doc_id",
    text: str = "text",
    head: int = 511,
    dim: int = 16,
    common: int = 1 << 17,
    part_bytes: int = 32 << 20,
    seed: int = 5,
    rates: tuple[float, ...] = (0.05, 0.01),
) -> DataFrame:
    """(doc_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are words (A-Z lower-cased) and one end. Counts cover all tokens of all rows where `learn` holds; base_score
    is add-one unigram log10 probability. The model predicts the `head` most frequent tokens, or "another token", from
    the two tokens before; another token is then drawn by its count plus one among all but head tokens (one unseen
    token stands for the rest), so probabilities over tokens add up to one. Training passes over all learning texts once
    for each of `rates`, every time from the average of what the tasks had learned; another split of the texts gives slightly other weights.

    Only tokens with at least 1 / `common` of all occurrences (at most `common` of them) and the parameters are
    broadcast. Counts of the other tokens meet the texts' tokens in packed parts of the token space.

    Null text is the empty text: one token, the end. Rows that repeat get the same scores. Without learning rows all
    counts are 0. An empty table gives an empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), row_key(key, text).alias("row"), text_of(text).cast("binary").alias("text"), learn.alias("learned"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes)))
    learning = rows.where("learned").select("text")
    counts = token_counts(learning, parts)
    total, kinds = (int(x or 0) for x in counts.agg(F.sum("total"), F.sum("kinds")).first())
    least = max(1, -(-total // common))

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, n in zip(pdf["keys"], pdf.n, strict=True):
                keys, n = np.frombuffer(keys, np.uint64), np.frombuffer(n, np.int64)
                yield pd.DataFrame({"key": keys[n >= least].view(np.int64), "n": n[n >= least]})

    top = counts.mapInPandas(frequent, "key long, n long").toPandas()  # at most `common` rows
    top = top.assign(u=top.key.to_numpy(np.int64).view(np.uint64)).sort_values(["n", "u"], ascending=[False, True], ignore_index=True)
    chosen = top.u.to_numpy(np.uint64)[:head]
    if END not in chosen:
        chosen = np.append(chosen[: head - 1], END)
    by_key = dict(zip(top.u, top.n, strict=True))
    head_n = np.array([by_key.get(u, 0) for u in chosen], np.int64)
    rest = total - int(head_n.sum())
    model = new_model(chosen, np.maximum(head_n, 1), rest, dim, seed)
    weights = np.append(np.maximum(head_n, 1), max(rest, 1)).astype(float)
    noise = weights / weights.sum()
    for r in range(len(rates) if total else 0):
        model = train(learning, model, noise, seed + r, rates[r])
    tail = rest + (kinds - int((head_n > 0).sum())) + 1
    order = np.argsort(top.u.to_numpy(np.uint64))
    shared = spark.sparkContext.broadcast((top.u.to_numpy(np.uint64)[order], top.n.to_numpy(np.int64)[order], model, model.tables()))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, known_n, model, (near, far, norm) = shared.value
        log_known = np.log10(known_n + 1.0)
        for pdf in _groups(batches, ["text", "row"]):
            texts = [bytes(t) for t in pdf.text]
            keys, at = tokens(texts)
            rows_of = pdf.row.to_numpy(np.int64)
            which = np.repeat(np.arange(len(texts)), np.diff(at))
            f, l, w = _windows(model, texts).T
            other = w == model.size - 1
            lbl = (near[l, w] + far[f, w] - norm[l, f]).astype(float) / np.log(10)
            if len(known):
                spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[spot] == keys
                gain = np.where(hit, log_known[spot], 0.0)
            else:
                hit, gain = np.zeros(len(keys), bool), np.zeros(len(keys))
            n = len(texts)
            base = np.bincount(which, gain, n)
            scores = np.bincount(which, lbl + np.where(other, gain, 0.0), n)
            sums = np.stack([np.ones(n), np.diff(at), np.bincount(which, hit, n), base, scores, np.bincount(which, other, n)], 1)
            mine = _part(mix64(rows_of.view(np.uint64)), parts)
            out = [(parts + p, *b) for p, b in _deal(mine, parts, rows_of, sums)]
            rare = ~hit
            out += [(p, *b) for p, b in _deal(_part(keys[rare], parts), parts, rows_of[which[rare]], keys[rare])]
            yield pd.DataFrame(out, columns=["part", "rows", "data"])

    def meet(found: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        if not len(found):
            return pd.DataFrame({"part": [], "rows": [], "data": []})
        p = int(found.part.iloc[0])
        if p >= parts:
            return found.assign(part=found.part - parts)[["part", "rows", "data"]]
        keys = np.frombuffer(counted["keys"].iloc[0], np.uint64) if len(counted) else np.zeros(0, np.uint64)
        n = np.frombuffer(counted.n.iloc[0], np.int64) if len(counted) else np.zeros(0, np.int64)
        rows_of = np.concatenate([np.frombuffer(b, np.int64) for b in found["rows"]])
        asked = np.concatenate([np.frombuffer(b, np.uint64) for b in found.data])
        if len(keys):
            at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            c = np.where(keys[at] == asked, n[at], 0)
        else:
            c = np.zeros(len(asked), np.int64)
        rows_of, which = np.unique(rows_of, return_inverse=True)
        gain = np.bincount(which, np.log10(c + 1.0))
        sums = np.zeros((len(rows_of), 6))
        sums[:, 2], sums[:, 3], sums[:, 4] = np.bincount(which, c > 0), gain, gain
        mine = _part(mix64(rows_of.view(np.uint64)), parts)
        return pd.DataFrame([(q, *b) for q, b in _deal(mine, parts, rows_of, sums)], columns=["part", "rows", "data"])

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        rows_of = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["rows"]])
        sums = np.concatenate([np.frombuffer(b, np.float64).reshape(-1, 6) for b in pdf.data])
        rows_of, which = np.unique(rows_of, return_inverse=True)
        copies, n, hits, base, scores, other = (np.bincount(which, sums[:, k]) for k in range(6))
        n, hits, base, scores, other = (x / copies for x in (n, hits, base, scores, other))  # rows that repeat came together
        return pd.DataFrame({"row": rows_of, "n_tokens": np.rint(n).astype(np.int64), "n_known": np.rint(hits).astype(np.int64), "base_score": base - n * np.log10(total + kinds + 1.0), "score": scores - other * np.log10(tail)})

    packed = "part int, rows binary, data binary"
    looked = rows.select("text", "row").mapInPandas(look, packed)
    met = looked.groupBy("part").cogroup(counts.select("part", "keys", "n").groupBy("part")).applyInPandas(meet, packed)
    scored = met.groupBy("part").applyInPandas(close, "row long, n_tokens long, n_known long, base_score double, score double")
    out = rows.select("doc_id", "learned", "row").join(scored, "row").withColumn("train_tokens", F.lit(total).cast("long"))
    return out.select("doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score")
