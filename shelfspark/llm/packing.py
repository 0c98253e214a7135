"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window of tokens."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import fill_from, text_of, trim


#: Characters that often end a word; a run of them is a piece of its own.
_TAIL = ".,;:!?"


#: Python splits at these, too, but tokenizers don't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def _words(text: str) -> list[str]:
    if any(c in text for c in _NOT_SPACE):
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return text.split()


class _Ragged:
    """Rows of token ids of different lengths, to which rows are added."""

    def __init__(self) -> None:
        self.ids, self.at, self.rows = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        end = int(self.at[self.rows])
        while len(self.at) <= self.rows + len(sizes):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        while len(self.ids) < end + len(flat):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[end : end + len(flat)] = flat
        self.at[self.rows + 1 : self.rows + 1 + len(sizes)] = end + np.cumsum(sizes)
        self.rows += len(sizes)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids one after another, and the end of each row in them."""
        start, size = self.at[rows], self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], ends


class _Numbers(dict):
    """Numbers strings by first use; `new` holds those that were met since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        n = self[text] = len(self)
        self.new.append(text)
        return n


#: Pieces of an ASCII word in lower case, as the tokenizer splits them.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class WordTokenizer:
    """Token ids of texts by way of their distinct words; for tokenizers whose tokens never span white space.

    Words of letters with closing punctuation, and ASCII words, are made of pieces that the tokenizer splits apart, too.
    Pieces are encoded many at a time and told apart by the ids that end a piece; ASCII pieces need no normalising.
    Other words are encoded one by one. Up to `most` words and twice as many pieces are remembered; when there are more,
    all of them are forgotten.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = Tokenizer(self.tokenizer.model)  # one vocabulary in memory
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most = most
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.known, self.word_ids = _Numbers(), _Ragged()
        self.pieces, self.piece_ids = _Numbers(), _Ragged()

    @staticmethod
    def _encode(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(r) for r in rows], np.int64)
        return np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum())), sizes

    def _encode_pieces(self, tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = self._encode(tokenizer, [" ".join(pieces[i : i + 256]) for i in range(0, len(pieces), 256)])
        ends = np.flatnonzero(self.closes[flat])
        if len(ends) == len(pieces):
            return flat, np.diff(np.concatenate(([-1], ends)))
        return self._encode(tokenizer, pieces)  # lower-casing made several pieces of one

    def _learn(self, words: list[str]) -> None:
        look, flat, counts = self.pieces.__getitem__, [], []
        for w in words:
            core = w.rstrip(_TAIL)
            if core.isalpha():
                flat.append(look(core.lower() if core.isascii() else core))
                if len(core) < len(w):
                    flat.append(look(w[len(core) :]))
                    counts.append(2)
                else:
                    counts.append(1)
            elif w.isascii():
                found = _PIECES.findall(w.lower())
                flat += map(look, found)
                counts.append(len(found))
            else:
                flat.append(look(w))
                counts.append(1)
        new, self.pieces.new = self.pieces.new, []
        kinds = [0 if p.isascii() else 1 if p.isalpha() else 2 for p in new]
        order, parts = np.argsort(kinds, kind="stable"), _Ragged()
        for kind in range(3):
            some = [p for p, q in zip(new, kinds, strict=True) if q == kind]
            if some:
                parts.add(*(self._encode(self.tokenizer, some) if kind == 2 else self._encode_pieces((self.plain, self.tokenizer)[kind], some)))
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(new))
        ids, ends = parts.gather(place)
        self.piece_ids.add(ids, np.diff(np.concatenate(([0], ends))))
        ids, ends = self.piece_ids.gather(np.array(flat, np.int64))
        last = np.concatenate(([0], ends))[np.cumsum(counts)]
        self.word_ids.add(ids, np.diff(np.concatenate(([0], last))))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of the texts in order, and the texts' offsets."""
        if len(self.known) > self.most:
            self.known, self.word_ids = _Numbers(), _Ragged()
        if len(self.pieces) > 2 * self.most:
            self.pieces, self.piece_ids = _Numbers(), _Ragged()
        flat, sizes, held, size = [], [], [], 0
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size < 1 << 20 and i + 1 < len(texts):
                continue
            split = [_words(x) for x in held]
            sizes += [len(w) for w in split]
            flat.append(np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int32))
            held, size, split = [], 0, None
            if self.known.new:
                new, self.known.new = self.known.new, []
                self._learn(new)
        return np.concatenate(flat or [np.zeros(0, np.int32)]).astype(np.int64), np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))

    def expand(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words in order, and the words' offsets in them."""
        ids, ends = self.word_ids.gather(words)
        return ids, np.concatenate(([0], ends))


class BM25Shard:
    """Inverted index of one shard of documents, whose words are small numbers; words of one document only, and of too many, have no list."""

    def __init__(self, words: np.ndarray, at: np.ndarray, k1: float = 1.2, b: float = 0.75, query_terms: int = 16):
        n = len(at) - 1
        which = np.repeat(np.arange(n), np.diff(at))
        pairs, tf = np.unique(words * n + which, return_counts=True)
        term, doc = np.divmod(pairs, n)
        df = np.bincount(term, minlength=1)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        length = np.diff(at)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / max(length.mean(), 1)))
        listed = (df[term] > 1) & (df[term] <= max(20, n // 10))
        term, doc, weight = term[listed], doc[listed], weight[listed]
        self.n = n
        self.docs, self.weights = doc, weight
        self.cut = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(df)))))
        # each document's terms of highest weight are its query; pairs stand in order of terms, which settles ties
        order = np.lexsort((-weight, doc))
        start = np.searchsorted(doc[order], np.arange(n + 1))
        self.queries = [term[order[a : min(b, a + query_terms)]] for a, b in zip(start, start[1:], strict=False)]

    def neighbours(self, seed: int, unused: np.ndarray, k: int = 64) -> np.ndarray:
        """Unused documents that share query terms with the seed, by falling score; ties by number."""
        terms = self.queries[seed]
        if not len(terms):
            return terms
        docs = np.concatenate([self.docs[self.cut[t] : self.cut[t + 1]] for t in terms])
        weights = np.concatenate([self.weights[self.cut[t] : self.cut[t + 1]] for t in terms])
        ok = unused[docs]
        if not ok.any():
            return docs[:0]
        found, at = np.unique(docs[ok], return_inverse=True)
        return found[np.lexsort((found, -np.bincount(at, weights[ok])))[:k]]


def fill_windows(lengths: np.ndarray, index: BM25Shard, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once.

    Whole windows of a long document stand alone. What is left of a document is a seed in turn, or a neighbour that
    fills a seed's window; a neighbour that doesn't fit is cut and its rest is the next seed. The last window of a shard
    is cut into lengths that are powers of two, which need no padding.
    """
    out, starts = [], np.zeros(len(lengths), np.int64)
    for d in np.flatnonzero(lengths >= window).tolist():
        whole = int(lengths[d]) // window
        out += [[(d, i * window, window)] for i in range(whole)]
        starts[d] = whole * window
    left = lengths - starts
    unused = left > 0
    order, at, rest, now, room = np.argsort(-left, kind="stable"), 0, -1, [], window

    def put(d: int) -> bool:
        """Puts what fits; True when the window is full."""
        nonlocal room, rest, now
        n = min(int(left[d]), room)
        now.append((d, int(starts[d]), n))
        starts[d] += n
        left[d] -= n
        unused[d] = False
        room -= n
        rest = d if left[d] else -1
        if room:
            return False
        out.append(now)
        now, room = [], window
        return True

    while True:
        seed = rest
        if seed < 0:
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                break
            seed = int(order[at])
        if not put(seed):
            for d in index.neighbours(seed, unused).tolist():
                if put(d):
                    break
    short = window - room
    sizes = [1 << i for i in range(short.bit_length() - 1, -1, -1) if short >> i & 1]
    tail, space = [], sizes.pop(0) if sizes else 0
    for d, start, n in now:
        while n:
            m = min(n, space)
            tail.append((d, start, m))
            start, n, space = start + m, n - m, space - m
            if not space:
                out.append(tail)
                tail, space = [], sizes.pop(0) if sizes else 0
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end: int = 2,
    window: int = 4096,
    shard_bytes: int = 8 << 20,
    remember: int = 300_000,
) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` tokens.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). A document's ids are the tokenizer's, without
    special tokens, then `end`. Documents of one task are packed in shards of about `shard_bytes` of text; each shard has
    its own BM25 index, and nothing is shuffled. A seed document's unused neighbours fill its window by falling score;
    when none is left the next unused document does.

    A task remembers about `remember` words and what they encode to, beside those of the shard at hand: memory for speed.

    Null text is the empty text: one token. Repeated rows are documents of their own. An empty table gives an empty
    result. Extra columns are ignored. sequence_id is unique over tasks; a task that runs again gives the same rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # few texts at a time become Python objects
                part = batch.slice(lo, 64)
                yield from zip(part.column("_key").to_pylist(), part.column("_text").to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        words_of, task, n = WordTokenizer(tokenizer, remember), TaskContext.get().partitionId(), 0
        for shard in fill_from(read(batches), shard_bytes, lambda r: len(r[1]) + 64):
            words, at = words_of.words([t for _, t in shard])
            index = BM25Shard(words, at)
            ids, word_at = words_of.expand(words)
            ids = np.insert(ids, word_at[at[1:]], end).astype("<u4")
            begin = word_at[at] + np.arange(len(at))
            lengths = np.diff(begin)
            sequences = fill_windows(lengths, index, window)
            out = []
            for s, pieces in enumerate(sequences):
                offset = 0
                for d, start, size in pieces:
                    b = int(begin[d]) + start
                    out.append((d, start, size, zlib.crc32(ids[b : b + size].tobytes()), int(lengths[d]), (task << 40) + n + s, offset))
                    offset += size
            n += len(sequences)
            found = pd.DataFrame(out, columns=["d", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            found.insert(0, "doc_id", [shard[d][0] for d in found.d])
            yield pa.RecordBatch.from_pandas(found.drop(columns="d"), form, preserve_index=False)
            del shard, words, at, index, ids, word_at, sequences, out, found
            trim()

    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = "doc_id string, " + ", ".join(f"{c} long" for c in longs)
    form = pa.schema([("doc_id", pa.string()), *((c, pa.int64()) for c in longs)])
    # keys travel as text, so that nulls and large integers stay as they are
    packed = docs.select(F.col(key).cast("string").alias("_key"), text_of(text).alias("_text")).mapInArrow(run, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
