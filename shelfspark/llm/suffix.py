"""Removal of repeated byte strings: suffixes of document shards interleaved by Burrows-Wheeler refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import is_space, keep, may_hold, mix64, powers, prefix_hash, row_key, text_of, trim, word_hashes

_LOW = np.uint64(0xFFFFFFFF)


def winnow(data: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of n-byte windows that share an anchor: first and last window start, anchor position, anchor hash.

    A window's anchor is its k-byte string of smallest hash, the last one on ties, so equal windows have equal anchors
    at equal offsets, wherever they stand.
    """
    none = np.zeros(0, np.int64)
    if len(data) < n:
        return none, none, none, np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    grams = mix64((sums[k:] - sums[:-k]) * powers(len(data) + 1)[1][: len(data) - k + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    keys = (grams & ~_LOW) | (_LOW - at)
    width = n - k + 1
    pad = -len(keys) % width
    rows = np.concatenate((keys, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF)))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(data) - n + 1
    anchor = (_LOW - (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(anchor) != 0)))
    last = np.append(first[1:], windows) - 1
    return first, last, anchor[first], mix64(grams[anchor[first]])


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo..hi], both ends included, over doubling spans."""
    out = values[lo]
    wide = np.flatnonzero(hi > lo)
    if not len(wide):
        return out
    lo, hi = lo[wide], hi[wide]
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    table, best = values, np.empty(len(wide), values.dtype)
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        now = np.flatnonzero(level == k)
        best[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << k) + 1])
    out[wide] = best
    return out


class Interleave:
    """Suffixes of several shards in one order, with the common prefix length of each and the one before it.

    Suffixes belong to pages (suffixes of different pages are never compared). At first all suffixes are empty, in the
    order in which the shards brought them. A step puts one symbol before each suffix: the symbols, read in the order
    so far, are the page's Burrows-Wheeler transform, and dealing the suffixes out by symbol, keeping the order among
    equal symbols, gives the order of the longer suffixes. Two suffixes with one symbol have in common that symbol and
    the least prefix length between their old places; nothing is compared or sorted again.
    """

    def __init__(self, pages: np.ndarray):
        self.order = np.argsort(pages, kind="stable")
        self.page = pages[self.order]
        self.common = np.zeros(len(pages), np.int64)
        self.common[1:] = np.where(self.page[1:] == self.page[:-1], 0, -1)

    def step(self, symbols: np.ndarray, width: int, stays: np.ndarray | None = None) -> None:
        """symbols: of `width` bytes (1 or 8, first byte highest), in the present order; suffixes that don't stay end here."""
        if width == 1:
            place = np.argsort(self.page * 256 + symbols, kind="stable")
        else:
            place = np.lexsort((symbols, self.page))
        if stays is not None:
            place = place[stays[place]]
        symbols, page = symbols[place], self.page[place]
        common = np.full(len(place), -1, np.int64)
        if len(place) > 1:
            same_page = page[1:] == page[:-1]
            same = same_page & (symbols[1:] == symbols[:-1])
            part = np.zeros(len(place) - 1, np.int64)
            if width == 8:
                apart = symbols[1:] ^ symbols[:-1]
                for j in range(1, 8):
                    part += apart < np.uint64(1 << (8 * (8 - j)))
            at = np.flatnonzero(same)
            part[at] = width + range_min(self.common, place[at] + 1, place[at + 1])
            common[1:] = np.where(same_page, part, -1)
        self.order, self.page, self.common = self.order[place], page, common


def repeated_windows(pages: np.ndarray, texts: list[bytes], near: np.ndarray, far: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """Which windows of each context also stand in another one: a context x (far + 1) matrix, by distance to the anchor.

    A context holds the bytes from its first window's start, `far` before the anchor, to the end of its last one, which
    starts `near` before the anchor. `many` marks contexts that stand for several equal ones.
    """
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    data = np.frombuffer(b"".join(texts) + bytes(n + 8), np.uint8)
    anchor, end = start + far, start + size
    state = Interleave(pages)
    steps = -(-n // 8)
    for t in range(steps - 1, -1, -1):
        symbols = np.zeros(len(texts), np.uint64)
        for j in range(8):
            at = anchor + 8 * t + j
            symbols = (symbols << np.uint64(8)) | np.where(at < end, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
        state.step(symbols[state.order], 8)
    out = np.zeros((len(texts), int(far.max()) + 1), bool)
    for o in range(out.shape[1]):
        if o:
            i = state.order
            state.step(data[np.maximum(anchor[i] - o, 0)].astype(np.int64), 1, far[i] >= o)
        i = state.order
        if not len(i):
            break
        interval = np.cumsum(state.common < n) - 1
        valid = near[i] <= o
        count = np.bincount(interval, valid * (1 + many[i]))
        out[i, o] = valid & (count[interval] >= 2)
    return out


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _deal(part: np.ndarray, parts: int, *columns: np.ndarray) -> list[tuple]:
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    return [(int(p), *(c[cut[p] : cut[p + 1]].tobytes() for c in columns)) for p in np.flatnonzero(np.diff(cut))]


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 400, gram: int = 100, part_bytes: int = 16 << 20) -> DataFrame:
    """(row, spans): for every row key with repeats, the maximal byte spans covered by n-byte strings that start elsewhere, too."""
    rows = docs.select(row_key(key, text).alias("row"), text_of(text).cast("binary").alias("text")).where(F.octet_length("text") >= n)
    return _repeats(rows, _parts(rows, part_bytes), n, gram)


#: Bytes that stand for a word where repeated passages are looked for.
_CODE = 4


def _plain(texts: pd.Series) -> Iterator[bytes]:
    return map(bytes, texts)


def _coded(texts: pd.Series) -> Iterator[bytes]:
    """Each text's words as codes."""
    for lo in range(0, len(texts), 256):
        found, at = word_hashes([bytes(t) for t in texts.iloc[lo : lo + 256]], lower=False)
        data = (found >> np.uint64(32)).astype("<u4").tobytes()
        yield from (data[_CODE * a : _CODE * b] for a, b in zip(at, at[1:], strict=False))


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 51, part_bytes: int = 16 << 20) -> DataFrame:
    """(row, passages): for every row key with repeats, the maximal runs of words (numbers, the end excluded) covered by passages of that many words that start elsewhere, too.

    A word is a maximal run without white space; white space itself is not compared. Words become codes of four bytes,
    in which repeated strings of so many codes are found; the ends of a found span that split a code are chance.
    """

    rows = docs.select(row_key(key, text).alias("row"), text_of(text).cast("binary").alias("text")).where(F.octet_length("text") >= 2 * words - 1)
    found = _repeats(rows, _parts(rows, part_bytes), _CODE * words, _CODE * max(1, words // 4), _coded)
    inward = lambda s: F.struct(F.ceil(s.lo / _CODE).alias("lo"), F.floor(s.hi / _CODE).alias("hi"))
    passages = F.filter(F.transform("spans", inward), lambda s: s.hi - s.lo >= words)
    return found.select("row", passages.alias("passages")).where(F.size("passages") > 0)


def _parts(rows: DataFrame, part_bytes: int) -> int:
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes)))


def _repeats(rows: DataFrame, parts: int, n: int, gram: int, seen: Callable[[pd.Series], Iterator[bytes]] = _plain) -> DataFrame:
    """(row, spans) of rows (row, text): see `repeated_spans`. `seen` makes of texts the bytes that are compared.

    Each window of n bytes has an anchor that depends on its bytes only (winnow). Anchors are counted over the corpus;
    documents with repeated anchors give those anchors' contexts, dealt to parts by anchor. A part interleaves the
    contexts of all shards (map tasks) page by page, where a page is an anchor: it refines the order of all suffixes
    from `n` bytes after the anchor to the first window's start, byte by byte, and reads repeated intervals off the
    common prefixes. Equal contexts of one shard travel once. Texts without repeated anchors don't travel, but for what
    the fixed size of the key filter lets through.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, owners, size = [], [], 0
        for pdf in batches:
            for t, row in zip(seen(pdf.text), pdf.row, strict=True):
                found, count = np.unique(winnow(np.frombuffer(t, np.uint8), n, gram)[3], return_counts=True)
                keys.append((found & ~np.uint64(1)) | (count > 1).astype(np.uint64))  # the last bit: more than once here
                owners.append(np.full(len(found), row, np.int64))
                size += len(found)
            if size >= 1 << 18:
                yield dealt(keys, owners)
                keys, owners, size = [], [], 0
        if keys:
            yield dealt(keys, owners)
        trim()

    def dealt(keys: list, owners: list) -> pd.DataFrame:
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        part = (mix64(keys >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        return pd.DataFrame(_deal(part, parts, keys, owners), columns=["part", "keys", "rows"])

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["keys"]])
        owners = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["rows"]])
        _, at = np.unique(keys >> np.uint64(1), return_inverse=True)
        often = np.bincount(at, 1 + (keys & np.uint64(1)))[at] >= 2
        return pd.DataFrame({"row": owners[often], "key": (keys[often] >> np.uint64(1)).view(np.int64)})

    marked = rows.mapInPandas(mark, "part int, keys binary, rows binary").groupBy("part").applyInPandas(repeated, "row long, key long")
    marked = keep(marked.groupBy("row").agg(F.collect_set("key").alias("marks")), "marks")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list[tuple]] = {}
        size = 0
        for pdf in batches:
            for t, row, marks in zip(seen(pdf.text), pdf.row, pdf.marks, strict=True):
                data = np.frombuffer(t, np.uint8)
                first, last, anchor, keys = winnow(data, n, gram)
                keys = (keys >> np.uint64(1)).view(np.int64)
                for r in np.flatnonzero(np.isin(keys, np.asarray(marks))).tolist():
                    a, b = int(first[r]), int(last[r])
                    c = t[a : b + n]
                    size += 64 + (len(c) if c not in held else 0)
                    held.setdefault(c, []).append((int(keys[r]), row, a, b, int(anchor[r])))
                if size >= 16 << 20:
                    yield sent(held)
                    held, size = {}, 0
        if held:
            yield sent(held)
        held = {}
        trim()

    def sent(held: dict) -> pd.DataFrame:
        out = []
        for c, found in held.items():
            k, row, a, b, at = found[0]
            out.append((int(mix64(np.array([k]).view(np.uint64))[0] % np.uint64(parts)), k, row, a, at - b, at - a, len(found) > 1, c))
            if len(found) > 1:  # every window of these stands in at least two places
                out += [(int(mix64(np.array([row]).view(np.uint64))[0] % np.uint64(parts)), 0, row, a, 0, b + n, True, None) for _, row, a, b, _ in found]
        return pd.DataFrame(out, columns=["part", "anchor", "row", "at", "near", "far", "many", "bytes"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        trim()
        own = pdf[pdf["bytes"].isna()]
        rows_out, lo_out, hi_out = [own.row.to_numpy(np.int64)], [own["at"].to_numpy(np.int64)], [own.far.to_numpy(np.int64)]
        pdf = pdf[pdf["bytes"].notna()]
        pdf = pdf[pdf.many | pdf.anchor.duplicated(keep=False)]
        if len(pdf):
            pages = np.unique(pdf.anchor.to_numpy(np.int64), return_inverse=True)[1]
            far = pdf.far.to_numpy(np.int64)
            found = repeated_windows(pages, [bytes(b) for b in pdf["bytes"]], pdf.near.to_numpy(np.int64), far, pdf.many.to_numpy(bool).astype(np.int64), n)
            edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            (i, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            start = pdf["at"].to_numpy(np.int64) + far  # the anchor's place
            rows_out.append(pdf.row.to_numpy(np.int64)[i])
            lo_out.append(start[i] - (b - 1))
            hi_out.append(start[i] - a + n)
        rows_, lo, hi = (np.concatenate(x).astype(np.int64) for x in (rows_out, lo_out, hi_out))
        part = (mix64(rows_.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        del pdf, own
        trim()
        return pd.DataFrame(_deal(part, parts, rows_, lo, hi), columns=["part", "rows", "lo", "hi"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        trim()
        rows_, lo, hi = (np.concatenate([np.frombuffer(b, np.int64) for b in pdf[c]]) for c in ("rows", "lo", "hi"))
        order = np.argsort(rows_, kind="stable")
        rows_, lo, hi = rows_[order], lo[order], hi[order]
        names, cut = np.unique(rows_, return_index=True)
        ends = np.append(cut[1:], len(rows_))
        spans = [[{"lo": x, "hi": y} for x, y in _merged(lo[a:b], hi[a:b])] for a, b in zip(cut, ends, strict=True)]
        return pd.DataFrame({"row": names, "spans": spans})

    shipped = may_hold(rows, "row", marked.select("row"), "_held").where("_held").drop("_held").join(marked, "row").mapInPandas(contexts, "part int, anchor long, row long, at long, near long, far long, many boolean, bytes binary")
    found = shipped.groupBy("part").applyInPandas(meet, "part int, rows binary, lo binary, hi binary")
    return found.groupBy("part").applyInPandas(merge, "row long, spans array<struct<lo: long, hi: long>>")


def passage_bytes(text: bytes, passages: list) -> list[tuple[int, int]]:
    """Byte spans of runs of words; white space before the first word and after the last one goes with these."""
    edge = np.diff(np.concatenate(([1], is_space(np.frombuffer(text, np.uint8)).view(np.int8), [1])))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return [(0 if p["lo"] == 0 else int(begin[p["lo"]]), len(text) if p["hi"] == len(end) else int(end[p["hi"] - 1])) for p in passages]


_SPANS = "array<struct<lo: long, hi: long>>"


def _joined(text: pd.Series, spans: pd.Series, passages: pd.Series) -> pd.Series:
    """Union of byte spans and passages; null where the text is null."""

    def union(t: bytes, found: list, runs: list) -> list[dict]:
        both = np.array([(s["lo"], s["hi"]) for s in found] + passage_bytes(bytes(t), runs), np.int64)
        return [{"lo": a, "hi": b} for a, b in _merged(both[:, 0], both[:, 1])]

    trim()
    return pd.Series([None if t is None else union(t, f, r) for t, f, r in zip(text, spans, passages, strict=True)])


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 400, gram: int = 100, words: int | None = None, cut: bool = True) -> DataFrame:
    """Adds kept (the bytes that stay, in order) and spans (the maximal removed runs, by byte) to every row.

    A byte goes when an n-byte string that covers it also starts at any other place of any document, its own included.
    With `words`, passages of that many words and more that also start at another place, whatever their bytes, are found,
    too: their bytes go as well, or, without `cut`, they only stand in a column `passages` (runs of words, by number).
    Texts are UTF-8 bytes, strings never cross documents, and all are judged on the input. Null text is empty; texts
    under n bytes (and under `words` words) stay whole. Rows that repeat are documents of their own, so such texts of n
    bytes and more go whole. A very long text takes a few dozen times its bytes in its task. An empty table gives an
    empty result. Columns of the new names are replaced; other columns, whatever their names, stay.
    """
    found = repeated_spans(docs, key=key, text=text, n=n, gram=gram)
    none = F.array().cast(_SPANS)
    if words:
        found = found.join(repeated_passages(docs, key=key, text=text, words=words), "row", "full")
        found = found.select("row", F.coalesce("spans", none).alias("spans"), F.coalesce("passages", none).alias("passages"))
    else:
        found = found.withColumn("passages", none)
    found = keep(found, "repeats")
    new = ["kept", "spans", "passages"] if words and not cut else ["kept", "spans"]
    own = [c for c in docs.columns if c not in new]
    data = text_of(text).cast("binary")
    # the caller's columns travel in one struct, so none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), row_key(key, text).alias("row"), data.alias("data"))
    rows = may_hold(rows, "row", found.select("row"), "_held")
    rest = rows.where("not _held").select("own", "data", none.alias("spans"), none.alias("passages"))
    met = rows.where("_held").join(found, "row", "left").select("own", "data", F.coalesce("spans", none).alias("spans"), F.coalesce("passages", none).alias("passages"))
    if words and cut:
        joined = F.pandas_udf(_joined, _SPANS)(F.when(F.size("passages") > 0, F.col("data")), F.col("spans"), F.col("passages"))  # only these texts go to Python
        met = met.withColumn("spans", F.coalesce(joined, "spans"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s.hi))
    ends = F.concat(F.transform("spans", lambda s: s.lo), F.array(F.octet_length("data").cast("long")))
    gaps = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    piece = lambda g: F.substring("data", (g.a + 1).cast("int"), (g.b - g.a).cast("int"))
    kept = F.aggregate(gaps, F.lit(b""), lambda held, g: F.concat(held, piece(g)))
    met = met.withColumn("kept", F.when(F.size("spans") == 0, F.col("data")).otherwise(kept))
    out = met.unionByName(rest.withColumn("kept", F.col("data")))
    return out.select(*[F.col("own").getField(c).alias(c) for c in own], *new)
